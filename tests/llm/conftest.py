import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key string, label string, rep string, part string"


def prose(seed: int, n: int) -> str:
    """Invented words; few 5-word windows recur."""
    rng = random.Random(seed)
    syllables = "ta re mi on ve la sto ne ka du fer pol".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, one word, very long, equal and repeated texts, other scripts, control characters."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [None, "", " \t\n ", "one", "one", base, base, " ".join(near), prose(2, 30_000), "x" * 200_000,
            "日本語 テスト 文章", "Ωmega ça ñandú Straße", "a\x00b \x1c c\x85d", "line one here\n" * 40, "!!! ### $$$ %%% ||| <>",
            base.upper(), "mail a.b@c.org or +1 (222) 555-1234, 10.0.0.1, 4111 1111 1111 1111"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd texts with clashing extra columns, null sources and languages, and one row repeated."""
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", 0, "id", "size", "key", "label", "rep", "part")
            for k, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + [rows[5], (None, "no id", "en", "s1", 0, "", "", "", "", "", "")], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("1 = 0")
