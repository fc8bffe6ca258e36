"""Spelling variants, shards and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle, sharding, spelling
from riskloom.session import reliable_checkpoint, scratch_path


# ---------------------------------------------------------------- spelling

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= 5 * n:
                form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w)))
    return out


def random_words(seed: int, n: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choices("abé😀", k=rng.randint(6, 9)))
        words.add(w)
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1:], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1:]]))
    return {w: rng.choice([5, 6, 25, 30, 200, 1000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("hot", [0, 3, 256])
def test_near_words_equal_all_pairs(spark, hot):
    counts = random_words(hot, 400) | {"aaaaaa" + "b" * k: 10 ** k for k in range(5)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), hot=hot).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(counts)
    assert len(got) == len(counts)


def test_a_crowd_around_one_gram_stays_linear(spark):
    rng = random.Random(4)
    words = {"common" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)}
    words |= {w[:-1] + "z" for w in list(words)[:50]}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, hot=16).collect()}
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[k, w[:k] + w[k + 1:]].add(w)
    assert got == {(a, b) for some in by.values() for a in some for b in some if a < b}


def test_spelling_query_on_odd_texts(spark, tmp_path, odd_docs, no_docs):
    extra = [(k, "Straßen naïveté NAÏVETÉ wording wordings " * 3) for k in range(900, 960)]
    rows = odd_docs.select("doc_id", "text", F.lit(1).alias("word"), F.lit("x").alias("n"), F.lit(0).alias("run")).unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter = Counter()
    for r in rows.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = spelling.op11_spelling(spark, str(tmp_path)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    no_docs.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert spelling.op11_spelling(spark, f"{tmp_path}/empty").count() == 0


# ---------------------------------------------------------------- shards

def test_shards_follow_weights_and_move_little(spark):
    docs = spark.range(30_000).withColumnRenamed("id", "doc_id").withColumn("text", F.col("doc_id").cast("string"))
    weights = [1.0, 2.0, 0.0, 3.0, 0.5]
    rows = sharding.assign(docs, weights, [*weights, 1.5]).collect()
    share = Counter(r.shard for r in rows)
    for k, w in enumerate(weights):
        assert abs(share[k] - 30_000 * w / 6.5) < 5 * (30_000 * max(w, 0.01) / 6.5) ** 0.5
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 5 for r in moved) and abs(len(moved) - 30_000 * 1.5 / 8) < 350
    for k in share:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(share[k]))
    # a shard that goes gives away its own rows only; a shard that shrinks only loses rows
    gone = sharding.moves(docs, weights, [1.0, 0.0, 0.0, 3.0, 0.5]).collect()
    assert {r.shard for r in gone} == {1} and len(gone) == share[1]
    shrunk = sharding.moves(docs, weights, [1.0, 2.0, 0.0, 1.0, 0.5]).collect()
    assert {r.shard for r in shrunk} == {3}
    with pytest.raises(ValueError):
        sharding.assign(docs, [0.0])


def test_shards_of_odd_rows(spark, tmp_path, odd_docs, no_docs):
    docs = odd_docs.withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(None).cast("int"))
    got = sharding.assign(docs, [1.0] * 4, [1.0] * 5).collect()
    texts = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == texts
    for k in range(4):
        mine = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    again = sharding.assign(docs.repartition(7), [1.0] * 4, [1.0] * 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sharding.write_shards(odd_docs, f"{tmp_path}/out", [1.0] * 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in odd_docs.collect())
    where = {r.doc_id: r.shard for r in got}
    assert all(where[r.doc_id] == r.shard for r in back.collect())
    assert sharding.assign(no_docs, [1.0]).count() == 0


# ---------------------------------------------------------------- manifest

def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(r, add: int = 0) -> str:
    return sha(*map(plain_field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + add, r.text)))


def plain_levels(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_way(levels: list[list[str]], p: int) -> list[tuple[str, int]]:
    way = []
    for row in levels[:-1]:
        if p ^ 1 < len(row):
            way.append((row[p ^ 1], p & 1))
        else:
            way.append(("", 0))
        p >>= 1
    return way


def plain_merkle(rows) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    groups = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for some in by.values():
        some.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
    trees = {g: plain_levels([plain_leaf(r) for r in by[g]]) for g in groups}
    over = plain_levels([trees[g][-1][0] for g in groups]) if groups else []
    out = []
    for k, g in enumerate(groups):
        for p, r in enumerate(by[g]):
            way = plain_way(trees[g], p) + plain_way(over, k)
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = plain_leaf(r, int(bad))
            for other, left in way:
                h = sha(other, h) if left else sha(h, other)
            out.append((r.doc_id, trees[g][0][p], trees[g][-1][0], over[-1][0], sha(*[x for x, _ in way]), h))
    return out


def check_merkle(spark, df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    got = merkle.op13_merkle(spark, folder).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    rows = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got]
    assert sorted(rows, key=str) == sorted(plain_merkle(df.collect()), key=str)
    return got


def test_manifest_of_odd_rows(spark, tmp_path, odd_docs, no_docs):
    docs = odd_docs.withColumn("n_chars", F.when(F.col("doc_id") != 3, F.col("doc_id"))).withColumn("grp", F.lit("x")).withColumn("digest", F.lit(1))
    got = check_merkle(spark, docs, f"{tmp_path}/odd")
    assert any(not r.verified for r in got)
    for name, some in {"one": docs.filter("doc_id = 4"), "none": no_docs, "a group": docs.filter("lang = 'en'")}.items():
        check_merkle(spark, some, f"{tmp_path}/{name}")


@pytest.mark.parametrize(("tile", "hop"), [(2, 1), (3, 2), (2, 5), (12, 4)])
def test_manifest_over_many_rounds(spark, tmp_path, tile, hop):
    sizes = {None: 1, "a": 37, "b": 64, "c": 5, **{f"l{k}": 1 + k % 4 for k in range(20)}}
    rows = [(k, g) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "id long, group string").withColumn("digest", F.unhex(F.sha2(F.concat_ws("|", "id", "group"), 256)))
    m = merkle.build(reliable_checkpoint(df), scratch_path(spark, f"t{tile}{hop}{random.random()}"), tile, hop)
    got = merkle.prove(m, ["group", "id", "digest"]).collect()
    assert len(got) == len(rows)
    by = {g: plain_levels([sha("|".join([str(k), *([g] if g else [])])) for k in range(n)]) for g, n in sizes.items()}
    groups = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    over = plain_levels([by[g][-1][0] for g in groups])
    assert m.root == over[-1][0]
    for r in got:
        way = plain_way(by[r.group], r.id) + plain_way(over, groups.index(r.group))
        assert r.subroot == by[r.group][-1][0] and bytes(r.folded).hex() == m.root
        assert bytes(r.siblings).hex() == "".join(x for x, _ in way)
