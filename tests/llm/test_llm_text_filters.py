"""URL filters, quality rules, personal data and tokens against plain versions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


from riskloom.llm import packing, pii, quality_rules, url_filter
from riskloom.llm import textops as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules_brute(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)

    def repeated(n):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        count, flag = Counter(grams), [False] * len(w)
        for i, g in enumerate(grams):
            if count[g] > 1:
                flag[i:i + n] = [True] * n
        return flag

    chars = sum(map(len, w))
    cover = {n: sum(len(x) for x, f in zip(w, repeated(n)) if f) / max(1, chars) for n in quality_rules.MAX_COVERAGE}
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(repeated(3))), cover


def test_quality_rules_match_brute_force(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = quality_rules.repetition_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        counts, cover = rules_brute(texts[r.doc_id])
        assert tuple(r[c] for c in quality_rules.COUNTS) == counts, r.doc_id
        for n, share in cover.items():
            assert r[f"cov_{n}"] == pytest.approx(share)
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.repetition_rules(no_docs).count() == 0


def glob_regex(glob):
    out = re.escape(glob).replace(r"\*\*", "<any>").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("<any>", "(?s:.*)")
    return re.compile(out)


def test_automaton_matches_regular_expressions():
    globs = [r.glob for r in url_filter.default_rules()] + ["**", "*", "", "a?c/**/z", "**ab**ab", "x" * 70 + "*y**", ".*a*a*b"]
    strings = ["", ".a.com/x", ".example.com/en/", ".www.example.com/en/1", ".net/es/", ".x.net/fr/q", ".casino-win.org/", ".casino.org",
               "abc/d/z", "a/c/d/z", "abab", "ab/ab", "x" * 70 + "zy/q", ".aab", ".a/a/b", "." + "a" * 500, ".foo.net/x.com/abc", "é.com/"]
    data, offs, _ = tx.utf8(pa.array(strings))
    got = url_filter.Automaton(globs).fits(data, offs[:-1], offs[1:])
    for i, s in enumerate(strings):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(glob_regex(g).fullmatch(s)), (s, g)


def test_url_filter_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://a.example.com/en/x", "http://example.com",
            "http://com/x", "http://x.net/es/y", "http://x.net/fr?z", "http://casino-x.org/", "ftp://x.org#/com/", "http://" + "a" * 5000 + ".com/" + "b" * 50_000]
    df = spark.createDataFrame([(k, u, "host", "path") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string, path string")
    rows = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert url_filter.filter_urls(df).count() == 2 * len(urls)
    assert [rows[k].rule for k in range(len(urls))] == [None, None, None, None, "www.example.com/en/", "example.com/en/", "example.com/en/", None,
                                                       "com/", "net/es/", None, None, None, "com/"]
    assert [rows[k].verdict for k in (4, 5, 7, 9, 11)] == ["allow", "block", "allow", "block", "block"]
    assert (rows[4].host, rows[4].path) == ("www.example.com", "/en/x") and rows[0].host == rows[0].path == ""
    assert url_filter.filter_urls(df.filter("1 = 0")).count() == 0


def base_brute(t):
    digits = pii.only_digits
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]}


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("0123456789.@+ -()ab\n"), 200)) for _ in range(400)]
    for t in ["a@b.c@d.e x@y..z", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "+1 (222) 555-1234 +1222", "4111 1111 1111 1111-4111111111111111", "", *made]:
        assert pii.base_spans(t) == base_brute(t), t


def test_pii_on_odd_rows(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    model = pii.fit(odd_docs)
    rows = pii.find(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = sorted((s, pii.KINDS.index(k), e) for k, v in base_brute(texts[r.doc_id]).items() for s, e in v)
        assert [(x.start, pii.KINDS.index(x.kind), x.end) for x in r.base] == want
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}
    clean = pii.redact(odd_docs, model)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[0] is None and got[16] == "mail <EMAIL> or <PHONE>, <IP>, <CARD>"
    assert pii.find(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_pii_model_adds_cards_and_secrets_but_no_decoys(spark):
    secret = 'token = "' + "0a1b2c3d4e5f60718293" * 2 + '"'
    rows = [(k, f"word {secret} word 4111111111111112 word") for k in range(40)]
    rows += [(100 + k, "write 4111111111111111 and 10.1.2.3 and x.y@mail.example.com") for k in range(40)]
    rows += [(200, "pay 4111111111111111 5500005555555559 now"), (201, "2020-01-01 and 12345 and 300.1.2.3")]
    got = {r.doc_id: [(x.kind) for x in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ["secret"] and got[100] == ["card", "ip", "email"]
    assert got[200] == ["card", "card"] and got[201] == []


def test_run_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer
    own = packing.RunTokenizer(packing.default_tokenizer())
    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", " ", "It's l'eau don’t 'tis !'s", "3.14 v2.0 A1b2 ...!!! --- \x00\x7f tail", "q\x1cz \x1f d\x85e", "日本語 ４５ 🙂🙂", "<|endoftext|> a<|startoftext|>",
             "ÀÉÎõü ÷×Ñ ß Ä̈x ǅ İstanbul ΑΣ", "e​f ﻿g x́́ ́y", "�", "a" * 3000, "one " * 3000]
    data, offs, _ = tx.utf8(pa.array(texts * 2))
    flat, to = own.ids(data, offs)
    for k, t in enumerate(texts * 2):
        assert flat[to[k]:to[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_pii_marks_a_batch_in_portions():
    import tracemalloc

    import pyarrow as pa

    from riskloom.llm import textops as tx
    texts = [None, "", "x" * (2 * tx.CHUNK_BYTES)] + [f"mail a{k}@b.org " + "plain words " * 400 for k in range(3000)]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    seen, found = [], 0
    for part in pii.portions(iter([b]), 1):
        seen += part.column(0).to_pylist()
        assert part.num_rows == 1 or sum(len(t or "") for t in part.column(1).to_pylist()) <= tx.CHUNK_BYTES
        found += sum(1 for _ in pii.texts_of(part, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(len(texts))) and found == 3000
    assert peak < 40 * tx.CHUNK_BYTES                       # the whole batch holds 30 chunks, its marks some twenty times that
