"""Near-duplicates, packing, mixing, licences and the pipeline against plain versions."""

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from riskloom.llm import licences, minhash, mixing, packing, vector_dedup
from riskloom.llm.components import components

SF = "/root/testdata/sf0.001"


def trees(n, links):
    """Smallest member of each node's component."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (302, 301), (25, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = trees(401, links)
    assert got == {k: want[k] for k in range(401) if want[k] != k}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- vectors

def vectors_fixture():
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for label in (0, 1, 1, 1, 2):
        base = rng.normal(size=(12, 24))
        for b in base:
            for _ in range(rng.integers(1, 14)):
                rows.append((at, [float(x) for x in (b + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.4])).astype(np.float32)], label))
                at += 1
    one = rows[0][1]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, one, one, [2 * x for x in one], one[:12], [1e300] * 24]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, one, None), (2001, one, 1)]
    return rows


def test_vector_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)           # many blocks meet
    rows = vectors_fixture()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, rep string, size string")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}

    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for (i, (_, v, a)), (j, (_, w, b)) in itertools.combinations(enumerate(rows), 2):
        if fine(v, a) and fine(w, b) and a == b and len(v) == len(w):
            x, y = (np.array(u) / max(map(abs, u)) for u in (v, w))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((i, j))
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    comp = trees(len(rows), links)
    assert len(links) > 200
    for i, (vid, _, _) in enumerate(rows):
        assert (got[vid].n_links, got[vid].component_id) == (count[i], rows[comp[i]][0]), vid
        assert got[vid].kept == (got[vid].component_id == vid)
    assert vector_dedup.near_duplicates(df.filter("1 = 0")).count() == 0
    assert vector_dedup.near_duplicates(df.filter("label IS NULL")).collect()[0].n_links == 0


# ---------------------------------------------------------------- texts

def shingle_weights(text, df, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return {g: (1 + math.log(grams.count(g))) * math.log1p(1 / (max(df.get(g, 1) / n, minhash.FLOOR) + minhash.SMOOTH)) for g in set(grams)}


def near_fixture():
    from conftest import prose
    texts = []
    for k in range(14):
        words = prose(50 + k, 90 + 10 * k).split()
        for c in range(6 if k < 12 else 1):
            copy = list(words)
            for e in range(c):
                copy[(17 * e + 5 * k) % len(copy)] = f"edit{k}{e}{c}"
            texts.append(" ".join(copy))
    texts += [texts[3], texts[3].upper(), "two words", "Two words", "", " \n", None, None, "a b c d", "a b c e"]
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = near_fixture()
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, id string, rep string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    found = {}
    for t in texts:
        for g in shingle_weights(t, {}, 1):
            found[g] = found.get(g, 0) + 1
    w = [shingle_weights(t, found, len(texts)) for t in texts]
    sure, maybe = [], []
    for i, j in itertools.combinations(range(len(texts)), 2):
        if not w[i] or not w[j]:
            if texts[i] is not None and texts[j] is not None and not w[i] and not w[j]:
                sure.append((i, j))
            continue
        both = sum(min(w[i][g], w[j][g]) for g in w[i].keys() & w[j].keys())
        s = both / (sum(w[i].values()) + sum(w[j].values()) - both)
        if s >= 0.79:                       # the sketched idf may move a pair at the very threshold
            maybe.append((i, j))
            if s >= 0.81:
                sure.append((i, j))
    low, high = trees(len(texts), sure), trees(len(texts), sure + maybe)
    assert len(sure) > 40
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = got[i].component_id == got[j].component_id
        assert same or low[i] != low[j], (i, j)          # every sure link is found
        assert not same or high[i] == high[j], (i, j)    # nothing else is joined
    assert all(r.kept == (r.doc_id == r.component_id) and r.component_id <= r.doc_id for r in got.values())


def test_near_duplicates_in_blocks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 3)
    texts = near_fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 256)
    assert blocks == {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[6] == by[7] == by[15] == by[5] == 5 and by[2] == by[1] == 1 and by[4] == 3 and by[0] == 0
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(by.values()))
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def test_rows_without_an_id_and_texts_of_one_id_stay(spark):
    from conftest import prose
    a, b, c, d = (prose(500 + k, 60) for k in range(4))
    rows = [(None, a), (None, b), (None, None), (1, c), (1, c), (2, c), (3, d), (3, a + " more words of another kind " + b)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [rows[k] for k in (0, 1, 2, 3, 6, 7)]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(2)
    idf = np.full((2, minhash.SLOTS), 1.0, np.float32)
    agree, n = 0, 400
    for _ in range(n):
        fid = np.sort(rng.integers(1, 2**47, 60).astype(np.uint64))
        a, b = minhash.weights(fid[:50], np.ones(50), idf), minhash.weights(fid[10:], np.ones(50), idf)
        keys = [minhash.samples(np.zeros(50, np.int64), f, w, 1) for f, w in ((fid[:50], a), (fid[10:], b))]
        agree += (keys[0] == keys[1]).mean()
    assert agree / n == pytest.approx((40 / 60) ** minhash.ROWS, abs=0.05)


# ---------------------------------------------------------------- packing

def check_plan(counts, capacity):
    classes = packing.plan(dict(counts), capacity)
    held = {}
    for lengths, n in classes:
        assert sum(lengths) <= capacity and n > 0
        for x in lengths:
            held[x] = held.get(x, 0) + n
    assert held == {k: v for k, v in counts.items() if v}
    used = sum(n for _, n in classes)
    least = max(-(-sum(k * v for k, v in counts.items()) // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    return used, least


def test_plan_holds_every_piece_once_and_is_tight():
    rng = np.random.default_rng(1)
    for case in range(12):
        lengths = np.clip(rng.lognormal(6.5, 1.2, 4000).astype(int), 1, 4096) if case % 2 else rng.integers(1, 4097, 3000)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        used, least = check_plan(counts, 4096)
        assert used <= least * 1.02 + 2
    for counts in ({}, {4096: 7}, {1: 10_000_000_000}, {2049: 5}, {1366: 10}, {4095: 3, 1: 2}):
        used, least = check_plan(counts, 4096)
        assert used == max(least, math.ceil(counts.get(1366, 0) / 2))


def test_packing_places_every_token(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    rows = packing.pack(odd_docs, packing.default_tokenizer()).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[(r.piece, r.start, r.length, r.ids_crc32)] = True
    for doc, text in texts.items():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want = {(p, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())): True for p, s in enumerate(range(0, len(ids), 4096))}
        assert pieces[doc] == want, doc
    assert sum(r.doc_id == 5 for r in rows) == 2                        # the repeated row is packed twice
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(no_docs, packing.default_tokenizer()).count() == 0
    with_ids = packing.pack(odd_docs, packing.default_tokenizer(), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_spelled_added_tokens_get_their_ids():
    from tokenizers import Tokenizer
    from riskloom.llm import textops as tx
    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["plain words", "one <|endoftext|> two", "", "<|startoftext|>Ça va<|endoftext|>", "<|endoftext|", "|> split", "l'été <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>\n x"]
    data, offs, _ = tx.utf8(pa.array(texts))
    flat, to = packing.RunTokenizer(packing.default_tokenizer()).ids(data, offs)
    for k, text in enumerate(texts):
        assert flat[to[k]:to[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert 49407 in flat and 49406 in flat


# ---------------------------------------------------------------- mixing

def targets_brute(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if out[s] > cap * sizes[s]}
        if not over:
            return out | full
        full |= over


def test_mix_meets_targets_in_whole_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.plan(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    assert len(rows) == docs.count()
    sizes, taken, target, most = {}, {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        most[s] = max(most.get(s, 0), r.size)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
    want = targets_brute(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(0.005 * want[s], 60)
    again = {r.doc_id: r.taken for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.plan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (0, 1, 2))
    sizes = {}
    src = {r.doc_id: r.source for r in odd_docs.collect()}
    for r in rows:
        sizes[src[r.doc_id]] = sizes.get(src[r.doc_id], 0) + r.size
    want = targets_brute(sizes)
    assert {src[r.doc_id]: pytest.approx(r.target) for r in rows} == want
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


# ---------------------------------------------------------------- licences

def test_licences_by_header_file_and_ancestor(spark):
    rows = [(1, "src0/a/LICENSE", "Released under the MIT License."), (2, "src0/a/b/c/x.txt", "plain words here"), (3, "src0/z/y.txt", "nothing"),
            (4, "src0/a/own.txt", "some words of prose.\nLicensed under the Apache License, Version 2.0.\nmore prose " * 30),
            (5, "src0/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, None, "All rights reserved."),
            (7, None, None), (8, "src0/a/b/n.txt", None), (9, "src0/a/b/n.txt", ""), (10, "top.txt", "a licence to thrill " + "words " * 500),
            (10, "top.txt", "a licence to thrill " + "words " * 500)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, path string, text string, unit string, licence string")
    got = {}
    out = licences.scan(df, df["path"]).collect()
    for r in out:
        got[r.doc_id] = (r.licence, r.how, r.licence_path)
    assert len(out) == len(rows)
    assert got == {1: ("MIT", "file", "src0/a/LICENSE"), 2: ("GPL-3.0", "inherited", "src0/a/b/COPYING"), 3: (None, "none", None),
                   4: ("Apache-2.0", "header", "src0/a/own.txt"), 5: ("GPL-3.0", "file", "src0/a/b/COPYING"), 6: ("Proprietary", "file", None),
                   7: (None, "none", None), 8: ("GPL-3.0", "inherited", "src0/a/b/COPYING"), 9: ("GPL-3.0", "inherited", "src0/a/b/COPYING"),
                   10: (None, "none", None)}
    assert licences.scan(df.filter("1 = 0"), df["path"]).count() == 0


def test_licence_lines_of_documents_are_all_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.licence for r in licences.op10_licences(spark, SF).collect()}
    for r in docs.collect():
        for words, name in (("Apache License, Version 2.0", "Apache-2.0"), ("the MIT License", "MIT"), ("CC BY-NC 4.0", "CC-BY-NC-4.0")):
            if words in r.text:
                assert got[r.doc_id] == name


def test_documents_inherit_in_the_query_and_its_twin(spark, tmp_path):
    import duckdb
    prose = "plain words about rivers and hills "
    rows = [(1, "Released under the MIT License.", "en", "a"), (2, prose, "en", "a"), (3, prose, "de", "a"), (4, None, "en", "a"), (5, "", None, "a"),
            (6, "All rights reserved.", None, None), (7, prose, None, None), (8, prose * 30 + ".\nLicensed under CC BY 4.0.\n" + prose * 30, "en", "a"),
            (9, prose * 30 + ".\nLicensed under CC BY 4.0.\n" + prose * 30, "fr", "b"), (10, prose, "fr", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = licences.op10_licences(spark, str(tmp_path))
    got = {r.doc_id: (r.licence, r.how, r.licence_path) for r in found.collect()}
    assert got[1] == ("MIT", "file", "a/en/1") and got[8] == ("CC-BY-4.0", "header", "a/en/8")
    assert got[2] == got[4] == ("MIT", "inherited", "a/en/1") and got[7] == ("Proprietary", "inherited", "unknown/und/6")
    assert got[3] == got[5] == got[10] == (None, "none", None)            # no other folder's, no header's
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    twin = con.execute(f"SELECT {', '.join(found.columns)} FROM ({licences.OP10_SQL})").fetchall()
    assert sorted(twin, key=lambda r: r[0]) == sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])


def test_whole_licence_texts_are_licence_files(spark):
    texts = dict(licences.full_texts())
    bare = texts["BSD-3-Clause"].replace("the copyright holder nor", "Example University nor").replace("Copyright (c)", "Copyright (c) 1999 The Regents of Example University.")
    rows = [(name, f"by/{name}/text", text) for name, text in texts.items()]
    rows += [("own BSD", "a/bsd", bare), ("no appendix", "b/x", texts["GPL-2.0"].split("END OF TERMS AND CONDITIONS")[0]), ("below", "b/c/d.txt", "plain words here"),
             ("with name", "c/mit", texts["MIT"].replace("Copyright (c)", "Copyright (c) 2024 Some Person and the contributors of a project")),
             ("prose", "d/LICENSE", "the terms of a contract and the copyright of the work are " * 40)]
    df = spark.createDataFrame(rows, "doc_id string, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in licences.scan(df, df["path"]).collect()}
    for name in texts:
        assert got[name] == (name, "file"), (name, got[name])
    assert len(texts) >= 14 and {name for name, _ in licences.TEMPLATES} - set(texts) == {"Proprietary"}
    assert got["own BSD"] == ("BSD-3-Clause", "file") and got["no appendix"] == ("GPL-2.0", "file") and got["below"] == ("GPL-2.0", "inherited")
    assert got["with name"] == ("MIT", "file") and got["prose"] == (None, "none")


def test_every_template_is_found_inside_prose(spark):
    from conftest import prose
    assert all(re.search(licences.TRIGGER, text) for _, text in licences.TEMPLATES)
    rows = [(k, f"d{k}/x.txt", f"{prose(300 + k, 150)}.\n{text}\n{prose(400 + k, 150)}.") for k, (_, text) in enumerate(licences.TEMPLATES)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in licences.scan(df, df["path"]).collect()}
    assert got == {k: (name, "header") for k, (name, _) in enumerate(licences.TEMPLATES)}


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "pii":
            a = {r.doc_id: r.text for r in before.collect()}
            changed = [r for r in docs.collect() if r.text != a[r.doc_id]]
            assert changed and all(re.search(r"<(EMAIL|IP|CARD|PHONE|SECRET)>", r.text) for r in changed)
    assert 200 > seen[0] > seen[1] == seen[2] < seen[3] <= seen[4]
    assert corpus_pipeline.run(spark, SF).count() == seen[4]
