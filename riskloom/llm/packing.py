"""Best-fit packing of documents into token sequences (operator 2): linear grouping.

Every text is tokenised whole, ends with ``END_ID`` and is cut only if longer than a
sequence. Lengths are integers up to the capacity, so the whole packing problem is
a histogram of at most ``capacity`` counts, whatever the corpus:

1. Linear grouping: pieces above ``LARGE`` of the capacity, longest first, fall into
   groups of equal cardinality, each rounded up to its longest length.
2. The few-size problem is solved by column generation: a linear program over
   configurations, new ones priced by a knapsack.
3. Actual pieces replace the rounded ones: in each place the longest piece left that the
   rounded length holds, in a sequence's last place the longest that the room holds.
4. What is left, the small pieces above all, is placed best-fit, longest first, into
   the tightest sequence that holds it.
5. Steps 1 to 4 run for each number of groups in ``GROUPS``; the fewest sequences win.

The plan is a list of runs (length, ranks, first sequence, offset). On Spark, pieces
get their rank within their length from per-partition counters plus offsets, so a
length that a third of all pieces share is never gathered; each piece then looks its
run up. Lineage is cut by checkpoint() before ranks are read twice.

Defined results: a null or empty text is one piece that holds ``END_ID`` alone;
repeated rows are packed like any others; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import textops as tx
from riskloom.session import ensure_checkpoint_dir, reliable_checkpoint

CAPACITY = 4096
END_ID = 1
LARGE = 1 / 4               # share of the capacity above which pieces are grouped
FULL = 0.9                  # configurations whose rounded lengths fill less are left to best-fit
GROUPS = (12, 24, 48)       # numbers of groups tried; the fewest sequences win, the first of equals
UNIT = 8                    # knapsack prices configurations in units of this many tokens
KNOWN_RUNS = 600_000


# ---------------------------------------------------------------- tokens

def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for low, high in ranges:
        t[low:high + 1] = True
    return t


LETTER, DIGIT = _bytes((65, 90), (97, 122)), _bytes((48, 57))
MARK = _bytes((0x21, 0x7E)) & ~LETTER & ~DIGIT & ~_bytes((0x27, 0x27))
ODD = np.uint64(0x5851F42D4C957F2D)


class RunTokenizer:
    """Ids of many texts at once, every run of characters asked of the tokenizer only once.

    The tokenizer's rules never join characters across blanks, and within a word they cut
    runs of letters, single digits and runs of marks. Runs are found on the UTF-8 bytes,
    lower-cased (ASCII and the Latin letters of U+00C0-U+00FF) and looked up by hash; new
    ones go to the tokenizer many in one call (a run's last token carries the end-of-word
    mark). A word with anything else in it (an apostrophe, a control character, another
    script) is looked up and tokenised as a whole. A text that spells an added token (such as
    <|endoftext|>) is tokenised whole by the plain tokenizer, which gives that token's id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.plain.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)             # run k holds pool[at[k]:at[k + 1]]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def add(self, ids: np.ndarray, lengths: np.ndarray, hashes: list[int]) -> None:
        n, used = len(self.known), int(self.at[len(self.known)])
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(lengths) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[used:used + len(ids)] = ids
        self.at[n + 1:n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.known.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def learn(self, runs: list[str], hashes: list[int], odd: bool) -> None:
        for k in range(0, len(runs), 4096):
            some, names = runs[k:k + 4096], hashes[k:k + 4096]
            if not odd:
                ids = self.encode(" ".join(some))
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(some):
                    self.add(ids, np.diff(ends, prepend=0), names)
                    continue
            each = [self.encode(r) for r in some]
            self.add(np.concatenate(each), np.array([len(e) for e in each]), names)

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        flat, to = self.run_ids(data, offs)
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return flat, to
        parts = [flat[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if any(t in raw[a:b] for t in self.added):
                parts[k] = np.array(self.plain.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def run_ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text), added tokens spelled out."""
        n, texts = len(data), len(offs) - 1
        inside = ~tx.IS_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        second = np.zeros(n, bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        low = tx.ASCII_LOWER[data]
        low[second & (data <= 0x9E)] += 0x20
        kind = LETTER[data] + np.uint8(2) * DIGIT[data] + np.uint8(3) * MARK[data]
        kind[second] = 1
        kind[:-1][second[1:]] = 1
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:n]
        word = np.flatnonzero(begin)
        if not len(word):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        strange = np.add.reduceat((inside & (kind == 0)).astype(np.int32), word) > 0
        if strange.any():
            stretch = np.repeat(strange, np.add.reduceat(inside.astype(np.int32), word))
            kind[np.flatnonzero(inside)[stretch]] = 4
        begin[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        start = np.flatnonzero(begin)
        last = inside
        last[:-1] &= begin[1:] | ~inside[1:] | cut[1:n]
        end = np.flatnonzero(last) + 1
        h = tx.span_hash(tx.prefix_sums(low), start, end)
        h[kind[start] == 4] ^= ODD
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KNOWN_RUNS:
            self.forget()
        names = unique.tolist()
        new = [k for k, name in enumerate(names) if name not in self.known]
        if new:
            where = first[new]
            for odd in (False, True):
                pick = [k for k, w in zip(new, (kind[start[where]] == 4).tolist(), strict=True) if w == odd]
                source = data if odd else low
                runs = [source[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[first[pick]].tolist(), end[first[pick]].tolist(), strict=True)]
                self.learn(runs, [names[k] for k in pick], odd)
        code = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[which]
        size = self.at[code + 1] - self.at[code]
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.pool[np.repeat(self.at[code] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, offs)]


_tokenizers: dict[str, RunTokenizer] = {}      # one per worker process: the runs it has met stay known


def tokenizer_at(path: str) -> RunTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = RunTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids), and its task's count of that length so far."""
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        tok, part = tokenizer_at(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            data, offs, _ = tx.utf8(b.column(1))
            for i, j in tx.chunks(offs):
                rows, out, ids = [], [[] for _ in types], []
                o = offs[i:j + 1]
                flat, to = tok.ids(data[o[0]:o[-1]], o - o[0])
                flat, to = flat.astype("<u4").tobytes(), (4 * to).tolist()
                for k in range(i, j):
                    raw = flat[to[k - i]:to[k - i + 1]] + end
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        one = raw[at:at + 4 * capacity]
                        n = len(one) // 4
                        rows.append(k)
                        for c, v in zip(out, (p, at // 4, n, zlib.crc32(one), part, seen[n]), strict=True):
                            c.append(v)
                        seen[n] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(one, "<u4").astype(np.int32))
                cols = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(out, types, strict=True))]
                more = [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(cols + more, names=names + ["ids"] * keep_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .mapInArrow(run, schema))


# ---------------------------------------------------------------- the plan, on counts alone

def group_linear(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count], longest first, cut into groups of equal cardinality."""
    total = sum(counts.values())
    out: list[list[list[int]]] = [[]]
    room = -(-total // groups) if total else 0
    left = room
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not left:
                out.append([])
                left = room
            m = min(n, left)
            out[-1].append([length, m])
            n, left = n - m, left - m
    return [g for g in out if g]


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The most valuable multiset of sizes within ``room``, as counts."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        ok = sizes <= c
        if ok.any():
            v = np.where(ok, best[c - np.where(ok, sizes, 0)] + values, -1.0)
            k = int(v.argmax())
            if v[k] > best[c - 1] + 1e-12:
                best[c], pick[c] = v[k], k
                continue
        best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), int), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= sizes[pick[c]]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 300) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, times used): the rounded-down optimum of the configuration LP."""
    m = len(sizes)
    unit = np.array([-(-s // UNIT) for s in sizes])
    room = capacity // UNIT
    basis = np.diag([float(max(1, capacity // s)) for s in sizes])
    d = np.array(demand, float)
    x = np.linalg.solve(basis, d)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(m))
        col = knapsack(duals, unit, room)
        if duals @ col <= 1 + 1e-9:
            break
        w = np.linalg.solve(basis, col.astype(float))
        ratio = np.where(w > 1e-12, x / np.where(w > 1e-12, w, 1.0), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = col
        x = np.maximum(np.linalg.solve(basis, d), 0.0)
    return [(basis[:, k].round().astype(int), int(x[k] + 1e-9)) for k in np.argsort(-x) if x[k] >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold every piece once."""
    return min((grouped_plan(counts, capacity, g) for g in GROUPS), key=lambda classes: sum(n for _, n in classes))


def grouped_plan(counts: dict[int, int], capacity: int, cardinalities: int) -> list[tuple[tuple[int, ...], int]]:
    counts = {k: v for k, v in counts.items() if v}
    done: list[tuple[tuple[int, ...], int]] = []
    if counts.get(capacity):
        done.append(((capacity,), counts.pop(capacity)))
    large = {k: v for k, v in counts.items() if k > LARGE * capacity}
    rest: dict[int, int] = defaultdict(int, {k: v for k, v in counts.items() if k not in large})
    open_: dict[int, list[list]] = defaultdict(list)            # room -> [[lengths, sequences], ...]
    keys: list[int] = []                                        # rooms in use, sorted

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if not room:
            done.append((lengths, n))
            return
        if not open_[room]:
            insort(keys, room)
        open_[room].append([lengths, n])

    groups = group_linear(large, cardinalities)
    tops = [g[0][0] for g in groups]
    use = configurations(tops, [sum(n for _, n in g) for g in groups], capacity) if groups else []
    lengths_left = sorted(large)
    for config, times in use:
        if config @ np.array(tops) < FULL * capacity:
            continue
        slots = [t for t, a in zip(tops, config, strict=True) for _ in range(a)]           # rounded lengths, longest first
        while times and lengths_left:
            lengths: list[int] = []
            room = capacity
            for k, top in enumerate(slots):
                # the longest piece left that its group's rounded length holds; in the last place, that the room holds
                at = bisect_right(lengths_left, room if k == len(slots) - 1 else top) - 1
                while at >= 0 and large[lengths_left[at]] <= lengths.count(lengths_left[at]):
                    at -= 1
                if at < 0:
                    break
                lengths.append(lengths_left[at])
                room -= lengths[-1]
            if not lengths:
                break
            alike = min([times, *(large[v] // lengths.count(v) for v in lengths)])         # as many alike as there are
            put(tuple(lengths), alike)
            times -= alike
            for v in lengths:
                large[v] -= alike
            for v in set(lengths):
                if not large[v]:
                    lengths_left.pop(bisect_left(lengths_left, v))
    for length in lengths_left:
        rest[length] += large[length]

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(keys, length)
            if at == len(keys):                                 # nothing holds it: new sequences
                fit = min(capacity // length, n)
                put((length,) * fit, n // fit)
                n -= fit * (n // fit)
                continue
            room = keys[at]
            lengths, have = open_[room].pop()
            if not open_[room]:
                keys.pop(at)
            fit = min(room // length, n)
            used = min(have, n // fit)
            if have > used:
                if not open_[room]:
                    insort(keys, room)
                open_[room].append([lengths, have - used])
            put(lengths + (length,) * fit, used)
            n -= fit * used
    for classes in open_.values():
        done += [(tuple(lengths), n) for lengths, n in classes]
    return done


def runs(classes: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: rank r of a run starting at
    r0 lies in sequence first + (r - r0)."""
    out, taken, base = [], defaultdict(int), 0
    for lengths, n in classes:
        at = 0
        for length in lengths:
            out.append((length, taken[length], base, at))
            taken[length] += n
            at += length
        base += n
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


# ---------------------------------------------------------------- on Spark

def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    ensure_checkpoint_dir(docs.sparkSession)
    cut = reliable_checkpoint(pieces(docs, tokenizer, capacity, id_col, text_col, keep_ids))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = reliable_checkpoint(counts.withColumn("before", F.coalesce(earlier, F.lit(0))))
    histogram = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # <= capacity rows
    table = runs(plan(histogram, capacity))
    key = (table[:, 0] << 44) + table[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length.astype(np.int64) << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                                             names=[*b.schema.names[:-1], "sequence_id", "offset"])

    keep = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = cut.join(before.drop("n"), ["part", "length"]).select(*keep, (F.col("before") + F.col("nth")).alias("rank"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]]
    return ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"])).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
