"""Personal data by weak-supervision aggregation (operator 9).

1. Candidates: every e-mail, address, card, phone or secret look-alike of a whole
   text, found by linear-time patterns (no backtracking over long runs).
2. Labelers vote +1 / 0 / -1 on each candidate: the strict pattern, a checksum or
   range test, a gazetteer of nearby words, assignment context, digit context.
3. Spark counts the vote patterns of all documents (at most 3^labelers times the
   kinds and shapes, whatever the corpus); expectation-maximisation on those counts
   estimates each labeler's reliability and a posterior for every pattern.
4. A logistic span classifier is trained on the patterns, weighted by their counts,
   with the posteriors as soft labels. It decides on candidates beside the base spans.

Base spans always stay. Kinds in order: email, ip, card, phone, secret.

Defined results: a null text counts as an empty one; an empty text has no spans (the
digest of the empty string); repeated rows give repeated results; an empty table
gives an empty result; extra columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textops as tx

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
GROUP = re.compile(r"[0-9]{12,19}(?![0-9])")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.)-])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])")
SPELLED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)
SECRET = re.compile(r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{16,}+")
KEY_START = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abpr]-|sk[-_](?:live|test)[-_])")     # fixed starts of issued keys

#: Words whose nearness speaks for a kind. Fixed values.
GAZETTEER = {
    "email": "mail email e-mail contact write kontakt correo courriel",
    "ip": "ip host server address adresse client dirección",
    "card": "card visa mastercard amex credit karte carte tarjeta kreditkarte",
    "phone": "phone tel telephone call mobile fax telefon téléphone teléfono handy",
    "secret": "token key secret password passwd apikey api_key access bearer credential",
}
NEAR = 24          # characters before a candidate in which its context is read
VOTES = 5          # pattern, test, gazetteer, assignment, digit context


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(t: str) -> list[tuple[int, int]]:
    out, last = [], 0
    back = t[::-1] if "@" in t else ""
    for m in AT_DOMAIN.finditer(t):
        at = m.start()
        left = LOCAL_BACKWARDS.match(back, len(t) - at, len(t) - last)
        if left:
            out.append((len(t) - left.end(), m.end()))
            last = m.end()
    return out


def addresses(t: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(four parts at most 255, four parts with a larger one)."""
    good, bad = [], []
    for m in DOTTED.finditer(t):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            small = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four)
            (good if small else bad).append((at, end))
            at = end + 1
    return good, bad


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of a text by kind, in code points."""
    cards = [(m.start(), m.end()) for m in DIGITS.finditer(t)
             if 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
    phones = [(m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(only_digits(m.group())) <= 15] if "+" in t else []
    return {"email": emails(t), "ip": addresses(t)[0], "card": cards, "phone": phones}


def other_candidates(t: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Look-alikes outside the base spans, first to last."""
    taken = sorted(s for kind in base.values() for s in kind)
    found: list[tuple[str, int, int]] = []
    found += [("ip", *s) for s in addresses(t)[1]]
    found += [("card", m.start(), m.end()) for m in GROUP.finditer(t) if m.start() == 0 or not t[m.start() - 1].isdigit()]
    found += [("phone", m.start(), m.end()) for m in LOCAL_PHONE.finditer(t)]
    found += [("secret", m.start(), m.end()) for m in SECRET.finditer(t) if any("0" <= c <= "9" for c in m.group())]
    if "at" in t and ("[" in t or "(" in t):
        found += [("email", m.start(), m.end()) for m in SPELLED_EMAIL.finditer(t)]
    out, edge, k = [], 0, 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= edge and not any(a < e and s < b for a, b in taken[k:k + 8]):
            out.append((kind, s, e))
            edge = e
    return out


def pattern_of(t: str, kind: str, s: int, e: int, base: bool) -> int:
    """The candidate's votes and shape as one small integer: kind, five votes, two shape bits."""
    body, before = t[s:e], t[max(0, s - NEAR):s].lower()
    digits = only_digits(body)
    near = [w.strip("=:\"'([#.,;") for w in before.split()]
    if kind == "card":
        test = 1 if luhn(digits) and 12 <= len(digits) <= 19 else -1
    elif kind == "ip":
        test = 1 if base else -1
    elif kind == "phone":
        test = 1 if 9 <= len(digits) <= 15 else -1
    elif kind == "secret":
        # many different characters: digits among them vote for, a few abstain
        test = -1 if len(set(body)) < 10 else 1 if len(digits) >= 4 else 0 if body == body.upper() else -1
    else:
        test = 1 if re.search(r"\.[A-Za-z]{2,}$", body) else 0
    strict = (base or kind == "secret" and (KEY_START.match(body) or len(body) >= 32 and re.fullmatch(r"[0-9a-fA-F]+", body))
              or kind == "card" and 13 <= len(body) <= 16 and test == 1)
    votes = [int(bool(strict)), test,
             1 if any(w in GAZETTEER_SETS[kind] for w in near) else 0,
             1 if re.search(r"[=:]\s*[\"']?$", before) else 0,
             -1 if re.search(r"[0-9][.,/]?$", before) or re.match(r"[.,/]?[0-9%]", t[e:e + 2]) else 0]
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v + 1
    long = len(body) >= 24
    return (code * 2 + (s > 0 and t[s - 1] in "\"'")) * 2 + long


GAZETTEER_SETS = {k: frozenset(v.split()) for k, v in GAZETTEER.items()}


def unpack(code: int) -> tuple[int, list[int], list[int]]:
    """(kind, votes, shape) of a pattern."""
    long, quoted, code = code % 2, code // 2 % 2, code // 4
    votes = []
    for _ in range(VOTES):
        votes.append(code % 3 - 1)
        code //= 3
    return code, votes[::-1], [quoted, long]


@dataclass
class SpanModel:
    """Probability of being personal data by vote pattern; patterns never seen use the classifier."""
    weights: np.ndarray
    reliability: np.ndarray          # (labelers): share of its votes that agree with the posterior
    threshold: float = 0.5

    def probability(self, code: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(code) @ self.weights, -30, 30))))


def features(code: int) -> np.ndarray:
    kind, votes, shape = unpack(code)
    x = np.zeros(1 + len(KINDS) + 2 * VOTES + 2)
    x[0] = 1
    x[1 + kind] = 1
    for j, v in enumerate(votes):
        x[1 + len(KINDS) + 2 * j] = v > 0
        x[2 + len(KINDS) + 2 * j] = v < 0
    x[-2:] = shape
    return x


def fit_patterns(codes: list[int], counts: list[int], rounds: int = 50) -> SpanModel:
    """EM over vote patterns (independent labelers given the truth), then a logistic classifier."""
    if not codes:
        w = np.zeros(1 + len(KINDS) + 2 * VOTES + 2)
        w[0] = -5.0
        return SpanModel(w, np.full(VOTES, 0.5))
    order = np.argsort(codes)
    codes = [codes[k] for k in order]
    n = np.asarray(counts, float)[order]
    un = [unpack(c) for c in codes]
    kind = np.array([u[0] for u in un])
    votes = np.array([u[1] for u in un])
    # start from the vote margin; a lone vote stays below certainty
    p = 1 / (1 + np.exp(-1.5 * (votes.sum(1) - 0.5)))
    for _ in range(rounds):
        wt, wf = n * p, n * (1 - p)
        log_t, log_f = np.zeros(len(n)), np.zeros(len(n))
        for k in set(kind.tolist()):
            m = kind == k
            prior = (wt[m].sum() + 1) / (n[m].sum() + 2)
            log_t[m] += np.log(prior)
            log_f[m] += np.log(1 - prior)
        for j in range(VOTES):
            # each labeler: chance of +1, 0, -1 given true and given false; smoothed towards better than chance
            for v, (a, b) in zip((1, 0, -1), ((4, 1), (2, 2), (1, 4)), strict=True):
                m = votes[:, j] == v
                log_t[m] += np.log((wt[m].sum() + a) / (wt.sum() + 7))
                log_f[m] += np.log((wf[m].sum() + b) / (wf.sum() + 7))
        p = 1 / (1 + np.exp(np.clip(log_f - log_t, -50, 50)))
    cast = votes != 0
    agree = np.where(votes > 0, p[:, None], 1 - p[:, None]) * cast * n[:, None]
    reliability = (agree.sum(0) + 1) / ((cast * n[:, None]).sum(0) + 2)
    x = np.array([features(c) for c in codes])
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n)                                     # frequent patterns count more, not alone
    for _ in range(30):                                     # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - p)) + 0.1 * w
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return SpanModel(w, reliability)


IS_HINT = np.zeros(256, bool)
IS_HINT[list(b"0123456789@([")] = True       # no candidate without one of these


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few texts: a worker holds the marks and copies of one slice, however long the texts are."""
    for b in batches:
        for i, j in tx.chunks(tx.utf8(b.column(column))[1]):
            yield b.slice(i, j - i)


def texts_of(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts that can hold a candidate."""
    data, offs, _ = tx.utf8(b.column(column))
    for i in np.flatnonzero(tx.per_text(IS_HINT[data], offs)):
        yield int(i), data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace")


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Count the vote patterns of all documents on Spark and fit the model on the counts."""
    def run(batches):
        for b in portions(batches, 0):
            seen: dict[int, int] = {}
            for _, t in texts_of(b, 0):
                base = base_spans(t)
                for kind, spans in base.items():
                    for s, e in spans:
                        c = pattern_of(t, kind, s, e, True)
                        seen[c] = seen.get(c, 0) + 1
                for kind, s, e in other_candidates(t, base):
                    c = pattern_of(t, kind, s, e, False)
                    seen[c] = seen.get(c, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                                             names=["pattern", "n"])

    got = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern long, n long")
           .groupBy("pattern").agg(F.sum("n").alias("n")).collect())   # at most 5 * 3^5 * 4 rows
    return fit_patterns([r.pattern for r in got], [r.n for r in got])


def spans_of(t: str, model: SpanModel, cache: dict[int, bool]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end), in order."""
    base = base_spans(t)
    have = sorted((s, KINDS.index(k), e) for k, spans in base.items() for s, e in spans)
    more = []
    for kind, s, e in other_candidates(t, base):
        code = pattern_of(t, kind, s, e, False)
        if code not in cache:
            cache[code] = model.probability(code) >= model.threshold
        if cache[code]:
            more.append((s, KINDS.index(kind), e))
    return have, sorted(have + more)


def find(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``base`` and ``spans``: arrays of (kind, start, end) of every document."""
    model = fit(docs, text_col) if model is None else model
    kind = docs.schema[id_col].dataType.simpleString()
    item = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        cache: dict[int, bool] = {}
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in portions(batches, 1):
            base = [[] for _ in range(b.num_rows)]
            every = [[] for _ in range(b.num_rows)]
            for i, t in texts_of(b, 1):
                one, two = spans_of(t, model, cache)
                base[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in one]
                every[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in two]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, arrow), pa.array(every, arrow)],
                                             names=["id", "base", "spans"])

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(run, f"id {kind}, base {item}, spans {item}").withColumnRenamed("id", id_col)


def mask(t: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one mark."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [t[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; personal data in ``text_col`` replaced by <KIND>."""
    model = fit(docs, text_col) if model is None else model
    place = docs.columns.index(text_col)
    # names may clash or repeat: columns travel by position
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    plain = plain.withColumn(f"c{place}", F.col(f"c{place}").cast("string"))

    def run(batches):
        cache: dict[int, bool] = {}
        for b in portions(batches, place):
            changed = {}
            for i, t in texts_of(b, place):
                spans = spans_of(t, model, cache)[1]
                if spans:
                    changed[i] = mask(t, spans)
            if changed:
                col = b.column(place).to_pylist()
                for i, t in changed.items():
                    col[i] = t
                b = b.set_column(place, b.schema.field(place), pa.array(col, b.schema.field(place).type))
            yield b

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op9_pii(spark, sf_dir):
    """The contract's digest of ``find``: counts and digest of the base spans, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def text_of(c):
        return F.array_join(F.transform(c, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"),
                                                              F.lit(":"), x["end"].cast("string"))), ",")

    def count_of(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count_of, BASE_KINDS), F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
                        text_of(F.col("spans")).alias("spans"))
