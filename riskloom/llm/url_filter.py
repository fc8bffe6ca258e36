"""URL filters by a bit-parallel wildcard automaton (operator 4).

Glob rules are packed side by side into multiword Shift-And masks: one bit per
(rule, number of literals matched). A byte moves every rule of every URL of a
batch at once: D' = ((D << 1) & step[byte]) | (D & loop[byte]). The canonical
URL is "." + host (A-Z lower-cased) + path, so a rule for a host and all its
subdomains is ``*.host/path**``.

Glob syntax: ``*`` any run of bytes without "/", ``**`` any run of bytes, ``?``
one byte but "/", every other byte itself.

Defined results: a null URL or one without "://" has empty host and path, fits
no rule and is allowed; repeated rows give repeated results; of the fitting
rules the longest wins (ties: the first listed); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textops as tx

#: (name, verdict): host, then path prefix. Fixed values.
HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
              ("net/es/", "block"), ("net/fr/", "block")]
#: Globs that block a URL no host rule decides; on the canonical URL. Fixed values.
BLOCK_GLOBS = ["*casino*/**", "*poker*/**", "*cheap-pills*/**", "*free-bets*/**", "*ads-track*/**",
               "*spam-farm*/**", "*adult-*/**", "*porn*/**", "*xxx*/**"]
BATCH_URLS = 8192
STATE_BYTES = 8 << 20    # states of the URLs that step together


@dataclass(frozen=True)
class GlobRule:
    glob: str
    verdict: str
    name: str | None     # reported as the rule; None: the method's own
    rank: int            # of the fitting rules the highest rank wins


def host_rule(name: str, verdict: str) -> GlobRule:
    return GlobRule(f"*.{name}**", verdict, name, len(name))


def default_rules() -> list[GlobRule]:
    return [host_rule(*r) for r in HOST_RULES] + [GlobRule(g, "block", None, 0) for g in BLOCK_GLOBS]


class Automaton:
    """Shift-And masks of many globs; ``fits`` runs them over many byte strings."""

    def __init__(self, globs: list[str]):
        states: list[tuple[int | None, bool, bool]] = []     # (byte or any, loops, loops on "/"); None starts a rule
        self.starts, self.ends = [], []
        for g in globs:
            self.starts.append(len(states))
            states.append((None, False, False))
            raw, k = g.encode(), 0
            while k < len(raw):
                if raw[k] == 42:                              # "*"
                    both = raw[k:k + 2] == b"**"
                    lit, _, slash = states[-1]
                    states[-1] = (lit, True, slash or both)
                    k += 1 + both
                else:
                    states.append((-1 if raw[k] == 63 else raw[k], False, False))
                    k += 1
            self.ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.init = np.zeros(self.words, np.uint64)
        not_slash = np.arange(256) != 47
        for s, (lit, loops, slash) in enumerate(states):
            w, bit = s // 64, np.uint64(1 << (s % 64))
            if lit == -1:
                self.step[not_slash, w] |= bit
            elif lit is not None:
                self.step[lit, w] |= bit
            if loops:
                self.loop[:, w] |= np.where(not_slash | slash, bit, np.uint64(0))
        for s in self.starts:
            self.init[s // 64] |= np.uint64(1 << (s % 64))

    def fits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Boolean (strings, globs): which globs match which whole string."""
        n = len(start)
        length = end - start
        order = np.argsort(-length, kind="stable")            # the running strings are a prefix
        at, size = start[order], length[order]
        d = np.tile(self.init, (n, 1))
        live = n
        for p in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -p, "left"))   # strings longer than p
            c = data[at[:live] + p]
            cur = d[:live]
            moved = cur << np.uint64(1)
            moved[:, 1:] |= cur[:, :-1] >> np.uint64(63)
            d[:live] = (moved & self.step[c]) | (cur & self.loop[c])
        ends = np.array(self.ends, np.int64)
        got = (d[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(ends)), bool)
        out[order] = got.astype(bool)
        return out


def split_url(url):
    """Columns (host, path) of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


def filter_urls(pages: DataFrame, rules: list[GlobRule] | None = None, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """One row per URL: id, host, path, rule (null where no named rule fits) and verdict."""
    rules = default_rules() if rules is None else rules
    best = sorted(range(len(rules)), key=lambda k: (-rules[k].rank, k))
    table = Automaton([rules[k].glob for k in best])
    names = pa.array([rules[k].name for k in best] + [None], pa.string())
    verdicts = pa.array([rules[k].verdict for k in best] + ["allow"], pa.string())
    named = np.array([rules[k].name is not None for k in best], bool)[None]       # these need a path
    step = max(64, min(BATCH_URLS, STATE_BYTES // (8 * table.words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                data, offs, _ = tx.utf8(part.column(3))
                fit = table.fits(data, offs[:-1], offs[1:])
                fit &= ~(named & ~np.asarray(part.column(4))[:, None])
                first = np.where(fit.any(1), fit.argmax(1), len(best))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], names.take(pa.array(first)), verdicts.take(pa.array(first))],
                                                 names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("u"))
    host, path = split_url(F.col("u"))
    keyed = urls.select("id", host.alias("host"), path.alias("path")).select(
        "id", "host", "path", F.concat(F.lit("."), "host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))).alias("canonical"),
        (F.col("path") != "").alias("has_path"))
    got = keyed.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return got.withColumnRenamed("id", id_col)


def op4_url_filters(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
                       ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
f AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule
  FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, 'casino|poker|cheap-pills|free-bets|ads-track|spam-farm|adult-|porn|xxx') THEN 'block'
       ELSE 'allow' END AS verdict
FROM f
"""
