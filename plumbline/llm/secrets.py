"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over characters are trained from labelled samples that the corpus itself gives: the values that
the fixed patterns find are random strings, all other text but the runs to be judged is ordinary.  A character belongs to one
sample at most, whatever patterns overlap there.  Counts cover every document; they are two tables of fixed size.  A run of 20 or more key characters outside the patterns' spans is reported if its log-likelihood ratio favours
the random model by enough, in total and per character.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # leftmost maximal runs: the same as runs of any length, then 32 and more
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
K = len(ALPHABET) + 1  # and one for all other characters
PRIOR = 1.0
TOTAL, EACH = 20.0, 0.8

_code = np.full(256, K - 1, np.int32)
for _i, _c in enumerate(ALPHABET):
    _code[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start and end of the secret value) by start, then kind; code points."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(text: str, hidden=()) -> np.ndarray:
    """Counts of neighbouring characters, K x K, flat; ``hidden``: spans, in order, whose characters are left out."""
    x = _code[np.frombuffer(text.encode(), np.uint8)]
    if not hidden:
        return np.bincount(x[:-1] * K + x[1:], minlength=K * K) if len(x) > 1 else np.zeros(K * K, np.int64)
    at = seen = 0
    plain = text.isascii()
    for i, j in hidden:
        if not plain:
            start = at + len(text[seen:i].encode())
            at, seen = start + len(text[i:j].encode()), j
        x[i if plain else start : j if plain else at] = K
    wide = K + 1
    return np.bincount(x[:-1] * wide + x[1:], minlength=wide * wide).reshape(wide, wide)[:K, :K].ravel()


def joined(spans) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans in order."""
    out: list[list[int]] = []
    for i, j in sorted(spans):
        if out and i < out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def candidates(text: str, spans) -> list[tuple[int, int, str]]:
    """Long runs of key characters that meet no base span."""
    out = []
    for m in CANDIDATE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, _, e, _, _ in spans):
            out.append((m.start(), m.end(), m.group()))
    return out


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass: a row per document (base spans, candidates), and a row of counts per task."""
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("run", T.StringType())]))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("kinds", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("runs", run_type), T.StructField("counts", T.ArrayType(T.LongType()))])
    runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("run", pa.string())]))

    def go(batches):
        random, ordinary = np.zeros(K * K, np.int64), np.zeros(K * K, np.int64)
        id_type = None
        for b in batches:
            kinds, starts, ends, found = [], [], [], []
            id_type = b.schema.field(0).type
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                runs_here = candidates(text, spans)  # unlabelled, so neither model learns from them
                values = joined((i, j) for *_, i, j in spans)
                for i, j in values:
                    random += transitions(text[i:j])
                ordinary += transitions(text, joined([*values, *((i, j) for i, j, _ in runs_here)]))
                kinds.append([s[1] for s in spans])
                starts.append([s[0] for s in spans])
                ends.append([s[2] for s in spans])
                found.append([{"start": i, "end": j, "run": run} for i, j, run in runs_here])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                                              pa.array(found, runs), pa.nulls(n, pa.list_(pa.int64()))], schema.names)
        if id_type is not None:
            empty = [pa.nulls(1, id_type), *(pa.nulls(1, x) for x in (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), runs))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([np.concatenate([random, ordinary]).tolist()], pa.list_(pa.int64()))], schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return C.stored(rows.mapInArrow(go, schema), "scan")


def ratios(counts: np.ndarray) -> np.ndarray:
    """log P(next | this, random) - log P(next | this, ordinary), K x K, over key characters only."""
    tables = counts.reshape(2, K, K)[:, : K - 1, : K - 1].astype(float)
    flat = tables[0].sum(0) + PRIOR  # random strings have no memory: rows back off to the characters' own shares
    rare = (flat / flat.sum() + 1 / (K - 1)) / 2
    random = (tables[0] + 50 * rare) / (tables[0].sum(1, keepdims=True) + 50)
    common = tables[1].sum(0) + PRIOR / (K - 1)  # ordinary characters that hardly ever come first back off likewise
    ordinary = (tables[1] + 5 * common / common.sum() + 1e-3) / (tables[1].sum(1, keepdims=True) + 5 + 1e-3 * (K - 1))
    return np.log(random) - np.log(ordinary)


def score(run: str, ratio: np.ndarray) -> float:
    x = _code[np.frombuffer(run.encode(), np.uint8)]
    return float(ratio[x[:-1], x[1:]].sum())


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float = TOTAL, each: float = EACH) -> DataFrame:
    """Per row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov).

    Null text is empty: no spans, the digest of nothing.  Null and repeated ids pass through; an empty table gives no rows;
    other columns are not read.  Whole texts are read, one at a time: memory grows with the longest one.  Spans that start
    together are put in the order of their kinds.  A corpus without pattern matches trains the random model from its prior (all key
    characters alike).
    """
    scanned = scan(docs, id_col, text_col)
    sums = scanned.where("counts IS NOT NULL").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n"))
    counts = np.zeros(2 * K * K)
    for r in sums.where("n > 0").collect():  # 2 * K * K rows at most
        counts[r.pos] = r.n
    ratio = ratios(counts)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_markov", T.LongType())])

    def go(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for kinds, starts, ends, runs in zip(*(c.to_pylist() for c in b.columns[1:])):
                base = list(zip(starts, kinds, ends))
                extra = []
                for r in runs:
                    s = score(r["run"], ratio)
                    if s >= total and s >= each * len(r["run"]):
                        extra.append((r["start"], 3, r["end"]))
                line = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                row = [kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + extra)), len(extra)]
                for c, v in zip(cols, row):
                    c.append(v)
            kinds_ = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds_))], schema.names)

    return scanned.where("counts IS NULL").select("doc_id", "kinds", "starts", "ends", "runs").mapInArrow(go, schema)


def mean_log_ratio(run: str, ratio: np.ndarray) -> float:
    return score(run, ratio) / max(1, len(run) - 1) if run else -math.inf
