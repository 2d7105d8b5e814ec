"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Their votes are counted by pattern over the whole corpus
(at most 3 ** 10 patterns), and expectation-maximisation on those counts estimates how often each labeller casts which vote
on good and on bad documents.  The posterior of each pattern then labels documents, and a logistic scorer over hashed byte
trigrams is fitted on a bounded sample of them; the scorer decides on every document.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

GOOD, BAD, NONE = 1, 0, 2
#: Rows of each predicted class that the scorer is fitted on, and its number of hashed features.
SAMPLE = 1500
FEATURES = 4096
#: Rejected at this probability of being bad and above: classes weigh alike in the fit, so very short texts lie near a half.
#: The prior and this were chosen on the labels of even doc_id at sf0.1; the odd ones are for measuring.
THRESHOLD = 0.6
#: A Dirichlet prior on each labeller's votes (bad, good, nothing) on good and on bad documents, as heavy as PRIOR times the
#: corpus, so that it means the same at every size: hardly a good document has any one symptom.
ON_GOOD, ON_BAD, PRIOR = (0.0005, 0.5, 0.4995), (0.3, 0.3, 0.4), 1.0
_PIECE = 1 << 20

_odd = np.zeros(256, bool)
_odd[[ord(c) for c in "#$%&*+<=>@\\^_`|~{}[]"]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


# Labellers of a symptom vote bad or nothing: not having one symptom says little, and junk mostly has one kind.


def _odd_marks(f):
    return BAD if f["odd"] >= 5 and f["odd"] >= 0.04 * f["n"] else NONE


def _capitals(f):
    return BAD if f["letters"] >= 60 and f["upper"] >= 0.35 * f["letters"] else NONE


def _columns(f):
    return BAD if f["bars"] >= 4 and f["bars"] >= 0.08 * f["words"] else NONE


def _shouting(f):
    return BAD if f["doubled"] >= 4 and f["doubled"] >= 0.08 * f["words"] else NONE


def _digits(f):
    return BAD if f["digits"] > 0.45 * f["n"] else NONE


def _repeats(f):
    return BAD if f["lines"] >= 6 and f["distinct_lines"] < 0.4 * f["lines"] else NONE


def _lengths(f):
    mean = f["n"] / f["words"]
    return BAD if mean > 16 or mean < 2.2 and f["words"] >= 10 else NONE


def _echoes(f):
    """Words that repeat the word before."""
    return BAD if f["echoes"] >= 4 and f["echoes"] >= 0.2 * f["words"] else NONE


def _sentences(f):
    return GOOD if f["ended"] >= 0.04 * f["words"] else BAD if f["words"] >= 30 and f["ended"] <= 0.01 * f["words"] else NONE


def _prose(f):
    return GOOD if f["letters"] >= 0.75 * f["n"] and f["odd"] <= 0.01 * f["n"] else BAD if f["n"] >= 200 and f["letters"] < 0.55 * f["n"] else NONE


LABELLERS = (_odd_marks, _capitals, _columns, _shouting, _digits, _repeats, _lengths, _echoes, _sentences, _prose)
_DOUBLED = re.compile(rb"([!?.#$%&*])\1")
_ENDED = re.compile(rb"[.!?](?=\s|$)")


def facts(text: str) -> dict[str, float]:
    raw = text.encode()
    x = np.frombuffer(raw, np.uint8)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    words = raw.split()
    return {
        "n": max(1, len(raw)), "words": max(1, len(words)), "echoes": sum(map(eq, words, words[1:])), "odd": int(_odd[x].sum()), "upper": int(_upper[x].sum()), "letters": int(_letter[x].sum()),
        "digits": int(_digit[x].sum()), "bars": raw.count(b"|"), "doubled": len(_DOUBLED.findall(raw)), "ended": len(_ENDED.findall(raw)),
        "lines": len(lines), "distinct_lines": len(set(lines)),
    }


def votes(text: str | None) -> str:
    """One digit a labeller; a text without words gets votes of nothing but ``bad`` by its first labeller."""
    if not text or not text.split():
        return str(BAD) + str(NONE) * (len(LABELLERS) - 1)
    f = facts(text)
    return "".join(str(v(f)) for v in LABELLERS)


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: (posterior of bad per pattern, P(vote | class) as classes x labellers x votes, share of bad).

    Starts from "any symptom is bad"; tables are maximum a posteriori estimates under the Dirichlet prior.
    """
    v = np.array([[int(c) for c in p] for p in patterns])
    onehot = v[:, :, None] == np.arange(3)
    bad = np.where((v == BAD).any(1), 0.9, 0.05)
    share, table = 0.5, None
    for _ in range(rounds):
        before = bad
        w = np.stack([(1 - bad) * counts, bad * counts])
        share = (w[1].sum() + 1) / (counts.sum() + 4)
        prior = np.array([ON_GOOD, ON_BAD])[:, None, :] * max(3.0, PRIOR * counts.sum())
        table = np.einsum("cp,plv->clv", w, onehot) + prior
        table /= table.sum(2, keepdims=True)
        logit = np.log(share / (1 - share)) + (onehot * (np.log(table[1]) - np.log(table[0]))[None]).sum((1, 2))
        bad = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        if np.abs(bad - before).max() < 1e-9:
            break
    return bad, table, share


def features(text: str | None, size: int = FEATURES) -> np.ndarray:
    """Shares of hashed byte trigrams, and (hashed alike, as a token of its own) of words that repeat the word before."""
    raw = (text or "").encode()
    out = np.zeros(size)
    bits = size.bit_length() - 1
    for i in range(0, max(0, len(raw) - 2), _PIECE):
        x = np.frombuffer(raw[i : i + _PIECE + 2], np.uint8).astype(np.uint32)
        out += np.bincount(((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=size)
    out /= max(1, len(raw) - 2)
    words = raw.split()
    out[zlib.crc32(b"<same word>") % size] += sum(map(eq, words, words[1:])) / max(1, len(words))
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on centred, scaled square-root shares, by accelerated gradient steps; classes weigh alike."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y > 0.5, 0.5 / max(1e-9, y.sum()), 0.5 / max(1e-9, (1 - y).sum()))
    step = 4.0 / max(1e-9, float(weight @ np.einsum("ij,ij->i", x, x)))
    pw, pb = w, b
    for t in range(rounds):  # single precision and no copies of x: the driver holds the sample once
        m = t / (t + 3)
        qw, qb = w + m * (w - pw), b + m * (b - pb)
        r = (1 / (1 + np.exp(-np.clip(x @ qw.astype(x.dtype) + qb, -50, 50))) - y) * weight
        pw, pb = w, b
        w, b = qw - step * (r.astype(x.dtype) @ x + ridge * qw), qb - step * r.sum()
    return w, b


class Scorer:
    """The linear scorer: logit of being bad."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def __call__(self, text: str | None) -> float:
        return float(np.sqrt(features(text, len(self.weight))) @ self.weight + self.bias)


def train(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, size: int = FEATURES):
    """(table of (doc_id, key, votes) in the shared folder, posterior of bad by pattern, scorer or None)."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("key", T.LongType()), T.StructField("votes", T.StringType())])

    def vote(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([votes(t.as_py()) for t in b.column(2)], pa.string())], schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    voted = C.stored(rows.mapInArrow(lambda b: C.released(vote(b)), schema), "votes", 2000)
    counted = voted.groupBy("votes").count().orderBy("votes").collect()  # 3 ** 10 rows at most
    if not counted:
        return voted, {}, None
    bad, _, _ = estimate([r.votes for r in counted], np.array([r["count"] for r in counted], float))
    posterior = {r.votes: float(p) for r, p in zip(counted, bad)}
    hard = [p for p, v in posterior.items() if v >= 0.5]
    is_bad = F.col("votes").isin(hard) if hard else F.lit(False)
    cut = {}
    for name, side in (("bad", is_bad), ("good", ~is_bad)):  # the ``sample`` least keys of each side
        least = voted.where(side).select("key").orderBy("key").limit(sample).agg(F.max("key").alias("k")).first()
        cut[name] = least.k
    if cut["bad"] is None or cut["good"] is None:
        return voted, posterior, None
    chosen = voted.where((is_bad & (F.col("key") <= cut["bad"])) | (~is_bad & (F.col("key") <= cut["good"]))).select("key", "votes").distinct()
    table = C.cut(chosen)  # 2 * sample rows, but for equal keys of equal rows

    def shares(batches):
        for b in batches:
            x = [np.sqrt(features(t.as_py(), size)).astype(np.float32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["key", "votes", "x"])

    picked = rows.select("key", "text").join(F.broadcast(table), "key").dropDuplicates(["key"]).select("key", "text", "votes")
    got = picked.mapInArrow(shares, "key long, votes string, x binary").collect()
    got.sort(key=lambda r: r.key, reverse=True)
    y = np.array([posterior[r.votes] for r in reversed(got)])
    x = np.empty((len(got), size), np.float32)
    for i in range(len(x)):
        x[i] = np.frombuffer(got.pop().x, np.float32)
    weight, bias = _fit(x, y)
    return voted, posterior, Scorer(weight, bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, size: int = FEATURES, threshold: float = THRESHOLD, with_votes: bool = True) -> tuple[DataFrame, str]:
    """(``docs`` with one struct column (votes, weak, bad, kept) more, that column's name).

    ``weak`` is the labellers' posterior of bad, ``bad`` the scorer's probability, which decides; ``with_votes=False`` leaves
    the first two null unless they decide.  Where the labellers find one class only there is nothing to fit and their posterior
    decides.  Null, empty and blank texts are rejected; whole texts are read, one at a time.  Repeated rows get equal scores,
    null ids are no matter; of equal keys at the sample's border all are taken.  Empty table: no rows.  All input columns stay, whatever their names.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for i in range(len(taken) + 1) if (n := f"judged{i}") not in taken)
    _, posterior, scorer = train(docs, id_col, text_col, sample, size)
    result = T.StructType([T.StructField("votes", T.StringType()), T.StructField("weak", T.DoubleType()), T.StructField("bad", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    @F.pandas_udf(result)
    def judge(text: pd.Series) -> pd.DataFrame:
        pattern = [votes(t) for t in text] if with_votes or scorer is None else [None] * len(text)
        weak = [None if p is None else posterior.get(p, 0.5) for p in pattern]
        bad = weak if scorer is None else [1 / (1 + np.exp(-max(-50.0, min(50.0, scorer(t))))) for t in text]
        bad = [1.0 if not t or not t.strip() else b for t, b in zip(text, bad)]
        return pd.DataFrame({"votes": pattern, "weak": weak, "bad": bad, "kept": [b < threshold for b in bad]})

    return docs.withColumn(name, judge(F.col(text_col))), name


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rejected rows."""
    out, name = classify(docs, id_col, text_col, with_votes=False, **kw)
    return out.where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per row: (doc_id, votes, weak_bad, bad, kept)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, name = classify(rows, **kw)
    return out.select("doc_id", f"{name}.votes", F.round(f"{name}.weak", 6).alias("weak_bad"), F.round(f"{name}.bad", 6).alias("bad"), f"{name}.kept")
