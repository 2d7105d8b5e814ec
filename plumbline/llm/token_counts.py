"""Token counts by a compiled finite-state tokenizer.

For BPE, the last token of every prefix is determined: it is the one token t ending there that forms a stable pair with
the last token of the prefix before t.  So a deterministic transducer reads characters; its state holds, for each suffix
that begins a longer vocabulary piece, that suffix, the last token before it and how many tokens ago that was; each
transition is annotated with the change in the number of tokens.  States and transitions are compiled as they are met
and interned as integers.

A text is cut into chunks.  A chunk's state map gives, for every state that can enter it, the state after it and the tokens
added.  From a chunk's first cut on -- a space after another character, which no piece spans -- the state no longer
depends on the one entered with, so such maps differ by their heads only; a chunk without a cut is run from each of the
states that the text just before it can leave, whichever token began first there.  Maps compose associatively, by a
prefix scan in rounds of doubling distance; a state that a map lacks is run through its chunk then, so counts are exact.
Whole words between cuts are macro transitions, kept in a bounded cache.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16
#: Characters before a chunk without a cut that the states entering it are sought in.
LOOK = 64
#: Entries kept; they only save time.
WORDS_KEPT, STATES_KEPT, STABLE_KEPT = 300_000, 150_000, 500_000
SPACE = "▁"
UNKNOWN = ""
START = 0


class Transducer:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("a piece spans a space: words can't be counted apart")
        self.begins = {p[:i] for p in self.score for i in range(1, len(p))}
        self.longest = max(map(len, self.score))
        self.stable: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((("", None, 0),),)
        self.ids: dict[tuple, int] = {start[0]: START}
        self.states: list[tuple] = [start[0]]
        self.step: dict[int, tuple[int, int]] = {}
        self.words: Words = Words(self)

    def merge(self, chars: str) -> list[str]:
        """The library's merges on a short string: the best-scored pair first, the leftmost of equals."""
        parts = list(chars)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, before: str | None, token: str) -> bool:
        """Whether ``token`` can stand after ``before`` (None: at the start; UNKNOWN: after a character given in bytes)."""
        key = (before or "", token)
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) >= STABLE_KEPT:
                self.stable.clear()
            got = self.merge(token) == [token] if not before else self.merge(before + token) == [before, token]
            self.stable[key] = got
        return got

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from ``state`` by ``char``: (next state, change in the number of tokens)."""
        entries = self.states[state]
        if char not in self.score and char not in self.begins:
            change, following = len(char.encode()), (("", UNKNOWN, 0),)
        else:
            last = change = None
            for suffix, before, ago in entries:
                t = suffix + char
                if t in self.score and self.fits(before, t):
                    last, change = t, ago + 1
                    break
            if last is None:  # a character in longer pieces only: given in bytes
                last, change = UNKNOWN, len(char.encode())
            following = tuple((s + char, b, a - change) for s, b, a in entries if s + char in self.begins) + (("", last, 0),)
        n = self.number(following)
        self.step[state << 21 | ord(char)] = n, change
        return n, change

    def number(self, state: tuple) -> int:
        n = self.ids.get(state)
        if n is None:
            n = self.ids[state] = len(self.states)
            self.states.append(state)
        return n

    def run(self, state: int, chars: str) -> tuple[int, int]:
        """(state after, tokens added)."""
        total, step = 0, self.step
        for c in chars:
            got = step.get(state << 21 | ord(c))
            state, change = got if got is not None else self.compile(state, c)
            total += change
        return state, total

    def chunk_map(self, chunk: str, entries) -> dict[tuple, tuple[tuple, int]]:
        """Entering state -> (state after the chunk, tokens added).  States are whole here, not numbers."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        if "  " in chunk or chunk[:1] == " " or chunk[-1:] == " ":
            parts = re.findall(r"^ *[^ ]*| +[^ ]*", chunk)
        else:
            parts = chunk.split(" ")
            parts[1:] = map(" ".__add__, parts[1:])
        head = parts[0].replace(" ", SPACE)
        out = {}
        if len(parts) == 1:
            for entry in entries:
                state, n = self.run(self.number(entry), head)
                out[entry] = self.states[state], n
            return out
        state, tail = self.run(START, parts[-1].replace(" ", SPACE))
        rest = sum(map(self.words.__getitem__, parts[1:-1])) + tail
        for entry in entries:
            out[entry] = self.states[state], self.run(self.number(entry), head)[1] + rest
        return out

    def entering(self, before: str) -> set[tuple]:
        """States that a chunk after ``before`` may be entered with: one behind a cut, else one for each place a token may start."""
        near = before[-LOOK:]
        cut = max((i for i in range(1, len(near)) if near[i] == " " and near[i - 1] != " "), default=None)
        starts = [cut] if cut is not None else range(min(self.longest, len(near)))
        return {self.states[self.run(START, near[i:].replace(" ", SPACE))[0]] for i in starts}

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")  # the library treats both alike, and puts one before
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        first = self.states[START]
        maps = [Map(self, x, {first} if i == 0 else self.entering(chunks[i - 1])) for i, x in enumerate(chunks)]
        return scan(maps)[-1](first)[1]


class Map:
    """A state map: of one chunk, or of two neighbouring maps one after the other."""

    def __init__(self, transducer: Transducer, chunk: str, entries, first: Map | None = None, second: Map | None = None):
        self.transducer, self.chunk, self.first, self.second = transducer, chunk, first, second
        self.table = transducer.chunk_map(chunk, entries) if first is None else {e: self._through(e) for e in first.table}

    def _through(self, state: tuple) -> tuple[tuple, int]:
        middle, a = self.first(state)
        after, b = self.second(middle)
        return after, a + b

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        got = self.table.get(state)
        if got is None:
            got = self.table[state] = self._through(state) if self.first else self.transducer.chunk_map(self.chunk, [state])[state]
        return got

    def then(self, other: Map) -> Map:
        return Map(self.transducer, "", (), self, other)


def scan(maps: list[Map]) -> list[Map]:
    """Inclusive prefix scan: the i-th result goes through maps 0 to i; log2 rounds, each of independent compositions."""
    d = 1
    while d < len(maps):
        maps = [maps[i - d].then(m) if i >= d else m for i, m in enumerate(maps)]
        d *= 2
    return maps


class Words(dict):
    """Word -> its tokens: macro transitions from the start back to it, compiled when first met."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        n = self.transducer.run(START, word.replace(" ", SPACE))[1]
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = n
        return n


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; null is empty and has no tokens.

    Null and repeated ids pass through; other columns are not read; memory grows with the longest text only.
    """
    path = model or public_tokenizers.path(MODEL)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        t = transducer(path)
        for batch in batches:
            n = np.fromiter((t.count(x.as_py()) for x in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], [f.name for f in schema])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, schema)
