"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per Python worker.

A text is cut into pattern matches; the distinct matches of a batch that are not at hand become token-position rows.  A
recursive query joins neighbouring rows with the merge table and contracts the leftmost pair of least rank until none is
left; ordered aggregation gives ids.  Every text's ids are decoded by an ordered aggregation of the vocabulary's bytes.
Results of matches are kept in a bounded cache, which only saves time.

Rows are keyed by byte offset, and offsets fall into blocks.  A word of up to one block contracts its leftmost pair of
least rank, one a round; where all of a query's words are so short, a shorter query does it (``SHORT_ROUND``).  In a
longer word many pairs go in one round: those whose rank is the least of their own and both neighbouring blocks, blocks
being twice as long as the longest token that the word holds.  Whatever could reach such a pair first would have to start
from a pair of lower rank as near as that, so the order among them is free, but for three cases: overlapping pairs of
one rank go by every second one from the left; a run of those waits for its left end; and where the new token would at
once form a pair of lower rank still (``trig``), only the leftmost pair of the three blocks goes.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text handled at a time, bytes and rows of one recursive query, cached matches: all bound memory only.
TEXT_CHARS, QUERY_BYTES, QUERY_ROWS, CACHED = 2_000_000, 300_000, 4_000_000, 500_000
#: Memory that a database may take, and more, at so many bytes a byte, for a longer word than a query usually holds.
LEAST_MB, GROWTH = 120, 400
#: Blocks of words that fit in one have this many bits of offset.
BLOCK_BITS = 6

#: The least rank of a block and its neighbours; a word within one block has none.
LEAST = {True: "min(least) OVER (ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)", False: "least"}

# One recursion; a word without a pair left is put out once more, marked as ended by round -1, and then drops out of it.
ROUND = """
WITH RECURSIVE enc(w, k, tok, len, round) AS (
    SELECT w, k, tok, len, 0::SMALLINT FROM base
    UNION ALL
    (WITH live AS (SELECT w, k, tok, len, round FROM enc WHERE round BETWEEN 0 AND {rounds} - 1),
    p AS MATERIALIZED (
        SELECT l.w, l.k, r.k AS mid, r.k + r.len AS fin, m.new, m.loose
        FROM live l JOIN live r ON r.k = l.k + l.len JOIN pairs m ON m.ab = l.tok::BIGINT * 65536 + r.tok
    ),
    blocks AS (
        SELECT b, {least} AS least
        FROM (SELECT k >> {bits} AS b, min(new) AS least FROM p GROUP BY ALL)
    ),
    hits AS MATERIALIZED (SELECT p.* FROM p JOIN blocks ON b = p.k >> {bits} AND least = new),
    after AS MATERIALIZED (  -- hits whose first token is the last one of a pair of the same rank, itself a hit or not
        SELECT h.k, q.k AS prev, g.k IS NOT NULL AS settled FROM hits h JOIN p q ON q.mid = h.k AND q.new = h.new LEFT JOIN hits g ON g.k = q.k
    ),
    runs AS (
        SELECT h.k, settled, max(CASE WHEN a.k IS NULL OR NOT settled THEN h.k END) OVER (ORDER BY h.k ROWS UNBOUNDED PRECEDING) AS run
        FROM hits h LEFT JOIN after a ON a.k = h.k WHERE a.k IS NOT NULL OR h.k IN (SELECT prev FROM after)
    ),
    ranked AS (SELECT k, row_number() OVER (PARTITION BY run ORDER BY k) AS i, min(settled) OVER (PARTITION BY run) IS DISTINCT FROM false AS go FROM runs),
    trig AS MATERIALIZED (
        SELECT h.k FROM hits h JOIN live x ON x.k + x.len = h.k JOIN pairs m ON m.ab = x.tok::BIGINT * 65536 + h.new WHERE h.loose AND m.new < h.new
        UNION SELECT h.k FROM hits h JOIN live x ON x.k = h.fin JOIN pairs m ON m.ab = h.new::BIGINT * 65536 + x.tok WHERE h.loose AND m.new < h.new
        UNION SELECT h.k FROM hits h JOIN pairs m ON m.ab = h.new::BIGINT * 65537 WHERE h.loose AND m.new < h.new
    ),
    careful AS MATERIALIZED (SELECT DISTINCT (k >> {bits}) + unnest([-1, 0, 1]) AS b FROM trig),
    later AS (  -- of hits near such a one, all but the leftmost wait
        SELECT h.k FROM hits h JOIN careful c ON c.b = h.k >> {bits} JOIN (SELECT k >> {bits} AS b, min(k) AS k FROM hits GROUP BY ALL) f
        ON f.b BETWEEN (h.k >> {bits}) - 1 AND (h.k >> {bits}) AND f.k < h.k
    ),
    chosen AS MATERIALIZED (
        SELECT w, k, mid, fin, new FROM hits
        WHERE k NOT IN (SELECT k FROM later) AND (k NOT IN (SELECT k FROM after) OR k IN (SELECT k FROM ranked WHERE i % 2 = 1 AND go))
    )
    SELECT e.w, e.k, coalesce(c.new, e.tok), coalesce(c.fin - e.k, e.len)::SMALLINT, CASE WHEN o.w IS NULL THEN -1 ELSE e.round + 1 END::SMALLINT
    FROM live e LEFT JOIN (SELECT k, new, fin FROM chosen UNION ALL SELECT mid, -1, 0 FROM chosen) c ON c.k = e.k
    LEFT JOIN (SELECT DISTINCT w FROM chosen) o ON o.w = e.w
    WHERE c.new IS DISTINCT FROM -1)
)"""

# Words of one block each: the leftmost pair of least rank of every word, packed as rank, place and both tokens' lengths.
SHORT_ROUND = """
WITH RECURSIVE enc(w, k, tok, len, round) AS (
    SELECT w, k, tok, len, 0::SMALLINT FROM base
    UNION ALL
    (WITH live AS (SELECT w, k, tok, len, round FROM enc WHERE round BETWEEN 0 AND {rounds} - 1),
    best AS MATERIALIZED (
        SELECT l.w, min((m.new::BIGINT << 47) | (l.k::BIGINT << 16) | (l.len::BIGINT << 8) | r.len::BIGINT) AS x
        FROM live l JOIN live r ON r.k = l.k + l.len JOIN pairs m ON m.ab = l.tok::BIGINT * 65536 + r.tok GROUP BY l.w
    ),
    chosen AS (SELECT w, (x >> 47)::INT AS new, ((x >> 16) & 2147483647)::INT AS k, ((x >> 8) & 255)::INT AS own, (x & 255)::INT AS other FROM best)
    SELECT e.w, e.k, CASE WHEN e.k = c.k THEN c.new ELSE e.tok END, (CASE WHEN e.k = c.k THEN c.own + c.other ELSE e.len END)::SMALLINT,
        CASE WHEN c.w IS NULL THEN -1 ELSE e.round + 1 END::SMALLINT
    FROM live e LEFT JOIN chosen c ON c.w = e.w WHERE c.w IS NULL OR e.k <> c.k + c.own)
)"""


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.begins = {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        known, merges = self.ranks.get, []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                u, v = known(t[:i]), known(t[i:])
                if u is not None and v is not None:
                    merges.append((u, v, r, t, i))
        loose = {m for u, v, r, t, i in merges for m in self._loose(u, v, r, t, i)}
        self.pairs = pa.table({"ab": np.array([u * 65536 + v for u, v, *_ in merges]), "new": np.array([m[2] for m in merges], np.int32), "loose": [m[:2] in loose for m in merges]})
        self.vocabulary = pa.table({"id": np.array(list(self.ranks.values()), np.int32), "bytes": [t.decode("latin-1") for t in self.ranks]})
        self.opened = None
        #: Matches' ids of this and the last generation; a generation ends at half of CACHED.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    @property
    def db(self):
        if self.opened is None:
            self.opened, self.limit = duckdb.connect(config={"threads": 1, "memory_limit": f"{LEAST_MB}MB", "temp_directory": ""}), LEAST_MB
            self._table("pairs", self.pairs)
            self._table("vocabulary", self.vocabulary)
        return self.opened

    def close(self) -> None:
        """Gives the database's memory back; it is opened again when needed."""
        if self.opened is not None:
            self.opened.close()
            self.opened = None

    def _table(self, name: str, t: pa.Table) -> None:
        self.db.register("_t", t)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _t")
        self.db.unregister("_t")

    def _loose(self, u: int, v: int, r: int, t: bytes, i: int):
        """Merges into a token that may at once merge on, with a neighbour, at lower rank ``r``."""
        known = self.ranks.get
        for whole, other, before in ((t[i:], t[:i], True), (t[:i], t[i:], False)):
            rank = known(whole)
            if r >= rank:
                continue
            for j in range(1, len(whole)):
                y, z = whole[:j], whole[j:]
                if y in self.ranks and z in self.ranks:  # if the neighbour merges with the near half first, it never comes to this
                    if known(other + y if before else z + other, rank) >= rank:
                        yield known(y), known(z)

    # words -> token ids

    def _block_bits(self, word: bytes) -> int:
        if len(word) <= 1 << BLOCK_BITS:
            return BLOCK_BITS
        longest, begins = 1, self.begins
        for i in range(len(word)):
            while word[i : i + longest + 1] in begins and i + longest < len(word):
                longest += 1
        return max(4, (2 * longest - 1).bit_length())

    def _base(self, words: list[bytes], bits: int) -> pa.Table:
        """Token-position rows; a word starts a block and leaves one free behind it; one that is a token is so at once."""
        whole = [self.ranks.get(w) for w in words]
        size = np.fromiter((len(w) if r is None else 1 for w, r in zip(words, whole)), np.int64, len(words))
        taken = np.fromiter((-(-len(w) >> bits) + 1 << bits for w in words), np.int64, len(words))
        first = np.repeat(np.cumsum(taken) - taken, size)
        inside = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
        flat = np.frombuffer(b"".join(w if r is None else b"?" for w, r in zip(words, whole)), np.uint8)
        tok, length = self.byte_ids[flat], np.ones(len(flat), np.int16)
        at = np.flatnonzero([r is not None for r in whole])
        rows = (np.cumsum(size) - size)[at]
        tok[rows], length[rows] = [whole[i] for i in at], [len(words[i]) for i in at]
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "k": (first + inside).astype(np.int32), "tok": tok, "len": length})

    def _merge(self, words: list[bytes]) -> list[str]:
        """The ids of each word, joined by spaces."""
        out = [""] * len(words)
        by_bits: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_bits.setdefault(self._block_bits(w), []).append(i)
        for bits, own in by_bits.items():
            at = 0
            while at < len(own):
                end, held = at, 0
                while end < len(own) and held < QUERY_BYTES:
                    held += len(words[own[end]])
                    end += 1
                part, at = own[at:end], end
                self._table("base", self._base([words[i] for i in part], bits))
                if (limit := max(LEAST_MB, held * GROWTH >> 20)) != self.limit:
                    self.db.execute(f"SET memory_limit = '{limit}MB'")
                    self.limit = limit
                rounds = min(30_000, max(4, QUERY_ROWS // max(1, held)))
                while True:  # a query holds the rows of all its rounds: very long words go on in a further one
                    longest = max(len(words[i]) for i in part)
                    query = (SHORT_ROUND if longest <= 1 << BLOCK_BITS else ROUND).format(bits=bits, rounds=rounds, least=LEAST[longest > 1 << bits])
                    self.db.execute(f"CREATE OR REPLACE TEMP TABLE done AS {query} SELECT * FROM enc WHERE round IN (-1, {rounds})")
                    for w, ids in self.db.execute("SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY k) FROM done WHERE round = -1 GROUP BY w").fetchall():
                        out[part[w]] = ids
                    self.db.execute("CREATE OR REPLACE TEMP TABLE base AS SELECT w, k, tok, len FROM done WHERE round > 0")
                    if not self.db.execute("SELECT count(*) FROM base").fetchall()[0][0]:
                        break
        return out

    def _learn(self, pieces: set[str]) -> dict[str, str]:
        """The ids of each match."""
        missing = []
        for p in pieces:
            if p not in self.young:
                if (x := self.old.get(p)) is not None:
                    self.young[p] = x
                else:
                    missing.append(p)
        self.young.update(zip(missing, self._merge([p.encode() for p in missing])))
        found = self.young
        if len(self.young) > CACHED // 2:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: list[str]) -> list[str]:
        """The token ids of each text, joined by spaces."""
        split = list(map(self.pattern.findall, texts))
        known = self._learn(set().union(*split)).__getitem__
        return [" ".join(map(known, parts)) for parts in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids: its tokens' bytes, aggregated in order."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        self.db.register("_ids", pa.table({"text": np.repeat(np.arange(len(ids), dtype=np.int32), size), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        out = [b""] * len(ids)
        ordered = "SELECT text, bytes FROM _ids JOIN vocabulary USING (id) ORDER BY pos"  # one thread aggregates rows as they come
        for i, chars in self.db.execute(f"SELECT text, string_agg(bytes, '') FROM ({ordered}) GROUP BY text").fetchall():
            out[i] = chars.encode("latin-1")  # a character stands for a byte
        self.db.unregister("_ids")
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _groups(sizes: list[int]):
    """Slices of texts of so many characters that hold TEXT_CHARS at most, or one text."""
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (held == 0 or held + sizes[end] <= TEXT_CHARS):
            held += sizes[end]
            end += 1
        yield at, end
        at = end


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                     pattern: str = public_tokenizers.PATTERN, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids: array of int]) of every row; null text is empty.

    Empty texts have no tokens and the digests of nothing.  Null or repeated ids pass through; other columns are not
    read.  A very long text is handled in one piece, its words in bounded queries; memory grows with the longest text
    and, at some 400 bytes a byte, with the longest unbroken word.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for at, end in _groups(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
                joined = c.encode(batch.column(1).slice(at, end - at).to_pylist())
                ids = [np.fromstring(x, np.int32, sep=" ") if x else np.zeros(0, np.int32) for x in joined]
                shas = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
                decoded = [hashlib.sha256(x).hexdigest() for x in c.decode(ids)]
                cols = [batch.column(0).slice(at, end - at), pa.array(list(map(len, ids)), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])
        c.close()

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lambda batches: C.released(run(batches)), schema)


def decode(ids: list[int], path: str) -> bytes:
    """The bytes of token ids, in order."""
    return codec(path, public_tokenizers.PATTERN).decode([np.array(ids, np.int32)])[0]
