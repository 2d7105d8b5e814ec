"""WARC archives: write, normalise, read back.

Archives are first written as whole-file gzip streams.  The normaliser inflates such a stream once, in bounded pieces,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets; the reader then seeks to each
member.  Files live in the folder all executors share; each task writes under a name of its own attempt and only names
of ended tasks enter the manifest, so lost executors leave no half archives in it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

PIECE = 1 << 20
#: An archive is closed once its records hold this many bytes.
ROLL = 256 << 20
LEVEL = 1
MANIFEST = "path string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(s) -> str:
    return "" if s is None else " ".join(str(s).split())


def urn(page_id) -> str:
    """A record id: any id as a string, escaped; null apart from the string "None"."""
    return "<urn:null:>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page(name: str | None) -> str | None:
    """The id that ``urn`` was made of."""
    return unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, which keeps the HTTP head (with the full length) and no body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Inflated:
    """The bytes of a gzip file of one or more members, inflated piece by piece."""

    def __init__(self, source):
        self.source, self.z, self.buffer, self.at, self.ended = source, zlib.decompressobj(31), b"", 0, False

    def _more(self) -> bool:
        while not self.ended:
            raw = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if not raw:
                raw = self.source.read(PIECE)
                if not raw:
                    self.ended = True
                    return False
            got = self.z.decompress(raw, PIECE)
            if got:
                self.buffer, self.at = self.buffer[self.at :] + got, 0
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``; None at the end of the file."""
        while (i := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                if self.buffer[self.at :].strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.at = self.buffer[self.at : i], i + len(mark)
        return out

    def pieces(self, n: int):
        """The next ``n`` bytes, in pieces."""
        while n:
            if self.at == len(self.buffer) and not self._more():
                raise ValueError("the archive ends inside a record")
            out = self.buffer[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out

    def skip_blank_lines(self) -> None:
        while True:
            while self.buffer[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            if self.at < len(self.buffer) or not self._more():
                return


def normalise_file(fs, source: str, target: str) -> int:
    """Rewrite ``source`` with a member per record; the index is ``target``.idx: offset, length, type, record id, digest."""
    at = n = 0
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(target + ".idx", compression=None) as index:
        inflated = _Inflated(raw)
        while True:
            inflated.skip_blank_lines()
            if (head := inflated.until(b"\r\n\r\n")) is None:
                return n
            f = fields(head)
            z, length = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
            for piece in (head, b"\r\n\r\n"):
                length += out.write(z.compress(piece)) or 0
            for piece in inflated.pieces(int(f["content-length"])):
                length += out.write(z.compress(piece)) or 0
            length += out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0
            line = [at, length, f["warc-type"], f["warc-record-id"], f.get("warc-payload-digest", "")]
            index.write(("\t".join(map(str, line)) + "\n").encode())
            at, n = at + length, n + 1


def read_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    f = fields(head)
    http, _, payload = rest[: int(f["content-length"])].partition(b"\r\n\r\n")
    return f, fields(http), payload


def _named(folder: str, n: int) -> str:
    t = TaskContext.get()
    return f"{folder}/part-{t.partitionId():06d}-{t.taskAttemptId()}-{n}.warc.gz"


def write(records: DataFrame, folder: str) -> DataFrame:
    """Whole-file gzip archives of ``records`` (page_id, url, html, refers_to); returns their manifest."""

    def run(batches):
        fs, base = C.filesystem(folder)
        fs.create_dir(base, recursive=True)
        out = z = None
        n = held = 0
        names = []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c for c in b.columns)):
                if out is None:
                    names.append(_named(base, n))
                    out, z, n, held = fs.open_output_stream(names[-1], compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), n + 1, 0
                payload = (html.as_py() or "").encode()
                out.write(z.compress(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py())))
                held += len(payload) + 512
                if held >= ROLL:
                    out.write(z.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x.rsplit("/", 1)[1] for x in names], pa.string())], ["path"])

    return C.stored(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def _each_file(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Normalise each archive of ``manifest`` from folder ``source`` into ``target``; returns the new manifest."""

    def run(batches):
        fs, a = C.filesystem(source)
        _, b = C.filesystem(target)
        fs.create_dir(b, recursive=True)
        for batch in batches:
            names = []
            for i, name in enumerate(batch.column(0).to_pylist()):
                names.append(_named(b, i).rsplit("/", 1)[1].replace(".warc.gz", f"-{name}"))
                normalise_file(fs, f"{a}/{name}", f"{b}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return C.stored(_each_file(manifest).mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of normalised archives, each found through the index and checked against its digest.

    (page_id string, url, payload_bytes, payload_digest, record_type, refers_to string[, payload binary])
    """
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fs, base = C.filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f, fs.open_input_stream(f"{base}/{name}.idx", compression=None) as idx:
                    rows, held = [], 0
                    for line in pa.BufferReader(idx.read()).read().decode().splitlines():
                        at, length, kind, _, _ = line.split("\t")
                        warc, http, payload = read_record(f.read_at(int(length), int(at)))
                        want = warc["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest(payload) != want:
                            raise ValueError(f"{name}: the record at {at} does not match its digest")
                        row = [page(warc["warc-record-id"]), warc["warc-target-uri"], int(http["content-length"]), want, kind, page(warc.get("warc-refers-to"))]
                        rows.append([*row, payload] if payloads else row)
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _arrow(names))
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _arrow(names))

    return _each_file(manifest).mapInArrow(run, schema)


def _arrow(names: list[str]) -> pa.Schema:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """Records to write: (page_id, url, html, refers_to); of equal payloads that with the least page_id is the response.

    Only groups of two or more are looked up, so payloads are not shuffled while those groups are few.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    body = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("sum", F.when(F.octet_length(body) >= least_bytes, F.sha2(body, 256)))
    groups = rows.where("sum IS NOT NULL").groupBy("sum").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = C.cut(groups.where("n > 1 AND first IS NOT NULL").select("sum", "first"))
    found = rows.join(C.sized(groups), "sum", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"))


def archive_and_read(pages: DataFrame, **kw) -> DataFrame:
    """Per page, from the archives: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null payloads are empty.  Rows that repeat the least page_id of a group are all responses.  A null page_id is a revisit
    where its payload has another page, else a response.  Ids of any type are escaped in the headers.  Empty table: no archives
    and no rows.  Extra columns are not kept.  A payload is held whole, a few times over, while it is written and while it is
    checked against its digest; the normaliser streams.
    """
    spark = pages.sparkSession
    raw, ready = C.fresh_path(spark, "warc-raw"), C.fresh_path(spark, "warc")
    kind = pages.schema[kw.get("id_col", "page_id")].dataType
    manifest = normalise(write(revisits(pages, **kw), raw), raw, ready)
    out = read(manifest, ready)
    C.remove(spark, raw)  # all of it is rewritten
    own = lambda c: F.col(c).cast(kind).alias(c)
    return out.select(own("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to"))
