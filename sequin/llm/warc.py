"""Operator 10, WARC archives through a chunked record table.

Payloads never pass as whole records between the steps: the chunk table has a
row for each (record, chunk number) of at most ``CHUNK`` bytes, with the SHA-1 of
the payload up to the chunk's end, so that the last chunk's is the record's.

* ``records`` decides, from digests and lengths alone, which of equal payloads
  is the response and which revisit it.
* ``chunk_rows`` cuts the payloads before they leave the JVM; ``write_archives``
  streams the chunk rows to gzipped WARC files in the shared folder, one gzip
  member a record, a new file after ``FILE_BYTES`` of payload. A revisit names its
  response by WARC-Refers-To.
* ``read_chunks`` reads the archives back, one task a file, and emits the chunk
  table: memory is one chunk and one header, whatever the record's size.

Edge cases: a null html is an empty payload, and an empty payload has one empty
chunk; a null url is left out of the header; of rows that repeat page_id and
payload one is the response and the others revisit it (from 1000 bytes on); a
null page_id is smaller than any other. Empty tables give no archive and no row.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import file_system, salted_lookup, stored

CHUNK, FILE_BYTES, MIN_REVISIT = 1 << 16, 1 << 25, 1000


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, bytes, record_type, refers_to: the input of the writer."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("bytes"))
    # only digests shuffle here; the two are written so that the pages' text is read once for them
    slim = stored(rows.select("page_id", "digest", "bytes"), "op10-digests")
    keepers = slim.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max(F.struct("page_id")).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = salted_lookup(slim.filter(F.col("bytes") >= least), keepers, ["digest", "bytes"], F.col("page_id"))
    # pages with a copy, once for each (id, digest); every other page is a response
    known = stored(copies.groupBy("page_id", "digest").agg(F.first("keep.page_id").alias("refers_to")), "op10-copies")
    k = known.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", F.lit(True).alias("copied"))
    met = rows.join(k, rows["page_id"].eqNullSafe(k["_id"]) & (rows["digest"] == k["_digest"]), "left").drop("_id", "_digest")
    own = met.filter(F.col("copied") & F.col("page_id").eqNullSafe(F.col("refers_to")))
    one = Window.partitionBy("page_id", "digest").orderBy(F.col("url"))
    own = own.withColumn("rn", F.row_number().over(one)).withColumn("record_type", F.when(F.col("rn") == 1, "response").otherwise("revisit")).drop("rn")
    rest = met.filter(F.col("copied").isNull() | ~F.col("page_id").eqNullSafe(F.col("refers_to"))).withColumn("record_type", F.when(F.col("copied"), "revisit").otherwise("response"))
    out = rest.unionByName(own)
    return out.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("refers_to"))).drop("copied")


def _header(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {clean(v)}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_id(page_id: object, digest: str) -> str:
    """The id of the response that revisits of this payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}/sha1:{digest}')}>"


def _begin(row: dict, least: int) -> bytes:
    """The header of a record. Only payloads of at least ``least`` bytes are referred to, and
    there is one response of each: its id follows from page and digest, any other is fresh."""
    revisit, large = row["record_type"] == "revisit", row["bytes"] >= least
    own = record_id(row["page_id"], row["digest"]) if large and not revisit else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Page-Id", row["page_id"]), ("X-Payload-Length", row["bytes"])]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(row["refers_to"], row["digest"])), ("X-Refers-To-Page-Id", row["refers_to"])]
    return _header(row["record_type"], fields, 0 if revisit else row["bytes"])


def chunk_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The records as rows of at most ``size`` bytes of payload, a record's in order and together;
    a revisit and an empty payload have one empty chunk."""
    response = F.col("record_type") == "response"
    n = F.when(response, F.greatest(F.ceil(F.col("bytes") / size), F.lit(1))).otherwise(1).cast("int")
    fields = ["page_id", "url", "digest", "bytes", "record_type", "refers_to"]
    cut = rows.select(*fields, F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), n.alias("chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    data = F.when(response, F.substring(F.col("payload"), F.col("chunk") * size + 1, F.lit(size))).otherwise(F.lit(b""))
    return cut.select(*fields, "chunk", (F.col("chunk") == F.col("chunks") - 1).alias("last"), data.alias("data"))


def write_archives(rows: DataFrame, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Write the records below ``folder`` (a path of the shared store); returns the files: path, records.

    A task gets the records as chunk rows and never holds a whole payload. A file's name
    holds a fresh number, so a repeated or doubled task writes files of its own and only
    those that its result names are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        stream, packer, name, count, size = None, None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i] for j, k in enumerate(batch.schema.names)}
                data = row.pop("data").as_buffer()
                row = {k: v.as_py() for k, v in row.items()}
                if stream is None:
                    name, count, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(os.path.join(base, name), compression=None)
                if row["chunk"] == 0:  # a gzip member for each record
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    stream.write(packer.compress(_begin(row, least)))
                stream.write(packer.compress(data))
                if not row["last"]:
                    continue
                stream.write(packer.compress(b"\r\n\r\n") + packer.flush())
                count, size = count + 1, size + row["bytes"]
                if size >= FILE_BYTES:
                    stream.close()
                    done.append((name, count))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    return chunk_rows(rows).mapInArrow(run, "path string, records long")


class _Inflated:
    """Bounded reads from a file of gzip members."""

    def __init__(self, source):
        self.source, self.packed, self.plain, self.unpacker = source, b"", bytearray(), None

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.source.read(CHUNK)
            if not self.packed:
                return False
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(31)
        self.plain += self.unpacker.decompress(self.packed, CHUNK)
        self.packed = self.unpacker.unconsumed_tail
        if self.unpacker.eof:
            self.packed, self.unpacker = self.unpacker.unused_data, None
        return True

    def header(self) -> bytes | None:
        """Up to the blank line; None at the end of the file."""
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.plain:
                    raise ValueError("an archive ends inside a header")
                return None
        out = bytes(self.plain[:at])
        del self.plain[: at + 4]
        return out

    def read(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


_CHUNKS = "record_id string, record_type string, page_id string, refers_to string, refers_to_record string, target_uri string, stated_digest string, stated_bytes long, chunk int, last boolean, data binary, bytes_so_far long, sha1_so_far string"


def read_chunks(spark: SparkSession, paths: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of the archives named in ``paths`` (column path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CHUNKS.split(", ")]
        types = [pa.string()] * 7 + [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as source:
                    plain = _Inflated(source)
                    while (head := plain.header()) is not None:
                        first, *lines = head.decode().split("\r\n")
                        if not first.startswith("WARC/1."):
                            raise ValueError(f"no WARC record: {first[:40]!r} in {path}")
                        f = dict(x.split(": ", 1) for x in lines)
                        left, chunk, digest, done = int(f["Content-Length"]), 0, hashlib.sha1(), 0
                        stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        while True:
                            data = plain.read(min(size, left))
                            left -= len(data)
                            done += len(data)
                            digest.update(data)
                            if not left and f["WARC-Type"] == "response" and digest.hexdigest() != stated:
                                raise ValueError(f"a payload of {path} does not have its digest")
                            held.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id"), f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), stated, int(f["X-Payload-Length"]), chunk, left == 0, data, done, digest.hexdigest()))
                            weight += len(data) + 400
                            chunk += 1
                            if weight >= 1 << 21:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                                held, weight = [], 0
                            if not left:
                                break
                        if plain.read(4) != b"\r\n\r\n":
                            raise ValueError(f"a record of {path} is longer than stated")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return paths.select("path").mapInArrow(run, _CHUNKS)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every page and read the archives back as the chunk table."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "op10-warc")
    files = stored(write_archives(records(pages, id, url, html), folder), "op10-files")
    n = max(1, files.count())
    return read_chunks(spark, files.repartition(min(n, 10_000)))
