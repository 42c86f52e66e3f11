"""WARC archives compressed record by record with a Zstandard dictionary.

Each archive is one .warc.zst file: a leading skippable frame (magic 0x184D2A5D) holds the
dictionary, then every record is a frame of its own that names that dictionary. Dictionaries are
trained per archive on its first records: those up to 1 MB in all (``sample``, of about 64 MB that an archive
takes compressed, ``size``), and of each the first 32 KB only. Records are whole whatever the dictionary; where
later ones are unlike the first, they compress less well. Of equal
payloads one record is the response, the others are revisits that point to it.

Archives are written by the executors into the shared folder, through whatever file system its
address names; a name carries a random part, and only archives listed in the committed result of
the writing job are read, so that a repeated or lost attempt leaves at most an unread file.

Defined cases: a null html is an empty payload; payloads under the size limit are never
revisits; of repeated rows with the largest page_id each is a response; a null page_id is written as
an empty field and read as null; an empty table makes no archive; other columns are ignored."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, shared_path, table

# Fixed values of the published formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def with_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds payload (binary), digest, record_type and refers_to.

    The largest page_id by digest is aggregated with map-side partial results from ids and digests alone;
    digests that occur once leave at that point. The join back takes pages as its large side, which adaptive
    execution splits where one digest is hot."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "response")
    joined = rows.join(shared, F.col("digest") == F.col("d"), "left").drop("d")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id")) & (F.length("payload") >= least)
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("response"))).drop("response")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record. Revisits have no payload; its size and digest stay in their headers."""
    body = payload if kind == "response" else b""
    clean = "".join(c for c in (url or "") if c > " ")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/octet-stream"), ("Content-Length", len(body)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    if not raw.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't agree with its header")
    return fields, rest[:n]


def open_folder(address: str):
    """(file system, path) for an address; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if ":" in address.split("/")[0] else (fs.LocalFileSystem(), address)


def dictionary(samples: list[bytes], size: int):
    """A trained dictionary; where there is too little to train on, the records themselves."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples, k=200, d=8, steps=1)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[:size] or VERSION * 2, dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive. Records wait until ``sample`` bytes of them are there to train on; of each, the
    first 32 KB are used."""

    def __init__(self, folder: str, sample: int, size: int, level: int):
        self.fs, self.folder = open_folder(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.path = f"{self.folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        self.sample, self.size, self.level = sample, size, level
        self.waiting, self.waits, self.out, self.written, self.n = [], 0, None, 0, 0

    def add(self, raw: bytes) -> None:
        self.n += 1
        if self.out is None:
            self.waiting.append(raw)
            self.waits += len(raw)
            if self.waits >= self.sample:
                self._begin()
        else:
            self._put(self.compressor.compress(raw))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        import zstandard as zstd

        made = dictionary([r[: 1 << 15] for r in self.waiting], self.size)
        self.out = self.fs.open_output_stream(self.path)
        data = made.as_bytes()
        self._put(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstd.ZstdCompressor(level=self.level, dict_data=made, write_checksum=True)
        for raw in self.waiting:
            self._put(self.compressor.compress(raw))
        self.waiting = []

    def close(self) -> str:
        if self.out is None:
            self._begin()
        self.out.close()
        return self.path.rpartition("/")[2]


def write_archives(rows: DataFrame, folder: str, size: int = 1 << 26, sample: int = 1 << 20, dictionary_size: int = 1 << 15, level: int = 3) -> DataFrame:
    """Writes rows of ``with_types`` into archives of about ``size`` bytes; the result (name,
    records, bytes) is checkpointed: it is the list of archives that count."""

    def run(batches):
        archive = None
        for batch in batches:
            names = ("page_id", "url", "payload", "digest", "record_type", "refers_to")
            for values in zip(*(batch.column(n) for n in names)):
                if archive is None:
                    archive = Archive(folder, sample, dictionary_size, level)
                archive.add(record(*(v.as_py() for v in values)))
                if archive.written >= size:
                    yield pa.RecordBatch.from_pydict({"name": [archive.close()], "records": [archive.n], "bytes": [archive.written]})
                    archive = None
        if archive is not None:
            yield pa.RecordBatch.from_pydict({"name": [archive.close()], "records": [archive.n], "bytes": [archive.written]})

    return checkpoint(rows.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "name string, records long, bytes long"))


def records_of(stream):
    """The raw records of an archive, one frame at a time."""
    import zstandard as zstd

    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    data = stream.read(n)
    known = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_AUTO)
    rest = b""
    while True:
        one = zstd.ZstdDecompressor(dict_data=known).decompressobj()
        out = io.BytesIO()
        while not one.eof:
            data = rest or stream.read(1 << 17)
            rest = b""
            if not data:
                break
            out.write(one.decompress(data))
        if not one.eof:
            if out.tell():
                raise ValueError("the archive ends within a record")
            return
        rest = one.unused_data
        yield out.getvalue()


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives. The digest of a response is computed from its payload and
    must agree with its header; a revisit's comes from the header."""
    spark = listed.sparkSession

    def run(batches):
        fs, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                out = [[] for _ in range(6)]
                with fs.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                    for raw in records_of(stream):
                        head, payload = parse(raw)
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(head["X-Payload-Length"])
                        if kind == "response":
                            n = len(payload)
                            if digest != hashlib.sha1(payload).hexdigest():
                                raise ValueError(f"damaged record in {name}")
                        values = (int(head["X-Page-ID"]) if head["X-Page-ID"] else None, head["WARC-Target-URI"], n, digest, kind, int(head["X-Refers-To-Page"]) if kind == "revisit" else None)
                        for column, v in zip(out, values):
                            column.append(v)
                        if len(out[0]) >= 4096:
                            yield _batch(out)
                            out = [[] for _ in range(6)]
                yield _batch(out)

    return listed.select("name").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, READ)


def _batch(columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def op7_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    listed = write_archives(with_types(table(spark, sf_dir, "pages")), folder)
    return read_archives(listed, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
