"""WARC archives compressed with a dictionary.

An archive is one file: a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, itself compressed, then one
frame a record. The dictionary is built from the archive's own first records, at most SAMPLE bytes of them, which is also the
most a writer holds back; the records after these stream through. Each task attempt writes a file of its own name, and only the
files of attempts that ended well are in the manifest, so lost executors leave at most files that nobody reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, cut, new_path, ship

MAGIC = 0x184D2A5D
SAMPLE, DICTIONARY, LEVEL, LEAST_PAYLOAD = 4 << 20, 64 << 10, 6, 1000
DATE = "2000-01-01T00:00:00Z"  # the input has no capture time


def dictionary_of(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary, or nothing where the records are too few to build one from."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY, total // 16)), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {''.join(c if c.isprintable() and c != ' ' else f'%{ord(c):02X}' for c in url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"X-Payload-Length: {size}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archive(out, records: Iterator[bytes]) -> int:
    """Write records, each in its own frame, after the dictionary frame. Returns how many."""
    held, size, n = [], 0, 0
    compressor = None

    def start():
        trained = dictionary_of(held)
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained)
            out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained))
        return zstandard.ZstdCompressor(level=LEVEL)

    for r in records:
        n += 1
        if compressor is None:
            held.append(r)
            size += len(r)
            if size >= SAMPLE:
                compressor = start()
                for x in held:
                    out.write(compressor.compress(x))
                held = []
        else:
            out.write(compressor.compress(r))
    if compressor is None:
        compressor = start()
        for x in held:
            out.write(compressor.compress(x))
    return n


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one frame in memory at a time."""
    head = source.read(8)
    decoder, rest = zstandard.ZstdDecompressor(), head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == MAGIC:
        raw = source.read(struct.unpack("<I", head[4:])[0])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        decoder, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    while True:
        parts, frame = [], decoder.decompressobj()
        while not frame.eof:
            data = rest or source.read(1 << 16)
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(frame.decompress(data))
            rest = frame.unused_data if frame.eof else b""
        raw = b"".join(parts)
        top, _, body = raw.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, body[: int(headers["Content-Length"])]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = arrow_fs(folder)

        def records() -> Iterator[bytes]:
            for batch in batches:
                ids, urls, sizes, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
                for k, raw in enumerate(batch.column(2)):
                    yield record(ids[k], urls[k], raw.as_py() if raw.is_valid else b"", sizes[k], digests[k], refers[k])

        rows = records()
        first = next(rows, None)
        if first is None:
            return
        name = f"{at}/{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(name) as out:
            n = write_archive(out, (r for part in ([first], rows) for r in part))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n_records"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = arrow_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple] = []
                with fs.open_input_stream(path) as source:
                    for h, body in read_archive(source):
                        revisit = h["WARC-Type"] == "revisit"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(body).hexdigest()
                        size = int(h["X-Payload-Length"]) if revisit else len(body)
                        whole = lambda k, h=h: int(h[k]) if k in h else None
                        out.append((whole("X-Page-ID"), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], whole("X-Refers-To-Page-ID"), path))
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    return run


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages; returns the manifest (path, n_records). folder: a URI that all executors share.

    Of the records with equal payloads of at least 1000 bytes the one with the largest id is a response (each of its rows, if it
    is repeated), the others revisit it; smaller payloads are all responses. A null html is an empty payload; a null url has no
    target; a row with a null id is a response unless its payload equals that of a row with an id. Only digests are compared:
    they are counted before the shuffle, and a hot one is split when the response's id is joined back.
    """
    ship(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumns({"size": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    many = (
        p.where(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    )
    refers = F.when((F.col("size") >= LEAST_PAYLOAD) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    linked = p.join(many, "digest", "left").withColumn("refers_to", refers)
    # A revisit has no block: its payload stays behind.
    rows = linked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")
    return cut(rows.mapInArrow(_write(folder), "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive. Digests of responses are those of what was read."""
    ship(manifest.sparkSession)
    spread = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism) * 4, "path")
    return spread.mapInArrow(_read(folder), _SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and read them back; see write_archives and read_archives."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
