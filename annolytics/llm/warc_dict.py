"""WARC archives whose records are compressed one by one against a Zstandard dictionary that the archive itself carries."""
from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, stored, text_of

SKIPPABLE = 0x184D2A5D  # the magic number of a leading frame that holds a dictionary
MANIFEST = "archive string, n_records long, raw_bytes long, stored_bytes long, dictionary_bytes long"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "archive string, payload binary")


def _record(page_id, url, kind: str, digest: str, size: int, first, payload: bytes | None, date: str) -> bytes:
    """One WARC record. Its id names page and payload; a revisit carries no payload but the length and digest of the full one."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    name = "" if page_id is None else int(page_id)
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:page:{name}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{digest}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{int(first)}:{digest}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on records; where they are too few to train on, their beginnings serve as raw content."""
    import zstandard
    total = sum(map(len, samples))
    want = min(size, total // 8)
    if want >= 1024 and len(samples) >= 8:
        try:
            return zstandard.train_dictionary(want, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:max(64, want)]


class _Archive:
    """An archive being written. Until ``sample_bytes`` of records have come they wait, then the dictionary is built from them."""

    def __init__(self, folder: str, dictionary_bytes: int, sample_bytes: int):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.dictionary_bytes, self.sample_bytes = dictionary_bytes, sample_bytes
        self.waiting, self.held, self.out = [], 0, None
        self.n = self.raw = self.stored = self.dictionary = 0

    def add(self, record: bytes) -> None:
        self.n, self.raw = self.n + 1, self.raw + len(record)
        if self.out:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.sample_bytes:
            self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.stored += len(data)

    def _open(self) -> None:
        import zstandard
        from pyarrow import fs
        data = build_dictionary(self.waiting, self.dictionary_bytes)
        store, path = fs.FileSystem.from_uri(self.name)
        self.out = store.open_output_stream(path, compression=None)
        words = zstandard.ZstdCompressionDict(data)
        words.precompute_compress(level=3)
        self.compressor = zstandard.ZstdCompressor(dict_data=words)
        self.dictionary = len(data)
        self._put(struct.pack("<II", SKIPPABLE, len(data)) + data)
        for record in self.waiting:
            self._put(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> tuple:
        if not self.out:
            self._open()
        self.out.close()
        return self.name, self.n, self.raw, self.stored, self.dictionary


def write_archives(pages: DataFrame, folder: str | None = None, *, date: str = "1970-01-01T00:00:00Z", min_revisit: int = 100,
                   dictionary_bytes: int = 112_640, sample_bytes: int = 8 << 20, archive_bytes: int = 128 << 20) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest, a row per archive.

    Of rows with equal payloads of ``min_revisit`` bytes or more, that with the smallest page_id is a response and the others
    are revisits of it; all smaller ones are responses. Rows that repeat the smallest page_id with the same payload are
    responses too, as is every row of a payload that has no page_id at all; a null page_id beside others is a revisit.
    A null html is an empty payload, a null url becomes ``urn:page:<id>``, other columns are not archived. No pages: no archives.

    Each task writes its own archives, closing one after ``archive_bytes`` of records. The dictionary of an archive is built
    from its own first ``sample_bytes`` of records, which bounds a task's memory. File names are new for every attempt and
    only those of attempts that succeeded come into the manifest, itself a table: a lost executor leaves at most files that
    nobody refers to. Equal payloads are counted by digest before anything is moved; the join to mark revisits has one small row
    per repeated payload on its right, so that a hot payload on the left can be split.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "archives")
    files = f"{folder}/archives"
    path = spark._jvm.org.apache.hadoop.fs.Path(files)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    payload = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = rows.join(first, "digest", "left").select(
        "page_id", "url", "digest", F.encode("payload", "utf-8").alias("payload"),
        F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, digest, data, of in zip(*(batch[c] for c in ("page_id", "url", "digest", "payload", "first"))):
                page_id, of = (None if pd.isna(x) else int(x) for x in (page_id, of))
                data = bytes(data)
                if archive is None:
                    archive = _Archive(files, dictionary_bytes, sample_bytes)
                archive.add(_record(page_id, url, "response" if of is None else "revisit", digest, len(data), of,
                                    data if of is None else None, date))
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return stored(marked.mapInPandas(lean(write), MANIFEST), f"{folder}/manifest")


def _parse(stream, archive: str) -> Iterator[tuple]:
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"{archive}: not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        payload = block[block.index(b"\r\n\r\n") + 4:]
        page_id, digest = head["WARC-Record-ID"][1:-1].split(":")[2:]
        kind = head["WARC-Type"]
        size, refers = int(head["Payload-Length"]), None
        if kind == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            refers = int(head["WARC-Refers-To"].split(":")[2])
        if head["WARC-Payload-Digest"] != "sha256:" + digest or int(head["Payload-Length"]) != size:
            raise ValueError(f"{archive}: payload of page {page_id} is damaged")
        yield (int(page_id) if page_id else None, head["WARC-Target-URI"], kind, size, digest, refers, archive,
               payload if kind == "response" else None)


def read_archive(name: str) -> Iterator[tuple]:
    """The records of one archive: its dictionary from the leading frame, then a frame per record, as a stream."""
    import zstandard
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(name)
    with store.open_input_stream(path, compression=None) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{name}: no dictionary frame")
        words = zstandard.ZstdCompressionDict(file.read(size))
        reader = zstandard.ZstdDecompressor(dict_data=words).stream_reader(file, read_across_frames=True)
        yield from _parse(io.BufferedReader(reader, 1 << 20), name)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives in the manifest, an archive per task. Digests and lengths are those of what was read; a record
    that differs from its header fails the job. ``payloads`` leaves the payload column empty where it is not wanted."""
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["archive"]:
                rows, held = [], 0
                for row in read_archive(name):
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(row[-1] or b"") if payloads else 100
                    if held > 4 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return manifest.select("archive").repartition(max(1, manifest.count())).mapInPandas(lean(read), RECORDS)
