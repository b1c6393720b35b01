"""WARC archives: writing, normalising whole-file gzip streams to one member per record, reading back by offset.

An archive that is one gzip stream can only be read from its start. The normaliser inflates it once, in pieces, and
writes every record as a gzip member of its own, with a sidecar index of their offsets; from then on any
slice of the index can be read by any task. Files go to the folder that all executors share; their
names hold the task attempt, and only those that a finished attempt reports are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard.llm.common import shared_folder, stage

#: Equal payloads of at least this many bytes are stored once.
LEAST_REVISIT = 1_000
#: An archive is closed when its records have reached this many bytes.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Index lines that a task reads at a time.
_LINES = 512


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, whose length is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    target = " ".join((url or "about:blank").split()) or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the pieces of an inflated stream; one record is held at a time."""
    held = bytearray()
    end = -1
    for chunk in chunks:
        held += chunk
        while True:
            if end < 0:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                end = head + 4 + int(fields(bytes(held[:head]))["content-length"]) + 4
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
            end = -1
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(path: str) -> Iterator[bytes]:
    """The pieces of a gzip file, of one member or many, read and inflated ``_CHUNK`` bytes at a time."""
    fs, name = _open(path)
    with fs.open_input_stream(name, compression=None) as f:
        z, begun = zlib.decompressobj(31), False
        while chunk := f.read(_CHUNK):
            while chunk or begun and not z.eof:
                begun = True
                made = z.decompress(chunk, _CHUNK)
                chunk = z.unconsumed_tail
                if made:
                    yield made
                if z.eof:
                    chunk, z, begun = z.unused_data, zlib.decompressobj(31), False
                elif not chunk and len(made) < _CHUNK:
                    break
        if begun:
            raise ValueError("the archive ends inside a gzip member")


def repeats(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``refers_to`` of the pages (``page_id, sha1, payload_bytes``) that repeat another's payload.

    The keeper of a payload is its largest page id. Rows that share the keeper's id are all kept; a null id is
    below any other; where all ids of a payload are null, each of its rows is kept.
    """
    large = pages.where(F.col("payload_bytes") >= LEAST_REVISIT)
    keepers = large.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = keepers.where("n > 1 AND keeper IS NOT NULL").select("sha1", "keeper")
    found = large.join(keepers, "sha1").where("page_id IS NULL OR page_id < keeper")
    return found.select("page_id", "sha1", F.col("keeper").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes *pages* (``page_id, url, payload, sha1, refers_to``) as archives of one gzip stream each; ``path, records`` of each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, _ = _open(folder)
        made, out, size, count = [], None, 0, 0

        def close() -> None:
            out.write(z.flush())
            out.close()
            made.append((path, count))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path = f"{stem}-{len(made):04d}.warc.gz"
                    out, z, size, count = fs.open_output_stream(_open(path)[1], compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                number = lambda v: None if pd.isna(v) else int(v)
                raw = record(number(row.page_id), row.url, row.payload, row.sha1, number(row.refers_to))
                out.write(z.compress(raw))
                size += len(raw)
                count += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(made, columns=["path", "records"])

    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    return pages.select("page_id", "url", "payload", "sha1", "refers_to").mapInPandas(write, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of *archives* (``path``) with one member per record and a sidecar index.

    Returns ``archive, index, records``. An index line holds, tab by tab, offset, length and archive.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        fs, _ = _open(folder)
        for batch in batches:
            for path in batch["path"]:
                stem = f"{folder}/{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{attempt}"
                archive, index, at, count = f"{stem}.warc.gz", f"{stem}.idx", 0, 0
                with fs.open_output_stream(_open(archive)[1], compression=None) as out, fs.open_output_stream(_open(index)[1]) as side:
                    for raw in records(inflated(path)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        side.write(f"{at}\t{len(member)}\t{archive}\n".encode())
                        at += len(member)
                        count += 1
                yield pd.DataFrame([(archive, index, count)], columns=["archive", "index", "records"])

    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    n = archives.count()
    return archives.repartition(max(1, n)).mapInPandas(rewrite, "archive string, index string, records long")


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest (hex), record_type and refers_to of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = fields(head)
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(named[k]) if k in named else None
    if named["warc-type"] == "revisit":
        digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
        return number("x-page-id"), int(fields(http)["content-length"]), digest, "revisit", number("x-refers-to-page")
    return number("x-page-id"), len(payload), hashlib.sha1(payload).hexdigest(), "response", None


def read_records(spark: SparkSession, folder: str, done: DataFrame) -> DataFrame:
    """The records of the archives that *done* lists, read slice by slice of the sidecar indexes in *folder*."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, file = None, None
        for batch in batches:
            for lo in range(0, len(batch), _LINES):
                rows = []
                for line in batch.iloc[lo : lo + _LINES].itertuples(index=False):
                    if line.archive != archive:
                        archive = line.archive
                        fs, name = _open(archive)
                        file = fs.open_input_file(name)
                    file.seek(line.offset)
                    rows.append(parsed(zlib.decompress(file.read(line.length), 31)))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = F.split("value", "\t")
    lines = spark.read.text(folder, pathGlobFilter="*.idx").select(
        F.get(parts, 0).cast("long").alias("offset"), F.get(parts, 1).cast("long").alias("length"), F.get(parts, 2).alias("archive")
    )
    lines = lines.join(done.select("archive"), "archive", "left_semi").select("offset", "length", "archive")
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return lines.sortWithinPartitions("archive", "offset").mapInPandas(read, kinds)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page, normalises the archives and reads them back: one row per record.

    A null html is an empty payload, a null url ``about:blank``; a null id stays null; repeated rows are
    records each; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    keyed = rows.select("page_id", "sha1", F.octet_length("payload").alias("payload_bytes"))
    again = stage(repeats(keyed), "repeats").select(
        F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to"
    )
    marked = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["sha1"] == again["again_sha1"]), "left")
    first, second = shared_folder(spark, "warc-streams"), shared_folder(spark, "warc-records")
    archives = stage(write_archives(marked, first), "archives")
    done = stage(normalise(archives, second), "indexes")
    return read_records(spark, second, done).withColumnRenamed("page_id", id_col)
