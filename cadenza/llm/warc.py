"""WARC archives: a deterministic sharded writer with manifests, and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cadenza.llm.common import table
from cadenza.sources.scratch import scratch_path

ROLL_BYTES = 16 << 20
SHARD_BYTES = 16 << 20
#: Shards of one archive at most; larger inputs get larger shards, which roll into more files.
SHARDS = 20_000
DATE = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "shard int, file string, temporary string, records long, file_bytes long, file_sha256 string"


def _record_uri(key: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if key is None else key}:{digest}>"


def _record(key: int | None, url: str | None, digest: str, payload: bytes, response: int | None, revisits: bool) -> bytes:
    """One WARC/1.1 record; its headers, lengths and digests follow from the row alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_record_uri(key, digest)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        *([f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {_record_uri(response, digest)}"] if revisits else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records give equal bytes."""
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _packed(payload: Column) -> Column:
    """The UTF-8 payload in a compact form for the shuffle."""

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.map(lambda t: squeeze.compress(t.encode("utf-8", "surrogatepass")))

    return pandas_udf(pack, "binary")(payload)


def _shard_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by a coarse and a fine look-up; null keys go first."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = at_most(F.array(*[F.lit(b) for b in bounds[::step]]))
    every = F.array(*[F.lit(b) for b in bounds])
    fine = at_most(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)))
    return F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine).cast("int")


def write_archives(
    pages: DataFrame,
    out_dir: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write every row as a WARC record below ``out_dir`` and return the manifest of the files.

    Records are sorted by key and cut into shards of consecutive keys; a shard rolls to the next file
    once that holds ``roll_bytes`` compressed.  Of equal payloads of ``least_bytes`` or more, the row with
    the largest key is the response and smaller keys revisit it; rows that repeat the largest key are
    responses too.  Null keys count as smallest, null payloads as empty, null urls leave the header out.
    An empty table writes no file.  The same rows give the same files, however often tasks are repeated:
    a task writes under temporary names of its own attempt, the manifest names those of the attempts that
    ended well, and only these are renamed.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).cast("string").alias("u"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    marked = rows.select("k", F.sha1(F.col("p").cast("binary")).alias("d"), F.octet_length("p").cast("bigint").alias("n"))
    newest = marked.filter(F.col("n") >= least_bytes).groupBy("d").agg(
        F.max("k").alias("newest"), F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1 AND newest IS NOT NULL")
    # one directive per (key, digest) that revisits; it travels beside the records and sorts before them
    directives = marked.select("k", "d").join(newest.select("d", "newest"), "d").filter(
        F.col("k").isNull() | (F.col("k") < F.col("newest"))
    ).distinct()
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0)), F.count(F.lit(1))).first()
    shards = min(SHARDS, max(1, total // shard_bytes))
    bounds: list[int] = []
    if shards > 1:
        # a hash of the key picks the keys that bound the shards; every row is written
        share = min(1.0, 40 * shards / count)
        drawn = rows.filter(F.pmod(F.xxhash64(F.col("k")), F.lit(1 << 30)) < int(share * (1 << 30))).select("k").distinct()
        keys = sorted(r[0] for r in drawn.filter("k IS NOT NULL").collect())
        bounds = sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []
    records = rows.select("k", F.sha1(F.col("p").cast("binary")).alias("d"), F.lit(1).alias("kind"), "u",
                          _packed(F.col("p")).alias("z"), F.lit(None).cast("bigint").alias("newest"))
    notes = directives.select("k", "d", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("u"),
                              F.lit(None).cast("binary").alias("z"), "newest")
    dealt = (
        records.unionByName(notes).withColumn("shard", _shard_of(F.col("k"), bounds))
        .repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("k"), "d", "kind", F.asc_nulls_first("u"))
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        attempt = uuid.uuid4().hex
        unpack = zstandard.ZstdDecompressor()
        shard, number, out, sums, size, records = None, 0, None, None, 0, 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal out, size, records, number
            if out is not None:
                out.close()
                name = f"pages-{shard:05d}-{number:05d}.warc.gz"
                done.append((shard, name, f"_temporary/{attempt}-{shard:05d}-{number:05d}", records, size, sums.hexdigest()))
                out, size, records, number = None, 0, 0, number + 1

        noted: tuple = ()
        for batch in batches:
            columns = (batch[c].tolist() for c in ("shard", "k", "d", "kind", "u", "z", "newest"))
            for s, k, d, kind, u, z, response in zip(*columns):
                k = None if pd.isna(k) else int(k)
                if not kind:
                    noted = (k, d, int(response))
                    continue
                if s != shard:
                    close()
                    shard, number = s, 0
                if out is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    out = fs.open_output_stream(f"{root}/_temporary/{attempt}-{shard:05d}-{number:05d}", compression=None)
                    sums = hashlib.sha256()
                revisits = noted[:2] == (k, d)
                data = _member(_record(k, u, base64.b32encode(bytes.fromhex(d)).decode(), unpack.decompress(z),
                                       noted[2] if revisits else None, revisits))
                out.write(data)
                sums.update(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=_names(_MANIFEST), dtype=object)

    # k as text: a float would lose digits where keys are null
    dealt.withColumn("k", F.col("k").cast("string")).mapInPandas(write, _MANIFEST).write.parquet(f"{out_dir}/_manifest")
    manifest = pages.sparkSession.read.parquet(f"{out_dir}/_manifest")

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for name, temporary in zip(batch["file"], batch["temporary"]):
                with suppress(FileNotFoundError):
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise FileNotFoundError(name)  # neither renamed before nor now
            yield batch

    manifest.mapInPandas(rename, _MANIFEST).write.format("noop").mode("overwrite").save()
    fs, root = pafs.FileSystem.from_uri(out_dir)
    with suppress(FileNotFoundError):
        fs.delete_dir(f"{root}/_temporary")
    return manifest


_READ = (
    "file string, page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "content_length long, digests_hold boolean, payload binary"
)


def read_archives(spark: SparkSession, out_dir: str) -> DataFrame:
    """The records of the files the manifest names, payload included.

    ``digests_hold`` tells whether block and payload digests were found right.  A revisit's payload is null.
    A folder without files gives no rows.
    """
    manifest = spark.read.parquet(f"{out_dir}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out_dir).select(
        F.substring_index("path", "/", -1).alias("file"), "content"
    ) if not manifest.isEmpty() else spark.createDataFrame([], "file string, content binary")
    named = files.join(manifest.select("file"), "file", "left_semi")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                found, at = [], 0
                while at < len(content):
                    data, at = _inflated(content, at)
                    found.append((name, *_parsed(data)))
                    if len(found) == 256:
                        yield pd.DataFrame(found, columns=_names(_READ), dtype=object)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=_names(_READ), dtype=object)

    return named.mapInPandas(parse, _READ)


def _inflated(content: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """The gzip member that begins at a place, and where the next one begins; reads on in small steps, as the rest is copied."""
    inflate, parts = zlib.decompressobj(31), []
    while not inflate.eof:
        chunk = content[at : at + step]
        if not chunk:
            raise ValueError("an archive ends within a record")
        parts.append(inflate.decompress(chunk))
        at += len(chunk) - len(inflate.unused_data)
    return b"".join(parts), at


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _parsed(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    key = fields["WARC-Record-ID"].split(":")[2]
    revisits = fields["WARC-Type"] == "revisit"
    holds = fields["WARC-Block-Digest"] == f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"
    if not revisits:
        holds = holds and len(payload) == length and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    response = fields["WARC-Refers-To"].split(":")[2] if revisits else ""
    return (int(key) if key else None, fields.get("WARC-Target-URI"), fields["WARC-Type"],
            int(response) if response else None, digest, length, holds, None if revisits else payload)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(
        "page_id", F.col("content_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


OP7_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
    SELECT page_id, hex, octet_length(encode(html)) AS payload_bytes,
           array_to_string([right('000' || bin(strpos('0123456789abcdef', h) - 1), 4) FOR h IN string_split(hex, '')], '') AS b
    FROM p
), newest AS (
    SELECT hex, max(page_id) AS newest FROM p GROUP BY hex
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
           + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT)
           + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < newest THEN newest END AS refers_to
FROM bits JOIN newest USING (hex)
"""
