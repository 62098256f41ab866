"""A content-addressed WARC archive.

Two tables make an archive: `payloads` holds every distinct payload once, under its SHA-256, grouped by the bytes
themselves (two payloads under one digest stop the run); `headers` holds each record's exact header block and its payload's
digest. reconstruct() joins them to whole records, header, block and closing line ends; a payload that many records carry is
dealt to several tasks by a salt. read_back() parses the reconstructed records and measures their blocks. export() writes them
as WARC/1.1 files; warc_bytes() and parse_warc() turn records into gzip members and back.

Defined cases: a null payload is empty; payloads of any length are taken whole; of records with equal payloads of at least min_bytes, that with the smallest id is
the response and others revisit it; smaller ones are all responses; rows that repeat the smallest id are all responses; a
null id never is referred to unless all ids of the payload are null; a null URL is an empty target; an empty table gives an
archive without records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import hot_lookup, new_path, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Records with one payload that one task joins.
RECORDS_A_SALT = 256


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are 32 letters, five hex digits give four of them."""
    digest, letters = F.sha1(payload), F.lit(BASE32)
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archive(df: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> str:
    """Write a record for each row; returns the archive's path."""
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    once = rows.groupBy("digest", "payload").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    revisited = F.octet_length("payload") >= min_bytes
    facts = once.select("digest", "first_id", "n", F.when(revisited, F.lit(1).cast("long")).otherwise(F.col("n")).alias("blocks"), F.octet_length("payload").cast("long").alias("n_bytes"), sha1_base32(F.col("payload").cast("binary")).alias("sha1"), F.col("payload").cast("binary").alias("payload"))
    facts.write.option("compression", "zstd").parquet(f"{path}/payloads")
    held = spark.read.schema(facts.schema).parquet(f"{path}/payloads").drop("payload")
    clashes = held.groupBy("digest").count().filter("count > 1")
    if not clashes.isEmpty():
        raise ValueError("two payloads share a SHA-256")
    total = held.agg(F.sum("n")).first()[0] or 0
    found = hot_lookup(rows.select("id", "url", "digest"), held, ["digest"], "n", total, F.col("id"))
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:tarn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), block.cast("string")), F.lit("\r\n"),
    ]
    headers = found.select(F.concat_ws("\r\n", *lines).cast("binary").alias("header"), "digest", F.col("n").alias("copies"), "blocks")
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


#: copies and blocks: how many records have the payload, and about how many carry it (others refer to one of those).
HEADERS = "header binary, digest binary, copies long, blocks long"
PAYLOADS = "digest binary, first_id long, n long, blocks long, n_bytes long, sha1 string, payload binary"


def _field(name: str, header: str = "header") -> Column:
    return F.regexp_extract(F.col(header).cast("string"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _number(name: str, header: str = "header") -> Column:
    return F.nullif(F.regexp_extract(_field(name, header), "([0-9-]+)>?$", 1), F.lit("")).cast("long")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, refers_to, header_digest, content_length, header, digest, copies, blocks), parsed from the header blocks."""
    rows = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    return rows.select(
        _number("WARC-Record-ID").alias("id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"), _number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("header_digest"), _field("Content-Length").cast("long").alias("content_length"), "header", "digest", "copies", "blocks",
    )


def reconstruct(spark: SparkSession, path: str, originals: bool = False) -> DataFrame:
    """(record, digest, copies): header, block and the closing line ends. originals: revisits get their payload too."""
    rows = spark.read.schema(HEADERS).parquet(f"{path}/headers").withColumn("record_type", _field("WARC-Type"))
    held = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    carries = F.lit(True) if originals else F.col("record_type") != "revisit"
    salts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / RECORDS_A_SALT)).cast("long")
    left = rows.filter(carries).withColumn("salt", F.pmod(F.xxhash64("header"), salts("copies" if originals else "blocks")))
    right = held.select("digest", "payload", F.explode(F.sequence(F.lit(0).cast("long"), salts("n" if originals else "blocks") - 1)).alias("salt"))
    whole = left.join(right, ["digest", "salt"]).select(F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"), "digest", "copies")
    bare = rows.filter(~carries).select(F.concat("header", F.lit(b"\r\n\r\n")).alias("record"), "digest", "copies")
    return whole.unionByName(bare)


def parsed(records: DataFrame) -> DataFrame:
    """(id, record_type, refers_to, header_digest, block_bytes, block_digest, sound, digest, copies) of reconstructed records: the
    block is what stands between the header and the closing line ends, and is measured; `sound` if its length is that of the header."""
    text = records.select(F.col("record").cast("string").alias("record"), "digest", "copies").withColumn("at", F.instr("record", "\r\n\r\n"))
    cut = text.select(
        F.expr("substring(record, 1, at + 1)").alias("header"), F.expr("substring(record, at + 4)").cast("binary").alias("rest"), "digest", "copies",
    )
    size = F.octet_length("rest") - 4
    block = F.expr("substring(rest, 1, octet_length(rest) - 4)")
    sound = (_field("Content-Length").cast("long") == size) & (F.expr("substring(rest, -4, 4)") == F.lit(b"\r\n\r\n"))
    return cut.select(
        _number("WARC-Record-ID").alias("id"), _field("WARC-Type").alias("record_type"), _number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("header_digest"), size.cast("long").alias("block_bytes"), sha1_base32(block).alias("block_digest"), sound.alias("sound"), "digest", "copies",
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(id, record_type, refers_to, payload_bytes, payload_digest, intact) of each reconstructed record: what its own block, or that
    of the record it refers to, measures; `intact` if that agrees with the record's header."""
    rows = stored(parsed(reconstruct(spark, path)), "records")
    facts = rows.filter("record_type = 'response'").groupBy("digest").agg(
        F.max("copies").alias("n"), F.max("block_bytes").alias("payload_bytes"), F.max("block_digest").alias("payload_digest"), F.min("id").alias("first"), (F.count(F.lit(1)) == F.count_if("sound")).alias("all_sound")
    )
    found = hot_lookup(rows, facts, ["digest"], "n", rows.count(), F.struct("id", "refers_to"))
    revisit = F.col("record_type") == "revisit"
    agrees = F.when(revisit, F.col("refers_to").eqNullSafe(F.col("first")) & (F.col("block_bytes") == 0)).otherwise(F.col("block_digest") == F.col("payload_digest"))
    intact = F.col("sound") & F.col("all_sound") & agrees & (F.col("header_digest") == F.col("payload_digest"))
    return found.select("id", "record_type", "refers_to", "payload_bytes", "payload_digest", intact.alias("intact"))


def export(spark: SparkSession, path: str, to: str, compression: str = "gzip") -> None:
    """Write the archive as WARC/1.1 files, part by part, into the folder `to`."""
    texts = reconstruct(spark, path).select(F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value"))
    texts.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(to)


def warc_bytes(records: DataFrame) -> DataFrame:
    """(member): each record of reconstruct() as a gzip member; concatenated they are a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gzip.compress(r, mtime=0) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    return records.select("record").mapInArrow(run, "member binary")


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a .warc or .warc.gz file."""
    raw = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    out = []
    while line := raw.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := raw.readline()).strip():
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = raw.read(int(headers["Content-Length"]))
        if raw.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end in two line ends")
        out.append((headers, block))
    return out
