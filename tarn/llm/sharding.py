"""Sharding by extendible hashing. DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash of the key. Every shard starts at depth 0; only a shard over
its byte limit splits on one more bit, until every shard fits. The split is worked out on byte totals by prefix, a map-side
combined sum: `step` bits at a time, and a further round looks only at prefixes that are still too large.

Defined cases: a null key hashes as the empty string, a null text has 0 bytes; rows that share the key share all bits, so
they stay together at the greatest depth and the shard is marked oversized if they alone exceed the limit (a single row
over the limit likewise); texts of any length count whole; repeated rows all count; an empty table gives an empty directory;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import free_names, hot_lookup, new_path, stored

HASH_BITS = 60
#: Shards of a directory that is broadcast when rows are written (some 40 bytes each); a larger one is joined by shuffle.
BROADCAST_SHARDS = 1 << 20


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the MD5 of the key's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright(F.col("h"), HASH_BITS - bits)


def directory(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Shards of rows(h, n_bytes): (depth, prefix, shard_bytes, shard_rows, oversized). A written table."""
    if limit < 1 or not 1 <= step <= 20:
        raise ValueError("limit must be positive and step 1 to 20")
    found, low, pending = [], 0, rows.select("h", "n_bytes")
    while True:
        high = min(HASH_BITS, low + step)
        cells = stored(pending.groupBy(_prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), f"cells{high}")
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        nodes = cells.select("cell", "b", "n", depths).groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        nodes = nodes.withColumn("fits", F.col("b") <= limit)
        parents = nodes.filter(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        # a shard is a node that fits under a parent that doesn't; at the greatest depth, one that doesn't fit too
        leaf = nodes.withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left_semi")
        top = nodes.filter("depth = 0") if low == 0 else nodes.limit(0)
        last = high == HASH_BITS
        shards = leaf.select("depth", "prefix", "b", "n", "fits").filter(F.col("fits") | ((F.col("depth") == HASH_BITS) if last else F.lit(False))).unionByName(top.filter("fits").select("depth", "prefix", "b", "n", "fits"))
        found.append(stored(shards.select("depth", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), (~F.col("fits")).alias("oversized")), f"shards{high}"))
        still = stored(nodes.filter((F.col("depth") == high) & ~F.col("fits")).select(F.col("prefix").alias("cell")), f"still{high}")
        if last or still.isEmpty():
            break
        pending = pending.withColumn("cell", _prefix(high)).join(still, "cell", "left_semi").drop("cell")
        low = high
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def assign(df: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text", step: int = 12) -> DataFrame:
    """(doc_id, n_bytes, depth, shard, shard_bytes, shard_rows, oversized) for each row; shard is the prefix in binary."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(df.select(F.col(key_col).alias("key"), key_hash(F.col(key_col)).alias("h"), F.octet_length(text).cast("long").alias("n_bytes")), "rows")
    shards = directory(rows, limit, step)
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # at most 61 numbers
    few = shards.count() <= BROADCAST_SHARDS

    def placed(hashes: DataFrame) -> DataFrame:
        # each hash is in exactly one shard, so probing every depth in use yields one match
        probes = hashes.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else hashes.withColumn("depth", F.lit(0))
        probes = probes.withColumn("prefix", F.expr(f"shiftright(h, {HASH_BITS} - depth)"))
        if few:
            return probes.join(F.broadcast(shards), ["depth", "prefix"])
        return hot_lookup(probes, shards, ["depth", "prefix"], "shard_rows", total, F.col("h")).filter("shard_bytes is not null")

    if few:
        joined = placed(rows)
    else:  # the rows of one key are one hash, looked up once
        total = rows.count()
        hashes = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n_same")), "hashes")
        joined = hot_lookup(rows, stored(placed(hashes), "placed"), ["h"], "n_same", total, F.xxhash64("key", "n_bytes"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return joined.select(F.col("key").alias("doc_id"), "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", "shard_rows", "oversized")


def write_shards(df: DataFrame, limit: int, path: str | None = None, key_col: str = "doc_id", text_col: str = "text", step: int = 12) -> str:
    """Write df as Parquet, a folder for each shard, named by a column `shard` (with underscores before it where df has one);
    returns the path. An oversized shard, which holds the rows of one key, is written by several tasks."""
    path = path or new_path(df.sparkSession, "shards")
    shard, depth, part, hashed = free_names(df, "shard", "depth", "part", "h")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn(hashed, key_hash(F.col(key_col)))
    found = directory(stored(rows.select(F.col(hashed).alias("h"), F.octet_length(text).cast("long").alias("n_bytes")), "rows"), limit, step)
    parts = F.ceil(F.col("shard_bytes") / limit).cast("long")
    places = found.select(F.col("depth").alias(depth), F.col("prefix").alias("_prefix"), parts.alias("_parts"))
    if found.count() <= BROADCAST_SHARDS:  # then rows are not shuffled to find their shards
        places = F.broadcast(places)
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # at most 61 numbers
    if not depths:
        df.withColumn(shard, F.lit("")).write.partitionBy(shard).parquet(path)
        return path
    # the prefix lengths in use are tried one after another: a row's shard is the one whose prefix it has
    probes = rows.withColumn(depth, F.explode(F.array(*[F.lit(d) for d in depths]))).alias("r")
    same = (F.col(f"r.{depth}") == F.col(f"p.{depth}")) & (F.expr(f"shiftright(r.`{hashed}`, {HASH_BITS} - r.`{depth}`)") == F.col("p._prefix"))
    joined = probes.join(places.alias("p"), same)
    bits = F.when(F.col(f"r.{depth}") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("p._prefix").cast("string"), 10, 2), F.col(f"r.{depth}"), F.lit("0")))
    salt = F.pmod(F.xxhash64(F.struct(*[F.col(f"r.`{c}`") for c in df.columns])), F.col("p._parts"))
    dealt = joined.select(*[F.col(f"r.`{c}`") for c in df.columns], bits.alias(shard), salt.alias(part)).repartition(shard, part).drop(part)
    dealt.write.partitionBy(shard).parquet(path)
    return path
