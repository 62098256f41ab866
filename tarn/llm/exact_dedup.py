"""Exact deduplication over a log-structured merge index of text digests. DataFrame functions only.

* flush: every input task is a memtable; it leaves one run of (id, digest, probe) sorted by digest, a Parquet file with
  min/max statistics and a Bloom filter on the digest, so a point lookup skips runs that cannot hold it.
* compaction: the level-0 runs since the last compaction merge with the run of level 1 into its next generation, one row a
  digest that keeps the smallest identifier in the wanted order and the count; older level-0 runs are not read again.
* filter: digests held more than once set bits in a bitmap of their number's size; rows whose bit is clear are single and need
  no byte check. Beyond a size limit of the broadcast the same digests are joined by shuffle instead.
* verification: rows that hit are grouped by (digest, whole text), so equality is equality of bytes. Copies collapse
  before the shuffle. Texts that share a digest but differ stay apart.

Defined cases: a null text counts as empty; texts of any length are digested whole; a null id counts as a row and never is the
keeper unless all ids of its group are null; rows that share text and id are one document, all marked kept, and deduplicate()
returns one of them; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import MAX_BITS, ascii_lower, free_names, hot_lookup, may_be_among, new_path, stored


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


ENTRY = "id long, digest binary, probe long"
MERGED = "digest binary, keep_id long, n long"


class DigestIndex:
    """Runs of digests in `path`: level 0 as flushed, level 1 as compacted. keep: "smallest" or "largest" identifier."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", digest=sha256_digest, filter_bits: int = MAX_BITS):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep is {keep!r}")
        self.spark, self.path, self.keep, self.digest, self.filter_bits = spark, path or new_path(spark, "lsm"), keep, digest, filter_bits
        self.flushed = self.merged = 0

    def _write(self, df: DataFrame, run: str) -> None:
        sorted_runs = df.sortWithinPartitions("digest").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true")
        sorted_runs.parquet(f"{self.path}/{run}")

    def _best(self, ids: str) -> Column:
        return F.min(ids) if self.keep == "smallest" else F.max(ids)

    def rows(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, digest, probe, text); probe is a second hash, which tells apart texts that share a digest."""
        text = normalised(F.col(text_col))
        df = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
        return df.select("id", self.digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("probe"), "text")

    def flush(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Append the rows of df as runs of level 0."""
        self._write(self.rows(df, id_col, text_col).drop("text"), f"level0-{self.flushed}")
        self.flushed += 1

    def entries(self, since: int = 0) -> DataFrame:
        """(id, digest, probe) of the flushes from number `since`."""
        if since >= self.flushed:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/level0-{k}" for k in range(since, self.flushed)])

    def level1(self) -> DataFrame:
        """(digest, keep_id, n) as last compacted."""
        return self.spark.read.schema(MERGED).parquet(f"{self.path}/level1-{self.merged}") if self.merged else self.spark.createDataFrame([], MERGED)

    def compact(self) -> DataFrame:
        """Merge the runs of level 0 that are new with the run of level 1; returns the new level 1."""
        if self.merged < self.flushed:
            new = self.entries(self.merged).groupBy("digest").agg(self._best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
            if self.merged:
                new = self.level1().unionByName(new).groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            self._write(new, f"level1-{self.flushed}")
            self.merged = self.flushed
        return self.level1()

    def lookup(self, digest: bytes) -> DataFrame:
        """Entries with one digest; statistics and Bloom filters of the runs are consulted by the Parquet reader."""
        return self.entries().filter(F.col("digest") == F.lit(digest))

    def may_hit(self, rows: DataFrame) -> DataFrame:
        """Rows whose digest may be held more than once; no row of one that is is lost."""
        hits = self.level1().filter("n > 1").select("digest")
        return may_be_among(rows, ["digest"], hits, hits.count(), self.filter_bits)

    def verified(self, rows: DataFrame) -> DataFrame:
        """Groups of byte-equal texts among rows(): (digest, probe, keep_id, n). Fails if digest and probe both collide."""
        equal = rows.groupBy("digest", "text").agg(self._best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        equal = equal.select("digest", F.xxhash64("text").alias("probe"), "keep_id", "n")
        same = equal.groupBy("digest", "probe").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        clash = F.assert_true(F.col("texts") == 1, F.lit("two texts share the digest and the probe hash"))
        return same.select("digest", "probe", "keep_id", "n").where(clash.isNull())


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, probe) for every row of df."""
    index = DigestIndex(df.sparkSession, keep=keep, **options)
    index.flush(df, id_col, text_col)
    index.compact()
    groups = stored(index.verified(index.may_hit(index.rows(df, id_col, text_col))), "groups")
    entries = index.entries()
    found = hot_lookup(entries, groups, ["digest", "probe"], "n", entries.count(), F.col("id"))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "digest", "probe"
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """The rows of df that stay, all columns: one of each group of equal texts."""
    made = decisions(df, id_col, text_col, keep, **options).filter("kept")
    id_, text_ = own = free_names(df, "id", "hash")
    kept = stored(made.groupBy(F.col("doc_id").alias(f"kept_{id_}"), F.col("probe").alias(f"kept_{text_}")).agg(F.count(F.lit(1)).alias("n")), "kept")
    repeated = (kept.agg(F.max("n")).first()[0] or 0) > 1
    rows = df.withColumn(id_, F.col(id_col).cast("long")).withColumn(text_, F.xxhash64(normalised(F.col(text_col))))
    kept = kept.drop("n")
    stay = rows.join(kept, rows[id_].eqNullSafe(kept[f"kept_{id_}"]) & (rows[text_] == kept[f"kept_{text_}"]), "left_semi")
    if repeated:
        stay = stay.dropDuplicates(own)
    return stay.select(*df.columns)
