"""Claims (id, rev) as a stream with keyed state: an id holds the largest revision claimed so far, and only claims above it are appended
to the log, so that neither a claim that comes again nor a batch that runs again is written twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLAIM = "id long, rev long"
#: Ids are held in so many buckets; a checkpoint goes on with the number that it began with.
BUCKETS = 1024
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Highest(StatefulProcessor):
    """For each id of a bucket the largest revision, as two arrays in the order of ids; puts out a batch's largest where it is above what is
    held. One call into the state store serves all of a bucket's ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ids binary, revs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        most = pd.concat([r[["id", "rev"]].groupby("id")["rev"].max() for r in rows]).groupby(level=0).max()  # sorted by id
        ids, revs = most.index.to_numpy(np.int64), most.to_numpy(np.int64)
        before = self.held.get() or (b"", b"")
        held, last = (np.frombuffer(x, np.int64) for x in before)
        at = np.searchsorted(held, ids)
        known = at < len(held)
        known[known] = held[at[known]] == ids[known]
        above = np.ones(len(ids), bool)
        above[known] = revs[known] > last[at[known]]
        if above.any():
            last = last.copy()
            last[at[known & above]] = revs[known & above]
            held, last = np.insert(held, at[~known], ids[~known]), np.insert(last, at[~known], revs[~known])
            self.held.update((held.tobytes(), last.tobytes()))
            yield pd.DataFrame({"id": ids[above], "rev": revs[above]})

    def close(self) -> None:
        pass


def above_held(claims: DataFrame) -> DataFrame:
    """(id, rev) of a stream of claims(id, rev): those above what their id holds."""
    rows = claims.select(F.col("id").cast("long").alias("id"), F.col("rev").cast("long").alias("rev")).filter("id is not null and rev is not null")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Highest(), outputStructType=CLAIM, outputMode="Update", timeMode="None")


def follow(spark: SparkSession, source: str, log: str, checkpoint: str) -> None:
    """Take in the new Parquet files of claims at `source`, and append what they add to the log: a folder of `id rev` lines a batch, which
    a batch that runs again writes again."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        made = above_held(spark.readStream.schema(CLAIM).parquet(source))
        line = F.concat_ws(" ", F.col("id").cast("string"), F.col("rev").cast("string")).alias("value")

        def step(rows: DataFrame, number: int) -> None:
            rows.select(line).write.mode("overwrite").text(f"{log}/batch={number}")

        made.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def appended(spark: SparkSession, log: str) -> DataFrame:
    """(id, rev) of all lines of a log; garbled ones are skipped."""
    parts = F.split("value", " ")
    rows = spark.read.text(log).filter(F.rlike("value", F.lit(r"^-?[0-9]+ -?[0-9]+\z"))).select(parts[0].try_cast("bigint").alias("id"), parts[1].try_cast("bigint").alias("rev"))
    return rows.filter("id is not null and rev is not null")
