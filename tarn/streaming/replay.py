"""Incremental change-log replay: a file stream folded into a state table by foreachBatch, resumable and idempotent; and the sync of a
mirror with a served log: incremental, and rebuilt from zero where that cannot be trusted."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import changes
from tarn.sources import scratch

PARTS = 64


class StateTable:
    """Versions of a latest-row table under a path, in any file system that Spark writes.

    Rows are dealt to `parts` parts by id; a version rewrites only the parts that its batch touches, and a small manifest names for
    each part the version that wrote it last. The manifest is written last and never again: a version that has one is done, and its
    batch, if it comes again, changes nothing. Tombstones stay as rows, so older rows that come late cannot revive an id. vacuum()
    drops parts that no kept manifest names.
    """

    def __init__(self, spark: SparkSession, path: str, schema, parts: int = PARTS):
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts
        self.names = spark.createDataFrame([], schema).columns

    def last(self) -> int:
        """The number of the last version, or -1."""
        found = [int(n[2:]) for n in scratch.names_in(self.spark, f"{self.path}/manifest") if n.startswith("v=") and n[2:].isdigit()]
        return max(found, default=-1)

    def manifest(self, number: int) -> dict[str, int]:
        """For each part that holds rows, the version that wrote it."""
        raw = scratch.read_text(self.spark, f"{self.path}/manifest/v={number}")
        return json.loads(raw) if raw else {}

    def _read(self, parts: dict[str, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/part={p}" for p, v in sorted(parts.items())])

    def version(self, number: int) -> DataFrame:
        return self._read(self.manifest(number))

    def merge(self, batch: DataFrame, number: int, fresh: bool = False) -> None:
        """Write version `number`: the latest of old and new rows of each id; a fresh one begins without old rows."""
        if scratch.exists(self.spark, f"{self.path}/manifest/v={number}"):
            return
        earlier = max((int(n[2:]) for n in scratch.names_in(self.spark, f"{self.path}/manifest") if n.startswith("v=") and n[2:].isdigit() and int(n[2:]) < number), default=-1)
        held = {} if fresh or earlier < 0 else self.manifest(earlier)
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")
        batch = scratch.store(changes.latest(batch).select(*self.names).withColumn("part", part))
        touched = sorted(r[0] for r in batch.select("part").distinct().collect())  # at most `parts` numbers
        old = self._read({str(p): held[str(p)] for p in touched if str(p) in held})
        if touched:
            merged = changes.latest(old.unionByName(batch.select(*self.names))).select(*self.names).withColumn("part", part)
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/v={number}")
        scratch.write_new(self.spark, f"{self.path}/manifest/v={number}", json.dumps(held | {str(p): number for p in touched}))

    def vacuum(self, keep: int = 2) -> None:
        """Drop manifests but the last `keep`, and the data that none of those names."""
        numbers = sorted(int(n[2:]) for n in scratch.names_in(self.spark, f"{self.path}/manifest") if n.startswith("v=") and n[2:].isdigit())
        kept = numbers[-keep:]
        needed = {v for n in kept for v in self.manifest(n).values()}
        for n in numbers[:-keep]:
            scratch.delete(self.spark, f"{self.path}/manifest/v={n}")
        for name in scratch.names_in(self.spark, f"{self.path}/data"):
            if name.startswith("v=") and int(name[2:]) not in needed and (not kept or int(name[2:]) < kept[-1]):
                scratch.delete(self.spark, f"{self.path}/data/{name}")


def replay(spark: SparkSession, source: str, schema, state_path: str, checkpoint: str, files_a_batch: int = 1, parts: int = PARTS) -> DataFrame:
    """Replay the new files of a change log in micro-batches; returns the state after them, also where there were none."""
    table = StateTable(spark, state_path, schema, parts)

    def step(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)
        table.vacuum()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.version(table.last())


# --- the sync of a mirror ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Position:
    """How far a mirror has come. from_zero: it must be rebuilt; at_head: nothing was left when it last looked."""

    rev: int = 0
    id: int = 0
    epoch: int = 0
    from_zero: bool = True
    at_head: bool = False
    head_reached_at: int | None = None
    version: int = -1


@dataclass(frozen=True)
class Served:
    """What a server holds: its change log (id, rev, trashed, ...), epoch, and the number of its live nodes. A log that ends without
    that number has been rolled back."""

    log: DataFrame
    epoch: int
    live_nodes: int | None


class RolledBack(RuntimeError):
    pass


class Mirror:
    """A state table and its position, which is saved after the table, so that a run that dies is run again from the old position."""

    def __init__(self, spark: SparkSession, path: str, schema, parts: int = PARTS):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = StateTable(spark, f"{self.path}/state", schema, parts)

    def position(self) -> Position:
        """The saved position; a mirror without one begins from zero. One that cannot be parsed is an error."""
        raw = scratch.get_pointer(self.spark, f"{self.path}/POSITION")
        return Position(**json.loads(raw)) if raw is not None else Position()

    def save(self, position: Position) -> Position:
        scratch.put_pointer(self.spark, f"{self.path}/POSITION", json.dumps(asdict(position)))
        return position

    def state(self) -> DataFrame:
        return self.table.version(self.position().version)

    def live(self) -> DataFrame:
        return self.state().filter("not trashed")

    def _fold(self, rows: DataFrame, position: Position, fresh: bool) -> tuple[Position, int]:
        """The position after rows are applied (saved, not yet at the head), and the number of live nodes."""
        number = self.table.last() + 1
        self.table.merge(rows, number, fresh)
        end = self.table.version(number).agg(F.max(F.struct("rev", "id")), F.count_if(~F.col("trashed"))).first()
        at = end[0] if end[0] is not None else (position.rev, position.id)
        return replace(position, rev=int(at[0]), id=int(at[1]), version=number), int(end[1])

    def incremental(self, served: Served, now: int) -> Position:
        """Apply what lies after the position. An epoch that changed, or another number of live nodes than the server's (a delete that
        was missed), calls for a rebuild and changes nothing that is served; a missing number stops the run."""
        old = self.position()
        if served.epoch != old.epoch:
            return self.save(replace(old, from_zero=True, at_head=False))
        if served.live_nodes is None:
            raise RolledBack("the log ends without a count of live nodes")
        new = changes.after(served.log, old.rev, old.id)
        position, live = self._fold(new, replace(old, at_head=False), fresh=False)
        if live != served.live_nodes:
            return self.save(replace(position, from_zero=True))
        position = self.save(replace(position, at_head=True, head_reached_at=now))
        self.table.vacuum()
        return position

    def rebuild(self, served: Served, now: int) -> Position:
        """Replay the whole log into a fresh state; ids that it does not deliver are gone with it. It begins anew each time, never where
        another rebuild stopped; epoch and position are taken over only if the number of live nodes is the server's."""
        old = self.save(replace(self.position(), from_zero=True, at_head=False))
        if served.live_nodes is None:
            raise RolledBack("the log ends without a count of live nodes")
        position, live = self._fold(served.log, replace(old, rev=0, id=0), fresh=True)
        if live != served.live_nodes:
            return old  # the repair stays pending
        position = self.save(replace(position, epoch=served.epoch, from_zero=False, at_head=True, head_reached_at=now))
        self.table.vacuum()
        return position

    def sync(self, served: Served, now: int, may_rebuild: bool = True) -> Position:
        """At most two passes: an incremental one, and a rebuild where that finds itself untrusted (or the mirror already is); a caller
        without the time for a rebuild leaves it pending."""
        position = self.position()
        if not position.from_zero:
            position = self.incremental(served, now)
        if position.from_zero and may_rebuild:
            position = self.rebuild(served, now)
        return position

    def check(self, served: Served, now: int, transient_parks: int = 0, pending_removals: int = 0) -> tuple[str, Position]:
        """(verdict, position): whether the mirror is fresh, by one row after its position. A fresh verdict heals the flags; others say why
        the mirror is stale, and mark it."""
        old = self.position()
        if transient_parks:
            return "parked", old
        if pending_removals:
            return "pending_removals", old
        if served.epoch != old.epoch:
            return "epoch_changed", self.save(replace(old, from_zero=True))
        if not changes.after(served.log, old.rev, old.id).limit(1).isEmpty():
            return "behind", self.save(replace(old, at_head=False))
        if served.live_nodes is None:
            raise RolledBack("the log ends without a count of live nodes")
        if self.live().count() != served.live_nodes:
            return "missed_delete", self.save(replace(old, from_zero=True))
        if not old.at_head or old.head_reached_at is None or old.head_reached_at > now:
            old = self.save(replace(old, at_head=True, head_reached_at=now))
        return "fresh", old
