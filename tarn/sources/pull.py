"""A change log as a streaming source that is read by key, page by page.

publish() writes a log(rev, id, ...) sorted by (rev, id) into Parquet files of disjoint ranges, with a pointer that names its epoch and its
number of live nodes. The source `keyset_log` reads such a log: its offset is the key of the last row delivered, a micro-batch is
`pages` pages of at most `page` rows strictly after it, and every page is a partition of its own, read by a task from the row groups
that its range of keys meets. The driver reads keys only, of the row groups that hold the next pages. A page that is not full is
the head: until the log grows, no further batch begins. A run that starts again goes on at the key given as `rev` and `id` (the
position that the reader of the pages has saved); a batch that was planned but not committed is read again between the same keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tarn.operators.changes import PAGE_ROWS
from tarn.sources import scratch

Key = tuple[int, int]
START: Key = (0, 0)
#: Rows of a published row group.
GROUP_ROWS = 4 * PAGE_ROWS
#: Pages of a micro-batch of a reader to which its width is all the same: a micro-batch has its own cost, and the driver holds its keys.
WIDE = 512


class EpochChanged(RuntimeError):
    """The log is of another epoch than the one asked for: its keys mean nothing to the reader."""


def publish(log: DataFrame, path: str, epoch: int, live_nodes: int | None) -> None:
    """Append log(rev, id, ...), whose keys lie after all that is there, to the log at a path; the pointer is written last. Row groups are
    small, since a page is read from whole ones."""
    spark = log.sparkSession
    sorted_log = log.repartitionByRange("rev", "id").sortWithinPartitions("rev", "id")
    sorted_log.write.mode("append").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(f"{path}/rows")
    scratch.put_pointer(spark, f"{path}/HEAD", json.dumps({"epoch": epoch, "live_nodes": live_nodes, "schema": log.schema.json()}))


def head(spark: SparkSession, path: str) -> dict:
    """epoch, live_nodes and schema of a published log: what a reader that begins from zero learns first."""
    return json.loads(scratch.get_pointer(spark, f"{path}/HEAD"))


def pull(spark: SparkSession, path: str, position: Key = START, epoch: int | None = None, page: int = PAGE_ROWS, pages: int = 1) -> DataFrame:
    """A streaming DataFrame of the log's rows strictly after a position; EpochChanged if the log is of another epoch than asked."""
    found = head(spark, path)
    if epoch is not None and found["epoch"] != epoch:
        raise EpochChanged(f"epoch {found['epoch']}, not {epoch}")
    spark.dataSource.register(KeysetLog)
    options = {"path": path, "rev": str(position[0]), "id": str(position[1]), "page": str(page), "pages": str(pages)}
    return spark.readStream.format("keyset_log").schema(StructType.fromJson(json.loads(found["schema"]))).options(**options).load()


@dataclass
class Page(InputPartition):
    """Rows after `low` up to `high`, in row groups (file, number)."""

    low: Key
    high: Key
    groups: tuple[tuple[str, int], ...]


def _between(rows: pa.Table, low: Key, high: Key | None) -> pa.Table:
    rev, id_ = rows.column("rev"), rows.column("id")
    after = pc.or_(pc.greater(rev, low[0]), pc.and_(pc.equal(rev, low[0]), pc.greater(id_, low[1])))
    if high is not None:
        after = pc.and_(after, pc.or_(pc.less(rev, high[0]), pc.and_(pc.equal(rev, high[0]), pc.less_equal(id_, high[1]))))
    return rows.filter(after)


class KeysetLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset_log"

    def streamReader(self, schema: StructType) -> KeysetReader:
        return KeysetReader(self.options, schema.fieldNames())


class KeysetReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.columns = f"{options['path'].rstrip('/')}/rows", columns
        self.page, self.pages = int(options["page"]), int(options["pages"])
        self.at: Key = (int(options["rev"]), int(options["id"]))
        self.ranges: dict[str, list[tuple[int, int, int, int]]] = {}
        self.made: list[Page] = []

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _groups(self, low: Key) -> list[tuple[int, str, int]]:
        """(first rev, file, number) of the row groups that may hold a key after `low`, in order of their keys. Footers are read once.

        Groups are disjoint and sorted, so of two that begin with one rev the earlier one ends with it, and then its bounds of ids are exact."""
        from pyarrow import fs

        system, base = self._system()
        for info in system.get_file_info(fs.FileSelector(base)):
            if info.is_file and info.path.endswith(".parquet") and info.path not in self.ranges:
                with system.open_input_file(info.path) as f:
                    file = pq.ParquetFile(f)
                    at = [file.schema_arrow.names.index(c) for c in ("rev", "id")]
                    stats = [[file.metadata.row_group(g).column(i).statistics for i in at] for g in range(file.num_row_groups)]
                self.ranges[info.path] = [(rev.min, rev.max, id_.min, id_.max) for rev, id_ in stats]
        found = [(*r, path, g) for path, held in self.ranges.items() for g, r in enumerate(held) if (r[1], r[3]) > low]
        return [(r[0], r[4], r[5]) for r in sorted(found)]

    def _keys(self, path: str, group: int) -> pa.Table:
        system, _ = self._system()
        with system.open_input_file(path) as f:
            return pq.ParquetFile(f).read_row_group(group, columns=["rev", "id"])

    def _planned(self, low: Key, high: Key | None, limit: int | None) -> list[Page]:
        """Pages after `low`: up to `high`, or `limit` of them."""
        out: list[Page] = []
        held, last = 0, low
        groups: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal held
            out.append(Page(out[-1].high if out else low, last, tuple(groups)))
            held = 0
            groups.clear()

        for rev, path, group in self._groups(low):
            if high is not None and rev > high[0]:
                break
            some, at = _between(self._keys(path, group), low, high), 0
            while at < some.num_rows and (limit is None or len(out) < limit):
                taken = min(self.page - held, some.num_rows - at)
                at, held = at + taken, held + taken
                last = tuple(some.column(c)[at - 1].as_py() for c in ("rev", "id"))
                groups.append((path, group))
                if held == self.page:
                    close()
            if limit is not None and len(out) >= limit:
                break
        if held:
            close()
        return out

    def initialOffset(self) -> dict:
        return {"rev": self.at[0], "id": self.at[1]}

    def latestOffset(self) -> dict:
        self.made = made = self._planned(self.at, None, self.pages)
        at = made[-1].high if made else self.at
        return {"rev": at[0], "id": at[1]}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        low, high = (start["rev"], start["id"]), (end["rev"], end["id"])
        self.at = max(self.at, high)
        if self.made and (self.made[0].low, self.made[-1].high) == (low, high):
            return self.made  # as latestOffset() planned them
        return self._planned(low, high, None) if low < high else []

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        for path, groups in groupby(partition.groups, lambda g: g[0]):
            with system.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                for _, group in groups:
                    rows = _between(file.read_row_group(group, columns=self.columns), partition.low, partition.high)
                    yield from rows.select(self.columns).to_batches()


def collected_pages(stream: DataFrame, checkpoint: str, step) -> None:
    """Run a stream of pull() through step(rows, number) until its head."""
    query = stream.writeStream.foreachBatch(lambda rows, number: step(rows, number)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()

