"""Sources and sinks other than tables: blobs, workspaces, states and caches, the claim log, the mirror's files, mount files, results.

Paths are in any file system that Spark reaches. Walks and files of a mirror are listed, read and written by tasks; all else but write_out()
goes through Spark's own readers and writers.
"""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tarn.functions import rules
from tarn.operators import changes
from tarn.sources import scratch


def blobs(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """(id, content) of files named by an id, for the asked ids(id): the file list is joined before any content is read."""
    files = spark.read.format("binaryFile").load(folder)
    named = files.withColumn("id", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return named.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("id", "content")


def workspaces(spark: SparkSession, path: str) -> DataFrame:
    """(id, handle, name) of JSON lines; malformed rows and rows without an id are dropped, control characters are scrubbed."""
    rows = spark.read.schema("id string, handle string, name string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null and id is not null").select("id", rules.sanitize(F.col("handle")).alias("handle"), rules.sanitize(F.col("name")).alias("name"))


class SavedTable:
    """A table that is replaced as a whole: each save writes a new folder and then the next of numbered pointers, so a reader finds the
    old table or the new one wherever a writer stops. The table before is kept until the next save, for those who still read it.
    `stamp` goes with the table, for derived caches, which only their owner may read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, df: DataFrame, stamp: dict | None = None) -> None:
        name = f"table-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        if stamp is not None:
            scratch.owner_only(self.spark, f"{self.path}/{name}")
        scratch.put_pointer(self.spark, f"{self.path}/CURRENT", json.dumps({"folder": name, "schema": df.schema.json(), "stamp": stamp}))
        kept = {found["folder"] for raw in scratch.pointers(self.spark, f"{self.path}/CURRENT") if (found := _parsed(raw))}
        for folder in scratch.names_in(self.spark, self.path):
            if folder.startswith("table-") and folder not in kept:
                scratch.delete(self.spark, f"{self.path}/{folder}")

    def _pointer(self, strict: bool) -> dict | None:
        raw = scratch.get_pointer(self.spark, f"{self.path}/CURRENT")
        found = _parsed(raw) if raw is not None else None
        if strict and raw is not None and found is None:
            raise ValueError(f"the pointer of {self.path} cannot be parsed")
        return found

    def _table(self, pointer: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(pointer["schema"]))).parquet(f"{self.path}/{pointer['folder']}")

    def load(self) -> DataFrame | None:
        """The table; None if nothing was saved. A pointer that cannot be parsed is an error."""
        pointer = self._pointer(strict=True)
        return self._table(pointer) if pointer else None

    def load_cache(self, stamp: dict) -> DataFrame | None:
        """The table if it was saved with this very stamp; None if it was not, is absent, or is corrupt."""
        pointer = self._pointer(strict=False)
        if not pointer or pointer.get("stamp") != stamp or not scratch.exists(self.spark, f"{self.path}/{pointer['folder']}"):
            return None
        return self._table(pointer)

    def clear(self) -> None:
        """Forget the table; also where there is none."""
        scratch.delete(self.spark, self.path)


def _parsed(raw: str) -> dict | None:
    try:
        found = json.loads(raw)
        found["folder"], found["schema"]
        return found
    except (ValueError, KeyError, TypeError):
        return None


def append_claims(new: DataFrame, path: str) -> None:
    """Append claims(id, rev) to a log of `id rev` lines: of each id the largest, and only where the log does not cover it yet, so the same claims
    given again write nothing."""
    fresh = changes.new_claims(changes.fold_claims(new), claims(new.sparkSession, path))
    fresh = scratch.store(fresh.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("rev").cast("string")).alias("value")))
    if not fresh.isEmpty():
        fresh.write.mode("append").text(path)


def claims(spark: SparkSession, path: str) -> DataFrame:
    """(id, rev): the largest revision of each id in a log of claims; garbled lines are skipped, a missing log is empty."""
    if not scratch.exists(spark, path):
        return spark.createDataFrame([], "id long, rev long")
    parts = F.regexp_extract_all(F.trim("value"), F.lit(r"^(-?[0-9]+) (-?[0-9]+)\z"), 0)
    rows = spark.read.text(path).filter(F.size(parts) == 1).select(F.split(parts[0], " ").alias("p"))
    typed = rows.select(F.col("p")[0].try_cast("bigint").alias("id"), F.col("p")[1].try_cast("bigint").alias("rev")).filter("id is not null and rev is not null")
    return typed.groupBy("id").agg(F.max("rev").alias("rev"))


def _listed(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """(path, is_folder, size) of what stands right in each folder of a root."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
            found = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
            for low in range(0, len(found), 10_000):
                some = found[low : low + 10_000]
                paths, folders, sizes = [f.path[len(base) + 1 :] for f in some], [f.type == fs.FileType.Directory for f in some], [f.size or 0 for f in some]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())], ["path", "is_folder", "size"])


def walk(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """(path, is_folder, size) of all that stands below a root, empty files and folders too: folders are listed level by level in tasks, so
    no name passes the driver, which only asks of each level how many folders it has."""
    level, wide = spark.createDataFrame([("",)], "path string"), 1
    out = None
    while True:
        found = scratch.store(level.repartition(wide).mapInArrow(lambda b: _listed(b, root), "path string, is_folder boolean, size long"))
        out = found if out is None else out.unionByName(found)
        level = found.filter("is_folder").select("path")
        wide = min(tasks, level.count())
        if not wide:
            return out


def _digested(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """(path, digest) of files, read in pieces."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    for batch in batches:
        paths, digests = batch.column(0).to_pylist(), []
        for path in paths:
            running = hashlib.sha256()
            with system.open_input_stream(f"{base.rstrip('/')}/{path}") as source:
                while piece := source.read(1 << 20):
                    running.update(piece)
            digests.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(digests, pa.string())], ["path", "digest"])


def mirror(spark: SparkSession, root: str, control_files: tuple[str, ...] = ()) -> DataFrame:
    """(path, is_folder, digest) of what stands below a root; control files at the root are left out."""
    found = walk(spark, root)
    found = found.filter(F.substring_index("path", "/", 1) != STAGE)
    files = found.filter("not is_folder").filter(~F.col("path").isin(*control_files)) if control_files else found.filter("not is_folder")
    digests = files.select("path").mapInArrow(lambda b: _digested(b, root), "path string, digest string")
    folders = found.filter("is_folder").select("path", F.lit(True).alias("is_folder"), F.lit(None).cast("string").alias("digest"))
    return digests.select("path", F.lit(False).alias("is_folder"), "digest").unionByName(folders)


STAGE = ".stage"


class MirrorSink(DataSource):
    """Files of rows (path, content), staged below a root by tasks: a task writes into a folder of its own attempt, the commit names the
    folders of the attempts that count, and an abort removes all of them."""

    @classmethod
    def name(cls) -> str:
        return "mirror_files"

    def writer(self, schema: StructType, overwrite: bool) -> StageWriter:
        return StageWriter(self.options["root"], self.options["job"])


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class StageWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.stage = root.rstrip("/"), f"{root.rstrip('/')}/{STAGE}/{job}"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.stage)

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, stage = self._system()
        name, n = uuid.uuid4().hex, 0
        for path, content in iterator:
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"{path!r} leaves the folder")
            target = f"{stage}/{name}/{path}"
            system.create_dir(os.path.dirname(target), recursive=True)
            with system.open_output_stream(target) as out:
                out.write(content or b"")
            n += 1
        return Staged(name, n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, stage = self._system()
        system.create_dir(stage, recursive=True)
        with system.open_output_stream(f"{stage}/COMMITTED") as out:
            out.write("\n".join(m.folder for m in messages if m is not None and m.files).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, stage = self._system()
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)


def write_files(df: DataFrame, root: str, read_only: bool = True) -> DataFrame:
    """Write each of df(path, content) below a root that all executors share; returns (path, size) as written. A path that leaves the root is
    an error, and then nothing is written.

    Files are staged whole below the root, then moved to their places by tasks (again, if a task is lost in between: what was
    moved is not there any more), and are read-only where the file system knows such a thing. Whatever dies on the way leaves no part of a
    file in its place; what a task stages after its job was given up goes with sweep_stage().
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(MirrorSink)
    stage = f"{root.rstrip('/')}/{STAGE}/{job}"
    try:
        df.select("path", F.col("content").cast("binary").alias("content")).write.format("mirror_files").mode("append").options(root=root, job=job).save()
        folders = (scratch.read_text(spark, f"{stage}/COMMITTED") or "").split()
        staged = walk(spark, stage).filter("not is_folder").withColumn("folder", F.substring_index("path", "/", 1)) if folders else None
        if staged is None:
            return spark.createDataFrame([], "path string, size long")
        staged = staged.filter(F.col("folder").isin(folders)).select("folder", F.expr("substring(path, length(folder) + 2)").alias("path"), "size")
        return scratch.store(staged.mapInArrow(lambda b: _placed(b, root, stage, read_only), "path string, size long"))
    finally:
        scratch.delete(spark, stage)
        if not scratch.names_in(spark, os.path.dirname(stage)):
            scratch.delete(spark, os.path.dirname(stage))


def sweep_stage(spark: SparkSession, root: str) -> None:
    """Remove what tasks staged after their job had been given up; for when nothing else is being written below the root."""
    scratch.delete(spark, f"{root.rstrip('/')}/{STAGE}")


def _placed(batches: Iterator[pa.RecordBatch], root: str, stage: str, read_only: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    _, staged = fs.FileSystem.from_uri(stage)
    for batch in batches:
        for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            source, target = f"{staged}/{folder}/{path}", f"{base.rstrip('/')}/{path}"
            if system.get_file_info(source).type == fs.FileType.NotFound:
                continue  # moved by an attempt that was lost
            system.create_dir(os.path.dirname(target), recursive=True)
            if read_only and isinstance(system, fs.LocalFileSystem):
                os.chmod(source, 0o444)
            system.move(source, target)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["path", "size"])


def mount_table(spark: SparkSession, raw: str) -> DataFrame:
    """(workspace, name, dir, scope, server) of a TOML text with a server and [[mount]] entries; ValueError if it cannot be parsed."""
    try:
        found = tomllib.loads(raw)
        rows = [(m["workspace"], m.get("name"), m.get("dir", ""), m.get("folder"), found["server"]) for m in found.get("mount", [])]
    except (tomllib.TOMLDecodeError, KeyError) as e:
        raise ValueError(f"not a mount file: {e}") from None
    return spark.createDataFrame(rows, "workspace string, name string, dir string, scope string, server string")


def to_lines(df: DataFrame) -> DataFrame:
    """(value): one line a row, values joined by tabs, control characters scrubbed, nulls empty."""
    return df.select(F.concat_ws("\t", *(F.coalesce(rules.sanitize(F.col(c).cast("string")), F.lit("")) for c in df.columns)).alias("value"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON object a row, without null fields, names in camel case."""

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(x.title() for x in rest)

    return df.select(F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in df.columns)), {"ignoreNullFields": "true"}).alias("value"))


def write_out(content: bytes, path: str, mounts: list[str], force: bool = False) -> None:
    """Write one file's bytes to a user's path: refused if its folder is missing or lies in a mount, if the path is a link or a folder,
    or if it exists and is not forced."""
    target = os.path.abspath(path)
    folder = os.path.realpath(os.path.dirname(target))
    if not os.path.isdir(folder):
        raise NotADirectoryError(f"{folder} is not a folder")
    for m in map(os.path.realpath, mounts):
        if folder == m or folder.startswith(m + os.sep):
            raise PermissionError(f"{target} lies in the mount {m}")
    if os.path.islink(target) or os.path.isdir(target):
        raise PermissionError(f"{target} is a link or a folder")
    if os.path.exists(target) and not force:
        raise FileExistsError(f"{target} exists")
    beside = f"{target}.{uuid.uuid4().hex[:8]}.tmp"
    with open(beside, "wb") as out:
        out.write(content)
    os.replace(beside, target)
