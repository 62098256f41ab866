"""Written intermediate tables in the shared folder that the session names, and small file operations in any file system that
Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, or a temporary one only where that is unset in local mode, as in tests; deleted when the
    driver's file system client closes."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local = _local or "file://" + tempfile.mkdtemp(prefix="tarn-plans-")
        root = _local
    path = f"{root.rstrip('/')}/tarn/{uuid.uuid4().hex}/{name}"
    fs, place = _at(spark, path)
    fs.deleteOnExit(place.getParent())
    return path


def store(df: DataFrame) -> DataFrame:
    """df written and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def owner_only(spark: SparkSession, path: str) -> None:
    """Nobody but the owner may read or enter a folder."""
    fs, place = _at(spark, path)
    fs.setPermission(place, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small text at a path where nothing is yet, written beside it and moved there whole."""
    fs, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, False)
        raise FileExistsError(f"{path} is there already")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, _, leaf = path.rpartition("/")
    return sorted(int(n[len(leaf) + 1 :]) for n in names_in(spark, folder) if n.startswith(f"{leaf}.") and n[len(leaf) + 1 :].isdigit())


def put_pointer(spark: SparkSession, path: str, text: str, keep: int = 2) -> None:
    """The next of the numbered texts `path`.1, `path`.2, ...: the highest number counts, and none is changed or moved away, so whoever stops
    anywhere in between leaves the one before. All but the last `keep` are dropped afterwards."""
    held = _numbers(spark, path)
    write_new(spark, f"{path}.{(held[-1] if held else 0) + 1}", text)
    for n in held[: len(held) + 1 - keep]:
        delete(spark, f"{path}.{n}")


def pointers(spark: SparkSession, path: str) -> list[str]:
    """The kept texts of put_pointer(), the one that counts first."""
    found = (read_text(spark, f"{path}.{n}") for n in reversed(_numbers(spark, path)))
    return [x for x in found if x is not None]


def get_pointer(spark: SparkSession, path: str) -> str | None:
    """The text of put_pointer() that counts; None if there is none."""
    return next(iter(pointers(spark, path)), None)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text; None if there is no such file."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    source = fs.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
