"""Tables, words and shared folders, as all operators of this subpackage use them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metalint.session import cut, shuffle_width

__all__ = ["ascii_lower", "cut", "documents", "drop_folder", "fresh", "hashed_sample", "lean_shuffles", "open_folder", "scratch_folder", "shuffle_width", "table", "WORD"]

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query built in here go when the query has ended.

    For jobs of many steps whose results are all on reliable storage: nothing reads those files again, and a lost
    executor costs the step that runs, not the ones before.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About the rows with the smallest hashes, at most the given number: a training sample of bounded size.

    Hashes are thinned out first, so a task hands on a few rows and not its own smallest ones. The same rows in any
    run; all rows of a table that has no more.
    """
    hashed = F.xxhash64(F.col(key), F.lit("sample"))
    every = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(hashed, F.lit(every)) == 0).orderBy(F.xxhash64(key), key).limit(rows)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder that the session names (below the warehouse where it names none)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; works in tasks as well as in the driver."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder.removeprefix("file:"))
    return fs.FileSystem.from_uri(folder)


def drop_folder(folder: str) -> None:
    """Delete a folder; one that nothing was written to does not exist."""
    store, path = open_folder(folder)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then give it its final name: a repeated or killed task leaves no half file."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(part, f"{path}/{name}")
