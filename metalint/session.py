"""Sessions and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("metalint")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; in local mode one below the warehouse where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    context.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage and drop the lineage; a lost executor costs a re-read, not a rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join of which neither side is to be broadcast.

    Spark sees the size of the files behind a column, not the size of what is made from it: texts written from keys, or
    rows unrolled from texts, are many times larger, and a broadcast passes through the driver.
    """
    return df.hint("merge")


def few_or_shuffled(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df cut, to be broadcast if it has few rows by count; otherwise shuffled."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else shuffled(kept)


#: Rows that one task takes where a table is dealt by its row count.
TASK_ROWS = 500_000


def tasks_for(rows: int) -> int:
    return -(-rows // TASK_ROWS)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df by hash of keys in that many partitions; left to Spark where it has as many cores.

    Spark makes as many tasks as there are cores as long as none reads above 64 MB, and 64 MB of packed rows with like
    values can be ten times as much in a sort or an aggregate. So tasks follow the number of rows of large tables.
    """
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def ordered(df: DataFrame, tasks: int, *order: Column | str) -> DataFrame:
    """df in order, in that many ranges; the number of ranges is left to Spark where it has as many cores."""
    ranges = df.repartitionByRange(tasks, *order) if tasks > df.sparkSession.sparkContext.defaultParallelism else df
    return ranges.orderBy(*order)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, part: str, *order: str) -> DataFrame:
    """Write df once as Parquet in the shared folder, a folder for each value of part and rows by order, and read it back.

    Readers that filter part and name their columns open just these; a lost executor costs a re-read. The folder goes
    with the checkpoint folder, or by `drop_staged`.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.sortWithinPartitions(part, *order).write.partitionBy(part).option("compression", "zstd").parquet(folder)
    columns = [f for f in df.schema if f.name != part]
    return spark.read.schema(type(df.schema)([*columns, df.schema[part]])).parquet(folder)


def stored(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder, rows as they come, and read it back; readers open their columns only."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table; nothing that reads it can be used afterwards."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Buckets:
    """A table laid out by key: in the shared folder, as many buckets as shuffles have partitions, grown by `add`.

    A join or distinct on exactly these keys needs no shuffle of this table, however large it has become; only the
    other side moves. The name in the catalogue is there for the scan to know the layout, `release` takes it back; the
    files stay in the shared folder. Each `add` is a batch of its own, which `batch` reads alone.
    """

    def __init__(self, df: DataFrame, keys: list[str]):
        self.spark, self.keys = df.sparkSession, list(keys)
        ensure_checkpoint_dir(self.spark)
        token = uuid.uuid4().hex
        self.name, self.folder = f"metalint_{token}", f"{self.spark.sparkContext.getCheckpointDir()}/buckets-{token}"
        self.width, self.batches = shuffle_width(self.spark), 0
        self.columns = df.columns
        self.add(df.repartition(self.width, *self.keys))

    def add(self, df: DataFrame) -> None:
        """Append df as the next batch; where it is dealt by the keys already, every bucket gets one file at most."""
        batch = df.select(*self.columns, F.lit(self.batches).alias("_batch"))
        batch.write.format("parquet").option("path", self.folder).mode("append").partitionBy("_batch").bucketBy(
            self.width, *self.keys).sortBy(*self.keys).saveAsTable(self.name)
        self.batches += 1

    def all(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def batch(self, number: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("_batch") == number).select(*self.columns)

    def release(self) -> DataFrame:
        """All rows as plain files; the layout is forgotten."""
        schema = self.spark.table(self.name).schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.folder).select(*self.columns)
