"""Session settings shared by tests, benchmarks and jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type


def build_session(cores: int | str = "*", app: str = "gleanery", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and measurements. On a cluster the caller brings the session, sized to the job."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rule chains build thousands of Columns; recording a call site for each costs more than planning them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Zone-less text is the source's own wall clock; the catalogue keeps it as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables: spark.checkpoint.dir.

    Only a session that runs in one process, as in a bare local test, may go without: it
    gets a folder of its own. On a cluster a missing setting is an error, since a local folder
    would hold each machine's part alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gleanery-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root, never reused by another run."""
    return f"{shared_root(spark)}/gleanery/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside is never asked for its shuffles again: their files go when the write ends, not when the driver
    happens to collect garbage, so a job of many steps holds those of one step at a time."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def write_step(df: DataFrame, path: str) -> None:
    """A step's rows as files that other steps read: small rather than quick to pack."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder once, or to a path that the caller removes, and read from there."""
    path = path or shared_path(df.sparkSession, name)
    write_step(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as a local relation, whose size the optimizer knows exactly."""
    struct = T._parse_datatype_string(schema)
    arrays = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(struct.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=struct.names), schema=struct)


class Stage:
    """Tables kept for the length of one job: compressed columns in the shared folder, gone when the job ends.

    For rows that are read several times before the job is done. A checkpoint would hold them uncompressed, and for as
    long as the application lives.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, shared_path(spark, name), 0

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *failure) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        write_step(df, path)
        return self.spark.read.schema(df.schema).parquet(path)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint of df in the shared folder (survives a lost executor)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_root(spark)}/gleanery/rdd")
    return df.checkpoint(eager=eager)
