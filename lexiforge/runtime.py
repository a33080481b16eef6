"""Session, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexiforge")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory, cut to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which goes when the process ends; on a cluster executors
    could not share it, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lexiforge-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so what follows neither recomputes it nor loses it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, as a table in columns: for what is read several times, a few columns each."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_BUILT: dict[tuple, tuple] = {}


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files of some tables, summed up: another state if any of them changes. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def once(spark: SparkSession, name: str, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from others, written to the shared folder the first time it is asked for in a session and again only if their files change."""
    key = (spark.sparkContext.applicationId, name, *paths)
    state = state_of(spark, paths)
    if key not in _BUILT or _BUILT[key][0] != state:
        df = make()
        at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        df.write.parquet(at)
        _BUILT[key] = (state, at, df.schema)
    _, at, schema = _BUILT[key]
    return spark.read.schema(schema).parquet(at)
