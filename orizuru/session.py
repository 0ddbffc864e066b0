"""Session factory, table access and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "orizuru", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; `conf` overrides any setting."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is set (tests, local runs)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "orizuru-checkpoints")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared folder, so that later stages and lost executors reread files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared folder, for tables that `written` keeps; deleted in the end."""
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        discard(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` kept in compressed files, a small part of what a checkpoint takes; its owner discards them."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of `scratch`."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """`df` in enough partitions to keep all cores busy; inputs that have them already are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(factor * cores)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context; they may run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_orizuru_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    out = pathlib.Path(tempfile.mkdtemp(prefix="orizuru-")) / "orizuru.zip"
    with zipfile.ZipFile(out, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(str(out))
    sc._orizuru_shipped = True


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by hash of `keys`, written once, so that later joins on them don't move it. Adaptive execution, which
    forgets how a checkpoint is laid out, is off for this one write."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def release(spark: SparkSession) -> None:
    """Let the driver drop the broadcast tables and plans of jobs that are done; they go with a collection of garbage,
    which a driver of little work puts off until its memory is full."""
    spark.sparkContext._jvm.System.gc()


def hashed_sample(df: DataFrame, n: int) -> DataFrame:
    """At most n different rows of `df`, chosen by their hash, the same whatever the partitions. Only about four times as
    many rows as asked for leave the scan; what is left is made different and cut to n."""
    h, share = F.xxhash64(*df.columns), min(1.0, 4.0 * n / max(1, df.count()))
    some = df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else df
    return some.distinct().orderBy(h, *df.columns).limit(n)


@contextmanager
def sorted_joins(spark: SparkSession) -> Iterator[None]:
    """Joins of the jobs run inside are sorted, not broadcast, unless told to: every broadcast table takes pages of the
    driver's memory, however small it is, and a query of a hundred small joins fills it."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
