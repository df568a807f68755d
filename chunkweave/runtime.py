"""Session, table and materialisation helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that an operator broadcasts by hint.
BROADCAST_LIMIT = 32 << 20


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-node session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chunkweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_chunkweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="chunkweave-")) / "chunkweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    context._chunkweave_shipped = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset a new one, only if all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_by = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by.isDefined():
            return set_by.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chunkweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    A written table survives the loss of executors, is columnar and carries its size, so later joins
    are planned from real figures.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores.

    Only for CPU-bound Python steps: a table of many files or row groups already has more splits than
    cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df if len(files) >= cores else df.repartition(cores * per_core)


def size_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only where the estimated size is within ``limit``."""
    return F.broadcast(df) if size_bytes(df) <= limit else df


def first_rows(df: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """One row per key: the earliest by ``at`` (nulls last). Null keys are dropped.

    Uses ``min_by`` over the whole row so that it is pre-aggregated before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    order = F.coalesce(F.col(f"`{at}`"), F.lit("9999-12-31").cast("timestamp")) if at else F.lit(0)
    out = (
        df.filter(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias(key))
        .agg(F.min_by(row, order).alias("__row"))
    )
    return out.select(key, *[F.col("__row").getField(c).alias(c) for c in others])


def once_per_key(df: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """One row per key like :func:`first_rows`, but only repeated keys are shuffled; rows with a null key stay.

    For wide rows of which few are repeated: the keys alone are counted, and rows of keys that occur once stay where they are.
    """
    many = written(df.groupBy(key).agg(F.count("*").alias("__n")).filter(f"__n > 1 AND `{key}` IS NOT NULL").select(key), "repeated-keys")
    many = broadcast_if_small(many)
    return df.join(many, key, "left_anti").select(*df.columns).unionByName(first_rows(df.join(many, key, "left_semi"), key, at).select(*df.columns))
