"""Session helpers: lineage cutting through the shared checkpoint folder, and table sizes that are checked before a broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root


def stage(df: DataFrame, **sums: Column) -> DataFrame:
    """Writes df once to the shared folder and reads it back: the lineage is cut, a lost executor costs nothing, and the planner knows the size.

    The number of rows, and the sums asked for by name, are observed while writing; figure() tells them without another job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c.cast("long")).alias(n) for n, c in sums.items()]).write.parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path, out._figures = path, seen.get
    return out


def figure(staged: DataFrame, name: str = "rows") -> int:
    return staged._figures.get(name) or 0  # a plan that is optimised away as empty reports nothing


def release(*frames: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_stage_path", None)
        if path and _staged.pop(path, None):
            _delete(df.sparkSession, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a step go when the step is written, not when the driver happens to collect its garbage, which more data does not hasten."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_staged.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            break


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once per application, so that executors need no copy of it and the working directory does not matter."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="loomline-")) / "loomline.zip"  # only the driver reads it; Spark serves it to the executors
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def tasks(spark: SparkSession) -> int:
    """Tasks that a compute-bound stage should have: a few per core, so that a straggler does not hold the stage."""
    return max(4, 3 * spark.sparkContext.defaultParallelism)
