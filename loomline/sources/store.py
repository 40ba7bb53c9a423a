"""Versioned graph tables in Parquet under one commit log, so that nodes, edges and vectors of a commit are visible together or not at all.

base/_commits/<version>.json lists, per table, the folders that make up the version; base/<table>/<attempt>/_version=<version>/ holds the rows of one attempt to
commit, so two writers never write to one place. A commit's log entry is written last, by creating the file, which fails if another writer took the version; on
object stores that needs a file system whose create without overwrite is a conditional put. An overwrite starts from new folders only; an append adds its folder
to those of the version before, until compact() makes them one.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import epoch_ms_to_iso, iso_to_epoch_ms
from loomline.model import COMMITS, EDGES, NODES, VECTORS, Graph
from loomline.sources.tables import last_wins

#: Milliseconds by which a commit may lie after the time asked for and still be taken.
TOLERANCE_MS = 100
TABLES = {"nodes": (NODES, ["id"]), "edges": (EDGES, ["source_id", "target_id", "type"]), "vectors": (VECTORS, ["id"])}


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._fs = None

    def _path(self, p: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{p}")
        self._fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return path

    def log(self) -> list[dict]:
        """The commits in ascending order of version. The log has an entry per commit, not per row."""
        path = self._path("_commits")
        if not self._fs.exists(path):
            return []
        rows = self.spark.read.text(f"{self.base}/_commits", wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda c: c["version"])

    def commits(self) -> DataFrame:
        """version, ts, operation."""
        log = [(c["version"], c["ts_ms"], c["operation"]) for c in self.log()]
        df = self.spark.createDataFrame(log, "version long, ms long, operation string")
        return df.select("version", F.timestamp_millis("ms").alias("ts"), "operation").to(COMMITS)

    def write(self, mode: str = "overwrite", ts_ms: int | None = None, batch: str | None = None, **tables: DataFrame) -> int:
        """Commits nodes, edges and vectors (each optional) and returns the version. A failed write leaves no commit and raises. batch: a name under which this
        is committed once only; if the log has it, its version is returned and nothing is written."""
        if mode not in ("overwrite", "append"):
            raise ValueError("mode is overwrite or append")
        log = self.log()
        if batch is not None and (before := [c["version"] for c in log if c.get("batch") == batch]):
            return before[0]
        attempt = uuid.uuid4().hex
        version = log[-1]["version"] + 1 if log else 0
        held = {t: list(log[-1]["tables"].get(t, [])) if log and mode == "append" else [] for t in TABLES}
        for name, df in tables.items():
            if df is None:
                continue
            schema, _ = TABLES[name]
            rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
            if name == "nodes":
                rows = rows.withColumn("description", F.coalesce("description", F.lit(""))).withColumn("properties", F.coalesce("properties", F.lit("{}")))
            elif name == "edges":
                rows = rows.withColumn("properties", F.coalesce("properties", F.lit("{}")))
            else:
                rows = rows.filter("vector is not null")
            out = f"{name}/{attempt}/_version={version}"
            rows.withColumn("_seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.base}/{out}")
            held[name].append(out)
        entry = {"version": version, "ts_ms": ts_ms if ts_ms is not None else time.time_ns() // 1_000_000, "operation": mode, "tables": held}
        if batch is not None:
            entry["batch"] = batch
        return self._commit(entry)

    def compact(self, ts_ms: int | None = None) -> int:
        """Commits the newest version again with one folder per table, without the rows that later ones replaced; the versions before stay readable."""
        return self.write("overwrite", ts_ms, **{name: self.table(name) for name in TABLES})

    def _commit(self, entry: dict) -> int:
        version = entry["version"]
        stream = None
        path = self._path(f"_commits/{version:012d}.json")
        try:
            stream = self._fs.create(path, False)
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            if stream is not None:
                stream.close()
        return version

    def resolve(self, as_of: str | int | None) -> int | None:
        """The version that as_of names: the newest for None, a number for digits, else the newest commit up to that time plus the tolerance; None before
        the first. Text that is neither raises."""
        return self._resolve(as_of, self.log())

    def _resolve(self, as_of: str | int | None, log: list[dict]) -> int | None:
        if not log:
            return None
        if as_of is None or as_of == "":
            return log[-1]["version"]
        if str(as_of).isdigit():
            if int(as_of) not in {c["version"] for c in log}:
                raise ValueError(f"there is no version {as_of}")
            return int(as_of)
        ms = self.spark.range(1).select(iso_to_epoch_ms(F.lit(str(as_of))).alias("ms")).first()[0]
        if ms is None:
            raise ValueError(f"neither a version nor a time: {as_of}")
        fit = [c for c in log if c["ts_ms"] <= ms + TOLERANCE_MS]
        return max(fit, key=lambda c: (c["ts_ms"], c["version"]))["version"] if fit else None

    def table(self, name: str, as_of: str | int | None = None) -> DataFrame:
        """The rows of a table at a version, the last of each key; before the first commit none."""
        schema, keys = TABLES[name]
        log = self.log()
        version = self._resolve(as_of, log)
        dirs = next((c["tables"].get(name, []) for c in log if c["version"] == version), [])
        if not dirs:
            return self.spark.createDataFrame([], schema)
        # one scan over all folders; the version of a row is its folder's
        stored = T.StructType([*schema.fields, T.StructField("_seq", T.LongType())])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.base}/{d}" for d in dirs])
        rows = rows.withColumn("_version", F.regexp_extract(F.col("_metadata.file_path"), r"/_version=(\d+)/", 1).cast("long"))
        return last_wins(rows, keys, ["_version", "_seq"]).select(*schema.fieldNames())

    def graph(self, as_of: str | int | None = None) -> Graph:
        return Graph(self.table("nodes", as_of), self.table("edges", as_of))

    def timeline(self) -> DataFrame:
        """version, timestamp (text), timestamp_ms, operation, in ascending order."""
        return timeline(self.commits())


def timeline(commits: DataFrame) -> DataFrame:
    ms = F.unix_millis("ts")
    return commits.select("version", epoch_ms_to_iso(ms).alias("timestamp"), ms.alias("timestamp_ms"), "operation").orderBy("version")


def versions_at(times: DataFrame, commits: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """times with `version`: the newest commit up to each row's ts plus the tolerance, null before the first.

    The log has one row per commit; it is sorted once and goes to the workers as an array, in which each row's time is found by bisection. The rows are neither
    shuffled nor joined.
    """
    log = commits.select(F.unix_micros("ts"), "version").filter("ts is not null").orderBy("ts", "version").collect()
    at = np.array([r[0] for r in log], dtype=np.int64)
    versions = pd.array([None, *[r[1] for r in log]], dtype="Int64")

    @F.pandas_udf("long")
    def found(us: pd.Series) -> pd.Series:
        place = np.searchsorted(at, us.fillna(-(1 << 62)).to_numpy(np.int64) + tolerance_ms * 1000, side="right")
        return pd.Series(versions.take(place))

    return times.withColumn("version", found(F.unix_micros("ts")))
