"""Shared plumbing: tables, lineage cuts in the shared folder, and connected components.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, so a lost executor
costs a re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space as the contracts name it; what stands between is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a cluster it must be named, on one machine a temporary one will do."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cmdlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_ROOTS: list[tuple[SparkSession, str]] = []
#: Seconds between two sweeps.
SWEEP = 3.0


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_workspaces() -> None:
    """Results are read lazily from their workspaces, so these go when the program ends."""
    for spark, root in _ROOTS:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # noqa: BLE001 - the session is gone already
            return


class Workspace:
    """Tables written on the way to a result. ``drop`` frees those the result doesn't read; the rest goes with the program."""

    swept = 0.0

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: lineage is cut, and shuffle files behind it can go."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._cmdlake_path = path
        self.sweep()
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._cmdlake_path)

    def sweep(self) -> None:
        """Lets Spark's cleaner remove shuffle files that nothing refers to any more."""
        if time.monotonic() - Workspace.swept > SWEEP:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            Workspace.swept = time.monotonic()


def connected_components(ws: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of links (a, b); component is its smallest node.

    Alternating large-star and small-star steps: O(log n) rounds whatever the diameter, every
    step a partially aggregated minimum and a join on narrow rows. A hub's rows are combined
    before the shuffle; the minima are dealt anew before the join back, so that both its sides are plain
    exchanges, which adaptive execution splits at a hub.
    """
    edges = ws.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    n, parts, was = 0, int(ws.spark.conf.get("spark.sql.shuffle.partitions")), state(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.repartition(parts), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours of u are all smaller than u here
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.repartition(parts).join(low2.repartition(parts), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        n += 1
        after = ws.write(small.where("u <> v").distinct(), f"{name}-{n}")
        ws.drop(edges)
        edges = after
        if (now := state(edges)) == was:
            break
        was = now
    star = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = star.select(F.col("component").alias("node"), "component").distinct()
    out = ws.write(star.select(F.col("u").alias("node"), "component").union(roots), f"{name}-labels")
    ws.drop(edges)
    return out
