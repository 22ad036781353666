"""Lineage cuts in the shared folder, distributed ranks and components.

`spark.checkpoint.dir` names a folder that all executors share; it is read from
the session and only replaced where it is unset, in local mode.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: With it Spark drops the shuffle files of a query when it ends, not when the driver's heap is next collected. Only set while `cut` writes, whose plan is not run again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def own_dir(spark: SparkSession) -> str:
    """The folder of this application: others share the one above it."""
    return f"{shared_dir(spark)}/caselink/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(spark: SparkSession, *written: DataFrame) -> None:
    """Removes tables of `cut` that are read no more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in written:
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(conf).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark takes an explode for a row out of a row, an array for one element and a
    compressed file for its size in memory, so a table many times its bound could be
    gathered on the driver.
    """
    return df.hint("merge")


def drop_shared(spark: SparkSession) -> None:
    """Removes all that `cut` has written in this application; what others keep in the shared folder stays."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _joined(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Union-find over all pairs (a, b) of a task; a class is named by its smallest id."""
        above: dict = {}

        def root(x):
            top = x
            while (up := above.setdefault(top, top)) != top:
                top = up
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
        ids = list(above)
        at = pa.string() if kind == "string" else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(ids, at), pa.array([root(x) for x in ids], at)], ["id", "component"])

    return run


def components(edges: DataFrame, name: str, rounds: int = 60, few: int = 200_000, peel: bool = True) -> DataFrame:
    """(id, component) for every end of `edges` (a, b); component is the smallest id reachable.

    Up to `few` distinct pairs are joined by union-find in one task of an executor:
    one job instead of several a round, each of which leaves its plan and its
    stages with the driver. Beyond that, ends of one pair are set aside (`peel`), and
    among the rest labels spread to neighbours and then jump to the label of their
    label, so a chain of n links takes about log n rounds. Each round is two joins
    and a min that is combined before the shuffle; nothing is gathered on the driver.
    """
    kind = dict(edges.dtypes)["a"]
    once = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    if kind in ("string", "bigint") and once.limit(few + 1).count() <= few:
        return cut(once.repartition(1).mapInArrow(_joined(kind), f"id {kind}, component {kind}"), f"{name}-labels")
    if not peel:
        return _spread(once, name, rounds)
    # Ends of one pair wait for what the other end gets; what is left, often little or nothing, is spread.
    ends = cut(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.min("b").alias("only")), f"{name}-ends")
    one = ends.where("n = 1").select("id", "only")
    least = one.groupBy(F.col("only").alias("id")).agg(F.min("id").alias("least"))
    core = cut(ends.where("n > 1").select("id").join(shuffled(least), "id", "left").select("id", F.least("id", "least").alias("least")), f"{name}-core")
    inner = core.select("id")
    rest = once.join(shuffled(inner), once["a"] == inner["id"], "left_semi").join(shuffled(inner), once["b"] == inner["id"], "left_semi")
    found = components(rest, f"{name}-inner", rounds, few, peel=False)
    placed = core.join(shuffled(found.withColumnRenamed("component", "of")), "id", "left").withColumn("of", F.coalesce("of", "id"))
    lowest = placed.groupBy("of").agg(F.min("least").alias("component"))
    settled = cut(placed.join(shuffled(lowest), "of").select("id", "component"), f"{name}-settled")
    outer = one.join(shuffled(settled.select(F.col("id").alias("only"), "component")), "only", "left").select("id", F.coalesce("component", F.least("id", "only")).alias("component"))
    out = cut(settled.union(outer), f"{name}-labels")
    release(edges.sparkSession, once, ends, core, settled)
    return out


def _spread(once: DataFrame, name: str, rounds: int) -> DataFrame:
    """`components` of distinct pairs, by rounds."""
    links = once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(
        links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"), F.lit(True).alias("changed")),
        f"{name}-labels",
    )
    for _ in range(rounds):
        near = (
            links.join(shuffled(labels.select(F.col("id").alias("b"), "component")), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        before, step = labels, labels.join(shuffled(near), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = cut(step, f"{name}-step")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = cut(
            step.join(shuffled(jump), "component", "left")
            .select("id", F.coalesce("further", "component").alias("component"), "was")
            .select("id", "component", (F.col("component") != F.col("was")).alias("changed")),
            f"{name}-labels",
        )
        release(once.sparkSession, before, step)
        if labels.where("changed").isEmpty():
            return labels.select("id", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def components_in_turn(ids: DataFrame, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """(id, component) for every id of `ids` (id), over links (a, b) given in parts; links with an end that is no id are left out.

    The classes of the parts before stand for their ids, so a part is mostly settled
    by its own distinct values, and no more than one part is on disk at once.
    """
    spark = ids.sparkSession
    labels = cut(ids.select("id").distinct().select("id", F.col("id").alias("component")), f"{name}-turn")
    for part in parts:
        a, b = labels.select(F.col("id").alias("a"), F.col("component").alias("x")), labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
        merged = components(part.select("a", "b").join(shuffled(a), "a").join(shuffled(b), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), name)
        before, labels = labels, cut(labels.join(shuffled(merged.select(F.col("id").alias("component"), F.col("component").alias("less"))), "component", "left").select("id", F.coalesce("less", "component").alias("component")), f"{name}-turn")
        release(spark, before)
    return labels


def ranked(df: DataFrame, name: str, *order: str, rank: str = "rank") -> DataFrame:
    """df with the global position (from 1) in the order of columns, without sorting all rows in one task.

    Rows are dealt by range, numbered within their part, and shifted by the sizes
    of the parts before, of which there are as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(offsets, "__part").withColumn(rank, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")
