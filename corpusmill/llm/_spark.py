"""What the operators share on the Spark side: scratch tables, sizes, row indexes, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is set, one below the warehouse, if executors share that."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if home.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"{home}/_scratch")
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts its lineage durably."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing will read any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def evaluated(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``build()``, written; the scratch tables that it made on the way are deleted."""
    token = _made.set([])
    try:
        out = materialize(build(), name)
        for t in _made.get()[:-1]:
            discard(t)
    finally:
        _made.reset(token)
    return out


def _scans_files(df: DataFrame) -> bool:
    """Whether the rows of ``df`` are those of Parquet files, one by one."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    files = plan.nodeName().startswith(("LogicalRelation", "Relation")) and plan.toString().rstrip().endswith("parquet")
    return files and "_metadata" not in [*df.columns, *plan.schema().fieldNames()]


def with_place(df: DataFrame, out: str, name: str) -> DataFrame:
    """Add ``out``, a struct of two longs that stays a row's own in every job: its file (hashed) and its place in the file.

    Numbers that follow partitions would not: a scan planned again, on more or fewer executors, is cut otherwise. What is not a plain
    scan of Parquet files (each named once) is written once, with numbers.
    """
    if _scans_files(df):
        return df.withColumn(out, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return materialize(df.withColumn(out, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), name)


def apart(df: DataFrame, core: tuple[str, ...], stage: Callable[[DataFrame], DataFrame], added: tuple[str, ...] = ()) -> DataFrame:
    """``stage`` over the columns ``core``; all others go along in one struct, so that no name can clash with the stage's own.

    Gives the columns of ``df``, then those ``added``, which replace columns of their names.
    """
    more = [c for c in df.columns if c not in core]
    kept = [c for c in df.columns if c.lower() not in added]
    if not more:
        return stage(df).select(*kept, *added)
    x = stage(df.select(*[c for c in df.columns if c in core], F.struct(*[F.col(f"`{c}`") for c in more]).alias("_more")))
    return x.select(*[F.col(f"_more.`{c}`").alias(c) if c in more else F.col(c) for c in kept], *added)


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """Add ``row``, a long that stays a row's own in every job: the number of its file, and its place in it.

    The list of files is broadcast where it is under 64 MB. What is not a plain scan of Parquet files is written once, with numbers.
    """
    if not _scans_files(df):
        return materialize(df.withColumn("row", F.monotonically_increasing_id()), name)
    path = F.col("_metadata.file_path")
    files = df.select(path.alias("_file")).distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file")).cast("long"))
    files = materialize(files, "files")
    files = F.broadcast(files) if plan_bytes(files) < 64 << 20 else files
    x = df.withColumns({"_path": path, "_at": F.col("_metadata.row_index")}).join(files, F.col("_path") == F.col("_file"))
    return x.withColumn("row", F.call_function("shiftleft", "_no", F.lit(40)) + F.col("_at")).drop("_path", "_at", "_file", "_no")


BITS = 1 << 26


def bit(key: str) -> Column:
    """The place of a key in a bitmap of :func:`bitmap`."""
    return F.pmod(F.xxhash64(key), F.lit(BITS)).alias("_bit")


def bitmap(keys: DataFrame, key: str) -> Broadcast:
    """A broadcast bitmap of fixed size in which the places of all ``keys`` are set; see :func:`marked`."""
    at = keys.select(bit(key))
    word = at.groupBy(F.expr("_bit div 32").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 32).cast("int"))).alias("m")).toArrow()
    words = np.zeros(BITS // 32, np.uint32)
    words[word.column("w").to_numpy()] = word.column("m").to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(words)


def marked(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the places are set: true for all keys of the bitmap, and for some others."""
    return (words[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``: file bytes for a scan, with no job run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, mb: float, least: int = 8) -> int:
    """Number of pieces of about ``mb`` megabytes that ``df`` divides into."""
    return int(min(1 << 24, max(least, plan_bytes(df) / (mb * 1e6))))


def same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality of the columns of two frames."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def running_offset(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int, deal: list[str] | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come earlier.

    Rows of a group are dealt over ``buckets`` by a hash, so a group of any size is worked on by
    many tasks: sums by bucket, an offset for each bucket, and a running sum within each bucket.
    Names that start with ``_off_`` are its own. The order is that of (bucket, ``order``): fixed, but not that of ``order`` alone. Buckets go by the columns ``deal``, else by ``order``.
    """
    x = df.withColumn("_off_bucket", F.pmod(F.xxhash64(*(deal or order)), F.lit(buckets)).cast("int")).withColumn("_off_value", value)
    sums = x.groupBy(*group, "_off_bucket").agg(F.sum("_off_value").alias("_off_sum"))
    before = Window.partitionBy(*group).orderBy("_off_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_off_base", F.coalesce(F.sum("_off_sum").over(before), F.lit(0)))
    base = base.select(*[F.col(c).alias(f"_off_g{i}") for i, c in enumerate(group)], F.col("_off_bucket").alias("_off_gb"), "_off_base")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_off_g{i}")) for i, c in enumerate(group)], F.col("_off_bucket") == F.col("_off_gb"))
    within = Window.partitionBy(*group, "_off_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_off_in", F.coalesce(F.sum("_off_value").over(within), F.lit(0)))
    drop = ["_off_bucket", "_off_value", "_off_gb", "_off_base", "_off_in", *[f"_off_g{i}" for i in range(len(group))]]
    return x.join(base, on).withColumn(out, (F.col("_off_base") + F.col("_off_in")).cast("long")).drop(*drop)


def _out_of_place(e: DataFrame) -> int:
    """Nodes of the distinct edges (u, v), u > v, that have two smaller neighbours, or a smaller and a larger one."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.count("*").alias("n"))
    return nodes.where("ups > 0 AND n > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the smallest node reachable.

    Alternates large-star and small-star contraction (Kiveris et al., 2014). Each round is written
    to the shared folder; the driver only sees the number of nodes that are not yet in place. When there are none, the edges are
    stars around their smallest node, which no round would change.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, name)
    for _ in range(most_rounds):
        if not _out_of_place(e):
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, name)
        discard(e)
        e = now
    else:
        if _out_of_place(e):
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
