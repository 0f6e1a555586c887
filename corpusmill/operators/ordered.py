"""Scans in one order over all rows of a run of any length.

A running sum, a best value so far or a rank needs all rows before. Rows are partitioned by ranges of the order and written with the number of
their range; each range is summed up on its own; the summaries of a run, one for each of its ranges, are folded into what every range starts
from; a second pass starts from that. No task ever holds more than a range, and no window spans a run.

Orders must be unique within a run where results depend on the order of equals. Nulls come first. A run that lies in several ranges has a summary in each:
as many numbers as there are partitions. Names that start with ``_`` and are listed in OWN are the scans' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources.scratch import written

OWN = ("_range", "_run", "_in", "_carry", "_from")


def ranged(rows: DataFrame, order: list[str], run: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``rows`` with ``_run`` (what tells runs apart) and ``_range``: rows of a lower range come first in ``run``, ``order``."""
    clash = {c.lower() for c in rows.columns} & set(OWN)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the scan's own")
    keys = [F.col(f"`{c}`") for c in [*(run or []), *order]]
    keys = [k.desc() for k in keys] if descending else keys
    x = rows.withColumn("_run", F.struct(*[F.col(f"`{c}`") for c in run]) if run else F.lit(0))
    return written(x.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranged")


def within(order: list[str], descending: bool = False, *more: str) -> Window:
    """The window over one range of one run, up to the row."""
    cols = [F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`") for c in order]
    return Window.partitionBy("_run", "_range", *more).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)


def carried(x: DataFrame, summary: dict[str, Column], start: Column, step) -> DataFrame:
    """``x`` with ``_carry``: ``start``, folded by ``step(carry, summary of a range)`` over the ranges of the run that come earlier."""
    parts = x.groupBy("_run", "_range").agg(F.struct("_range", *[v.alias(k) for k, v in summary.items()]).alias("s"))
    runs = parts.groupBy("_run").agg(F.array_sort(F.collect_list("s")).alias("s"))
    # a fold that keeps every value on its way
    begun = F.struct(start.alias("now"), F.array().cast(f"array<{_kind(x, start)}>").alias("kept"))
    folded = F.aggregate("s", begun, lambda a, s: F.struct(step(a["now"], s).alias("now"), F.array_append(a["kept"], a["now"]).alias("kept")), lambda a: a["kept"])
    carry = runs.select("_run", F.explode(F.arrays_zip(F.transform("s", lambda s: s["_range"]).alias("r"), folded.alias("c"))).alias("p"))
    carry = carry.select(F.col("_run").alias("_of"), F.col("p.r").alias("_from"), F.col("p.c").alias("_carry"))
    return x.join(carry, x["_run"].eqNullSafe(carry["_of"]) & (x["_range"] == carry["_from"])).drop("_of", "_from")


def _kind(x: DataFrame, c: Column) -> str:
    return x.limit(0).select(c.alias("c")).schema["c"].dataType.simpleString()


def _done(x: DataFrame, *more: str) -> DataFrame:
    return x.drop("_range", "_run", "_carry", "_in", *more)


def running_total(rows: DataFrame, value: str, order: list[str], out: str, run: list[str] | None = None) -> DataFrame:
    """``out``: the sum of ``value`` from the first row of the run to this one; nulls count as nothing."""
    x = ranged(rows, order, run).withColumn("_in", F.coalesce(F.sum(value).over(within(order)), F.lit(0)))
    zero = F.lit(0).cast(x.schema["_in"].dataType)
    x = carried(x, {"total": F.coalesce(F.sum(value), zero)}, zero, lambda a, s: (a + s["total"]).cast(x.schema["_in"].dataType))
    return _done(x.withColumn(out, F.col("_carry") + F.col("_in")))


def within_budget(rows: DataFrame, cost: str, order: list[str], limit: float, run: list[str] | None = None) -> DataFrame:
    """Rows of each run with ``spent``, up to the one at which the running total exceeds ``limit``; that row is not emitted, nor is any after it."""
    x = ranged(rows, order, run).withColumn("_in", F.coalesce(F.sum(cost).over(within(order)), F.lit(0)))
    kind = x.schema["_in"].dataType
    zero = F.struct(F.lit(0).cast(kind).alias("spent"), F.lit(False).alias("over"))

    def add(a: Column, s: Column) -> Column:
        return F.struct((a["spent"] + s["total"]).cast(kind).alias("spent"), (a["over"] | (a["spent"] + s["peak"] > limit)).alias("over"))

    x = carried(x, {"total": F.coalesce(F.sum(cost), F.lit(0).cast(kind)), "peak": F.max("_in")}, zero, add)
    x = x.where("NOT _carry.over").withColumn("spent", F.col("_carry.spent") + F.col("_in"))
    x = x.withColumn("_over", F.max(F.col("spent") > limit).over(within(order))).where("NOT _over")
    return _done(x, "_over")


def with_ranks(rows: DataFrame, order: list[str], out: str, run: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``out``: the place of the row in its run, from 1."""
    x = ranged(rows, order, run, descending).withColumn("_in", F.row_number().over(within(order, descending)))
    x = carried(x, {"n": F.count("*")}, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return _done(x.withColumn(out, F.col("_carry") + F.col("_in")))


def early_stop(history: DataFrame, patience: int, min_delta: float, loss: str = "eval_loss", step: str = "step", run: list[str] | None = None) -> DataFrame:
    """Evaluations of each run with ``improved`` and ``waited``, up to the one at which ``patience`` in a row have not improved on the best by ``min_delta``.

    A null loss never improves on anything, but at the start of a run.
    """
    own = within([step])
    kind = history.schema[loss].dataType
    x = ranged(history, [step], run)
    x = carried(x, {"least": F.min(loss)}, F.lit(None).cast(kind), lambda a, s: F.least(a, s["least"]))
    best = F.least(F.col("_carry"), F.min(loss).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("improved", F.coalesce(best.isNull() | (F.col(loss) < best - min_delta), F.lit(False))).drop("_carry")
    x = x.withColumn("_g", F.sum(F.col("improved").cast("int")).over(own)).withColumn("_in", F.row_number().over(within([step], False, "_g")))
    # the rows since the last improvement, at the end of each range
    tail = F.max_by("_in", F.struct("_g", "_in"))
    x = carried(x, {"any": F.max("_g") > 0, "tail": tail.cast("long")}, F.lit(0).cast("long"), lambda a, s: F.when(s["any"], s["tail"] - 1).otherwise(a + s["tail"]))
    x = x.withColumn("waited", F.when(F.col("_g") > 0, F.col("_in") - 1).otherwise(F.col("_carry") + F.col("_in")).cast("long"))
    stop = x.where(F.col("waited") >= patience).groupBy(F.col("_run").alias("_of")).agg(F.min(step).alias("_stop"))
    x = x.join(stop, x["_run"].eqNullSafe(stop["_of"]), "left").where(F.col("_stop").isNull() | (F.col(step) <= F.col("_stop")))
    return _done(x, "_g", "_of", "_stop")


def false_discovery(tests: DataFrame, p: str, rate: float = 0.05, run: list[str] | None = None) -> DataFrame:
    """Benjamini and Hochberg's adjusted p over all tests of a run, ``q``, and whether it stays under ``rate``.

    The largest p come first; equal ones share the rank of the last of them and have one q. A null p has none and does not count.
    """
    clash = {c.lower() for c in tests.columns} & {"_n", "_rank", "_of", "q", "rejected"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the scan's own")
    by = run or []
    known = tests.where(F.col(p).isNotNull())
    # equal p are one row of the scan
    each = known.groupBy(*by, p).agg(F.count("*").alias("_n"))
    x = ranged(each, [p], by, descending=True)
    x = x.withColumn("_in", F.sum("_n").over(within([p], True)) - F.col("_n"))
    total = known.groupBy(*by).agg(F.count("*").alias("_m")).select((F.struct(*by) if by else F.lit(0)).alias("_of"), "_m")
    x = carried(x, {"n": F.sum("_n")}, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    x = x.join(total, x["_run"].eqNullSafe(total["_of"])).withColumn("_rank", F.col("_m") - F.col("_carry") - F.col("_in")).drop("_of", "_carry")
    x = x.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_rank")))
    x = carried(x, {"least": F.min("_raw")}, F.lit(None).cast("double"), lambda a, s: F.least(a, s["least"]))
    x = x.withColumn("q", F.least("_carry", F.min("_raw").over(within([p], True))))
    found = x.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate([*by, p])], "q")
    on = [tests[c].eqNullSafe(found[f"_k{i}"]) for i, c in enumerate([*by, p])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return tests.join(found, cond, "left").select(*tests.columns, "q", (F.col("q") <= rate).alias("rejected"))


def range_quantiles(rows: DataFrame, value: str, quantiles: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles by index of values of any number: the item at int(n * q) of a group's sorted values, counted from 0.

    Ranges are counted, and only those that hold an asked index are looked into. Equal values are counted first.
    """
    by = by or []
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    x = ranged(n, [value], by)
    sizes = x.groupBy("_run").agg(F.sum("_n").alias("_all")).withColumnRenamed("_run", "_of")
    asked = F.array(*[F.least(F.floor(F.col("_all") * F.lit(q)), F.col("_all") - 1) for q in quantiles])
    sizes = sizes.select("_of", asked.alias("_asked"))
    span = x.groupBy("_run", "_range").agg(F.sum("_n").alias("_total"))
    span = carried(span, {"n": F.sum("_total")}, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    span = span.join(sizes, span["_run"].eqNullSafe(sizes["_of"])).drop("_of")
    span = span.where(F.exists("_asked", lambda k: (k >= F.col("_carry")) & (k < F.col("_carry") + F.col("_total"))))
    span = span.select(F.col("_run").alias("_of"), F.col("_range").alias("_from"), "_carry", "_asked")
    y = x.join(span, x["_run"].eqNullSafe(span["_of"]) & (x["_range"] == span["_from"])).drop("_of", "_from")
    y = y.withColumn("_upto", F.col("_carry") + F.sum("_n").over(within([value])))
    hit = lambda k: F.max(F.when((F.col("_asked")[k] < F.col("_upto")) & (F.col("_asked")[k] >= F.col("_upto") - F.col("_n")), F.col(value)))
    return y.groupBy(*by).agg(*[hit(k).alias(f"p{q * 100:g}".replace(".", "_")) for k, q in enumerate(quantiles)])
