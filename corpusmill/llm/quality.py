"""Quality rules with adaptive thresholds (operator 9), in DataFrame functions only.

Every document gets counts from its whole text. Four ratios of these counts, in thousandths, go
into one quantile sketch per (language, source, ratio): a histogram whose cells keep the leading
seven bits of the value, so a quantile is off by less than 1/64 of itself. Sketches are counts by
cell; they merge by addition, in any order, with the same outcome. A group's limits come from its
own sketch: third quartile plus ``spread`` times its distance from the median, plus a slack for
groups without variation (the word length also has a lower limit, mirrored at the first quartile).

Cases: a null or empty text has no words, all counts 0, and fails; null languages and sources form
groups of their own; repeated rows count as often as they occur; other columns pass through
untouched, but for those that start with ``q_``, which are the operator's own and are replaced; an empty table
gives an empty result. The slack of a ratio is what a group without variation may stray: that of repeated lines is 400 in
a thousand, as one line that comes again in a text of two or three is no sign of bad quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm._spark import SPACE, materialize

#: ratio: (numerator, denominator, slack in thousandths)
RATIOS = {
    "word_length": ("q_word_chars", "q_words", 1500),
    "symbols": ("q_symbols", "q_words", 150),
    "dup_lines": ("q_dup_lines", "q_lines", 400),
    "repeats": ("q_repeat_words", "q_words", 300),
}
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambda bodies otherwise compute it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice among ``words``."""
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_grams(h), _covered))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found)


def _grams(h: Column) -> Column:
    return F.zip_with(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.slice(h, 3, F.size(h)), lambda a, z: F.when(z.isNotNull(), F.xxhash64(a["x"], a["y"], z)))


def _covered(g: Column) -> Column:
    """``g`` ends with two nulls, where no window starts."""
    some = let(F.array_sort(F.transform(F.slice(g, 1, F.size(g) - 2), lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _positions)
    return F.when(F.size(F.array_distinct(g)) == F.size(g) - 1, F.lit(0)).otherwise(some)


def _positions(s: Column) -> Column:
    flagged = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]).otherwise(F.lit(-1)))
    step = F.aggregate(
        F.array_sort(F.filter(flagged, lambda i: i >= 0)),
        F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(3), i - a["p"])).alias("n")),
    )
    return step["n"]


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add q_words, q_word_chars, q_symbols, q_lines, q_dup_lines and q_repeat_words (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    x = df.withColumn("q_w", words).withColumn("q_l", lines)
    x = x.withColumns(
        {
            "q_words": F.size("q_w").cast("long"),
            "q_word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "q_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "q_lines": F.size("q_l").cast("long"),
            "q_dup_lines": (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"),
            "q_repeat_words": repeated_words(F.col("q_w")).cast("long"),
        }
    )
    return x.drop("q_w", "q_l")


def ratio(name: str) -> Column:
    over, under, _ = RATIOS[name]
    return F.expr(f"{over} * 1000 div greatest({under}, 1L)")


def cell(v: Column) -> Column:
    """Lower end of the sketch cell of a whole number: its seven leading bits."""
    bits = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    low = F.call_function("shiftright", v, bits)
    return F.call_function("shiftleft", low, bits)


def limits(counted: DataFrame, lang: str, source: str, spread: int) -> DataFrame:
    """One row per (language, source): q_low_word_length and q_high_<ratio>, in thousandths."""
    long = counted.where("q_words > 0").select(
        F.col(lang).alias("q_lang"),
        F.col(source).alias("q_source"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("r"), cell(ratio(r)).alias("cell")) for r in RATIOS])).alias("m"),
    )
    sketch = long.groupBy("q_lang", "q_source", F.col("m.r").alias("r"), F.col("m.cell").alias("cell")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("q_lang", "q_source", "r")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("cell"))).alias(f"p{k}")
    q = ranked.groupBy("q_lang", "q_source", "r").agg(*[quartile(k) for k in (1, 2, 3)])
    slack = F.create_map(*[F.lit(v) for r, (_, _, s) in RATIOS.items() for v in (r, s)])
    q = q.withColumn("high", F.col("p3") + spread * (F.col("p3") - F.col("p2")) + slack[F.col("r")])
    q = q.withColumn("low", F.col("p1") - spread * (F.col("p2") - F.col("p1")) - slack[F.col("r")])
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    return q.groupBy("q_lang", "q_source").agg(*[pick(r, "high").alias(f"q_high_{r}") for r in RATIOS], pick("word_length", "low").alias("q_low_word_length"))


def judge_quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_words: int = 50, spread: int = 4, carry_text: bool = True) -> DataFrame:
    """``df`` with the counts, q_base_failed and q_kept.

    q_base_failed: fewer than ``least_words`` words, or over half of the words in repeated 3-word windows.
    q_kept: not that, and all ratios within the limits of the document's language and source.
    The counted rows are written once (without ``text`` if ``carry_text`` is false); limits are a small
    table of one row per group, read back at its true size, so Spark broadcasts it only while it is small.
    """
    counted = with_counts(df, text)
    counted = materialize(counted if carry_text else counted.drop(text), "quality")
    fence = materialize(limits(counted, lang, source, spread), "quality-limits")
    x = counted.join(fence, counted[lang].eqNullSafe(fence["q_lang"]) & counted[source].eqNullSafe(fence["q_source"]), "left")
    failed = (F.col("q_words") < least_words) | (F.col("q_repeat_words") * 100 > F.col("q_words") * 50)
    inside = ratio("word_length") >= F.col("q_low_word_length")
    for r in RATIOS:
        inside &= ratio(r) <= F.col(f"q_high_{r}")
    x = x.withColumn("q_base_failed", failed).withColumn("q_kept", ~failed & F.coalesce(inside, F.lit(False)))
    return x.drop("q_lang", "q_source", "q_low_word_length", *[f"q_high_{r}" for r in RATIOS])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    x = judge_quality(docs, carry_text=False)
    names = {"q_words": "n_words", "q_word_chars": "word_chars", "q_symbols": "n_symbols", "q_dup_lines": "n_dup_lines", "q_repeat_words": "n_repeat_words", "q_base_failed": "base_failed", "q_kept": "kept"}
    return x.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row_number() OVER () AS rid, *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
p AS (SELECT rid, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM p) WHERE c > 1),
rw AS (SELECT rid, sum(least(3, i - coalesce(prev, -5))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM r) GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(w) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
      FROM g LEFT JOIN rw USING (rid)),
m AS (SELECT *, word_chars * 1000 // greatest(n_words, 1) AS m1, n_symbols * 1000 // greatest(n_words, 1) AS m2,
        n_dup_lines * 1000 // greatest(n_lines, 1) AS m3, n_repeat_words * 1000 // greatest(n_words, 1) AS m4 FROM c),
u AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS r, unnest([m1, m2, m3, m4]) AS v FROM m WHERE n_words > 0),
s AS (SELECT lang, source, r, ((v::BIGINT >> greatest(length(bin(v::BIGINT)) - 7, 0)) << greatest(length(bin(v::BIGINT)) - 7, 0)) AS cell, count(*) AS n FROM u GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, r ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lang, source, r) AS total FROM s),
q AS (SELECT lang, source, r, min(cell) FILTER (upto * 4 >= total) AS p1, min(cell) FILTER (upto * 4 >= total * 2) AS p2, min(cell) FILTER (upto * 4 >= total * 3) AS p3 FROM k GROUP BY ALL),
f AS (SELECT lang, source,
        max(p3 + 4 * (p3 - p2) + 1500) FILTER (r = 1) AS h1, max(p1 - 4 * (p2 - p1) - 1500) FILTER (r = 1) AS l1,
        max(p3 + 4 * (p3 - p2) + 150) FILTER (r = 2) AS h2, max(p3 + 4 * (p3 - p2) + 400) FILTER (r = 3) AS h3,
        max(p3 + 4 * (p3 - p2) + 300) FILTER (r = 4) AS h4 FROM q GROUP BY ALL),
j AS (SELECT m.*, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
        coalesce(m1 <= h1 AND m1 >= l1 AND m2 <= h2 AND m3 <= h3 AND m4 <= h4, false) AS inside
      FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM j
"""
