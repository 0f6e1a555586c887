"""Secret scans (operator 3), in DataFrame functions only.

Pattern rules find assignments, access keys and long hexadecimal runs. The entropy rule takes every run
of ``[A-Za-z0-9+/_=-]`` of at least ``window`` characters as a candidate and slides a window along it. The counts of
the window's characters are kept packed in a few long integers: a step reads and changes two of them, those of the
character that leaves and of the one that enters, and with them the sum of c*log2(c); the window's entropy is log2(w)
less that sum over w. Hexadecimal candidates and mixed ones have limits of their own. Candidates on the allow list (words,
identifiers in lower case, UUIDs, digit strings, runs of marks) are passed over, and ordered alphabets within a candidate count as one character
repeated; the rule adds spans and never removes those of the pattern rules.

Cases: a null text is an empty one; an empty text has no spans; time grows with the text's length, whatever its
candidates are, and with n log n of its matches (patterns repeat no group but possessively, so Java doesn't recurse); rows are judged on their own, so ties,
repeated rows and other columns do not matter, but for ``secret_base`` and ``secret_spans``, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values of the contract
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
ALLOWED = (
    r"[A-Za-z]++",
    r"[a-z]++(?:[_/-]++[a-z]++)*+[0-9]{0,4}",
    r"[0-9]++(?:[_/-][0-9]++)*+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[=_+/-]++",
)
ORDERED = "0123456789|abcdefghij|ABCDEFGHIJ"
#: code points of candidates' characters
FIRST, LAST = ord("+"), ord("z")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(x: Column) -> Column:
    """For each place of an array of int, the sum up to it: sums of 1, 2, 4, ... neighbours, so n log n steps."""
    rounds = F.length(F.bin(F.size(x).cast("long"))) - 1  # 2**rounds <= n

    def double(a: Column, k: Column) -> Column:
        return F.transform(a, lambda v, i: v + F.when(F.call_function("shiftleft", F.lit(1), k) <= i, F.get(a, i - F.call_function("shiftleft", F.lit(1), k))).otherwise(0))

    return F.when(F.size(x) < 2, x).otherwise(F.aggregate(F.sequence(F.lit(0), rounds), x, double))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of ``pattern``, left to right: array of (s, e, g), in code points; g is group ``group``."""
    none = F.array().cast("array<struct<s:int,e:int,g:string>>")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def spans(n: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(n)), lambda x: F.length(x))
        ends = running_sums(F.zip_with(gaps, n, lambda g, m: g + m))
        return let(ends, lambda e: F.zip_with(F.zip_with(e, n, lambda x, m: F.struct((x - m).alias("s"), x.alias("e"))), part, lambda x, g: F.struct(x["s"].alias("s"), x["e"].alias("e"), g.alias("g"))))

    return F.when(text.rlike(pattern), let(F.transform(whole, lambda x: F.length(x)), spans)).otherwise(none)


def _f(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


class Counts:
    """Counts up to ``most`` of the characters of candidates, packed in an array of long."""

    def __init__(self, most: int):
        self.bits = most.bit_length()
        self.each = 63 // self.bits
        self.none = F.array(*[F.lit(0).cast("long")] * -(-(LAST - FIRST + 1) // self.each))

    def of(self, counts: Column, code: Column) -> Column:
        held = F.get(counts, F.floor(code / self.each).cast("int"))
        return F.call_function("shiftright", held, (code % self.each) * self.bits).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")

    def add(self, counts: Column, code: Column, sign: int) -> Column:
        one = F.call_function("shiftleft", F.lit(sign).cast("long"), (code % self.each) * self.bits)
        return F.transform(counts, lambda v, i: F.when(i == F.floor(code / self.each), v + one).otherwise(v))


def hot_range(candidate: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """A struct with first and last: the window starts whose entropy is over the limit of the candidate's class; -1 if there is none."""
    held = Counts(window)
    masked = F.regexp_replace(candidate, ORDERED, "aaaaaaaaaa")
    codes = F.transform(F.split(masked, ""), lambda x: F.ascii(x) - FIRST)
    limit = F.when(candidate.rlike("^[0-9a-fA-F]++$"), F.lit(hex_bits)).otherwise(F.lit(mixed_bits))

    def enter(a: Column, code: Column) -> Column:
        n = held.of(a["n"], code)
        return F.struct(held.add(a["n"], code, 1).alias("n"), (a["s"] - _f(n) + _f(n + 1)).alias("s"))

    def leave(a: Column, code: Column) -> Column:
        n = held.of(a["n"], code)
        return F.struct(held.add(a["n"], code, -1).alias("n"), (a["s"] - _f(n) + _f(n - 1)).alias("s"))

    def slide(c: Column, most: Column) -> Column:
        hot = lambda w: F.lit(math.log2(window)) - w["s"] / window >= most

        def seen(w: Column, i: Column, first: Column, last: Column) -> Column:
            return F.struct(w.alias("w"), F.when(hot(w) & (first < 0), i).otherwise(first).alias("first"), F.when(hot(w), i).otherwise(last).alias("last"))

        def step(a: Column, i: Column) -> Column:
            after = let(a["w"], lambda w: let(leave(w, F.get(c, i - 1)), lambda x: enter(x, F.get(c, i + window - 1))))
            return let(after, lambda w: seen(w, i, a["first"], a["last"]))

        begin = F.aggregate(F.slice(c, 1, window), F.struct(held.none.alias("n"), F.lit(0.0).alias("s")), enter)
        state = let(begin, lambda w: seen(w, F.lit(0), F.lit(-1), F.lit(-1)))
        steps = F.when(F.size(c) > window, F.sequence(F.lit(1), F.greatest(F.size(c) - window, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, state, step)

    return let(codes, lambda c: let(limit, lambda most: slide(c, most)))


def entropy_spans(text: Column, window: int = 20, hex_bits: float = 3.2, mixed_bits: float = 3.9) -> Column:
    """Spans of high entropy, array of (s, e, g), one for each candidate that has any."""
    candidates = F.filter(located(text, CANDIDATE % window), lambda x: ~x["g"].rlike("^(?:" + "|".join(ALLOWED) + ")$"))
    ranges = F.transform(candidates, lambda x: F.struct(x["s"].alias("s"), hot_range(x["g"], window, hex_bits, mixed_bits).alias("r")))
    hot = F.filter(ranges, lambda x: x["r"]["first"] >= 0)
    return F.transform(hot, lambda x: F.struct((x["s"] + x["r"]["first"]).alias("s"), (x["s"] + x["r"]["last"] + window).alias("e"), F.lit("").alias("g")))


def scan_secrets(df: DataFrame, text: str = "text", window: int = 20, hex_bits: float = 3.2, mixed_bits: float = 3.9) -> DataFrame:
    """Add ``secret_base`` and ``secret_spans``: arrays of (s, rank, e, kind), sorted by start, then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    tag = lambda spans, rank, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    assign = F.filter(located(t, ASSIGN, 2), lambda x: F.length(x["g"]) >= 12)
    base = F.concat(tag(assign, 0, "assign"), tag(located(t, ACCESS), 1, "access"), tag(located(t, HEX), 2, "hex"))
    x = df.withColumn("secret_base", F.array_sort(base)).withColumn("_e", tag(entropy_spans(t, window, hex_bits, mixed_bits), 3, "entropy"))
    return x.withColumn("secret_spans", F.when(F.size("_e") == 0, F.col("secret_base")).otherwise(F.array_sort(F.concat("secret_base", "_e")))).drop("_e")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return x.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("secret_base"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))
