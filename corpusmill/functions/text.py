"""Scalar text functions as Column expressions, with the whitespace and rounding rules of Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what Python's str.strip and \s take for white space; Java's (?U)\s lacks the four separators
WS = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once: an expression is otherwise computed wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"(?U)^{WS}+|{WS}+\\z", "")


def clean(c: Column | str) -> Column:
    """Collapse runs of white space to one space, and strip."""
    return strip(F.regexp_replace(col(c), f"(?U){WS}+", " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), f"(?U){WS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(F.coalesce(col(c), F.lit(""))))


def fix_mojibake(c: Column | str) -> Column:
    """Text that is UTF-8 read as Latin-1 is decoded anew; anything else is kept."""
    c = col(c)
    latin = F.when(c.rlike(r"^[\x00-\xff]*\z") & c.rlike(r"[\x80-\xff]"), c)
    again = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.coalesce(again, c)


def normalize(c: Column | str) -> Column:
    """Repair mojibake, end lines with \\n, empty those of white space alone, keep one blank line of several."""
    t = fix_mojibake(c)
    t = F.regexp_replace(t, r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    t = F.regexp_replace(t, r"\n\z", "")
    t = F.regexp_replace(t, f"(?Umd)^[{WS[1:-1]}&&[^\\n]]+$", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def split_keep(c: Column | str, pattern: str) -> Column:
    """Pieces that each start with a match of ``pattern``; what is before the first is dropped."""
    flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    head, body = (flags[0], pattern[flags.end() :]) if flags else ("", pattern)
    return F.filter(F.split(col(c), f"{head}(?={body})"), lambda p: p.rlike(f"{head}\\A(?:{body})"))


def strip_think(c: Column | str) -> Column:
    c = col(c)
    both = c.contains("<think>") & c.contains("</think>")
    return F.when(both, F.substring(c, F.instr(c, "</think>") + 8, F.length(c))).otherwise(c)


def strip_quotes(c: Column | str) -> Column:
    """Strip one pair of quotes, if the same quote is at both ends."""
    t = strip(c)
    first, last = F.substring(t, 1, 1), F.right(t, F.lit(1))
    matching = (F.length(t) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(matching, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def substitute(template: str, values: dict[str, Column], required: list[str]) -> Column:
    """Fill ``{name}`` in one pass: what a value brings along is not filled again. A required name must have a value."""
    missing = [v for v in required if v not in values]
    if missing:
        raise KeyError(f"template needs {missing[0]!r} (expected: {required})")
    if not required:
        return F.lit(template)
    parts = re.split("(" + "|".join(re.escape("{" + v + "}") for v in required) + ")", template)
    cols = [values[p[1:-1]].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)]
    return F.concat(*cols)


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def script_json(c: Column | str) -> Column:
    """JSON text that is safe within an HTML script element."""
    out = col(c)
    for raw, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def percent(c: Column | str) -> Column:
    """A fraction as a percentage of one decimal; a dash for null."""
    return F.when(col(c).isNull(), "—").otherwise(F.format_string("%.1f%%", half_even(col(c) * 100, 1)))


def number_or_dash(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("—"))


def slug(c: Column | str) -> Column:
    """A model's name as part of a file name."""
    return F.translate(col(c), "/-", "__")


def source_slug(c: Column | str, most: int = 80) -> Column:
    return F.left(F.regexp_replace(col(c), f"(?U){WS}+", "_"), F.lit(most))


def preview(c: Column | str, most: int) -> Column:
    return F.left(col(c), F.lit(most))


def half_even(x: Column, digits: int = 0) -> Column:
    """Python's ``round``: to even where the double is a tie exactly, else to what is nearer.

    Spark's ``bround`` takes the shortest decimal text of a double for its value. Where that is a tie, the sign of
    2 * 10**digits * x - n decides, summed exactly: each term is x times a power of two, less a whole number.
    """
    return let(x.cast("double"), lambda v: _half_even(v, digits))


def _half_even(x: Column, digits: int) -> Column:
    scale = 2 * 10**digits
    n = F.rint(x * scale)
    powers = [1 << k for k in range(scale.bit_length()) if scale >> k & 1][::-1]
    whole = [F.rint(x * p) for p in powers[:-1]]
    rest = sum((x * p - w for p, w in zip(powers, whole, strict=False)), F.lit(0.0))
    last = n
    for w in whole:
        last = last - w
    over = rest + (x * powers[-1] - last)
    down, up = F.floor(n / 2), F.ceil(n / 2)
    even = F.when(down % 2 == 0, down).otherwise(up)
    tie = F.when(over > 0, up).when(over < 0, down).otherwise(even)
    nearest = F.when(n % 2 == 0, (n / 2).cast("long")).otherwise(tie)
    return nearest.cast("double") / 10**digits if digits else nearest.cast("double")
