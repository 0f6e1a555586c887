"""Parsing what language models answer: ratings, rubrics, question lists, chat responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col, half_even, let, strip, strip_think

# fixed values: the official output formats of the two benchmarks
CB_PATTERN = r"(?md)^Rating:\s*([1-7])\s*$"
RR_VALID, CB_VALID = (0, 1, 2, 3, 4), (1, 2, 3, 4, 5, 6, 7)
NEUTRAL = 4
# fixed values: weights of the rubric, and what it accepts
RUBRIC = {"precisao_teologica": 0.4, "clareza_pastoral": 0.2, "qualidade_ptbr": 0.2, "sem_alucinacao": 0.2}
ACCEPT = 93


def cb_score(reply: Column | str) -> Column:
    """The rating of the first line that is one, null if there is none."""
    return F.nullif(F.regexp_extract(strip(strip_think(F.coalesce(col(reply), F.lit("")))), CB_PATTERN, 1), F.lit("")).cast("int")


def _unfenced(t: Column) -> Column:
    inner = F.get(F.split(t, "```"), F.lit(1))
    inner = F.regexp_replace(inner, r"(?Ui)\A\s*json", "")
    return F.when(t.startswith("```"), strip(inner)).otherwise(t)


def _between(t: Column, first: str, last: str) -> Column:
    begin, back = F.instr(t, first), F.instr(F.reverse(t), last)
    return F.when((begin > 0) & (back > 0), F.substring(t, begin, F.length(t) - back + 2 - begin)).otherwise(t)


def _whole(score: Column) -> Column:
    """A JSON value as Python's int() takes it: numbers are cut, text must be a whole number, the rest is null."""
    kind = F.schema_of_variant(score)
    text = F.try_variant_get(score, "$", "string")
    number = F.when(kind == "BOOLEAN", F.try_variant_get(score, "$", "boolean").cast("int"))
    number = number.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*\z"), F.regexp_replace(text, r"[\s_]", "").try_cast("int")))
    return number.otherwise(F.try_variant_get(score, "$", "double").try_cast("int"))


def rr_score(reply: Column | str) -> Column:
    """Struct (score, rationale, reason): score is null, with a reason, for what cannot be parsed or is off the scale."""
    raw = F.coalesce(col(reply), F.lit(""))

    def judged(v: Column) -> Column:
        rationale = F.coalesce(F.try_variant_get(v, "$.rationale", "string"), F.lit(""))
        return let(F.struct(_whole(F.try_variant_get(v, "$.score", "variant")).alias("n"), rationale.alias("why")), told)

    def told(x: Column) -> Column:
        ok = x["n"].isin(*RR_VALID)
        reason = F.when(x["n"].isNull(), F.concat(F.lit("[parse-error] "), F.left(raw, F.lit(120)))).when(~ok, F.concat(F.lit("[out-of-range:"), x["n"].cast("string"), F.lit("] "), F.left(raw, F.lit(100))))
        return F.struct(F.when(ok, x["n"]).alias("score"), F.when(ok, x["why"]).alias("rationale"), reason.alias("reason"))

    inner = let(strip(strip_think(raw)), lambda t: let(_unfenced(t), lambda u: _between(u, "{", "}")))
    return let(F.try_parse_json(inner), judged)


def qa_pairs(reply: Column | str) -> Column:
    """Array of (question, answer) from a JSON list, with or without code fences; items that lack either are dropped."""
    t = strip(F.regexp_replace(strip_think(col(reply)), r"```(?:json)?|```", ""))
    body = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    kept = F.filter(F.from_json(body, "array<struct<question:string,answer:string>>"), lambda x: x["question"].isNotNull() & x["answer"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<question:string,answer:string>>"))


def rubric_score(reply: Column | str) -> Column:
    """Struct (score, accepted): the weighted score, computed from its parts; 0 for what cannot be parsed."""
    t = strip(strip_think(strip(F.regexp_replace(col(reply), r"```(?:json)?|```", ""))))

    def scored(data: Column) -> Column:
        parts = [F.coalesce(F.try_element_at(data, F.lit(k)).try_cast("double"), F.lit(0.0)) * w for k, w in RUBRIC.items()]
        return F.when(data.isNotNull(), half_even(parts[0] + parts[1] + parts[2] + parts[3], 1)).otherwise(F.lit(0.0))

    body = F.from_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")
    return let(let(body, scored), lambda x: F.struct(x.alias("score"), (x >= ACCEPT).alias("accepted")))


def response_text(response: Column | str) -> Column:
    """The message of a chat response, without a think block; empty where there is none."""
    return strip(strip_think(F.coalesce(F.get_json_object(col(response), "$.choices[0].message.content"), F.lit(""))))


def served_model(response: Column | str, requested: Column | str) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(col(response), "$.model"), F.lit("")), col(requested))


def label_key(key: Column | str, low: int, high: int) -> Column:
    """Struct (action, score) of what a labeller typed: score, skip, quit or bad."""
    k = F.lower(strip(key))
    number = F.when(k.rlike(r"^[+-]?[0-9]+\z"), k.try_cast("int"))
    action = F.when(k.isin("q", "quit"), "quit").when(k.isin("s", "skip"), "skip").when(number.between(low, high), "score").otherwise("bad")
    return F.struct(action.alias("action"), F.when(number.between(low, high), number).alias("score"))
