"""Rule-based parsers of structured documents: one text per row in, questions and answers out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import clean, normalize, split_keep, strip


@dataclass(frozen=True)
class Catechism:
    """Numbered questions with their answers."""

    label: str
    ref: str
    mark: str
    body: str
    least: int = 1


@dataclass(frozen=True)
class Confession:
    """Chapters of numbered parts; questions come from a template."""

    label: str
    ref: str
    chapter: str
    head: str
    part: str
    part_body: str
    whole_question: str | None
    question: str
    part_label: str = "{c}.{n}"
    part_ref: str = "{c}.{n}"
    cut: str | None = None
    least: int = 40
    least_whole: int = 50


# The documents' marks, patterns and question texts.
WSC = Catechism("WSC", "WSC", r"(?i)Pergunta\s+\d+\.", r"(?s)\APergunta\s+(\d+)\.\s+(.+?)\n\nR\.\s+(.+?)(?:\n\nRef|\n\nReferências|\z)")
WLC = Catechism("WLC", "WLC", r"(?md)^\d+\.", r"(?s)\A(\d+)\.\s+(.+?)\n\n(.+?)(?:\n\n|\z)", 10)
HEIDELBERG = Catechism("Heidelberg", "HC", r"(?md)^\d+\.", r"(?s)\A(\d+)\.\s+(.+?)\n\n(.+?)(?:\n\n(?:DIA DO SENHOR|\d+\.|Parte)|\z)")
WCF = Confession(
    "WCF", "WCF", r"(?iu)CAP[IÍ]TULO\s+\d+", r"(?siu)\ACAP[IÍ]TULO\s+(\d+)[:\s]+([^\n]+)\n(.+)", r"(?md)^\d+\.", r"(?s)\A(\d+)\.\s+(.+)",
    "O que ensina a Confissão de Fé de Westminster no Capítulo {c} ({t})?",
    "O que ensina a Confissão de Fé de Westminster no Capítulo {c} ({t}), artigo {n}?",
)
LCF = Confession(
    "LCF", "LCF", r"(?iu)CAP[IÍ]TULO\s+\d+", r"(?siu)\ACAP[IÍ]TULO\s+(\d+)\s*\n+([^\n]+)\n(.+)", r"(?md)^\d+\.", r"(?s)\A(\d+)\.\s+(.+)",
    "O que ensina a Confissão Batista de Londres de 1689 no Capítulo {c} ({t})?",
    "O que ensina a Confissão Batista de Londres de 1689 no Capítulo {c} ({t}), parágrafo {n}?",
)
DORT = Confession(
    "Dort", "Dort", r"(?iu)Cap[íi]tulo\s+\d+", r"(?siu)\ACap[íi]tulo\s+(\d+)\s*\n+([^\n]+)\n(.+)", r"(?iu)ARTIGO\s+\d+", r"(?s)\AARTIGO\s+(\d+)\s*\n(.+)",
    None, "O que ensinam os Cânones de Dort sobre '{t}' (Capítulo {c}, Artigo {n})?", cut=r"REJEI[ÇC][ÃA]O",
)
DORT_REJECTIONS = Confession(
    "Dort", "Dort", r"(?iu)Cap[íi]tulo\s+\d+", r"(?siu)\ACap[íi]tulo\s+(\d+)\s*\n+([^\n]+)\n(.+)", r"(?iu)REJEI[ÇC][ÃA]O\s+\d+", r"(?s)\AREJEI[ÇC][ÃA]O\s+(\d+)\s*\n(.+)",
    None, "O que os Cânones de Dort rejeitam como erro no Capítulo {c} ({t}), Rejeição {n}?", "{c}.rej{n}", "{c} rejeição {n}",
)


def _filled(template: str, **values: Column) -> Column:
    out, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}") for k in values if "{" + k + "}" in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        name = rest[at + 1]
        out += [F.lit(rest[:at]), values[name]]
        rest = rest[at + 3 :]
    return F.concat(*out)


def _row(x: DataFrame, pos: Column, question: Column, answer: Column, label: Column, ref: Column) -> DataFrame:
    return x.select("doc", pos.alias("pos"), question.alias("question"), answer.alias("answer"), label.alias("source"), F.array(ref).alias("confessional_refs"))


def parse_catechism(docs: DataFrame, rule: Catechism) -> DataFrame:
    x = docs.select("doc", F.posexplode(split_keep(normalize("text"), rule.mark)).alias("p", "piece"))
    x = x.where(F.col("piece").rlike(rule.body))
    got = [F.regexp_extract("piece", rule.body, k) for k in (1, 2, 3)]
    x = x.select("doc", "p", got[0].alias("n"), clean(got[1]).alias("q"), clean(got[2]).alias("a"))
    x = x.where((F.length("q") > 0) & (F.length("a") >= rule.least))
    return _row(x, F.array(F.col("p")), F.col("q"), F.col("a"), F.concat(F.lit(rule.label + "_"), "n"), F.concat(F.lit(rule.ref + " "), "n"))


def parse_confession(docs: DataFrame, rule: Confession) -> DataFrame:
    """Chapters, then their parts. A chapter without parts is one answer where the rule has a question for it."""
    x = docs.select("doc", F.posexplode(split_keep(normalize("text"), rule.chapter)).alias("p", "piece"))
    x = x.where(F.col("piece").rlike(rule.head))
    x = x.select("doc", "p", F.regexp_extract("piece", rule.head, 1).alias("c"), strip(F.regexp_extract("piece", rule.head, 2)).alias("t"), F.regexp_extract("piece", rule.head, 3).alias("body"))
    x = x.withColumn("parts", split_keep("body", rule.part))
    y = x.select("doc", "p", "c", "t", F.posexplode("parts").alias("k", "part")).where(F.col("part").rlike(rule.part_body))
    text = F.regexp_extract("part", rule.part_body, 2)
    if rule.cut:
        text = F.get(F.split(text, rule.cut), F.lit(0))
    y = y.withColumns({"n": F.regexp_extract("part", rule.part_body, 1), "a": clean(text)}).where(F.length("a") >= rule.least)
    fill = lambda t: _filled(t, c=F.col("c"), t=F.col("t"), n=F.col("n"))
    out = _row(y, F.array("p", "k"), fill(rule.question), F.col("a"), F.concat(F.lit(rule.label + "_"), fill(rule.part_label)), F.concat(F.lit(rule.ref + " "), fill(rule.part_ref)))
    if rule.whole_question:
        w = x.where(F.size("parts") == 0).withColumn("a", clean("body")).where(F.length("a") >= rule.least_whole).withColumn("n", F.lit(""))
        out = out.unionByName(_row(w, F.array(F.col("p")), fill(rule.whole_question), F.col("a"), F.concat(F.lit(rule.label + "_"), "c"), F.concat(F.lit(rule.ref + " "), "c")))
    return out


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "wsc": lambda d: parse_catechism(d, WSC),
    "wlc": lambda d: parse_catechism(d, WLC),
    "heidelberg": lambda d: parse_catechism(d, HEIDELBERG),
    "wcf": lambda d: parse_confession(d, WCF),
    "dort": lambda d: parse_confession(d, DORT).unionByName(parse_confession(d, DORT_REJECTIONS)),
    "lcf": lambda d: parse_confession(d, LCF),
}


def parse_apart(docs: DataFrame, out: str, wanted: list[str] | None = None) -> tuple[DataFrame | None, dict[str, int], dict[str, str]]:
    """(rows, counts, failures): every source parsed and written below ``out`` on its own, so that one that fails leaves the others.

    rows: those of the sources that went well, read again; None if there is none. failures: what went wrong, by source. A source
    without a document has a count of 0, like one without answers.
    """
    spark, counts, failures, done = docs.sparkSession, {}, {}, []
    for name in wanted or PARSERS:
        path = f"{out}/{name}"
        try:
            PARSERS[name](docs.where(F.col("doc") == name)).write.mode("overwrite").parquet(path)
        except Exception as e:  # noqa: BLE001  whatever a source's text or rule brings about
            failures[name] = f"{type(e).__name__}: {e}".splitlines()[0]
            continue
        done.append(path)
        counts[name] = spark.read.parquet(path).count()
    return (spark.read.parquet(*done) if done else None), counts, failures


def parse_all(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Rows of every source in ``docs(doc, text)``; ``doc`` names the parser. An unknown name in ``wanted`` fails."""
    unknown = set(wanted or []) - PARSERS.keys()
    if unknown:
        raise ValueError(f"unknown source: {sorted(unknown)}")
    parts = [PARSERS[k](docs.where(F.col("doc") == k)) for k in (wanted or PARSERS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
