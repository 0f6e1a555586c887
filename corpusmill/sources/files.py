"""Readers: JSON lines, whole texts, reviewed files, PDF, configurations; and what is derived from file names."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import source_slug, strip
from corpusmill.schemas import CORPUS_RECORD, REVIEWED


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; a bad line fails the job if ``strict``, else it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_with_bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with ``_corrupt_record`` for what cannot be read."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def tiers(spark: SparkSession, paths: dict[str, str], schema: T.StructType = CORPUS_RECORD) -> DataFrame:
    """Union of the tiers' files; those that are missing are passed over."""
    out = spark.createDataFrame([], schema)
    for path in paths.values():
        if exists(spark, path):
            out = out.unionByName(jsonl(spark, path, schema), allowMissingColumns=True)
    return out


def texts(spark: SparkSession, path: str, pattern: str = "*", least: int = 0) -> DataFrame:
    """(path, name, text) of whole files; bytes that are not UTF-8 become replacement characters."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    x = x.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), text.alias("text"))
    return x.where(F.length("text") >= least)


def bundle(rows: DataFrame, path: str) -> None:
    """Write files given as rows (path, content) as a bundle: a Parquet table of them, in a folder for each suffix.

    A loose file costs a listing, an opening and a rename by the driver, however short it is; in a bundle it costs its bytes.
    """
    x = rows.select("path", F.col("content").cast("binary").alias("content"), F.regexp_extract("path", r"\.[^./]*$", 0).alias("suffix"))
    x.write.partitionBy("suffix").option("compression", "zstd").parquet(path)


def bundled_texts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """The same as :func:`texts`, of the files of a bundle that have the suffix, dot included; no other folder of it is read."""
    x = spark.read.schema("path string, content binary, suffix string").parquet(path).where(F.col("suffix") == suffix)
    return x.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def sidecar_texts(spark: SparkSession, path: str, least: float, suffix: str = ".md", score: str = "quality_score", stem: str = r"([^/]+)\.[^./]+$", bundled: bool = False) -> DataFrame:
    """(stem, text, sidecar, score) of texts whose JSON sidecar of the same stem has a score of ``least`` or more.

    A text without a sidecar stays; a sidecar without a score, or one that cannot be read, counts as 0. ``stem`` tells from a path what pairs. Sidecars
    under the limit are found first, and their texts are never joined: only the short list of stems is. Files are loose below ``path``, or ``bundled`` there.
    """
    read = (lambda end: bundled_texts(spark, path, end)) if bundled else (lambda end: texts(spark, path, "*" + end))
    text = read(suffix).select(F.regexp_extract("path", stem, 1).alias("stem"), "text")
    side = read(".json").select(F.regexp_extract("path", stem, 1).alias("stem"), F.col("text").alias("sidecar"))
    side = side.withColumn("score", F.coalesce(F.get_json_object("sidecar", f"$.{score}").try_cast("double"), F.lit(0.0)))
    low = side.where(F.col("score") < least).select("stem")
    return text.join(low, "stem", "left_anti").join(side.where(F.col("score") >= least), "stem", "left")


def reviewed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEWED).option("multiLine", "true").json(path)


def pdf_texts(spark: SparkSession, path: str, cache: str | None = None, least: int = 500) -> DataFrame:
    """(source_id, source_label, text) of PDF files; a text read once can be kept under ``cache`` as a table.

    Needs the package pypdf on the executors; a file it cannot read gives no row.
    """
    if cache and exists(spark, cache):
        return spark.read.parquet(cache)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    out.append((name, "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)))
                except pypdf.errors.PyPdfError:
                    continue
            yield pd.DataFrame(out, columns=["name", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    x = files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("name"), "content").mapInPandas(run, "name string, text string")
    x = x.withColumn("text", F.regexp_replace("text", r"\n{3,}", "\n\n")).where(F.length("text") >= least)
    x = x.select(source_slug("name").alias("source_id"), F.col("name").alias("source_label"), "text")
    if cache:
        x.write.parquet(cache)
        return spark.read.parquet(cache)
    return x


def prompts(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """Benchmark prompts: ``question`` stands in for a missing ``prompt``; blank ones go; the number of rows may be checked."""
    if "question" in rows.columns:
        prompt = F.coalesce("prompt", "question") if "prompt" in rows.columns else F.col("question")
        rows = rows.withColumn("prompt", prompt).drop("question")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} prompts, {expected} expected")
    return rows.where(F.length(strip("prompt")) > 0)


def new_files(found: DataFrame, have: DataFrame, excluded: list[str]) -> DataFrame:
    """Files to copy: not there yet, and under none of the excluded directories."""
    fresh = found.join(have.select("name"), "name", "left_anti")
    out = fresh
    for d in excluded:
        out = out.where(~F.contains("path", F.lit(f"/{d}/")))
    return out


def scoring_config(path: str) -> dict:
    """A benchmark's scoring prompt; its template, variables and output format must be there."""
    cfg = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = [k for k in ("template", "input_variables", "output_format") if k not in cfg]
    if missing:
        raise KeyError(f"{path} lacks {missing}")
    return cfg


def system_prompt(path: str) -> str:
    text = Path(path).read_text(encoding="utf-8").strip() if Path(path).exists() else ""
    if not text:
        raise FileNotFoundError(f"no system prompt in {path}")
    return text


def experiment_config(path: str) -> dict:
    """A configuration of ``key: value`` lines, sections by indentation and lists of scalars (``- x`` lines or ``[x, y]``)."""

    def scalar(text: str):
        try:
            return json.loads(text)
        except ValueError:
            pass
        if text.startswith("[") and text.endswith("]"):
            return [scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
        return {"~": None, "null": None, "True": True, "False": False}.get(text, text.strip("\"'"))

    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    last: tuple[dict, str] | None = None
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        if bare.strip().startswith("- "):
            if last is None:
                raise ValueError(f"{path}: a list without a name")
            where, name = last
            if not isinstance(where[name], list):
                where[name] = []
            where[name].append(scalar(bare.strip()[2:].strip()))
            continue
        key, _, value = bare.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = scalar(value.strip())
        else:
            last = (stack[-1][1], key)
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return out


def matrix(spark: SparkSession, path: str, row: str = "row", cells: str = "cells") -> DataFrame:
    """(row, col, value) of a file of JSON lines, each a row's name and its cells by column; cells that are null or absent are not there."""
    kind = T.StructType([T.StructField(row, T.StringType()), T.StructField(cells, T.MapType(T.StringType(), T.DoubleType()))])
    x = jsonl(spark, path, kind).select(F.col(row).alias("row"), F.explode(cells).alias("col", "value"))
    return x.where("value IS NOT NULL")


def pivoted(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A matrix with a column for each of ``columns``, null where there is no cell: one pass, as the columns are known."""
    return cells.groupBy("row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in columns])


def leaderboard(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    """A public board as a table (model, value); its values are inputs, not part of this package."""
    return spark.createDataFrame(rows, "model string, value double")


def category_matrix(spark: SparkSession, matrix: dict[str, list[int]], categories: list[str]) -> DataFrame:
    """(model, category, value) of a matrix with one list per model."""
    rows = [(m, c, int(v)) for m, vs in matrix.items() for c, v in zip(categories, vs, strict=True)]
    return spark.createDataFrame(rows, "model string, category string, value int")


def baseline_path(spark: SparkSession, folder: str, stem: str, lang: str) -> str | None:
    """The run's own baseline file; the untagged one only for English."""
    tagged, plain = f"{folder}/{stem}_{lang}.jsonl", f"{folder}/{stem}.jsonl"
    if exists(spark, tagged):
        return tagged
    return plain if lang == "en" and exists(spark, plain) else None
