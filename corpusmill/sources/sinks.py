"""Writers: JSON lines, atomic replacement, manifests and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def overwrite_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_jsonl(rows: DataFrame, path: str) -> None:
    """Write beside ``path``, then move into its place; ``rows`` may have been read from ``path``.

    A folder cannot be renamed over another, so ``path`` is missing between two renames. If the second fails, the old rows are
    put back; if the job ends between them, they lie in ``path``.*.old.
    """
    spark = rows.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.json(fresh)
    fs, target = _fs(spark, path)
    had = fs.exists(target)
    if had and not fs.rename(target, _fs(spark, old)[1]):
        raise OSError(f"could not move {path} away")
    if not fs.rename(_fs(spark, fresh)[1], target):
        if had:
            fs.rename(_fs(spark, old)[1], target)
        raise OSError(f"could not put {fresh} in the place of {path}")
    fs.delete(_fs(spark, old)[1], True)


def partitioned_jsonl(rows: DataFrame, path: str, by: str = "tier") -> None:
    rows.write.mode("overwrite").partitionBy(by).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under ``path``."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(split: DataFrame, tier: str, fraction: float, seed: int, version: str) -> dict:
    """Counts by split and tier; fails if they do not add up to the rows."""
    n = split.groupBy("split", F.coalesce(tier, F.lit("?")).alias("t")).agg(F.count("*").alias("n")).collect()
    out: dict = {"seed": seed, "eval_split": fraction, "pipeline_version": version, "total_records": sum(r["n"] for r in n)}
    for name in sorted({r["split"] for r in n}):
        by = {r["t"]: r["n"] for r in sorted(n, key=lambda r: r["t"]) if r["split"] == name}
        out[name] = {"count": sum(by.values()), "by_tier": by}
    if out["total_records"] != split.count():
        raise AssertionError("counts do not add up to the rows")
    return out


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, written by the driver to any file system Spark reaches."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2), path)
