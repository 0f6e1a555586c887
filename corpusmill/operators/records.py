"""Building corpus records: messages, hashes, ids, reviewed items, translations, chat threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.hashing import content_hash, label_of
from corpusmill.functions.text import strip
from corpusmill.operators import ordered

# fixed values: categories of reviewed items
REVIEW_LABELS = {"abst": "abstenção", "dist": "distintivo", "fato": "doutrina"}


def threads(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per thread with ``messages``, in the order of turns. A thread is gathered whole: it is one record."""
    sorted_turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(thread).agg(F.transform(sorted_turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chat_messages(system: Column | str, question: Column, answer: Column) -> Column:
    """System, user and assistant message, the last two stripped."""
    system = F.lit(system) if isinstance(system, str) else system
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(say("system", system), say("user", strip(question)), say("assistant", strip(answer)))


def build_records(rows: DataFrame, prefix: str, system: str, tradition: str, lang: str, tier: str, version: str, reviewed_by: str, quality: Column, numbering: str = "content") -> DataFrame:
    """Corpus records from rows with question, answer, source, source_label and confessional_refs.

    numbering: ``content`` takes 12 digits of the hash; ``sequence`` takes the rank by ``pos`` (one order over
    all rows: for sources of a bounded number of records).
    """
    x = rows.withColumn("messages", chat_messages(system, F.col("question"), F.col("answer")))
    x = x.withColumn("sha256", content_hash("messages", F.lit(tradition), F.lit(lang)))
    if numbering == "sequence":
        x = x.withColumn("id", F.format_string(prefix + "-%05d", F.row_number().over(Window.orderBy("pos"))))
    else:
        x = x.withColumn("id", F.concat(F.lit(prefix + "-"), F.left("sha256", F.lit(12))))
    fixed = {"version": version, "tradition": tradition, "lang": lang, "tier": tier, "reviewed_by": reviewed_by}
    x = x.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"quality_score": quality.cast("double"), "created_at": F.current_timestamp()})
    return x.select("id", "version", "tradition", "lang", "tier", "source", "source_label", "messages", "confessional_refs", "reviewed_by", "quality_score", "created_at", "sha256")


def reviewed_items(files: DataFrame) -> DataFrame:
    """Accepted items (ok or edit) of reviewed files, with their label and place."""
    x = files.select("system_prompt", F.posexplode("items").alias("pos", "item")).where(F.col("item.status").isin("ok", "edit"))
    return x.select("system_prompt", "pos", "item.id", "item.category", label_of(F.col("item.category"), REVIEW_LABELS).alias("source_label"), F.col("item.user").alias("question"), F.col("item.assistant").alias("answer"))


def translated(rows: DataFrame, translations: DataFrame, key: str, pos: str | None = None) -> DataFrame:
    """Rows with prompt replaced by its translation and the original as prompt_en; in source order if ``pos`` is named."""
    t = translations.select(key, F.col("prompt").alias("_prompt"))
    x = rows.join(t, key).withColumn("prompt_en", F.col("prompt")).withColumn("prompt", F.col("_prompt")).drop("_prompt")
    return x.orderBy(pos) if pos else x


def with_sequence_ids(rows: DataFrame, order: list[str], prefix: str, out: str = "id") -> DataFrame:
    """Ids by rank in ``order``, nulls first; ranks come from ranges of the order, so a source of any size is no task's burden."""
    x = ordered.with_ranks(rows, order, "_rank")
    return x.withColumn(out, F.format_string(prefix + "-%05d", "_rank")).drop("_rank")


def stamped(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """``created_at`` in UTC as ISO 8601 with microseconds, and ``day``: of now, the same for all rows of a query, or of ``at``, an instant."""
    at = F.current_timestamp() if at is None else at
    utc = lambda f: F.date_format(F.to_utc_timestamp(at, F.current_timezone()), f)
    return rows.withColumns({"created_at": F.concat(utc("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")), "day": utc("yyyy-MM-dd")})


def overlong(rows: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows with ``kept``: false where the text has more than ``most`` tokens. Nothing is cut."""
    return rows.withColumn("n_tokens", tokens.cast("long")).withColumn("kept", F.col("n_tokens") <= most)
