"""Canonical JSON, content hashes and message accessors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col


def json_string(c: Column | str) -> Column:
    """A string as JSON text, without escapes beyond ASCII and with lower-case ones for control characters."""
    text = F.to_json(F.array(col(c)))
    quoted = F.substring(text, F.lit(2), F.length(text) - 2)
    for code in (*range(0x0E, 0x10), 0x0B, *range(0x1A, 0x20)):
        quoted = F.regexp_replace(quoted, r"(?<!\\)((?:\\\\)*)\\u00%02X" % code, r"$1\\u00%02x" % code)
    return quoted


def content_hash(messages: Column | str, tradition: Column | str, lang: Column | str) -> Column:
    """SHA-256 of ``{"lang", "messages": [{"content", "role"}], "tradition"}``, keys sorted; other fields do not count."""
    one = lambda m: F.concat(F.lit('{"content": '), json_string(m["content"]), F.lit(', "role": '), json_string(m["role"]), F.lit("}"))
    body = F.array_join(F.transform(col(messages), one), ", ")
    return F.sha2(F.concat(F.lit('{"lang": '), json_string(lang), F.lit(', "messages": ['), body, F.lit('], "tradition": '), json_string(tradition), F.lit("}")), 256)


def chunk_hash(source: Column | str, index: Column | str, chunk: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over source, index, length and the first 200 characters."""
    c = col(chunk)
    return F.left(F.sha2(F.concat_ws("::", col(source), col(index).cast("string"), F.length(c).cast("string"), F.left(c, F.lit(200))), 256), F.lit(16))


def first_user(messages: Column | str) -> Column:
    return F.coalesce(F.get(F.filter(col(messages), lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(""))


def last_assistant(messages: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(col(messages), lambda m: m["role"] == "assistant"), F.lit(-1))["content"], F.lit(""))


def spoken_text(messages: Column | str) -> Column:
    """All but the system messages, joined by spaces."""
    return F.array_join(F.transform(F.filter(col(messages), lambda m: m["role"] != "system"), lambda m: m["content"]), " ")


def label_of(key: Column | str, labels: dict[str, str]) -> Column:
    """The label of a key, else the key, else nothing."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(key)), col(key), F.lit(""))
