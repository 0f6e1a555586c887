"""WARC archives: writer and splittable reader (operator 6).

Every record is a gzip member of its own (WARC 1.1, one member a record). Writing and reading go through
Spark's file sources alone, so archives can lie in any store that Spark reaches.

Writer: a partition writes one file, a row per member through the text sink with a line end of one zero
byte. A member's last byte is the top byte of its length, zero for records under 16 MiB, and is left to the line end;
a larger record is followed by an empty member that ends in it.

Reader: the text source, with the three bytes of gzip magic as line end, cuts files into byte ranges; a task gets
the pieces that start inside its range, each up to the next magic. A piece opens a record if it inflates to a
WARC header; otherwise the magic was compressed data and the piece continues the one before. A member that runs over
such a false magic into the next range is put together afterwards, from the few pieces that tasks could not place, by
file and range.

Archives of other writers are read too: any version of the format, header names in any case, values on several lines, several records in one member. What
cannot be read as a record, or is left over behind a member, is an error: no record is lost without one.

Cases: a null payload is an empty one; repeated rows and equal ids are records of their own; empty tables give no files and no rows;
a record is read whole; columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm._spark import materialize, scratch_dir, with_place

SALTS = 32
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
HEAD = re.compile(rb"WARC/\d[\d.]*[\x20\t]*\r?\n")
# fixed values: the format's own header names
NAMES = """WARC-Record-ID Content-Length WARC-Date WARC-Type Content-Type WARC-Concurrent-To WARC-Block-Digest WARC-Payload-Digest WARC-IP-Address WARC-Refers-To
WARC-Refers-To-Target-URI WARC-Refers-To-Date WARC-Target-URI WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile WARC-Identified-Payload-Type
WARC-Segment-Number WARC-Segment-Origin-ID WARC-Segment-Total-Length""".split()
OWN = {n.lower(): n for n in [*NAMES, "X-Key", "X-Payload-Length", "WARC-Refers-To-Key"]}


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY = member(b"")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str, uri: str, payload: bytes, size: int, sha1: str, refers: str | None, place: str, date: str) -> bytes:
    """``place`` tells the row from all others, equal ones too: it makes the record's id."""
    body = payload if kind == "response" else b""
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {uri} {sha1} {place}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {size}",
        f"X-Key: {key}",
        *([f"WARC-Refers-To-Key: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Fields and payload of every record of a member. The format's own names come as it spells them, others as they are written."""
    out, at = [], 0
    while at < len(data):
        begin = HEAD.match(data, at)
        end = re.compile(rb"\r?\n\r?\n").search(data, begin.end() - 2) if begin else None
        if end is None:
            raise ValueError("no record where one should begin")
        lines = re.sub(r"\r?\n[\x20\t]+", " ", data[begin.end() : end.start()].decode("utf-8", "replace"))
        fields = {}
        for line in filter(None, re.split(r"\r?\n", lines)):
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no header field: {line[:80]!r}")
            fields[OWN.get(name.strip().lower(), name.strip())] = value.strip()
        size = int(fields["Content-Length"])
        if end.end() + size > len(data):
            raise ValueError("a record is shorter than its length says")
        out.append((fields, data[end.end() : end.end() + size]))
        at = end.end() + size
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
    return out


def mark_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` (row, key, uri, payload as binary) with size, sha1, kind and refers; ``row`` tells rows apart.

    Of equal payloads of at least ``least_bytes`` bytes, the row with the largest key (of several, one of them) is
    the response. Digests alone are grouped; a payload with thousands of rows is one group of two numbers.
    """
    x = pages.withColumns({"size": F.octet_length(payload).cast("long"), "sha": F.sha1(payload)})
    best = F.max(F.struct(F.col(key).isNotNull(), F.col(key).alias("k"), F.col("row").alias("r")))
    first = x.where(F.col("size") >= least_bytes).groupBy("sha").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    # the commonest payload has rows in many tasks: its verdict goes to each of them
    first = first.select(F.col("sha").alias("_sha"), "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    on = (F.col("sha") == F.col("_sha")) & (F.pmod(F.xxhash64("row"), F.lit(SALTS)) == F.col("_salt")) & (F.col("size") >= least_bytes)
    x = x.join(first, on, "left")
    revisit = F.col("best").isNotNull() & (F.col("best.r") != F.col("row"))
    return x.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("refers", F.when(revisit, F.col("best.k").cast("string"))).drop("_sha", "best", "sha", "_salt")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, date: str | None = None) -> None:
    """Write one record for each row of ``pages`` to gzip-compressed WARC files under ``path``. ``date``: of all records, else the time of the call."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    x = pages.select(F.col(key).alias("key"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    x = with_place(x, "row", "warc-input")
    x = mark_revisits(x, "key", "payload", least_bytes).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "uri", F.when(F.col("kind") == "response", F.col("payload")).alias("payload"), "size", F.col("kind"), "refers", F.concat_ws("-", "row.file", "row.at").alias("place"), F.base64(F.unhex(F.sha1("payload"))).alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                out = []
                for r in b.slice(a, 64).to_pylist():
                    uri = r["uri"].replace("\r", "%0D").replace("\n", "%0A")
                    sha1 = base64.b32encode(base64.b64decode(r["sha"])).decode()
                    m = member(record(r["kind"], r["key"], uri, r["payload"] or b"", r["size"], sha1, r["refers"], r["place"], date))
                    out.append(m[:-1] if m[-1] == 0 else m + EMPTY[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    x.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _inflate(data: bytes, whole: bool) -> bytes | None:
    """The content of the member that ``data`` begins with; None if it isn't one, or isn't whole though it should be."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data) if whole else d.decompress(data, 4096)
    except zlib.error:
        return None
    if whole and d.unused_data.strip(b"\0"):
        raise ValueError("bytes behind a member that are no record")
    return out if d.eof or not whole else None


def is_member(piece: bytes) -> bool:
    """Whether a record, or an empty member, starts here: its header inflates to that of a record."""
    got = _inflate(piece[: 1 << 16], False)
    return got is not None and (HEAD.match(got) is not None or (got == b"" and piece[:20] == EMPTY))


def stitch(pieces: list[bytes], keep_open: bool) -> tuple[list[bytes], list[bytes], bytes | None]:
    """Leading pieces that continue an earlier member, contents of the whole members, and an unfinished last one."""
    at = 0
    while at < len(pieces) and not is_member(pieces[at]):
        at += 1
    orphans, out, held = pieces[:at], [], b""
    for p in [*pieces[at:], None]:
        if p is None or (held and is_member(p) and _inflate(held, True) is not None):
            if held:
                got = _inflate(held, True)
                if got is None:
                    if p is None and keep_open:
                        return orphans, out, held
                    raise ValueError("broken member in archive")
                if got:
                    out.append(got)
            held = b""
        held += p or b""
    return orphans, out, None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(fields map, payload binary) of every record of the archives under ``path``."""
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    raw = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
        where, held = None, []
        for b in batches:
            for p, f, s in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if (f, s) != where:
                    if held:
                        yield where, held
                    where, held = (f, s), []
                    if s == 0:
                        if p:
                            raise ValueError(f"{f} does not start with a gzip member")
                        continue
                held.append(MAGIC + p)
                if len(held) >= 256:
                    yield where, held[:-8]
                    held = held[-8:]
        if held:
            yield where, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("begin", pa.int64()), ("orphan", pa.bool_()), ("piece", pa.binary())])
        where, carry = None, b""
        for at, got in ranges(batches):
            rows = []
            if at != where:
                if carry:
                    rows.append({"file": where[0], "begin": where[1], "orphan": False, "piece": carry})
                where, carry, first = at, b"", True
            orphans, whole, last = stitch([carry, *got] if carry else got, True)
            if orphans and not first:
                raise ValueError("broken member in archive")
            first = False
            carry = last or b""
            rows += [{"file": at[0], "begin": at[1], "orphan": True, "piece": b"".join(orphans)}] if orphans else []
            rows += [{"fields": list(f.items()), "payload": p} for m in whole for f, p in parse(m)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if carry:
            yield pa.RecordBatch.from_pylist([{"file": where[0], "begin": where[1], "orphan": False, "piece": carry}], schema=schema)

    seen = materialize(raw.mapInArrow(run, "fields map<string,string>, payload binary, file string, begin long, orphan boolean, piece binary"), "warc-records")

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["begin"], not r["orphan"]))
        held, out = b"", []
        for r in rows:
            if not r["orphan"]:
                held = r["piece"]
            else:
                held += r["piece"]
                got = _inflate(held, True)
                if got is not None:
                    out += [got] if got else []
                    held = b""
        if held:
            raise ValueError("broken member in archive")
        return pa.Table.from_pylist([{"fields": list(f.items()), "payload": p} for m in out for f, p in parse(m)], schema=pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]))

    torn = seen.where("piece IS NOT NULL").select("file", "begin", "orphan", "piece").groupBy("file").applyInArrow(join, "fields map<string,string>, payload binary")
    return seen.where("piece IS NULL").select("fields", "payload").unionByName(torn)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    r = read_records(spark, path)
    response = F.col("fields")["WARC-Type"] == "response"
    kind = pages.schema["page_id"].dataType

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [digest(p.as_py() or b"") if ok.as_py() else d.as_py() for p, ok, d in zip(b.column(4), b.column(5), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), b.column(3), b.column(6)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    flat = r.select(
        F.expr("nullif(fields['X-Key'], '')").cast(kind).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("fields")["X-Payload-Length"].cast("long")).cast("long").alias("payload_bytes"),
        F.expr("substr(fields['WARC-Payload-Digest'], 6)").alias("d"),
        F.col("fields")["WARC-Type"].alias("record_type"),
        "payload",
        response.alias("ok"),
        F.col("fields")["WARC-Refers-To-Key"].cast(kind).alias("refers_to"),
    )
    return flat.mapInArrow(check, f"page_id {kind.simpleString()}, payload_bytes long, payload_digest string, record_type string, refers_to {kind.simpleString()}")

