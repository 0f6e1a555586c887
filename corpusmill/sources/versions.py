"""Tables that are rewritten whole, and logs that grow by batches, with commits that other readers see at once or not at all.

A version of a table is a folder that is never changed. One small file, ``CURRENT``, names the version that counts; it is replaced by a
rename that overwrites, which file systems do in one step. A job that ends anywhere before leaves the old rows in place, and what
it wrote is cleared later. A batch of a log is a folder that gets its name by one rename when it is complete: the same batch
sent again finds its name taken and adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """(Hadoop's package, its configuration, the path, its file system)."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = fs.Path(path)
    return fs, conf, p, p.getFileSystem(conf)


def rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> bool:
    """Rename in one step; without ``overwrite`` false if the target is there."""
    fs, conf, p, _ = _hadoop(spark, source)
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = getattr(getattr(fs, "Options$Rename"), "OVERWRITE" if overwrite else "NONE")
    context = fs.FileContext.getFileContext(p.toUri(), conf)
    from py4j.protocol import Py4JJavaError

    try:
        context.rename(context.makeQualified(p), context.makeQualified(fs.Path(target)), options)
    except Py4JJavaError as e:
        if not overwrite and "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a table says; None if the table has no version yet."""
    _, _, p, fs = _hadoop(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def point(spark: SparkSession, path: str, pointer: dict) -> None:
    """Let the pointer say ``pointer``, in one step."""
    temporary = f"{path}/_{uuid.uuid4().hex}"
    fs, conf, p, _ = _hadoop(spark, temporary)
    own = fs.FileSystem.newInstance(p.toUri(), conf)
    try:
        own.setWriteChecksum(False)  # a checksum beside it would be a second file to replace
        out = own.create(p, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
    finally:
        own.close()
    rename(spark, temporary, f"{path}/{POINTER}", overwrite=True)


def publish(rows: DataFrame, path: str, kind: str = "json") -> str:
    """Write ``rows``, which may come from the table itself, as its new version."""
    spark = rows.sparkSession
    before = read_pointer(spark, path) or {"version": None, "before": []}
    version = f"v-{uuid.uuid4().hex}"
    rows.write.format(kind).save(f"{path}/{version}")
    old = [v for v in [before["version"], *before["before"]] if v]
    point(spark, path, {"version": version, "kind": kind, "schema": rows.schema.jsonValue(), "before": old[:8]})
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that counts now. They stay those, whatever is published while they are read, until it is cleared."""
    now = read_pointer(spark, path)
    if now is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.format(now["kind"]).schema(T.StructType.fromJson(now["schema"])).load(f"{path}/{now['version']}")


def clear(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete versions but for the current one and the ``keep`` before it, and what ended jobs have left. No job may be writing."""
    now = read_pointer(spark, path) or {"version": None, "before": []}
    stay = {POINTER, now["version"], *now["before"][:keep]}
    _, _, p, fs = _hadoop(spark, path)
    gone = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() not in stay)
    for name in gone:
        fs.delete(_hadoop(spark, f"{path}/{name}")[2], True)
    return gone


def append_batch(rows: DataFrame, path: str, batch: int, kind: str = "json") -> bool:
    """Add a batch to a log; false if it is there already. Of two that write one batch at the same time, one adds it."""
    spark = rows.sparkSession
    target = f"{path}/batch={batch:012d}"
    _, _, p, fs = _hadoop(spark, target)
    if fs.exists(p):
        return False
    staged = f"{path}/_staged-{uuid.uuid4().hex}"  # names with an underscore in front are not read
    rows.write.format(kind).save(staged)
    if rename(spark, staged, target, overwrite=False):
        return True
    fs.delete(_hadoop(spark, staged)[2], True)
    return False


def batches(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    """All rows of a log, with the number of their batch."""
    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    _, _, p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], wide)
    return spark.read.format(kind).schema(wide).load(path)
