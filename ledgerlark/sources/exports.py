"""Exports as files: staged, then committed under a name of their own, so that a reader meets whole exports only.

A folder of exports holds ``<attempt>/data`` and ``<attempt>/manifest.json``. Files are written under a staging name, read
back and counted, renamed, and the manifest comes last: an export without one isn't there. A lost executor's tasks run again
inside the staging folder; a lost driver leaves a staging folder that no reader looks into.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: How csv marks a missing value, so that empty texts are told from it; blanks and line ends in texts stay.
MISSING = "\\N"
OPTIONS = {
    "csv": {"header": "true", "nullValue": MISSING, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **TIMES},
    "json": TIMES,
}


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its constructor of paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _load(spark: SparkSession, fmt: str, schema: StructType, where: str | list[str]) -> DataFrame:
    reader = spark.read.format(fmt).options(**OPTIONS[fmt]).schema(schema).option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("multiLine", "true")
    return reader.load(where)


def write_export(df: DataFrame, path: str, order: list[str], fmt: str = "csv", attempt: str | None = None) -> str:
    """Writes ``df`` under ``path`` as ``csv`` (with a head line in each file) or ``json`` (one object a line), rows in
    ``order`` within a file and from one file to the next by name, and returns the attempt's name. ``order`` should tell
    rows apart where their order matters. An attempt that is there already is refused, and so is csv where a text is the
    mark of missing values. An empty frame is an export too."""
    if fmt not in OPTIONS:
        raise ValueError(f"csv or json, not {fmt}")
    spark = df.sparkSession
    attempt = attempt or f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    files, make = _files(spark, path)
    if files.exists(make(f"{path}/{attempt}")):
        raise FileExistsError(f"{path}/{attempt}")
    staged, seen = f"{path}/_staging-{uuid.uuid4().hex}", Observation("export")
    texts = [f.name for f in df.schema if f.dataType == StringType()] if fmt == "csv" else []
    marked = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"`{c}`") == MISSING, F.lit(False)) for c in texts), F.lit(False))
    # Counted after the sort, in the tasks that write: the ranges of a sort are found by reading its input once more.
    df.orderBy(*order).observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(marked, 1)).alias("marked")).write.format(fmt).options(**OPTIONS[fmt]).save(f"{staged}/data")
    if seen.get["marked"]:
        raise ValueError(f"{seen.get['marked']} rows hold the text {MISSING}: write json")
    n = _load(spark, fmt, df.schema, f"{staged}/data").count()
    if n != seen.get["n"]:
        raise RuntimeError(f"{seen.get['n']} rows were written, {n} are in the files")
    parts = sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(make(f"{staged}/data")) if s.getPath().getName().startswith("part-"))
    if not files.rename(make(staged), make(f"{path}/{attempt}")):
        raise RuntimeError(f"could not commit {attempt}")
    manifest = {"attempt": attempt, "format": fmt, "order": order, "rows": n, "files": [{"name": name, "bytes": size} for name, size in parts], "schema": df.schema.jsonValue()}
    out = files.create(make(f"{path}/{attempt}/_manifest"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    files.rename(make(f"{path}/{attempt}/_manifest"), make(f"{path}/{attempt}/manifest.json"))
    return attempt


def exports(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed exports under ``path``, in order of name (without names of one's own: of time)."""
    files, make = _files(spark, path)
    if not files.exists(make(path)):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(make(path)) if not s.getPath().getName().startswith("_") and files.exists(make(f"{path}/{s.getPath().getName()}/manifest.json")))


def read_export(spark: SparkSession, path: str, attempt: str | None = None) -> DataFrame:
    """The rows of a committed export, by default the last one's, with the types that they had."""
    known = exports(spark, path)
    if not known or attempt not in (None, *known):
        raise FileNotFoundError(f"no export {attempt or ''} under {path}")
    attempt = attempt or known[-1]
    manifest = json.loads(spark.read.option("wholetext", "true").text(f"{path}/{attempt}/manifest.json").first()[0])
    schema = StructType.fromJson(manifest["schema"])
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    return _load(spark, manifest["format"], schema, [f"{path}/{attempt}/data/{f['name']}" for f in manifest["files"]])
