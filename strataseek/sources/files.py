"""Files of a project as a DataFrame: listing, classes, bounded reading, decoding, notebooks."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataseek.functions import paths as P
from strataseek.functions.text import path_key
from strataseek.runtime import materialise

#: Folders that are never entered.
IGNORED = r"(?:^|/)(?:\.git|node_modules|__pycache__|\.venv|venv|dist|build|\.cache|worktrees)/"


def scan(spark: SparkSession, root: str, ignored: str = IGNORED) -> DataFrame:
    """rel_path, size, modified, kind, reason of every file below a folder; contents are not read.

    Spark lists no files or folders whose name begins with a dot or an underscore; they count as excluded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    base = F.lit(root.rstrip("/").removeprefix("file://"))
    # the reader gives encoded addresses of the form file:/folder/name
    plain = F.url_decode(F.replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    rel = F.substr(plain, F.length(base) + 2)
    kind = P.classify(F.col("rel_path"), F.col("size"))
    return files.withColumn("rel_path", rel).where(~F.col("rel_path").rlike(ignored)).select("path", "rel_path", "size", "modified", kind.alias("kind")).withColumn("reason", P.skip_reason(F.col("kind")))


#: Paths handed to one read of contents.
READ_PATHS = 5_000


def read(spark: SparkSession, root: str, ignored: str = IGNORED, known: DataFrame | None = None) -> DataFrame:
    """``scan`` with raw content, digest and text of the files that may be indexed.

    The folder is listed first; then only files with a class that is indexed
    are opened, in blocks of READ_PATHS paths, so content of sensitive, large
    and unsupported files is never read. A text with a literal secret gets the
    reason ``secret_content`` and neither raw content nor text.

    ``known``: path_key, size, modified of files whose content is known
    already; files that agree with it are neither opened nor returned.
    """
    meta = scan(spark, root, ignored)
    if known is not None:
        meta = meta.withColumn("path_key", path_key(F.col("rel_path"))).join(known.select("path_key", "size", "modified").distinct(), ["path_key", "size", "modified"], "left_anti").drop("path_key")
    meta = materialise(meta)
    wanted = meta.where("reason IS NULL").select("path", "rel_path", "size", "modified", "kind")
    blocks, block = [], []
    for r in wanted.select("path").toLocalIterator():
        block.append(r.path)
        if len(block) == READ_PATHS:
            blocks.append(block)
            block = []
    blocks += [block] if block else []
    contents = [spark.read.format("binaryFile").load([_glob_free(x) for x in b]).select("path", F.col("content").alias("raw")) for b in blocks]
    empty = spark.createDataFrame([], "path string, raw binary")
    raw = reduce(DataFrame.unionByName, contents, empty)
    found = wanted.join(raw, "path", "left")
    text = decode(F.col("raw"))
    body = F.when(P.extension(F.col("rel_path")) == "ipynb", notebook(text)).otherwise(text)
    found = found.select("rel_path", "size", "modified", "kind", "raw", F.sha2("raw", 256).alias("sha256"), body.alias("text"))
    reason = F.when(F.col("raw").isNull(), "read_failed").when(F.col("text").isNull(), "binary").when(F.col("text").rlike(P.SECRET_TEXT), "secret_content")
    found = found.withColumn("reason", reason)
    secret = F.col("reason").eqNullSafe("secret_content")
    out = found.select("rel_path", "size", "modified", "kind", "reason", F.when(~secret, F.col("raw")).alias("raw"), "sha256", F.when(~secret, F.col("text")).alias("text"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return out.unionByName(meta.where("reason IS NOT NULL").select("rel_path", "size", "modified", "kind", "reason", none("binary", "raw"), none("string", "sha256"), none("string", "text")))


def _glob_free(path: str) -> str:
    """A listed path as a pattern that means this path only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


_BAD = r"[\x00-\x08\x0b\x0e-\x1f\x7f]"


@F.pandas_udf(StringType())
def _gb18030(raw: pd.Series) -> pd.Series:
    """GB18030 bytes as text, null for null and for what is none."""

    def one(b: bytes | None) -> str | None:
        try:
            return None if b is None else b.decode("gb18030")
        except UnicodeDecodeError:
            return None

    return raw.map(one)


def decode(raw: Column) -> Column:
    """Text of bytes: UTF-8 without its mark, else GB18030; null where it is neither or holds control characters."""
    utf = F.is_valid_utf8(raw.cast("string"))
    # bytes that are UTF-8 do not leave the JVM
    s = F.coalesce(F.when(utf, F.regexp_replace(F.decode(raw, "UTF-8"), "^\ufeff", "")), _gb18030(F.when(~utf, raw)))
    return F.when(~s.rlike(_BAD), s)


def is_binary(raw: Column) -> Column:
    """Whether the first 4096 bytes hold a NUL, or more than a quarter of control bytes; empty content is none."""
    head = F.substring(raw, 1, 4096)
    # bytes as Latin-1 characters, one each
    text = F.decode(head, "ISO-8859-1")
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f]", ""))
    return (F.octet_length(head) > 0) & (text.contains("\0") | (odd > F.octet_length(head) * 0.25))


def decode_lenient(raw: Column) -> Column:
    """Text of bytes that are not binary: UTF-8 without its mark, GB18030, else Latin-1; null for binary content."""
    return F.when(~is_binary(raw), F.coalesce(decode(raw), F.decode(raw, "ISO-8859-1")))


def notebook(text: Column) -> Column:
    """Markdown and code cells of a notebook joined by blank lines; the raw text if it is no notebook."""
    doc = F.from_json(text, "cells array<struct<cell_type:string,source:string>>")
    cells = F.filter(doc["cells"], lambda c: c["cell_type"].isin("markdown", "code"))
    lines = lambda s: F.coalesce(F.array_join(F.from_json(s, "array<string>"), ""), s)
    return F.coalesce(F.array_join(F.transform(cells, lambda c: lines(c["source"])), "\n\n"), text)
