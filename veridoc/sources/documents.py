"""Documents as rows (doc_id, ord, file, json VARIANT, reason).

``reason`` is null for a document that can be read; otherwise ``fatal`` (a
file that is neither JSON nor YAML) or ``ignored`` (an inline entry without
its parts).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = "doc_id string, ord bigint, file string, json variant, reason string"


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """JSON text of YAML text, null where it is neither."""
    import yaml

    def one(text: str | None) -> str | None:
        try:
            value = yaml.safe_load(text)
            return json.dumps(value, default=str) if value is not None else None
        except (yaml.YAMLError, ValueError, AttributeError):
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def last_members(texts: pd.Series) -> pd.Series:
    """JSON text again, of repeated members the last; null if it is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text))
        except (ValueError, TypeError):
            return None

    return texts.map(one)


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """``json`` and ``reason`` for a column of JSON or YAML text.

    JSON is parsed by Spark. Only what that rejects goes to Python: JSON with
    repeated members, then YAML."""
    x = F.col(f"`{text}`")
    first = F.try_parse_json(x)
    rest = F.when(first.isNull(), x)
    again = F.coalesce(first, F.try_parse_json(last_members(rest)), F.try_parse_json(yaml_to_json(rest)))
    out = df.withColumn("json", again)
    return out.withColumn("reason", F.when(F.col("json").isNull(), F.lit("fatal")))


#: What a folder gives, of a path below it: the names, and none that Spark's
#: reader skips.
_NAMES, _HIDDEN = r"\.json|\.yaml", r"(^|/)[._][^/]*"


def _plain(uri: Column) -> Column:
    """A path with one slash after its scheme, as writers differ in that."""
    return F.regexp_replace(uri, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")


def _qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The whole URI of a path, and whether it is a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(p)
    uri = re.sub("^([A-Za-z][A-Za-z0-9+.-]*:)/+", r"\1/", whole.toUri().toString())
    return uri.rstrip("/"), fs.getFileStatus(whole).isDirectory()


def files(spark: SparkSession, *paths: str, iter_arrays: bool = False) -> DataFrame:
    """Document files. In a folder, at any depth, those with ".json" or
    ".yaml" in their name that do not begin with a dot, as Spark's reader
    skips these; a file that is named itself is always taken. Documents are
    ordered by path. A file that several paths give counts once: whether an
    earlier path has it is told by its name, so that no text is shuffled. With
    ``iter_arrays`` each element of a top-level array is a document of its own,
    "file [i]"."""
    reader = spark.read.option("recursiveFileLookup", "true")
    parts, before = [], []
    for path in paths:
        uri, folder = _qualified(spark, path)
        whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        at = _plain(F.col("file"))
        whole = whole.filter(F.element_at(F.split("file", "/"), -1).rlike(_NAMES)) if folder else whole
        for other, is_folder in before:
            if is_folder:
                below = F.substring(at, len(other) + 2, 1 << 30)
                had = at.startswith(other + "/") & F.element_at(F.split(at, "/"), -1).rlike(_NAMES) & ~below.rlike(_HIDDEN)
            else:
                had = at == other
            whole = whole.filter(~had)
        before.append((uri, folder))
        parts.append(whole)
    docs = parsed(reduce(DataFrame.union, parts))
    if iter_arrays:
        docs = shredded(docs)
    else:
        docs = docs.withColumn("doc_id", F.col("file")).withColumn("at", F.lit(0))
    # The order of documents is that of their paths; no number is needed for
    # that, so none is counted over the whole set.
    return docs.select("doc_id", F.struct("file", "at").alias("ord"), "file", "json", "reason")


def shredded(docs: DataFrame) -> DataFrame:
    """One document for each element of a top-level array."""
    is_array = F.coalesce(F.schema_of_variant("json"), F.lit("")).startswith("ARRAY")
    items = F.when(is_array, F.try_variant_get("json", "$", "array<variant>")).otherwise(F.array("json"))
    rows = docs.select("file", "reason", is_array.alias("many"), F.posexplode(items).alias("at", "item"))
    doc_id = F.when(F.col("many"), F.concat("file", F.lit(" ["), F.col("at"), F.lit("]"))).otherwise(F.col("file"))
    return rows.select("file", F.col("item").alias("json"), "reason", "at", doc_id.alias("doc_id"))


def inline(spark: SparkSession, entries: list) -> DataFrame:
    """Inline documents: plain values, or entries {"json": ..., "errors": ...,
    "file": ...}; an entry without one of the first two is ignored."""
    rows = list(_inline_rows(entries))
    df = spark.createDataFrame(rows, "doc_id string, ord bigint, file string, text string, reason string")
    return df.select("doc_id", "ord", "file", F.try_parse_json("text").alias("json"), "reason")


def _inline_rows(entries: list) -> Iterator[tuple]:
    for i, e in enumerate(entries):
        name, reason, value = "(inline)", None, e
        if isinstance(e, dict) and ("json" in e or "errors" in e):
            name = e.get("file", name)
            reason = None if "json" in e and "errors" in e else "ignored"
            value = e.get("json")
        yield f"{name} #{i}" if name == "(inline)" else name, i, name, json.dumps(value), reason
