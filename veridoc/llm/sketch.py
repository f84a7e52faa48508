"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the k smallest distinct 64-bit hashes of a text's word
shingles, in ascending order. Fingerprints of parts merge into the
fingerprint of the union, and two of them estimate resemblance, containment
and the number of distinct shingles. A set of at most k shingles is held
whole, so its estimates are exact.

Defined results: null and empty texts have the empty fingerprint; two empty
fingerprints have resemblance 1, an empty and a full one 0. Equal texts have
equal fingerprints, and so have texts with equal shingle sets. Null keys come
first; rows of one key follow each other by the hash of their text, equal rows
too; the one row of a table is its own next; an empty table gives an empty
result; extra columns are not read, and the key may have any name; a very long
text takes time and memory in proportion. Rows of one key, null included, are
in one task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridoc.llm.common import Words, arrow_schema, map_batches, narrow, space_words, texts

#: Turns unsigned order into signed order.
_SIGN = np.uint64(1 << 63)

K = 256
WORDS = 5


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    found = Words(space_words(text)).shingles(words)
    return found[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of both sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard resemblance: among the k smallest of the union,
    the share that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(least, both, assume_unique=True).sum() / len(least))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """(key, fingerprint, n_shingles estimate) for each row; no shuffle."""

    def run(rb: pa.RecordBatch) -> dict:
        all_ = [sketch(x, k, words) for x in texts(rb.column(1))]
        return {key: rb.column(0), "fingerprint": [to_text(a) for a in all_], "n_shingles": [distinct(a, k) for a in all_]}

    return map_batches(narrow(df, key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string, n_shingles double")


def merged(prints: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, fingerprint) of the union over the rows of each ``by``.

    Equal hashes of a group collapse before and after one shuffle on (group,
    hash), and Spark's group limit keeps k rows of a group in each task
    before they meet, so a hot group costs no task more than k rows from each
    other."""
    kind = prints.schema[by].dataType.simpleString()
    ddl = f"`{by}` {kind}, h bigint"
    shape = arrow_schema(prints.sparkSession, ddl)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sketches = [from_text(s) for s in rb.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(sketches)), [len(a) for a in sketches])
            flat = np.concatenate([np.empty(0, np.uint64), *sketches]) ^ _SIGN
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(rows)), pa.array(flat.view(np.int64))], schema=shape)

    @F.pandas_udf("string")
    def joined(lists: pd.Series) -> pd.Series:
        return lists.map(lambda h: to_text(np.sort(np.array(h, np.int64)).view(np.uint64) ^ _SIGN))

    least = W.partitionBy(by).orderBy("h")
    rows = narrow(prints, by, "fingerprint").mapInArrow(spread, ddl).distinct()
    rows = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k)
    return rows.groupBy(by).agg(joined(F.collect_list("h")).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/4) code points replaced by the first as
    many (or all) of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def against_next(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to the
    edited and to the next text in ascending order of (key, hash of text);
    the last row is followed by the first.

    Rows are dealt by ranges of the key, whose bounds are keys of the table.
    The rows that open a range also go to the range before it, where they only
    serve as the next of its last row. So one shuffle of the texts is all, and
    no task or broadcast holds more than its range.
    """
    spark = df.sparkSession
    given, kind = key, df.schema[key].dataType.simpleString()
    df = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key, text = "key", "text"
    rows = df.withColumn("__tie", F.xxhash64("text"))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    cuts = narrow(df, key).agg(
        F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("at"), F.min(key).alias("least"), F.count(F.when(F.col(f"`{key}`").isNull(), 1)).alias("nulls")
    ).first()
    bounds = sorted({b for b in cuts["at"] or [] if b > cuts["least"]})
    last = len(bounds)
    edge = np.array(bounds)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        if len(edge):
            out[known] = np.searchsorted(edge, ids[known].to_numpy(edge.dtype), side="right")
        return pd.Series(out)

    rows = rows.withColumn("__part", place(F.col(f"`{key}`")))
    opens = F.col(f"`{key}`").isNull() if cuts["nulls"] else F.col(f"`{key}`") == F.lit(cuts["least"])
    also = F.when(F.col(f"`{key}`").isin(bounds), F.col("__part") - 1) if bounds else F.lit(None).cast("int")
    also = F.when(opens, F.lit(last)).otherwise(also)
    # A row that opens a range stands there as an own row (0) and before it as a guest (1).
    seats = F.array(F.struct(F.col("__part").alias("p"), F.lit(0).alias("guest")), F.when(also.isNotNull(), F.struct(also.alias("p"), F.lit(1).alias("guest"))))
    rows = rows.select(F.explode(F.filter(seats, lambda s: s.isNotNull())).alias("s"), F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text), "__tie")
    rows = rows.select("s.p", "s.guest", F.col(f"`{key}`"), F.col(f"`{text}`"), "__tie")
    rows = rows.repartitionById(last + 1, F.col("p")).sortWithinPartitions("p", "guest", F.col(f"`{key}`").asc_nulls_first(), "__tie")
    ddl = f"`{given}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    shape = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # (part, key, text, sketch) whose next row is awaited
        for rb in batches:
            for p, guest, x_key, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist(), texts(rb.column(3)), strict=True):
                if guest and held is None:
                    continue  # a guest after the one that was needed
                own = sketch(x, k, words)
                if held is not None and held[0] == p:
                    out.append(_row(held, x, own, k, words))
                held = None if guest else (p, x_key, x, own)
            if out:
                yield _batch(out, shape)
                out = []

    return rows.select("p", "guest", F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, ddl)


def _row(held: tuple, following: str, after: np.ndarray, k: int, words: int) -> tuple:
    _, key, text, own = held
    new = edited(text, following)
    changed = own if new == text else sketch(new, k, words)
    digest = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
    return key, len(text), digest, to_text(own), to_text(changed), resemblance(own, changed, k), resemblance(own, after, k)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
