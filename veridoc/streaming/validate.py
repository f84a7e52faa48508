"""Documents that arrive as a stream.

Keywords need no state. Uniqueness holds within a watermark, as state has to
end somewhere: a repeated key is dropped while the first is remembered.
References are checked batch by batch against a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.operators.keys import extract
from veridoc.operators.validate import Bound, Validator


def structural(validator: Validator, uri: str, stream: DataFrame, ids: list[str]) -> DataFrame:
    """ids, reason, keyword, pointer, path of violated keywords, as a stream."""
    return validator.bind(uri, stream, ids).structural(uri)


def accepted(validator: Validator, uri: str, stream: DataFrame, ids: list[str], time: str, delay: str) -> DataFrame:
    """Valid documents without those whose key came before, within ``delay``."""
    b = validator.bind(uri, stream, ids).bound[uri]
    out = validator.valid(uri).withWatermark(time, delay)
    for i, d in enumerate(k for k in b.schema.keys if k.kind in ("unique", "primary_key")):
        if i:
            raise ValueError("a stream can enforce one key, as a watermarked state cannot be withdrawn")
        out = out.withColumn("__key", extract(b.root, d, validator.compiler(b.schema))).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return out


def error_rates(validator: Validator, uri: str, stream: DataFrame, ids: list[str], time: str, window: str, delay: str) -> DataFrame:
    """(window, n_docs, n_failed) by event time."""
    b: Bound = validator.bind(uri, stream, ids).bound[uri]
    judged = stream.withWatermark(time, delay).withColumn("__ok", validator._ok(b))
    return judged.groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("n_docs"), F.count_if(~F.col("__ok")).alias("n_failed"))


def check_references(validator: Validator, uri: str, ids: list[str], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: gives ``sink`` each batch's errors,
    references included. Targets must be bound as tables."""

    def batch(df: DataFrame, number: int) -> None:
        validator.bind(uri, df, ids)
        sink(validator.errors(uri), number)

    return batch
