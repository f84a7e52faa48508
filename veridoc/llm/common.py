"""Shared plumbing of the training-data operators: table reading, shared
storage, Arrow row maps and vectorised word hashing.

Null texts count as empty texts everywhere in this subpackage unless an
operator's docstring says otherwise.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. A private one is made only where a local session has none, as
    in tests; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="veridoc-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files of what is no longer referred to. Spark removes
    them when the driver collects garbage, which a driver with room to spare
    does late, while they fill the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def sweep(spark: SparkSession, folder: str, prefix: str, keep: list[str]) -> None:
    """Removes files in ``folder`` that begin with ``prefix`` but with no path
    in ``keep``: those of attempts of tasks that did not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {k.rsplit("/", 1)[-1] for k in keep}
    for status in fs.listStatus(path) if fs.exists(path) else ():
        name = status.getPath().getName()
        if name.startswith(prefix) and name.split(".")[0] not in names:
            fs.delete(status.getPath(), True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Row-parallel Arrow map. ``fn`` turns a batch into a dict of columns in
    the order of ``schema``."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [_array(cols[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# --- vectorised word-shingle hashing ---------------------------------------

#: One odd 64-bit base and its inverse, and the multipliers of a
#: published 64-bit finaliser (splitmix64).
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_BYTE_TABLE = np.random.RandomState(20240601).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n, grown on demand per worker."""
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of one text, held as one byte string with single spaces, and
    hashes of any run of words in O(1) each.

    Only whole-text state of this one document is held: about 20 bytes for
    each byte of text.
    """

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.words = words
        self.joined = joined = b" ".join(words)
        raw = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts = np.concatenate(([0], gaps + 1)).astype(np.int64) if self.n else np.empty(0, np.int64)
        self.ends = np.concatenate((gaps, [len(raw)])).astype(np.int64) if self.n else np.empty(0, np.int64)
        up, self._down = _power_tables(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_TABLE[raw] * up[: len(raw)], out=self._sums[1:])

    def run_hashes(self, size: int) -> np.ndarray:
        """64-bit hash of each run of ``size`` consecutive words."""
        if self.n < size or size < 1:
            return np.empty(0, np.uint64)
        a, b = self.starts[: self.n - size + 1], self.ends[size - 1 :]
        return self.span_hashes(a, b - a)

    def span_hashes(self, a: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """64-bit hash of the bytes from each of ``a`` on."""
        return mix64((self._sums[a + size] - self._sums[a]) * self._down[a])

    def run_bytes(self, first: int, size: int) -> bytes:
        return self.joined[self.starts[first] : self.ends[first + size - 1]]

    def shingles(self, size: int) -> np.ndarray:
        """Sorted distinct hashes of ``size``-word shingles; a text with fewer
        words, but not none, has its whole sequence as its one shingle."""
        if not self.n:
            return np.empty(0, np.uint64)
        return np.unique(self.run_hashes(min(size, self.n)))


#: ASCII lower-casing of bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
