"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes of a text places chunk boundaries: it
covers the last 16 bytes, so boundaries inside a repeated passage fall in the
same places whatever stands before it, and an insertion only moves the chunks
that it touches. Boundaries fall between words (or, in scripts without
spaces, between characters). Where no hash in the neighbourhood is low enough,
as often in periodic text, the least ones of the neighbourhood are boundaries;
so also inside a long stretch without places between words. A chunk is known by the 64-bit digest of itself
and the chunk before it, so that a few common words do not count as repeated;
all occurrences but the first, in order of (document, place), are repeats, and
repeat both chunks. Runs of repeated chunks of at least ``min_run`` bytes are
removed.

The owner of a digest range gets one occurrence of each distinct digest of a
task's batch, packed; all others of the batch are repeats whatever stands
elsewhere, so they are dealt evenly, without their digests. An owner keeps one
occurrence of a digest and passes on what is beaten, batch by batch: a chunk
that a third of all documents share weighs on it by one row a batch, and on its
memory by one.

Defined results: a null text stays null and has no chunks; rows of equal id
and text are one document, and keep or lose the same spans; rows without an
id are left as they are and repeat nothing; texts shorter than ``min_run``
bytes stay whole unless they repeat as a whole; a very long text costs time in
proportion and some 60 bytes for each of its chunks; an empty table gives an
empty result; columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import arrow_schema, cut, free_names, mix64, narrow
from veridoc.llm.jaccard import _deal, _range_bits

#: One in so many places between words is a boundary: chunks of some 4 words.
ODDS = 3
#: Chunks are at least and at most so many bytes (the last may be shorter).
LEAST, MOST = 10, 512
#: A place is also a boundary if none of so many places on either side, or in a
#: stretch of more than MOST bytes without one none of so many characters, has a
#: lower hash. In prose this adds next to nothing.
NEAR, NEAR_CHARACTERS = 12, 32
#: Bytes of a run of repeated chunks that is removed: some 17 English words.
MIN_RUN = 100
#: Bytes of text that a task gathers before it packs their chunks.
PACK = 6_000_000
#: Occurrences that the owner of a digest range gathers before it compares them.
MEET = 1_000_000
#: Occurrences in a row that has no owner, and how far apart such rows go.
PIECE, _STRIDE = 20_000, 7919

_GEAR = np.random.RandomState(20240602).randint(0, 1 << 16, 256).astype(np.uint16)


def _between() -> np.ndarray:
    """Bytes before which a boundary may fall: white space, and the first
    bytes of characters of three bytes or more."""
    ok = np.zeros(256, bool)
    ok[[9, 10, 11, 12, 13, 32]] = True
    ok[0xE0:] = True
    return ok


_PLACES = _between()


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte, of the last 16 bytes: sum of table values
    shifted by distance, in 16 bits, by doubling."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last being its length."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    ends: list[int] = []
    if n > LEAST:
        h = gear(raw)
        limit = np.uint16(65536 // ODDS)
        # A boundary before byte i looks at the hash of the bytes before it.
        at = np.flatnonzero(_PLACES[raw[1:]]) + 1
        low = h[at - 1]
        at = at[(low < limit) | _is_least(low, NEAR)]
        bounds = np.concatenate(([0], at, [n]))
        more = [at]
        for k in np.flatnonzero(np.diff(bounds) > MOST):
            inner = _characters(raw, bounds[k] + 1, bounds[k + 1])
            more.append(inner[_is_least(h[inner - 1], NEAR_CHARACTERS)])
        at = np.sort(np.concatenate(more)) if len(more) > 1 else at
        last = 0
        for i in [*at.tolist(), n]:
            while i - last > MOST:
                inner = _characters(raw, last + LEAST, last + MOST + 1)
                last = int(inner[np.argmin(h[inner - 1])])
                ends.append(last)
            if i - last >= LEAST and i < n:
                ends.append(i)
                last = i
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


def _is_least(values: np.ndarray, near: int) -> np.ndarray:
    """Whether each value is the least, or equal to it, of itself and so many
    on either side."""
    if not len(values):
        return np.zeros(0, bool)
    padded = np.pad(values, near, constant_values=np.iinfo(values.dtype).max)
    least = values.copy()
    for k in range(2 * near + 1):
        np.minimum(least, padded[k : k + len(values)], out=least)
    return values == least


def _characters(raw: np.ndarray, a: int, b: int) -> np.ndarray:
    """Starts of characters from a on, before b."""
    return np.flatnonzero(raw[a:b] & 0xC0 != 0x80) + a


def digests(data: bytes, ends: list[int]) -> np.ndarray:
    """Digest of each chunk and the one before it, without the white space
    around them, so that a passage is the same after any kind of space. The
    first chunk has the start of the text before it."""
    one, out, a = xxhash.xxh3_64_intdigest, [], 0
    for b in ends:
        out.append(one(data[a:b].strip()))
        a = b
    own = np.array(out, np.uint64)
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    return mix64(own + mix64(before))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


FOUND = "id bigint, mark bigint, places array<int>"


def repeats(docs: DataFrame) -> DataFrame:
    """(id, mark, places) of chunks that repeat an earlier one, of rows
    (id, text); mark is the text's checksum. A document may have several rows."""
    bits, spark = _range_bits(docs), docs.sparkSession
    ddl = "bucket int, digest binary, id binary, mark binary, place binary, known int"
    shape, found = arrow_schema(spark, ddl), arrow_schema(spark, FOUND)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rb in batches:
            for x, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                data = _bytes(text)
                if not data:
                    continue
                d = digests(data, chunk_ends(data))
                held.append((d, np.full(len(d), x, np.int64), np.full(len(d), zlib.crc32(data), np.uint32), np.arange(len(d), dtype=np.int32)))
                size += len(data)
                if size >= PACK:
                    yield from _packed(held)
                    held, size = [], 0
        if held:
            yield from _packed(held)

    def _packed(held: list) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cols, first, beaten = _ordered(cols)
        kept, rest = [c[first] for c in cols], [c[beaten] for c in cols]
        bucket = (kept[0] >> np.uint64(64 - bits)).astype(np.int32)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(at[1:], len(bucket))
        blobs = [pa.array([c[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()) for c in kept]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), *blobs, pa.array(np.zeros(len(at), np.int32))], schema=shape)
        # In any bucket, as nothing is to be met there: pieces follow one another.
        at = range(0, len(rest[0]), PIECE)
        start = int(kept[0][0] ^ np.uint64(len(bucket))) % (1 << bits)
        blobs = [pa.array([c[i : i + PIECE].tobytes() for i in at], pa.binary()) for c in rest[1:]]
        anywhere = pa.array([(start + k * _STRIDE) % (1 << bits) for k in range(len(at))], pa.int32())
        yield pa.RecordBatch.from_arrays([anywhere, pa.array([b""] * len(at), pa.binary()), *blobs, pa.array(np.ones(len(at), np.int32))], schema=shape)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, most = None, [], 0, MEET
        for rb in batches:
            for bucket, digest, *parts, known in zip(*(rb.column(k).to_pylist() for k in range(6)), strict=True):
                cols = [np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.uint32, np.int32), strict=True)]
                if known:
                    yield from _by_document(*cols)
                    continue
                if bucket != now or size >= most:
                    held, beaten = _settle(held)
                    yield from _by_document(*beaten)
                    now, held, size = bucket, held if bucket == now else [], 0
                    # At least as many again before the next comparison.
                    most = max(MEET, len(held[0][0]) if held else 0)
                held.append([np.frombuffer(digest, np.uint64), *cols])
                size += len(cols[0])
        yield from _by_document(*_settle(held)[1])

    def _settle(held: list) -> tuple[list, list]:
        """One occurrence of each digest, and the beaten ones."""
        if not held:
            return [], [np.empty(0, t) for t in (np.int64, np.uint32, np.int32)]
        cols, first, beaten = _ordered([np.concatenate(c) for c in zip(*held, strict=True)])
        return [[c[first] for c in cols]], [c[beaten] for c in cols[1:]]

    def _by_document(x: np.ndarray, mark: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(x):
            return
        order = np.lexsort((place, mark, x))
        x, mark, place = x[order], mark[order].astype(np.int64), place[order]
        new = np.append(True, (x[1:] != x[:-1]) | (mark[1:] != mark[:-1]))
        one = new | np.append(True, place[1:] != place[:-1])
        x, mark, place, new = x[one], mark[one], place[one], new[one]
        at = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(x)).astype(np.int32)), pa.array(place))
        yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(mark[at]), lists.cast(found.field(2).type)], schema=found)

    return _deal(docs.mapInArrow(pack, ddl)).mapInArrow(meet, FOUND)


def _ordered(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Occurrences in order of (digest, id, mark, place), which of them are
    the first of their digest, and which are beaten by that. The same place of
    the same document, should its row be repeated, is neither."""
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    start = np.append(True, cols[0][1:] != cols[0][:-1])
    leader = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
    same = (cols[1] == cols[1][leader]) & (cols[2] == cols[2][leader]) & (cols[3] == cols[3][leader])
    return cols, start, ~same


def runs(ends: list[int], places: set[int], min_run: int) -> list[tuple[int, int]]:
    """Byte spans of runs of repeated chunks that are long enough, or whole.
    A place repeats its chunk and the one before it."""
    out, a, begun = [], 0, None
    for i, b in enumerate(ends):
        if i in places or i + 1 in places:
            begun = a if begun is None else begun
        elif begun is not None:
            out.append((begun, a))
            begun = None
        a = b
    if begun is not None:
        out.append((begun, a))
    whole = ends[-1] if ends else 0
    return [(a, b) for a, b in out if b - a >= min_run or b - a == whole]


def remove(text: str, places: set[int], min_run: int = MIN_RUN) -> tuple[str, int]:
    """``text`` without its repeated runs, and their number."""
    data = _bytes(text)
    spans = runs(chunk_ends(data), places, min_run)
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at:a])
        at = b
    keep.append(data[at:])
    out = b"".join(keep).decode("utf-8", "surrogatepass")
    return (out.lstrip() if spans and spans[0][0] == 0 else out) if spans else text, len(spans)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_run: int = MIN_RUN) -> DataFrame:
    """Rows of ``df`` with all their columns: repeated runs are removed from
    the text, a length column, if there is one, follows, and ``n_removed``
    counts the code points that went; a column of that name is replaced."""
    spark, df = df.sparkSession, df.drop("n_removed")
    docs = narrow(df, key, text).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL")
    # Sets, as many rows of equal id and text give equal lists. Cut, so that the
    # join has plain exchanges on both sides and a hot key can be split.
    found = cut(repeats(docs).groupBy("id", "mark").agg(F.flatten(F.collect_set("places")).alias("places")))
    i, m, p = free_names(df, "id", "mark", "places")
    found = found.select(F.col("id").alias(i), F.col("mark").alias(m), F.col("places").alias(p))
    mark = F.crc32(F.encode(F.col(f"`{text}`"), "utf-8"))
    rows = df.join(found, (F.col(f"`{key}`").cast("bigint") == F.col(i)) & (mark == F.col(m)), "left").drop(i, m)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "n_removed bigint"])
    shape, at = arrow_schema(spark, ddl), df.columns.index(text)
    sized = df.columns.index(n_chars) if n_chars in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            old = rb.column(at).to_pylist()
            places = rb.column(rb.num_columns - 1).to_pylist()
            new = [x if x is None or not p else remove(x, set(p), min_run)[0] for x, p in zip(old, places, strict=True)]
            gone = [0 if a is None else len(a) - len(b) for a, b in zip(old, new, strict=True)]
            cols = list(rb.columns[: len(shape) - 1])
            cols[at] = pa.array(new, shape.field(at).type)
            if sized is not None:
                n = [was if not g else len(b) for was, g, b in zip(cols[sized].to_pylist(), gone, new, strict=True)]
                cols[sized] = pa.array(n, shape.field(sized).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64())], schema=shape)

    return rows.mapInArrow(run, ddl)
