"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Every window of ``size`` consecutive words of a benchmark item goes into a
hash set; an item with fewer words, but not none, is one window as a whole.
Training texts are scanned once: the hashes of all their word windows, for
each window length in the set, are looked up at once, a hit is verified word
by word, and every word inside a verified window is hit. Then spans of hit
words or whole documents can be removed.

The set is a broadcast only up to ``block_windows`` windows. A larger
benchmark is cut into blocks of so many windows, each scanned in a pass of
its own over rows that carry the hits so far, with a written table between
passes; hits are unions over blocks, so results do not depend on their number.

Defined results: a null text has no words; a null item_id takes part in
hits but not in n_items; repeated items count once by their id; an empty
benchmark leaves all documents clean; repeated rows have equal results; an empty
table gives an empty result; extra columns of any name stay in ``clean`` (but
for ``__hit_words`` and ``__hit_items``, which passes use) and are not read by
``scan``; a very long text takes time and memory in proportion.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from veridoc.llm.common import LOWER, Words, arrow_schema, narrow, written

SIZE = 8
#: Windows in one broadcast: some 100 bytes each, so about 50 MB, and some
#: 300 MB in a worker's set.
BLOCK_WINDOWS = 500_000

#: Bytes of separators become spaces: all of ASCII but digits and letters.
_SEPARATE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)


#: The same words in the text itself, before lower-casing.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans of ``item_words`` in the text itself."""
    return [m.span() for m in _WORD.finditer(text)]


def windows(items: DataFrame, size: int = SIZE, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, n, item) of a benchmark."""
    kind = items.schema[item].dataType.simpleString()
    ddl = f"gram binary, n int, item {kind}"
    shape = arrow_schema(items.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for key, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                words = item_words(x)
                n = min(size, len(words))
                grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []
                if grams:
                    yield pa.RecordBatch.from_pydict({"gram": grams, "n": [n] * len(grams), "item": [key] * len(grams)}, schema=shape)

    return narrow(items, item, text).mapInArrow(run, ddl).distinct()


class GramSet:
    """Hash set of windows: sorted hashes by window length, and for each the
    windows and items that have it."""

    def __init__(self, rows: list[tuple[bytes, int, object]]):
        by_hash: dict[int, dict[int, dict[bytes, set]]] = {}
        for gram, n, item in rows:
            h = int(Words(gram.split(b" ")).run_hashes(n)[0])
            by_hash.setdefault(n, {}).setdefault(h, {}).setdefault(gram, set()).add(item)
        self.sizes = {n: (np.array(sorted(x), np.uint64), x) for n, x in by_hash.items()}

    def hits(self, words: Words) -> tuple[np.ndarray, set]:
        """Mask of hit words, and the items whose windows occur."""
        edges = np.zeros(words.n + 1, np.int64)
        items: set = set()
        for n, (known, grams) in self.sizes.items():
            hashes = words.run_hashes(n)
            if not len(hashes):
                continue
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == hashes).tolist():
                found = grams[int(hashes[i])].get(words.run_bytes(i, n))
                if found is not None:
                    edges[i] += 1
                    edges[i + n] -= 1
                    items |= found
        return np.cumsum(edges[:-1]) > 0, items


def gram_sets(items: DataFrame, size: int = SIZE, item: str = "item_id", text: str = "text", block_windows: int = BLOCK_WINDOWS) -> list[Broadcast]:
    """Broadcast windows of a benchmark, at most ``block_windows`` in each; the
    driver holds one block at a time."""
    sc = items.sparkSession.sparkContext
    rows, out = [], []
    for row in windows(items, size, item, text).toLocalIterator():
        rows.append((bytes(row.gram), row.n, row.item))
        if len(rows) == block_windows:
            out.append(sc.broadcast(rows))
            rows = []
    if rows or not out:
        out.append(sc.broadcast(rows))
    return out


_built: dict[str, tuple[Broadcast, GramSet]] = {}


def _set(block: Broadcast) -> GramSet:
    """The set of a block; a worker keeps the latest."""
    if "set" not in _built or _built["set"][0] is not block:
        _built["set"] = (block, GramSet(block.value))
    return _built["set"][1]


#: Columns that carry hits from one pass to the next.
_HIT, _ITEMS = "__hit_words", "__hit_items"


def find(text: str | None, grams: GramSet, hit: bytes | None = None, items: list | None = None) -> tuple[np.ndarray, set]:
    """Mask of hit words and items that occur, with those of passes before."""
    words = Words(item_words(text))
    mask, found = grams.hits(words)
    if hit:
        mask |= np.unpackbits(np.frombuffer(hit, np.uint8), count=words.n).astype(bool)
    return mask, found.union(items or ())


def _passes(df: DataFrame, sets: list[Broadcast], text: str, item_kind: str) -> DataFrame:
    """``df`` with the hits of all blocks but the last."""
    for block in sets[:-1]:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in (_HIT, _ITEMS)]
        ddl = ", ".join([*fields, f"`{_HIT}` binary", f"`{_ITEMS}` array<{item_kind}>"])
        shape, n = arrow_schema(df.sparkSession, ddl), len(fields)
        at = df.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], block=block, shape=shape, n=n, at=at) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                hits = [find(x, _set(block), *before) for x, before in zip(rb.column(at).to_pylist(), _before(rb), strict=True)]
                bits = [np.packbits(m).tobytes() for m, _ in hits]
                cols = [*rb.columns[:n], pa.array(bits, shape.field(n).type), pa.array([list(i) for _, i in hits], shape.field(n + 1).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=shape)

        df = written(df.mapInArrow(run, ddl))
    return df


def _before(rb: pa.RecordBatch) -> list[tuple]:
    if _HIT not in rb.schema.names:
        return [(None, None)] * rb.num_rows
    return list(zip(rb.column(rb.schema.names.index(_HIT)).to_pylist(), rb.column(rb.schema.names.index(_ITEMS)).to_pylist(), strict=True))


def item_digest(items: set) -> str:
    names = sorted(str(x) for x in items if x is not None)
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def scan(df: DataFrame, benchmark: DataFrame, *, size: int = SIZE, min_items: int = 2, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    sets = gram_sets(benchmark, size, item, item_text, block_windows)
    rows = _passes(narrow(df, key, text), sets, text, benchmark.schema[item].dataType.simpleString())
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    shape, last = arrow_schema(df.sparkSession, ddl), sets[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            out = []
            for x, before in zip(rb.column(1).to_pylist(), _before(rb), strict=True):
                mask, items = find(x, _set(last), *before)
                n = len(items - {None})
                out.append((len(mask), int(mask.sum()), n, item_digest(items), n >= min_items))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(shape)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0), *cols], schema=shape)

    return rows.mapInArrow(run, ddl)


def remove_spans(text: str, mask: np.ndarray) -> str:
    """``text`` without each stretch from the first word of a run of hit words
    up to the next word that stays (at the end of the text: up to the end of
    the last hit word)."""
    spans, keep, at, i = [m.span() for m in _WORD.finditer(text)], [], 0, 0
    n = len(spans)
    while i < n:
        if mask[i]:
            j = i
            while j + 1 < n and mask[j + 1]:
                j += 1
            keep.append(text[at : spans[i][0]])
            at = spans[j + 1][0] if j + 1 < n else spans[j][1]
            i = j
        i += 1
    return "".join(keep) + text[at:]


def clean(df: DataFrame, benchmark: DataFrame, *, size: int = SIZE, min_items: int = 2, text: str = "text", n_chars: str = "n_chars", item: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Rows of ``df`` with all their columns: documents that hold windows of
    ``min_items`` items or more go; in others the hit spans are removed from
    the text, and a length column, if there is one, follows. Rows without a
    hit stay as they are."""
    sets = gram_sets(benchmark, size, item, item_text, block_windows)
    rows = _passes(df, sets, text, benchmark.schema[item].dataType.simpleString())
    shape, last = arrow_schema(df.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)), sets[-1]
    at = df.columns.index(text)
    sized = df.columns.index(n_chars) if n_chars in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            old = rb.column(at).to_pylist()
            new, stay = list(old), []
            for k, (x, before) in enumerate(zip(old, _before(rb), strict=True)):
                mask, items = find(x, _set(last), *before)
                stay.append(len(items - {None}) < min_items)
                if stay[-1] and mask.any():
                    new[k] = remove_spans(x, mask)
            cols = list(rb.columns[: len(shape)])
            cols[at] = pa.array(new, shape.field(at).type)
            if sized is not None:
                n = [was if a == b else len(b) for was, a, b in zip(cols[sized].to_pylist(), old, new, strict=True)]
                cols[sized] = pa.array(n, shape.field(sized).type)
            yield pa.RecordBatch.from_arrays(cols, schema=shape).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(run, df.schema)
