"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a whole
pre-token that is itself a vocabulary entry; every other pre-token goes
through merges: its bytes form a doubly linked list and a heap yields the
adjacent pair of the lowest rank, so a pre-token of n bytes costs O(n log n)
however long it is.

Texts are independent, so encoding is one scan without a shuffle.

Defined results: a null text is the empty text and has no ids; repeated rows
give repeated results; an unpaired surrogate is replaced as UTF-8 decoding
with "replace" does; an empty table gives an empty result; extra columns are
not read. A very long text, also one without any space, takes time in
proportion (its longest pre-token a logarithm more) and some 100 bytes for each
byte of its longest pre-token; what a worker remembers has a bound in bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from veridoc.llm.common import arrow_schema, map_batches, narrow, texts


class MinimalPerfectHash:
    """Maps n distinct byte strings one to one onto 0..n-1 (hash and displace).

    Keys are dealt into buckets by one hash; from the largest bucket down, a
    seed is sought that sends all keys of the bucket to free slots. Buckets of
    one key store the free slot itself. ``find`` compares the stored key, so
    a string outside the key set is never mistaken for a member.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n = n
        self.seeds = [0] * max(1, n // 3 + 1)
        self.slots: list[bytes | None] = [None] * n
        buckets: dict[int, list[bytes]] = {}
        m = len(self.seeds)
        for key in keys:
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % m, []).append(key)
        order = sorted(buckets, key=lambda b: -len(buckets[b]))
        k = 0
        while k < len(order) and len(buckets[order[k]]) > 1:
            members, seed = buckets[order[k]], 1
            while True:
                spots = [xxhash.xxh3_64_intdigest(x, seed) % n for x in members]
                if len(set(spots)) == len(spots) and all(self.slots[s] is None for s in spots):
                    break
                seed += 1
            self.seeds[order[k]] = seed
            for s, x in zip(spots, members, strict=True):
                self.slots[s] = x
            k += 1
        free = iter([i for i, x in enumerate(self.slots) if x is None])
        for b in order[k:]:
            spot = next(free)
            self.seeds[b] = -spot - 1
            self.slots[spot] = buckets[b][0]

    def find(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is not a member."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % len(self.seeds)]
        spot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return spot if self.slots[spot] == key else -1


class Codec:
    """Encoder and decoder over one file of ranks (base64 token, rank a line)."""

    #: Bytes of the memo of pre-tokens in a worker, as ``Memo`` estimates them.
    MEMO = 200_000_000

    def __init__(self, ranks_path: str, pattern: str, memo: int = MEMO):
        with open(ranks_path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern)
        self.mph = MinimalPerfectHash(list(self.ranks))
        self.slot_rank = [self.ranks[x] for x in self.mph.slots]
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for key, rank in self.ranks.items():
            self.token[rank] = key
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)] if self.ranks else []
        #: Rank of the token that two adjacent tokens make, by both their ids,
        #: and that two adjacent bytes make, or -1.
        self.pairs: dict[int, int] = {}
        self.first = [[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        get = self.ranks.get
        for key, rank in self.ranks.items():
            for i in range(1, len(key)):
                if (a := get(key[:i])) is not None and (b := get(key[i:])) is not None:
                    self.pairs[a << 32 | b] = rank
        self.decimal = [str(i) for i in range(len(self.token))]
        self.pieces = Memo(self._learn, memo)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary, by merges of least rank
        first, leftmost among equals."""
        n, pair = len(piece), self.pairs.get
        ids = list(map(self.byte_id.__getitem__, piece))
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # Rank of what each part makes with the one after it: a place in the
        # heap with another rank is out of date.
        made = [self.first[x][y] for x, y in zip(piece, piece[1:])]
        made.append(-1)
        heap = [r << 32 | i for i, r in enumerate(made) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if made[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], made[i], made[j] = r, -1, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pair(r << 32 | ids[k], -1)) >= 0:
                    made[i] = q
                    heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0:
                made[h] = q = pair(ids[h] << 32 | r, -1)
                if q >= 0:
                    heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        slot = self.mph.find(piece)
        return [self.slot_rank[slot]] if slot >= 0 else self.merge(piece)

    def _learn(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8", "replace"))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        return np.frombuffer(self.pieces.joined(self.pattern, text), "<u4")

    def forget(self) -> None:
        """Frees the memo, as workers outlive the task that filled it."""
        self.pieces.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist())).encode()


class Memo(dict):
    """Packed ids of pre-tokens, in at most so many bytes, in two generations:
    what is not used while one fills up is forgotten with it. ``learn`` gives
    the ids of one that is not known.

    Pre-tokens over ``LONG`` characters are not kept: they seldom come again,
    and scripts without spaces, encoded data or minified code would fill the
    memo with them."""

    LONG = 64
    #: Bytes of an entry beside its characters and ids, measured: slot and two
    #: objects.
    ENTRY = 110
    #: Characters of a text whose pre-tokens are listed at once.
    AT_ONCE = 1_000_000

    def __init__(self, learn: Callable[[str], bytes], most: int):
        super().__init__()
        self.learn, self.most, self.bytes = learn, most, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= self.LONG:
            if self.bytes > self.most // 2:
                old = self.copy()
                self.clear()
                self.old = old
            self[piece] = ids
            self.bytes += self.ENTRY + 2 * len(piece) + len(ids)
        return ids

    def joined(self, pattern: regex.Pattern, text: str) -> bytes:
        """Ids of all pre-tokens of a text, one after the other."""
        if len(text) <= self.AT_ONCE:
            return b"".join(map(self.__getitem__, pattern.findall(text)))
        return b"".join(self[m[0]] for m in pattern.finditer(text))

    def clear(self) -> None:
        super().clear()
        self.old, self.bytes = {}, 0


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str, memo: int = Codec.MEMO) -> Codec:
    """One codec per Python worker."""
    return Codec(ranks_path, pattern, memo)


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` for each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        return {key: batch.column(0), "ids": [c.encode(x).astype(np.int32) for x in texts(batch.column(1))]}

    return map_batches(narrow(df, key, text), run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, bytes binary)`` for each row of ids; null ids are no ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        return {key: batch.column(0), "bytes": [c.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]}

    return map_batches(narrow(df, key, ids), run, f"`{key}` {kind}, bytes binary")


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint"


def round_trip(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids, and returns digests of both: the
    ids never leave the worker, so the scan is bound by tokenising alone."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(ranks_path, pattern)
        rows: list[tuple] = []
        for x in texts(batch.column(1)):
            ids = c.encode(x)
            back = c.decode(ids)
            rows.append((len(ids), hashlib.sha256(c.decimals(ids)).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
        cols = list(zip(*rows, strict=True))
        return {key: batch.column(0), "n_tokens": cols[0], "ids_sha256": cols[1], "decoded_sha256": cols[2], "n_bytes": cols[3]}

    return map_batches(narrow(df, key, text), run, f"`{key}` {kind}, {DIGESTS}")


def encoded(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", memo: int = Codec.MEMO // 4) -> DataFrame:
    """As ``round_trip``, with the ids themselves as ``ids array<int>``; its
    memo is smaller, as it runs where other stages have filled the memory."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern, memo)
        for rb in batches:
            for at in range(0, rb.num_rows, 1024):
                piece = rb.slice(at, 1024)
                ids = [c.encode(x) for x in texts(piece.column(1))]
                back = [hashlib.sha256(c.decode(i)).hexdigest() for i in ids]
                sizes = np.array([len(i) for i in ids], np.int64)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)
                sums = [hashlib.sha256(c.decimals(i)).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([piece.column(0), lists.cast(shape.field(1).type), pa.array(sizes), pa.array(sums), pa.array(back)], schema=shape)
        c.forget()

    ddl = f"`{key}` {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    shape = arrow_schema(df.sparkSession, ddl)
    return narrow(df, key, text).mapInArrow(run, ddl)
