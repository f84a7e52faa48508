"""Token-id output: Arrow stream files of fixed-size-list batches.

``write`` packs the ids of all documents, in ascending order of their key,
into sequences of equal length. Each part is one file in Arrow's stream
format with the columns

    input_ids       fixed_size_list<uint16 or uint32>[seq_len]
    attention_mask  fixed_size_list<bool>[seq_len], false in the padding that
                    ends a part

in batches of equally many sequences, so that a memory map gives sequence i
without copying or decoding. A side file in the same format holds (key,
offset, n_tokens) of the part's documents. Ids take two bytes where the
vocabulary fits them.

The one shuffle deals texts by range of (key, hash of text): a hot key is
split, and parts are balanced. Each attempt of a task writes files of its own
name, and the manifest, made of the rows of attempts that ended well, says
which count; what others left is removed. So a task that runs again, or twice
at once, never touches a file that a reader may have open.

Defined results: a null text is empty and gives only the end id; null keys
come first; rows of one key are ordered by the hash of their text, equal rows
stay; an empty table gives no files and no rows; extra columns are not read; a
very long text takes time in proportion and a task's memory grows with its ids.
"""

from __future__ import annotations

import atexit
import codecs
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.bpe import Memo
from veridoc.llm.common import _remove, arrow_schema, narrow, shared_dir, sweep, texts

SEQ_LEN = 2048
#: Sequences in a batch.
BATCH = 128


class LibraryEncoder:
    """Whole-text ids by the tokenizers library.

    ``pattern`` is the split pattern of the tokenizer file, so that the
    library's model encodes each pre-token as it would in its text. It is
    given those that are not in a memo of bounded bytes. Texts are split at the file's
    added tokens first, which have ids of their own, also in a text. A file
    whose steps before the model are not plain byte-level ones is left to the
    library text by text, as are texts with an added token that takes more
    than its own literal.
    """

    #: Bytes of the memo, as ``Memo`` estimates them.
    MEMO = 160_000_000

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        before = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space
        self.tokenize = self.tokenizer.model.tokenize
        self.pattern = regex.compile(pattern)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.literal = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        # The longest of those that begin in one place, as in the library.
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        letters = [x for x, _ in (before.pre_tokenize_str(chr(b))[0] for b in range(128))] if self.plain else []
        # Bytes from 128 up stand for themselves or for letters after U+00FF,
        # in the order of the bytes that have no visible character.
        self.letter = dict(enumerate(letters)) | self._high_letters(letters)
        # What each byte is to the model, as a table.
        self.letters = "".join(self.letter.get(b, chr(b)) for b in range(256))
        self.pieces = Memo(self._learn, self.MEMO)

    @staticmethod
    def _high_letters(low: list[str]) -> dict[int, str]:
        after = max((ord(x) for x in low), default=0xFF) + 1
        out = {}
        for b in range(128, 256):
            if 0xA1 <= b != 0xAD:
                out[b] = chr(b)
            else:
                out[b], after = chr(after), after + 1
        return out

    def _learn(self, piece: str) -> bytes:
        letters = codecs.charmap_decode(piece.encode("utf-8", "replace"), "strict", self.letters)[0]
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not any(map(text.__contains__, self.added)):
            return self.pieces.joined(self.pattern, text)
        if not self.literal:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[x] if i % 2 else self.pieces.joined(self.pattern, x) for i, x in enumerate(self.at_added(text)))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(path, pattern)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def sequence_schema(kind: pa.DataType, seq_len: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, seq_len)), ("attention_mask", pa.list_(pa.bool_(), seq_len))])


class PartWriter:
    """Packs documents into one part; at most one batch is held."""

    def __init__(self, base: str, kind: pa.DataType, key_type: pa.DataType, seq_len: int, batch: int):
        self.fs, self.path = _open(base)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.kind, self.seq_len, self.batch = kind, seq_len, batch
        self.schema = sequence_schema(kind, seq_len)
        self.docs_schema = pa.schema([("key", key_type), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = {end: self.fs.open_output_stream(self.path + end) for end in (".arrow", ".docs.arrow")}
        self.seqs = pa.ipc.new_stream(self.sinks[".arrow"], self.schema)
        self.docs = pa.ipc.new_stream(self.sinks[".docs.arrow"], self.docs_schema)
        self.full = batch * seq_len
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, keys: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        offsets = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([keys, pa.array(offsets), pa.array(sizes)], schema=self.docs_schema))
        self.n_docs += len(ids)
        self.n_tokens += int(sizes.sum())
        for x in ids:
            self.held.append(x)
            self.n_held += len(x)
            if self.n_held >= self.full:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        done = 0
        while len(flat) - done >= self.full:
            self._write(flat[done : done + self.full], self.full)
            done += self.full
        flat = flat[done:]
        if last and len(flat):
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, flat.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
            flat = flat[:0]
        self.held, self.n_held = [flat.copy()], len(flat)

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)]
        self.seqs.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.seqs.close()
        self.docs.close()
        for sink in self.sinks.values():
            sink.close()


def write(df: DataFrame, tokenizer_path: str, pattern: str, out: str, *, end_id: int, key: str = "doc_id", text: str = "text", parts: int | None = None, seq_len: int = SEQ_LEN, batch: int = BATCH) -> DataFrame:
    """Writes the files of ``df`` below ``out`` and returns their manifest:
    (part, path, n_docs, n_tokens, start), one row a file, where start counts
    the ids of all parts before."""
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = narrow(df, key, text)
    order = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(F.col(f"`{text}`")).asc()]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    key_type = arrow_schema(spark, f"k {df.schema[key].dataType.simpleString()}").field(0).type
    manifest = "part int, path string, n_docs bigint, n_tokens bigint"
    shape, one = arrow_schema(spark, manifest), uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, base, part = None, "", TaskContext.get().partitionId()
        for rb in batches:
            if not rb.num_rows:
                continue
            enc = encoder(tokenizer_path, pattern)
            kind = pa.uint16() if max(enc.vocab_size, end_id + 1) <= 1 << 16 else pa.uint32()
            if writer is None:
                base = f"{out}/part-{one}-{part:05d}-{uuid.uuid4().hex}"
                writer = PartWriter(base, kind, key_type, seq_len, batch)
            end, wide = np.array([end_id], "<u4").tobytes(), kind.to_pandas_dtype()
            for at in range(0, rb.num_rows, 256):
                piece = rb.slice(at, 256)
                writer.add(piece.column(0), [np.frombuffer(enc.encode(x) + end, "<u4").astype(wide) for x in texts(piece.column(1))])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [base], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]}, schema=shape)

    # One row a file: grows with the number of parts, not with their rows.
    files = sorted(rows.mapInArrow(run, manifest).collect())
    sweep(spark, out, f"part-{one}-", [f.path for f in files])
    starts = np.cumsum([0] + [f.n_tokens for f in files])
    whole = [(f.part, f.path, f.n_docs, f.n_tokens, int(s)) for f, s in zip(files, starts, strict=False)]
    return spark.createDataFrame(whole, f"{manifest}, start bigint")


class TokenFile:
    """Random access to one part through a memory map (local paths)."""

    def __init__(self, base: str):
        base = base.removeprefix("file://")
        self._maps = [pa.memory_map(base + ".arrow"), pa.memory_map(base + ".docs.arrow")]
        self.batches = list(pa.ipc.open_stream(self._maps[0]))
        self.docs = pa.ipc.open_stream(self._maps[1]).read_all()
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of sequence i as a view of the map, and its mask."""
        b, k = self.batches[i // self.rows], i % self.rows
        size = b.column(0).type.list_size
        return b.column(0).values.to_numpy()[k * size : (k + 1) * size], b.column(1).values.slice(k * size, size)


def read_documents(manifest: DataFrame, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """Documents of written files, read back part by part: key, start (ids of
    all documents before), n_tokens and the crc32 of the ids. A task holds one
    batch and one document."""
    ddl = f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    shape = arrow_schema(manifest.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.select(["path", "start"]).to_pylist():
                fs, path = _open(row["path"])
                with fs.open_input_file(path + ".arrow") as f, fs.open_input_file(path + ".docs.arrow") as g:
                    flow = _Flow(pa.ipc.open_stream(f))
                    for docs in pa.ipc.open_stream(g):
                        sizes = docs.column(2).to_numpy()
                        sums = [flow.crc(int(n)) for n in sizes]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + row["start"]), docs.column(2), pa.array(sums, pa.int64())], schema=shape)

    return manifest.mapInArrow(run, ddl)


class _Flow:
    """Ids of a part in order, batch by batch."""

    def __init__(self, batches):
        self.batches, self.flat, self.at = iter(batches), np.empty(0, np.uint16), 0

    def crc(self, n: int) -> int:
        out = 0
        while n:
            if self.at == len(self.flat):
                self.flat, self.at = next(self.batches).column(0).values.to_numpy(), 0
            take = self.flat[self.at : self.at + n]
            out = zlib.crc32(take.astype("<u4").tobytes(), out)
            self.at += len(take)
            n -= len(take)
        return out


def round_trip(df: DataFrame, tokenizer_path: str, pattern: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files of ``df`` to the shared folder and reads them back."""
    spark: SparkSession = df.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write(df, tokenizer_path, pattern, out, end_id=end_id, key=key, text=text)
    atexit.register(_remove, spark, out)
    return read_documents(manifest, df.schema[key].dataType.simpleString(), key)
