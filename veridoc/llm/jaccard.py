"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when 100 * |A & B| >= percent *
|A | B|. All links between different sets decide the result; copies with
equal sets collapse into one node first.

1. *Order.* One scan counts shingles over all documents: each task sends its
   distinct shingle hashes, packed by hash range, to the task that owns the
   range. The most frequent ones, up to ``HOT``, make a bounded broadcast; it
   only orders shingles from rare to frequent, results do not depend on it.
2. *Signatures.* For each document: set size, a digest of the set, a min-hash
   and its probe prefix, the rarest shingles of which any linked set must
   share one. One row of each set is its node; prefixes stay where they were
   written until the postings need them.
3. *Groups.* Nodes of equal min-hash form a group. Nodes whose probe prefix
   reaches a common shingle, as the many near copies of one text do, are
   grouped by that shingle instead. Groups over ``GROUP`` nodes are split
   evenly by digest.
4. *Forests.* Each group is compared within. Then ``REPS`` nodes of each
   component of a large family stand for it in a next level, grouped anew by
   another min-hash, and so on while groups are split: levels shrink, so this
   is linear in the size of a family. Nodes that these levels connect share a
   label, the smallest id among them.
5. *Matrix.* Postings of prefix shingles, again packed by hash range, give
   for each query the groups whose members share as many prefix shingles as
   sets of such sizes must if they link (``shared``), fit in
   size (the larger set queries the smaller one's group, of equal sizes that of
   the larger label) and have another label. Groups that were split are dealt anew by label for that, so that
   what the levels left over stands apart. Shingles of many nodes that all have
   one label are left out of the postings.
6. *Opening.* Members of a group and its queries meet in one task. The
   group's shingle union is the matrix row: a query that shares less than
   percent of its own set with the union cannot link to any member and is
   skipped; otherwise members of other labels are compared exactly. Groups with
   many queries are opened in several tasks, each with a share of the queries.
   So every pair that fits in size and shares enough of its prefixes is either
   compared or known to be connected: no link is lost.
7. *Components.* Distributed star contraction of the edges, of the levels
   first, then of labels.

Shingles are 64-bit hashes; a pair's intersection is wrong with a chance of
about |A| * |B| / 2**64.

Defined results: a null or empty text, or one without words, has an empty
set and links with nothing; rows without an id link with nothing and have no
component unless a row with an id has the same set; rows that share an id
count as one document in links; repeated rows have equal results; a very long
text takes time and memory in proportion; an empty table gives an empty result;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import Words, arrow_schema, cut, mix64, narrow, release, space_words, written
from veridoc.llm.components import components

#: Shingles in the broadcast that orders them: 8 bytes each, 8 MB at most.
HOT = 1_000_000
#: Shingles seen less often count as rare.
MIN_DF = 3
#: Shingles in so many documents are common.
COMMON = 32
#: Most nodes of a group, and most queries that one task opens a group for.
GROUP, QUERIES = 256, 256
#: Nodes that stand for a component of a group in the next level.
REPS = 8
#: Shingles in so many documents are left out of the postings if they can be.
HEAVY = 1000
#: Shingles that a task gathers before it packs them.
PACK = 1_000_000
#: Rows of a route or id table that may be a broadcast: some 50 bytes each.
BROADCAST_ROWS = 500_000
#: Keys alone that may be a broadcast: 16 MB.
BROADCAST_KEYS = 2_000_000


def needed(n, percent: int):
    """Least intersection of a set of size n with any set it links to."""
    return -(-percent * n // 100)


def probe_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1


def shared(n, m, percent: int):
    """Least number of shingles that the probe prefixes of linked sets of n and
    m <= n shingles share. Common shingles up to the end of the prefix that
    ends first in the order are in both prefixes; beyond it are fewer than
    ``needed(n)``, and a link takes percent / (100 + percent) of n + m."""
    return -(-percent * (n + m) // (100 + percent)) - needed(n, percent) + 1


def links(a: int, b: int, both: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _range_bits(df: DataFrame) -> int:
    """Hash ranges are about four times as many as shuffle partitions, so what
    one task owns shrinks as partitions grow with the input."""
    return min(20, (4 * _parts(df) - 1).bit_length())


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rb in batches:
        for at in range(0, rb.num_rows, 512):
            piece = rb.slice(at, 512)
            yield piece, [Words(space_words(x)).shingles(words) for x in piece.column(1).to_pylist()]


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents, as sorted high halves of
    their hashes, and in how many documents they are (copies that are packed
    together count once)."""
    bits, spark = _range_bits(docs), docs.sparkSession
    shape = arrow_schema(spark, "bucket int, high binary, n binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0
        for _, sets in _sets(batches, words):
            for s in sets:
                if len(s):
                    digest = hashlib.md5(s.tobytes()).digest()
                    size += len(s) if digest not in held else 0
                    held[digest] = s
            if size >= PACK:
                yield _packed(held)
                held, size = {}, 0
        if held:
            yield _packed(held)

    def _packed(held: dict) -> pa.RecordBatch:
        high, n = np.unique((np.concatenate(list(held.values())) >> np.uint64(32)).astype(np.uint32), return_counts=True)
        n = np.minimum(n, 65535).astype(np.uint16)
        bucket = (high >> np.uint32(32 - bits)).astype(np.int32)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(at[1:], len(high))
        return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([high[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], schema=shape)

    counted = arrow_schema(spark, "high bigint, df bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches, 2):
            high = np.frombuffer(b"".join(blobs[0]), np.uint32)
            n = np.frombuffer(b"".join(blobs[1]), np.uint16).astype(np.int64)
            order = np.argsort(high, kind="stable")
            high, n = high[order], n[order]
            at = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
            df = np.add.reduceat(n, at)
            often = df >= MIN_DF
            yield pa.RecordBatch.from_arrays([pa.array(high[at][often].astype(np.int64)), pa.array(df[often])], schema=counted)

    packed = docs.mapInArrow(pack, "bucket int, high binary, n binary")
    counts = cut(_deal(packed).mapInArrow(count, "high bigint, df bigint"))
    # The least count that leaves at most HOT shingles: a histogram of counts,
    # then one bounded collect.
    steps = counts.groupBy(F.least("df", F.lit(1_000_000)).alias("df")).count().orderBy(F.desc("df")).collect()
    least, total = None, 0
    for row in steps:
        total += row["count"]
        if total > HOT:
            break
        least = row.df
    if least is None:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    shape = arrow_schema(spark, "high binary, df binary")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            high, df = rb.column(0).to_numpy().astype(np.uint32), rb.column(1).to_numpy().astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"high": [high.tobytes()], "df": [df.tobytes()]}, schema=shape)

    rows = counts.filter(F.col("df") >= least).mapInArrow(bytes_of, "high binary, df binary").collect()
    high = np.frombuffer(b"".join(bytes(r.high) for r in rows), np.uint32)
    order = np.argsort(high)
    return high[order], np.frombuffer(b"".join(bytes(r.df) for r in rows), np.uint32)[order]


def _deal(packed: DataFrame) -> DataFrame:
    return packed.repartition(_parts(packed), "bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[list[bytes]]]:
    """The blobs of each bucket, of rows sorted by bucket."""
    now, held = None, [[] for _ in range(n)]
    for rb in batches:
        rows = zip(rb.column(0).to_pylist(), *(rb.column(k + 1).to_pylist() for k in range(n)), strict=True)
        for bucket, *blobs in rows:
            if bucket != now:
                if now is not None:
                    yield held
                now, held = bucket, [[] for _ in range(n)]
            for k, blob in enumerate(blobs):
                held[k].append(blob)
    if now is not None:
        yield held


SIGNATURE = "id bigint, mark bigint, n bigint, digest binary, low bigint, common boolean, prefix binary"


def signatures(docs: DataFrame, words: int, percent: int, order: Broadcast) -> DataFrame:
    """(id, mark, n, digest, low, common, prefix) of each row of (id, text,
    mark)."""
    shape = arrow_schema(docs.sparkSession, SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = order.value
        for piece, sets in _sets(batches, words):
            rows = []
            for s in sets:
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                prefix, common = _rarest(s, known, df, probe_length(len(s), percent))
                low = s[0] if common is None else common
                rows.append((len(s), hashlib.md5(s.tobytes()).digest(), int(low.astype(np.int64)), common is not None, prefix.tobytes()))
            cols = [piece.column(0), piece.column(2), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(shape)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, schema=shape)

    return docs.mapInArrow(run, SIGNATURE)


def _rarest(s: np.ndarray, known: np.ndarray, df: np.ndarray, n: int) -> tuple[np.ndarray, np.uint64 | None]:
    """The first n of a sorted set by (count, hash), and the first of them
    that is common, if there is one."""
    if len(known):
        high = (s >> np.uint64(32)).astype(np.uint32)
        at = np.searchsorted(known, high)
        at[at == len(known)] = 0
        count = np.where(known[at] == high, df[at], 0)
        if count.any():
            order = np.argsort(count, kind="stable")[:n]
            first = int(np.searchsorted(count[order], COMMON))
            return s[order], s[order[first]] if first < len(order) else None
    return s[:n], None


def _grouped(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their group, whether it has other members, and whether
    it was split. The sizes are cut, so that the join can be split where many
    nodes share ``low``."""
    sizes = cut(nodes.groupBy("low").agg(F.count("*").alias("size")).filter("size > 1"))
    rows = nodes.join(sizes, "low", "left")
    split = F.coalesce(F.col("size") > GROUP, F.lit(False))
    block = F.when(split, F.pmod(F.xxhash64("digest"), F.ceil(F.col("size") / GROUP))).otherwise(F.lit(0))
    return rows.select(*nodes.columns, _within(F.xxhash64("low", block)).alias("grp"), F.col("size").isNotNull().alias("shared"), split.alias("split"))


def _within(group: Column) -> Column:
    """Odd groups have had all their members compared with each other."""
    return group.bitwiseOR(F.lit(1).cast("bigint"))


def _between(group: Column) -> Column:
    return group.bitwiseAND(F.lit(-2).cast("bigint"))


def _regrouped(nodes: DataFrame) -> DataFrame:
    """``nodes`` with label, split groups dealt anew: large labels by
    themselves, small ones together, whole."""
    if nodes.filter("split").isEmpty():
        return nodes
    counts = cut(nodes.filter("split").groupBy("low", "label").agg(F.count("*").alias("size")))
    rest = counts.filter(F.col("size") <= GROUP).groupBy("low").agg(F.ceil(F.sum("size") / GROUP).alias("blocks"))
    dealt = cut(counts.join(rest, "low", "left").withColumn("of_label", F.col("size") > GROUP).select("low", "label", "of_label", F.when(F.col("of_label"), F.ceil(F.col("size") / GROUP)).otherwise(F.col("blocks")).alias("blocks"), F.lit(True).alias("split")))
    rows = nodes.join(dealt, ["low", "label", "split"], "left")
    of_label = F.xxhash64("low", "label", F.pmod(F.xxhash64("digest"), "blocks"))
    of_rest = F.xxhash64("low", F.lit("rest"), F.pmod(F.xxhash64("label"), "blocks"))
    return rows.withColumn("grp", F.when(F.col("of_label"), _between(of_label)).when(~F.col("of_label"), _between(of_rest)).otherwise(F.col("grp"))).select(*nodes.columns)


def _settled(nodes: DataFrame, order: Broadcast) -> np.ndarray:
    """High halves of the heavy shingles whose nodes all have one label: a
    minimum and a maximum for each, in tasks first. At most ``HOT``."""
    high, often = order.value
    heavy = high[often >= HEAVY]
    if not len(heavy):
        return heavy
    shared = nodes.sparkSession.sparkContext.broadcast(heavy)
    ddl = "k int, least bigint, most bigint"
    shape = arrow_schema(nodes.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, top = shared.value, np.iinfo(np.int64).max
        least, most = np.full(len(known), top), np.full(len(known), -top)
        for rb in batches:
            prefixes = rb.column(1).to_pylist()
            h = (np.frombuffer(b"".join(prefixes), np.uint64) >> np.uint64(32)).astype(np.uint32)
            label = np.repeat(rb.column(0).to_numpy(), [len(p) // 8 for p in prefixes])
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            there = known[at] == h
            np.minimum.at(least, at[there], label[there])
            np.maximum.at(most, at[there], label[there])
        seen = np.flatnonzero(least < top)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(least[seen]), pa.array(most[seen])], schema=shape)

    spans = nodes.select("label", "prefix").mapInArrow(run, ddl).groupBy("k").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    alone = spans.filter("least = most").select("k").toArrow().column(0).to_numpy()
    return heavy[np.sort(alone)]


def candidates(nodes: DataFrame, percent: int, settled: np.ndarray) -> DataFrame:
    """Distinct (key, grp) that must be compared: members of the group have
    another label, are not larger, fit in size and share as many prefix
    shingles as a link to the smallest of them takes."""
    bits, spark = _range_bits(nodes), nodes.sparkSession
    kinds = (np.uint32, np.int64, np.int64, np.int64, np.int32)
    ddl = "bucket int, shingle binary, key binary, grp binary, label binary, n binary"
    shape, skipped = arrow_schema(spark, ddl), spark.sparkContext.broadcast(settled)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, 4096):
                yield _packed(rb.slice(at, 4096))

    def _packed(rb: pa.RecordBatch) -> pa.RecordBatch:
        prefixes = rb.column(4).to_pylist()
        size = np.array([len(p) // 8 for p in prefixes], np.int64)
        shingle = np.frombuffer(b"".join(prefixes), np.uint64)
        order = np.argsort(shingle, kind="stable")
        if len(skipped.value):
            order = order[~np.isin((shingle[order] >> np.uint64(32)).astype(np.uint32), skipped.value)]
        bucket = (shingle[order] >> np.uint64(64 - bits)).astype(np.int32)
        # Within a bucket 32 bits tell shingles apart; a clash costs a comparison.
        columns = [((shingle[order] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), *(np.repeat(rb.column(k).to_numpy(), size)[order].astype(kinds[k + 1]) for k in range(4))]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(at[1:], len(bucket))
        blobs = [pa.array([c[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *blobs], schema=shape)

    pairs = "key bigint, grp bigint, hits bigint, least bigint"
    found = arrow_schema(spark, pairs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches, 5):
            columns = [np.frombuffer(b"".join(b), t) for b, t in zip(blobs, kinds, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            shingle, key, group, label, n = (c[order] for c in columns)
            starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            ends = np.append(starts[1:], len(shingle))
            # Runs of one shingle that hold more than one label.
            several = np.maximum.reduceat(label, starts) != np.minimum.reduceat(label, starts)
            out, held = [], 0
            for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                for hit in _run_pairs(key[a:b], group[a:b], label[a:b], n[a:b].astype(np.int64), percent):
                    out.append(hit)
                    held += len(hit[0])
                    if held > 1_000_000:
                        yield _counted(out)
                        out, held = [], 0
            if held:
                yield _counted(out)

    def _counted(hits: list[tuple]) -> pa.RecordBatch:
        """One row a query and group that meet in this range: at how many
        shingles, and how many a link takes at least."""
        key, group, least = (np.concatenate(c) for c in zip(*hits, strict=True))
        order = np.lexsort((least, group, key))
        key, group, least = key[order], group[order], least[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key[at], group[at], np.diff(np.append(at, len(key))), least[at])], schema=found)

    packed = nodes.select("key", "grp", "label", "n", "prefix").mapInArrow(pack, ddl)
    met = _deal(packed).mapInArrow(meet, pairs)
    return met.groupBy("key", "grp").agg(F.sum("hits").alias("hits"), F.min("least").alias("least")).filter("hits >= least").select("key", "grp")


def _run_pairs(key: np.ndarray, group: np.ndarray, label: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries and groups that meet at one shingle, and how many shingles a
    link of the two takes. Sizes of a group's members of one label are sorted,
    so the least of them that fits is one binary search a query of another
    label."""
    low = needed(n, percent)

    def fitting(asked: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some queries those for which some member fits, and the size of
        the least that does. Of equal sizes the larger label is the query."""
        if own & 1:
            asked = asked[group[asked] != own]
        sizes = n[members]
        least = np.searchsorted(sizes, low[asked])
        size = sizes[np.minimum(least, len(sizes) - 1)]
        fits = (least < len(sizes)) & (size <= n[asked] - (label[asked] <= label[members].min()))
        return asked[fits], size[fits]

    by_label = np.argsort(label, kind="stable")
    in_order = label[by_label]
    order = np.lexsort((n, label, group))
    for a, b in _stretches(group[order]):
        members = order[a:b]
        own, parts = group[members[0]], list(_stretches(label[members]))
        # Labels one by one, but of many only the largest: the rest together.
        first = max(parts, key=lambda p: p[1] - p[0])
        few = parts if len(parts) <= 4 else [first]
        fits = []
        for c, d in few:
            x = label[members[c]]
            i, j = np.searchsorted(in_order, x), np.searchsorted(in_order, x, "right")
            fits.append(fitting(np.concatenate([by_label[:i], by_label[j:]]), members[c:d]))
        if few is not parts:
            rest = np.concatenate([members[: first[0]], members[first[1] :]])
            fits.append(fitting(by_label, rest[np.argsort(n[rest], kind="stable")]))
        asked, size = (np.concatenate(c) for c in zip(*fits, strict=True))
        if len(fits) > 1:  # a query counts once, with the smallest member that fits
            by_query = np.lexsort((size, asked))
            asked, size = asked[by_query], size[by_query]
            once = np.append(True, asked[1:] != asked[:-1])[: len(asked)]
            asked, size = asked[once], size[once]
        if len(asked):
            yield key[asked], np.full(len(asked), own, np.int64), shared(n[asked], size, percent)


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        yield from zip(at.tolist(), [*at[1:].tolist(), len(values)], strict=True)


class Group:
    """One group's members, and its row of the token-group matrix."""

    def __init__(self, labels: list[int], sets: list[np.ndarray], percent: int):
        self.labels, self.percent = labels, percent
        self.union = np.unique(np.concatenate(sets))
        self.rows = [np.searchsorted(self.union, s) for s in sets]
        self.mark = np.zeros(len(self.union), np.uint8)

    def _linked(self, row: np.ndarray, n: int, known: set[int], label, below: int) -> set[int]:
        """Labels, by ``label`` of a member, of members before ``below`` whose
        set links to ``row``; members of known ones are not compared."""
        self.mark[row] = 1
        found: set[int] = set()
        for j in range(below):
            m, x = len(self.rows[j]), label(j)
            if x in known or x in found or m * 100 < self.percent * n or n * 100 < self.percent * m:
                continue
            if links(n, m, int(self.mark[self.rows[j]].sum()), self.percent):
                found.add(x)
        self.mark[row] = 0
        return found

    def forest(self) -> list[int]:
        """The smallest label that each member is connected with in the group."""
        index = {x: k for k, x in enumerate(sorted(set(self.labels)))}
        names, parent = list(index), list(range(len(index)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        own = [index[x] for x in self.labels]
        for i, row in enumerate(self.rows):
            for root in self._linked(row, len(row), {find(own[i])}, lambda j: find(own[j]), i):
                a, b = find(own[i]), find(root)
                parent[max(a, b)] = min(a, b)
        return [names[find(k)] for k in own]

    def query(self, label: int, s: np.ndarray) -> set[int]:
        """Labels of members that a query of another label links to."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        row = at[self.union[at] == s]
        if len(row) < needed(len(s), self.percent):
            return set()  # the bound: no member can share enough
        return self._linked(row, len(s), {label}, self.labels.__getitem__, len(self.labels))


SEAT = "grp bigint, salt bigint, query int, label bigint, again boolean"


def seated(docs: DataFrame, routes: DataFrame, words: int) -> DataFrame:
    """(seat..., shingles) for each seat of ``routes`` (id, mark, seats),
    which tells where a document's set is needed; a task sends each once."""
    small = (routes.agg(F.sum(F.size("seats"))).first()[0] or 0) <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(routes) if small else routes, ["id", "mark"])
    names = [x.split()[0] for x in SEAT.split(", ")]
    rows = rows.select("id", "text", "mark", *[F.col(f"seats.{x}").alias(x) for x in names])
    ddl = f"{SEAT}, shingles binary"
    shape = arrow_schema(docs.sparkSession, ddl)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()
        for piece, sets in _sets(batches, words):
            out = []
            for x, mark, s, *seats in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), sets, *(piece.column(3 + k).to_pylist() for k in range(len(names))), strict=True):
                if (x, mark) not in sent:
                    sent.add((x, mark))
                    raw = s.tobytes()
                    out += [(*seat, raw) for seat in zip(*seats, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return rows.mapInArrow(send, ddl)


def _seat(grp: Column | str, label: str, again: Column | str | None = None, salt: Column | None = None, query: int = 0) -> Column:
    return F.struct(F.col(grp).alias("grp") if isinstance(grp, str) else grp.alias("grp"), (salt if salt is not None else F.lit(0)).cast("bigint").alias("salt"), F.lit(query).alias("query"), F.col(label).alias("label"), (F.lit(False) if again is None else F.col(again) if isinstance(again, str) else again).alias("again"))


def levels(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) edges of labels that the forests of all levels connect."""
    spark = docs.sparkSession
    members = nodes.filter("shared").select(F.col("node").alias("id"), "mark", F.array(_seat("grp", "node", "common")).alias("seats"))
    rows = seated(docs, cut(members.groupBy("id", "mark").agg(F.flatten(F.collect_list("seats")).alias("seats"))), words)
    edges, before = [], None
    for level in range(64):
        out = written(_forests(rows, percent, level))
        edges.append(out.filter("low IS NULL").select("a", "b"))
        active = out.filter("low IS NOT NULL").select(F.col("a").alias("label"), "low", "shingles")
        sizes = cut(active.groupBy("low").agg(F.count("*").alias("size")).filter("size > 1"))
        n = sizes.agg(F.sum("size")).first()[0] or 0
        # Without progress what is left is for the postings.
        if not n or before is not None and 2 * n > before:
            break
        before = n
        split = F.col("size") > GROUP
        block = F.when(split, F.pmod(F.xxhash64("shingles"), F.ceil(F.col("size") / GROUP))).otherwise(F.lit(0))
        rows = active.join(sizes, "low").select(F.xxhash64("low", block).alias("grp"), F.lit(0).cast("bigint").alias("salt"), F.lit(0).alias("query"), "label", split.alias("again"), "shingles")
    return reduce(DataFrame.union, edges, spark.createDataFrame([], "a bigint, b bigint"))


def _forests(rows: DataFrame, percent: int, level: int) -> DataFrame:
    """(a, b) edges of each group, and rows (a, null, low, shingles) of those
    that stand for their component in the next level."""
    ddl = "a bigint, b bigint, low bigint, shingles binary"
    shape, seed = arrow_schema(rows.sparkSession, ddl), mix64(np.array([level + 1], np.uint64))[0]

    def settle(labels: list[int], raw: list[bytes], again: bool) -> list[tuple]:
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        roots, out, stand = Group(labels, sets, percent).forest(), [], {}
        for x, root, s, whole in zip(labels, roots, sets, raw, strict=True):
            if x != root:
                out.append((x, root, None, None))
            if again and stand.setdefault(root, 0) < REPS:
                stand[root] += 1
                out.append((root, None, int(mix64(s ^ seed).min().astype(np.int64)), whole))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels, raw, again = None, [], [], False
        for rb in batches:
            out: list[tuple] = []
            for g, x, more, s in zip(*(rb.column(k).to_pylist() for k in range(4)), strict=True):
                if g != now:
                    out += settle(labels, raw, again) if labels else []
                    now, labels, raw, again = g, [], [], False
                if not labels or x != labels[-1] or s != raw[-1]:
                    labels.append(x)
                    raw.append(s)
                    again = again or more
            if out:
                yield _table(out, shape)
        if labels and (out := settle(labels, raw, again)):
            yield _table(out, shape)

    dealt = rows.select("grp", "label", "again", "shingles").repartition(_parts(rows), "grp").sortWithinPartitions("grp", "label")
    return dealt.mapInArrow(run, ddl)


def opened(docs: DataFrame, nodes: DataFrame, cand: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) edges of labels that queries of other groups connect."""
    queries = cut(cand.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("salts")))
    # Seats: members in every salt of a group that has queries; queries in one.
    of_group = nodes.join(queries, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    members = of_group.select("node", "mark", _seat("grp", "label", salt=F.col("salt")).alias("seat"))
    asked = cand.join(queries, "grp").join(nodes.drop("grp"), "key")
    asked = asked.select("node", "mark", _seat("grp", "label", salt=F.pmod(F.xxhash64("key"), "salts"), query=1).alias("seat"))
    routes = members.union(asked).groupBy(F.col("node").alias("id"), "mark").agg(F.collect_list("seat").alias("seats"))
    shape = arrow_schema(docs.sparkSession, "a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels, sets, group = None, [], [], None
        for rb in batches:
            out: set[tuple] = set()
            for g, salt, query, label, raw in zip(*(rb.column(k).to_pylist() for k in range(5)), strict=True):
                if (g, salt) != now:
                    now, labels, sets, group = (g, salt), [], [], None
                s = np.frombuffer(raw, np.uint64)
                if not query:
                    labels.append(label)
                    sets.append(s)
                elif labels:
                    group = group or Group(labels, sets, percent)
                    out |= {(label, x) for x in group.query(label, s)}
            if out:
                yield _table(list(out), shape)

    rows = seated(docs, cut(routes), words).drop("again")
    dealt = rows.repartition(_parts(docs), "grp", "salt").sortWithinPartitions("grp", "salt", "query", "label")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _table(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)


def join(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``df``; the key is an
    integer column. component_id is the smallest key reachable by links."""
    docs = narrow(df, key, text).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent(docs, words))
    release(spark)
    rows = written(signatures(docs, words, percent, order).withColumn("place", F.monotonically_increasing_id()))
    # Cut, so that joins with it have plain exchanges on both sides and a large
    # group of equal sets can be split. What is beside the id is the same in all
    # rows of a set, or tells which row's prefix is taken.
    rep = F.min(F.struct(F.col("id").alias("node"), "mark", "place", "n", "low", "common"))
    reps = cut(rows.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(rep.alias("rep")).select("digest", "rep.*"))
    nodes = written(_grouped(reps.withColumn("key", F.xxhash64("node", "mark"))))
    keyed = docs.filter("id IS NOT NULL")
    roots = cut(components(levels(keyed, nodes, words, percent)).select("node", F.col("root").alias("label")))
    release(spark)
    few = roots.count() <= BROADCAST_ROWS
    labelled = nodes.join(F.broadcast(roots) if few else roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = written(_regrouped(labelled if few else cut(labelled)))
    # The one shuffle of prefixes.
    posted = written(rows.select("place", "prefix").join(nodes.select("place", "key", "grp", "label", "n"), "place"))
    release(spark)
    cand = cut(candidates(posted, percent, _settled(posted, order)))
    release(spark)
    last = cut(components(opened(keyed, nodes, cand, words, percent)).select(F.col("node").alias("label"), "root"))
    of_set = reps.select("digest", "node").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")).join(last, "label", "left")
    of_set = cut(of_set.select("digest", F.coalesce("root", "label").alias("component")))
    whole = rows.select("id", "n", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return whole.select(F.col("id").cast(df.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), component.cast(df.schema[key].dataType).alias("component_id"))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df``, all columns kept: of each group of linked texts the one
    with the smallest key stays, of several of that key the one whose text
    comes first; of rows that are equal in key and text one stays. Texts that
    link with nothing stay, also where their key has other rows, and so do
    rows without a key. Here a null text equals null texts alone.

    Only keys that go are joined, as a broadcast while they are few, so texts
    are not shuffled for it, unless keys repeat."""
    keyed = df.filter(F.col(f"`{key}`").isNotNull())
    again = cut(keyed.groupBy(key).count().filter("count > 1").select(key))
    if again.isEmpty():
        return _unlinked(df, words, percent, key, text)
    # Each text of a repeated key is a document of its own, known by its place
    # in order of key and text. Written, as a second sort may number otherwise.
    few, same = _few(again), F.sha2(F.col(f"`{text}`"), 256)
    several = keyed.join(few, key, "left_semi").withColumn("__same", same).dropDuplicates([key, "__same"])
    rows = keyed.join(few, key, "left_anti").select(*df.columns).union(several.select(*df.columns))
    placed = written(rows.orderBy(key, text).withColumn("__place", F.monotonically_increasing_id()))
    kept = _unlinked(placed, words, percent, "__place", text)
    return kept.select(*df.columns).union(df.filter(F.col(f"`{key}`").isNull()))


def _unlinked(df: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Rows of ``df`` but those that link to one with a smaller key; no key
    has several rows."""
    found = cut(join(df, words, percent, key, text).select(key, "component_id"))
    gone = found.filter(F.col(f"`{key}`") != F.col("component_id")).select(key).distinct()
    return df.join(_few(gone), key, "left_anti").select(*df.columns)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
