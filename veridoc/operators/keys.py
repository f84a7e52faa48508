"""Keys of documents: extraction, uniqueness, withdrawal of rejected documents.

A document is accepted if it is structurally valid, repeats no key within
itself and shares no key with an earlier accepted document; a rejected one
frees all its keys. Where a document has one key at most, the first place of
each key decides. Otherwise rounds accept every undecided document that comes first for all its
keys and reject those that share a key with one just accepted; only documents
with a contested key take part, and each round is cut by a checkpoint in the
shared folder. What is accepted depends on the order of all documents before,
so a chain of documents needs a round a link; once at most ``FINISH`` keys are
undecided, one task decides them in order.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from veridoc.functions.keywords import Compiler, NotColumnar, every
from veridoc.functions.paths import key_texts, located, single_key
from veridoc.functions.values import Value, no
from veridoc.plans.catalog import KeyDef, RefDef

REASONS = {"unique": "dup_unique", "primary_key": "dup_pk"}
#: Keys that may be a broadcast: some 300 bytes each with what goes with them.
BROADCAST_KEYS = 100_000
#: Undecided keys that one task decides: some 200 MB.
FINISH = 500_000
#: Places of a key from which on it is hot.
HOT = 100_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a private folder only where a local session
    names none, as in tests; on a cluster that is an error."""
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
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def extract(root: Value, d: KeyDef | RefDef, compiler: Compiler) -> Column:
    """All keys of one declaration in a document, as array<string>."""
    members = None if d.members is None else list(d.members)
    there = located(root, d.location)
    outer, inner = [], []
    for g in d.guards:
        if g.location == d.location:
            inner.append(g)
            continue
        at = located(root, g.location)
        if at.many is not None:
            raise NotColumnar("a condition on list elements around a key")
        holds = compiler.ok(g.schema, at.one, g.base)
        outer.append(holds if g.holds else ~holds)

    def keys(v: Value) -> Column:
        tests = [compiler.ok(g.schema, v, g.base) if g.holds else ~compiler.ok(g.schema, v, g.base) for g in inner]
        found = key_texts(v, members)
        return F.when(every(tests), found).otherwise(F.array().cast("array<string>")) if tests else found

    out = keys(there.one) if there.many is None else F.flatten(F.transform(there.many, lambda x: keys(there.of(x))))
    out = F.coalesce(out, F.array().cast("array<string>"))
    return F.when(every(outer), out).otherwise(F.array().cast("array<string>")) if outer else out


def extract_one(root: Value, d: KeyDef | RefDef, compiler: Compiler) -> Column | None:
    """The one key of a declaration, null where there is none; None if a
    document may have several."""
    there = located(root, d.location)
    if there.many is not None:
        return None
    one = single_key(there.one, None if d.members is None else list(d.members))
    if one is None or not d.guards:
        return one
    return F.get(extract(root, d, compiler), F.lit(0))


def keys_of(df: DataFrame, root: Value, d: KeyDef | RefDef, compiler: Compiler, *keep: Column) -> DataFrame:
    """(keep..., __key): one row for each distinct key of each document."""
    one = extract_one(root, d, compiler)
    if one is not None:
        return df.select(*keep, one.alias("__key")).filter(F.col("__key").isNotNull())
    return df.select(*keep, F.explode(F.array_distinct(extract(root, d, compiler))).alias("__key"))


def postings(df: DataFrame, root: Value, defs: list[KeyDef], compiler: Compiler, ids: list[str]) -> DataFrame:
    """(pointer, key, n_docs): in how many documents each key is. A row gives
    each of its keys once, and rows of one document are next to each other in
    one task, so that keys can be counted without a table of who has them. A
    scoped key begins with its document."""
    pointers, own = list(dict.fromkeys(d.pointer for d in defs)), Window.partitionBy(*[F.col(f"`{c}`") for c in ids])
    texts = []
    for p in pointers:
        found = [F.transform(extract(root, d, compiler), _after(_scope(d, ids))) if d.scoped else extract(root, d, compiler) for d in defs if d.pointer == p]
        texts.append(F.array_distinct(F.concat(*found)).alias(f"__keys{len(texts)}"))
    names = [f"__keys{i}" for i in range(len(texts))]
    rows = df.select(*[F.col(f"`{c}`") for c in ids], *texts).withColumns({"__n": F.count("*").over(own), **{f"{x}s": F.collect_list(x).over(own) for x in names}})
    rows = rows.withColumn("__row", F.row_number().over(own.orderBy(*[F.col(f"`{c}`") for c in ids]))).filter("__row = 1")
    each = [F.when(F.col("__n") == 1, F.col(x)).otherwise(F.array_distinct(F.flatten(f"{x}s"))) for x in names]
    keys = rows.select(F.explode(F.concat(*[F.transform(x, _at(p)) for x, p in zip(each, pointers, strict=True)])).alias("k"))
    return keys.groupBy(F.col("k.pointer").alias("pointer"), F.col("k.key").alias("key")).agg(F.count("*").alias("n_docs"))


def _scope(d: KeyDef, ids: list[str]) -> Column:
    return F.concat(F.to_json(_doc(ids)), F.lit("|")) if d.scoped else F.lit("")


def _after(prefix: Column):
    return lambda k: F.concat(prefix, k)


def _at(pointer: str):
    return lambda k: F.struct(F.lit(pointer).alias("pointer"), k.alias("key"))


def placed(df: DataFrame, root: Value, defs: list[KeyDef], compiler: Compiler, ids: list[str], order: list[str]) -> DataFrame:
    """(place, doc, keys): documents in their order, numbered, so that deciding
    between them moves a number for each. Cut, as a second sort may number
    otherwise. The sort reads its input twice, so keys that follow from the
    columns it moves anyway are made after it."""
    keys, by = _all_keys(root, defs, compiler, ids).alias("keys"), [F.col(f"`{c}`") for c in order]
    place = F.monotonically_increasing_id().alias("place")
    moved = dict.fromkeys([*ids, *order])
    if _needs(df, keys) <= set(moved):
        return cut(df.select(*[F.col(f"`{c}`") for c in moved]).orderBy(*by).select(place, _doc(ids).alias("doc"), keys))
    rows = df.select(_doc(ids).alias("doc"), F.struct(*by).alias("ord"), keys)
    return cut(rows.orderBy("ord").select(place, "doc", "keys"))


def _needs(df: DataFrame, c: Column) -> set[str]:
    """Names of the columns that a column is made of."""
    found, out = df.select(c)._jdf.queryExecution().analyzed().expressions().head().references().iterator(), set()
    while found.hasNext():
        out.add(found.next().name())
    return out


def spread(rows: DataFrame, doc: str = "doc") -> DataFrame:
    rows = rows.select(F.col(doc).alias("doc"), F.posexplode("keys").alias("pos", "k"))
    return rows.select("doc", "pos", F.col("k.def").alias("def"), F.col("k.key").alias("key"))


def _doc(ids: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in ids])


def _all_keys(root: Value, defs: list[KeyDef], compiler: Compiler, ids: list[str]) -> Column:
    arrays = []
    for i, d in enumerate(defs):
        arrays.append(F.transform(extract(root, d, compiler), _tagged(i, _scope(d, ids))))
    return F.concat(*arrays)


def _tagged(i: int, prefix: Column):
    return lambda k: F.struct(F.lit(i).alias("def"), F.concat(prefix, k).alias("key"))


def contested(df: DataFrame, root: Value, d: KeyDef, compiler: Compiler, order: Column, ids: list[str]) -> DataFrame:
    """(__key, __first, __holder) of keys that several documents have, with the
    place of the first of them and which it is; for declarations with one key
    at most. First places are partial minima."""
    keyed = df.select(extract_one(root, d, compiler).alias("__key"), order.alias("o"), F.struct(*[F.col(f"`{c}`") for c in ids]).alias("doc")).filter(F.col("__key").isNotNull())
    firsts = keyed.groupBy("__key").agg(F.min(F.struct("o", "doc")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    return few(cut(firsts.select("__key", F.col("f.o").alias("__first"), F.to_json("f.doc").alias("__holder"))))


def few(keys: DataFrame) -> DataFrame:
    """A broadcast of keys if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def first_come(df: DataFrame, root: Value, d: KeyDef, compiler: Compiler, order: Column, taken: DataFrame) -> DataFrame:
    """``df`` with ``__key``, ``__holder`` and ``__late``, whether an earlier
    document has the key.

    Only contested keys, ``taken``, are joined back. They are cut, so the join
    has plain exchanges on both sides and adaptive execution can split it: a
    key that a third of all documents share weighs on no single task, as it
    would in a window."""
    keyed = df.withColumn("__key", extract_one(root, d, compiler)).withColumn("__ord", order)
    return keyed.join(taken, "__key", "left").withColumn("__late", F.coalesce(F.col("__ord") > F.col("__first"), no())).drop("__ord", "__first")


def contests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that occur more than once, (kid, hot, def, key), and where they do,
    (doc, pos, kid, hot, again, rep, m), of keys (doc, pos, def, key): whether a
    key is there again, whether any key of the document is, and how many
    contested places the document has. Both cut; from here a key is a number."""
    counts = rows.groupBy("def", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(counts.select(F.monotonically_increasing_id().alias("kid"), (F.col("n") > HOT).alias("hot"), "def", "key"))
    on, hot = ["def", "key"], F.broadcast(shared.filter("hot"))
    cold = rows.join(hot, on, "left_anti").join(shared.filter("NOT hot"), on)
    places = cold.union(rows.join(hot, on).select(cold.columns)).select("doc", "pos", "kid", "hot")
    own = Window.partitionBy("doc")
    places = places.withColumn("again", F.coalesce(F.lag("kid").over(own.orderBy("kid", "pos")) == F.col("kid"), no()))
    return shared, cut(places.withColumns({"rep": F.max("again").over(own), "m": F.count("*").over(own)}))


def by_kid(places: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """``places`` with columns of ``keys``, one row a key. Hot keys are few, as
    each has more than ``HOT`` places, and are a broadcast: adaptive execution
    does not see them, since rows of one key compress to little."""
    cold = places.filter("NOT hot").join(keys.filter("NOT hot").drop("hot"), "kid", how)
    return cold.unionByName(places.filter("hot").join(F.broadcast(keys.filter("hot").drop("hot")), "kid", how))


def greedy(places: DataFrame) -> DataFrame:
    """Rejected documents (doc) of ``contests``."""
    rejected = [places.filter("rep").select("doc").distinct()]
    left = places.filter("NOT rep").select("doc", "kid", "hot", "m")
    own = Window.partitionBy("doc")
    while (n := left.count()) > FINISH:
        firsts = left.groupBy("kid").agg(F.min("doc").alias("first"), F.min_by("m", "doc").alias("m"), F.max("hot").alias("hot"))
        taken = firsts.withColumn("n", F.count("*").over(Window.partitionBy("first"))).filter("n = m").select("kid", "hot", "first")
        met = by_kid(left, taken, "left").withColumns({"won": F.coalesce(F.max(F.col("first") == F.col("doc")).over(own), no()), "lost": F.coalesce(F.max(F.col("first") != F.col("doc")).over(own), no())})
        state = cut(met.filter("NOT won").select("doc", "kid", "hot", "m", "lost"))
        rejected.append(state.filter("lost").select("doc").distinct())
        left = state.filter("NOT lost").drop("lost")
        if len(rejected) == 16:  # a short plan, however many rounds
            rejected = [cut(_union(rejected))]
    if n:
        rejected.append(in_order(left))
    return cut(_union(rejected))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def in_order(left: DataFrame) -> DataFrame:
    """Documents (doc) of undecided keys that are rejected, by one task that
    takes them in their order."""
    shape = to_arrow_schema(left.select("doc").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set[int] = set()
        for rb in batches:
            late = []
            for own in rb.column(1).to_pylist():
                late.append(not taken.isdisjoint(own))
                if not late[-1]:
                    taken.update(own)
            yield pa.RecordBatch.from_arrays([rb.column(0).filter(pa.array(late, pa.bool_()))], schema=shape)

    docs = left.groupBy("doc").agg(F.collect_list("kid").alias("own"))
    return docs.coalesce(1).sortWithinPartitions("doc").mapInArrow(run, "doc bigint")


def duplicates(shared: DataFrame, places: DataFrame, rejected: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, def, key, pos, holder, ids) of occurrences that repeat a key of an
    earlier accepted document, the holder, or an earlier place of their own
    document. Texts are put to rows last, so that joins move numbers."""
    own = docs.select(F.col("place").alias("doc"), F.col("doc").alias("ids"))
    held = places.filter("NOT rep").join(rejected, "doc", "left_anti").select("kid", F.col("doc").alias("held"))
    late = F.coalesce(F.col("held") < F.col("doc"), no()).alias("late")
    found = by_kid(places, shared.select("kid", "hot").join(held, "kid", "left")).select("doc", "pos", "kid", "hot", "again", late)
    found = found.filter("late OR again").join(own, "doc")
    holders = held.join(own.select(F.col("doc").alias("held"), F.to_json("ids").alias("holder")), "held").drop("held")
    holder = F.when(F.col("late"), F.col("holder")).otherwise(F.to_json("ids")).alias("holder")
    return by_kid(found, shared.join(holders, "kid", "left")).select("doc", "def", "key", "pos", holder, "ids")
