"""Validation of tables and documents against a schema set.

Pass 1 is structural: keywords are predicates in the scan. Keys of the
documents that pass are deduplicated per schema. Pass 2 checks references as
anti-joins against the accepted keys of their target. Nothing is collected;
results are DataFrames with the documents' own identifying columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.extensions import Extension, keywords
from veridoc.functions.evaluator import Evaluator, parse_json
from veridoc.functions.formats import Formats
from veridoc.functions.keywords import ERROR, Compiler, NotColumnar
from veridoc.functions.values import Row, Value, VariantValue
from veridoc.operators import keys as K
from veridoc.plans.catalog import Fault, KeyDef, RefDef, Schema, SchemaSet
from veridoc.sources.providers import collisions, forget_lists, provider_keys

DETAIL = ("reason", "keyword", "pointer", "path", "key", "holder")
#: The document of errors that no document has.
PROVIDERS = "(providers)"


@dataclass
class Bound:
    """Documents of one schema: a table and how its rows are read."""

    schema: Schema
    df: DataFrame
    ids: list[str]
    order: list[str]
    root: Value
    text: str | None = None

    @property
    def ord(self) -> Column:
        cols = [F.col(f"`{c}`") for c in self.order]
        return cols[0] if len(cols) == 1 else F.struct(*cols)


class Validator:
    """``config``: ``primary_key`` has the providers of keys, see
    ``veridoc.sources.providers``."""

    def __init__(self, schemas: SchemaSet, config: dict | None = None, formats: Formats | None = None, extensions: list[Extension] | None = None, types: dict | None = None):
        self.schemas, self.config = schemas, {**(config or {}), "lists": {}}
        self.extensions = extensions or []
        self.formats, self.keywords, self.types = formats or Formats(), keywords(self.extensions), types or {}
        self.bound: dict[str, Bound] = {}
        self._greedy: dict[str, tuple] = {}
        self._contested: dict[str, DataFrame] = {}
        self._some: dict[tuple, bool] = {}
        for x in self.extensions:
            for uri, messages in (x.bootstrap(self) if x.bootstrap else {}).items():
                schemas.valid[uri].faults += [Fault("schema_error", m, f"/{x.keyword}") for m in messages]

    def _hook(self, name: str, *more) -> None:
        for x in self.extensions:
            if (hook := getattr(x, name)) is not None:
                hook(self, *more)

    def close(self) -> None:
        self._hook("cleanup")

    def bind(self, uri: str, df: DataFrame, ids: list[str], order: list[str] | None = None) -> Validator:
        """Binds a table to a schema: each row is a document whose members are
        the columns, null being missing. ``order`` decides which of several
        documents with a key came first and must tell them apart."""
        return self.bind_as(Bound(self.schemas.valid[uri], df, ids, order or ids, Row(df.schema)))

    def bind_json(self, uri: str, df: DataFrame, ids: list[str], order: list[str] | None = None, value: str = "json") -> Validator:
        """Binds documents in a VARIANT column."""
        return self.bind_as(Bound(self.schemas.valid[uri], df, ids, order or ids, VariantValue(F.col(f"`{value}`")), value))

    def bind_as(self, b: Bound) -> Validator:
        """Binds, and forgets what was found out about documents bound before."""
        self.bound[b.schema.uri] = b
        self._greedy.pop(b.schema.uri, None)
        self._contested.pop(b.schema.uri, None)
        self._some.clear()
        self._hook("forget", b.schema.uri)
        return self

    # --- pass 1 ------------------------------------------------------------

    def compiler(self, schema: Schema) -> Compiler:
        return Compiler(schema.draft, self.schemas.resolve, self.formats, {n: k[0] if isinstance(k, tuple) else k for n, k in self.keywords.items()}, {n: t[0] if isinstance(t, tuple) else t for n, t in self.types.items()})

    def _ok(self, b: Bound) -> Column:
        try:
            return self.compiler(b.schema).ok(b.schema.body, b.root, b.schema.uri)
        except NotColumnar:
            return F.size(self._python_errors(b)) == 0

    def _suspect(self, b: Bound) -> Column:
        """Rows that have an error, as a filter that the scan can use to skip
        what is valid. Parsed documents have nothing to skip, and would only
        be parsed for the filter once more."""
        if any("variant" in f.dataType.simpleString() for f in b.df.schema):
            return F.lit(True)
        try:
            return ~self.compiler(b.schema).ok(b.schema.body, b.root, b.schema.uri)
        except NotColumnar:
            return F.lit(True)

    def _errors(self, b: Bound) -> Column:
        try:
            return self.compiler(b.schema).errors(b.schema.body, b.root, F.lit(""), "", b.schema.uri)
        except NotColumnar:
            return self._python_errors(b)

    def _python_errors(self, b: Bound) -> Column:
        schema, schemas, formats = b.schema, self.schemas, self.formats
        custom = {n: k[1] for n, k in self.keywords.items() if isinstance(k, tuple)}
        types = {n: t[1] for n, t in self.types.items() if isinstance(t, tuple)}

        @F.pandas_udf(f"array<{ERROR}>")
        def judge(texts: pd.Series) -> pd.Series:
            e = Evaluator(schema.draft, schemas.resolve, formats, custom, types)
            names = ("keyword", "pointer", "path")
            return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in e.errors(schema.body, parse_json(t), base=schema.uri)])

        return judge(F.to_json(F.col(f"`{b.text}`")) if b.text else b.root.canonical())

    def structural(self, uri: str) -> DataFrame:
        """ids, reason, keyword, pointer, path of every violated keyword."""
        b = self.bound[uri]
        rows = b.df.filter(self._suspect(b)).select(*b.ids, F.explode(self._errors(b)).alias("e"))
        return rows.select(*b.ids, F.lit("schema_error").alias("reason"), "e.keyword", "e.pointer", "e.path")

    def valid(self, uri: str) -> DataFrame:
        """Documents without a structural error."""
        b = self.bound[uri]
        return b.df.filter(self._ok(b))

    # --- keys ----------------------------------------------------------------

    def _enforced(self, uri: str) -> list[KeyDef]:
        return [k for k in self.bound[uri].schema.keys if k.kind in K.REASONS]

    def _single(self, uri: str) -> bool:
        defs = self._enforced(uri)
        b = self.bound[uri]
        return len(defs) == 1 and not defs[0].scoped and K.extract_one(b.root, defs[0], self.compiler(b.schema)) is not None

    def _providers(self, uri: str) -> list[tuple[str, str]]:
        return provider_keys(self.config, uri)

    def _shadow(self) -> bool:
        return bool(self.config.get("primary_key", {}).get("allow_provider_duplicates"))

    def _provided(self, uri: str) -> DataFrame | None:
        """Provider keys that documents must not repeat, as (def, key, source);
        a broadcast if they are few."""
        defs, rows = self._enforced(uri), []
        for i, d in enumerate(defs):
            if d.kind == "primary_key" and not self._shadow():
                found = self._providers(d.owner)
                if found and d.scoped:
                    raise ValueError(f"providers cannot serve the scoped key {d.id}")
                rows += [(i, key, source) for source, key in found]
        if not rows:
            return None
        out = self.bound[uri].df.sparkSession.createDataFrame(rows, "def int, key string, source string").groupBy("def", "key").agg(F.min("source").alias("source"))
        return F.broadcast(out) if len(rows) <= K.BROADCAST_KEYS else out

    def _settled(self, uri: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """Documents in order, their keys, contested keys and their places, and
        places of rejected documents."""
        if uri not in self._greedy:
            b = self.bound[uri]
            docs = K.placed(self.valid(uri), b.root, self._enforced(uri), self.compiler(b.schema), b.ids, b.order)
            rows, provided = K.spread(docs, "place"), self._provided(uri)
            shared, places = K.contests(rows)
            if provided is None:
                rejected = K.greedy(places)
            else:
                barred = K.cut(rows.join(provided, ["def", "key"], "left_semi").select("doc").distinct())
                rejected = K.cut(K.greedy(places.join(barred, "doc", "left_anti")).union(barred).distinct())
            self._greedy[uri] = (docs, rows, shared, places, rejected)
        return self._greedy[uri]

    def rejected(self, uri: str) -> DataFrame:
        """ids of documents that several keys a document withdraw."""
        docs, *_, rejected = self._settled(uri)
        return docs.join(rejected.withColumnRenamed("doc", "place"), "place", "left_semi").select("doc.*")

    def _first_come(self, uri: str) -> DataFrame:
        b, d = self.bound[uri], self._enforced(uri)[0]
        df, compiler = self.valid(uri), self.compiler(b.schema)
        if uri not in self._contested:
            self._contested[uri] = K.contested(df, b.root, d, compiler, b.ord, b.ids)
        return K.first_come(df, b.root, d, compiler, b.ord, self._contested[uri])

    def duplicates(self, uri: str) -> DataFrame:
        """ids, reason, keyword, pointer and key of keys that are taken, and
        the holder: JSON text of the identifying columns of the accepted
        document that has it, or the provider."""
        b, defs = self.bound[uri], self._enforced(uri)
        if not defs:
            return self._nothing(b, "holder")
        provided = self._provided(uri)
        if self._single(uri):
            ranked, holder = self._first_come(uri), F.when(F.col("__late"), F.col("__holder"))
            if provided is not None:
                ranked = ranked.join(provided.select(F.col("key").alias("__key"), F.col("source").alias("__source")), "__key", "left")
                holder = F.coalesce("__source", holder)
            return ranked.withColumn("__holder", holder).filter(F.col("__holder").isNotNull()).select(*b.ids, *self._names(F.lit(0), defs), F.col("__key").alias("key"), F.col("__holder").alias("holder"))
        docs, rows, shared, places, rejected = self._settled(uri)
        found = K.duplicates(shared, places, rejected, docs)
        if provided is not None:
            own = docs.select(F.col("place").alias("doc"), F.col("doc").alias("ids"))
            given = rows.join(provided, ["def", "key"]).join(own, "doc").select("doc", "def", "key", "pos", F.col("source").alias("holder"), "ids")
            found = found.union(given).groupBy("doc", "def", "key", "pos").agg(F.min("holder").alias("holder"), F.first("ids").alias("ids"))
        return found.select("ids.*", *self._names(F.col("def"), defs), "key", "holder")

    @staticmethod
    def _names(which: Column, defs: list[KeyDef]) -> list[Column]:
        def pick(values: list[str]) -> Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), which + 1)

        return [pick([K.REASONS[d.kind] for d in defs]).alias("reason"), pick([d.kind for d in defs]).alias("keyword"), pick([d.pointer for d in defs]).alias("pointer")]

    def survivors(self, uri: str) -> DataFrame:
        """Documents that pass 1 accepts."""
        b, defs = self.bound[uri], self._enforced(uri)
        if not defs:
            return self.valid(uri)
        if self._single(uri):
            ranked, provided = self._first_come(uri), self._provided(uri)
            if provided is not None:
                ranked = ranked.join(provided.select(F.col("key").alias("__key")), "__key", "left_anti")
            return ranked.filter(~F.col("__late")).select(*b.df.columns)
        return self.valid(uri).join(self.rejected(uri), b.ids, "left_anti").select(*b.df.columns)

    def postings(self, uri: str, kind: str = "index") -> DataFrame:
        """(def, key, n_docs) of a kind of key over the surviving documents."""
        b = self.bound[uri]
        defs = [k for k in b.schema.keys if k.kind == kind]
        return K.postings(self.survivors(uri), b.root, defs, self.compiler(b.schema), b.ids)

    # --- pass 2 ----------------------------------------------------------------

    def targets(self, r: RefDef) -> list[tuple[Bound, KeyDef]]:
        """Declarations, in any bound schema, that a reference may hit."""
        out = []
        for b in self.bound.values():
            out += [(b, k) for k in b.schema.keys if k.owner == r.target and k.kind == r.target_kind and (r.refers_to is None or k.name == r.refers_to)]
        return out

    def warm_up(self) -> None:
        """Reads the key lists of all providers, into the cache folder where
        there is one. Only such lists are cached: what documents hold is always
        read from the documents."""
        for owner in {k.owner for e in self.schemas.valid.values() for k in e.keys if k.kind == "primary_key"}:
            self._providers(owner)
        self._hook("warm_up")

    def invalidate(self) -> None:
        """Removes the cached key lists."""
        forget_lists(self.config)
        self._hook("invalidate")

    def _accepted_keys(self, b: Bound, k: KeyDef) -> DataFrame:
        """Accepted keys of one declaration, as (key), or (key, doc) if scoped.

        If the schema's only enforced key is this one, the accepted keys are
        those of all valid documents: the first of each key is accepted."""
        df = self.valid(b.schema.uri) if self._single(b.schema.uri) and self._enforced(b.schema.uri)[0] is k else self.survivors(b.schema.uri)
        doc = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in b.ids])).alias("__doc")] if k.scoped else []
        keys = K.keys_of(df, b.root, k, self.compiler(b.schema), *doc)
        if k.kind == "primary_key" and not k.scoped:
            extra = [(key,) for _, key in self._providers(k.owner)]
            if extra:
                keys = keys.select("__key").union(df.sparkSession.createDataFrame(extra, "__key string"))
        return keys

    def _refs(self, uri: str, r: RefDef) -> DataFrame:
        """Distinct (ids, key) of a reference in the surviving documents."""
        b = self.bound[uri]
        return K.keys_of(self.survivors(uri), b.root, r, self.compiler(b.schema), *[F.col(f"`{c}`") for c in b.ids])

    def _has_keys(self, r: RefDef) -> bool:
        """Whether the target has any key at all: a look for one row, which
        ends with the first that is found."""
        if r.kind == "foreign_keys" and self._providers(r.target):
            return True
        tables = self.targets(r)
        at = (r.target, r.kind, *(id(b) for b, _ in tables))
        if at not in self._some:
            self._some[at] = any(not self._accepted_keys(t, k).isEmpty() for t, k in tables)
        return self._some[at]

    def stale(self, uri: str) -> DataFrame:
        """ids, reason, keyword, pointer and key of references that hit nothing."""
        b, out = self.bound[uri], []
        for r in b.schema.refs:
            if r.refers_to is None and not self._has_keys(r):
                continue  # it dangles instead
            rows = self._refs(uri, r)
            if any(k.scoped for _, k in self.targets(r)):
                rows = rows.withColumn("__doc", F.to_json(F.struct(*b.ids)))
            targets = self.targets(r)
            if not targets:
                provided = [(key,) for _, key in self._providers(r.target)] if r.kind == "foreign_keys" else []
                if provided:
                    given = b.df.sparkSession.createDataFrame(provided, "__key string")
                    rows = rows.join(F.broadcast(given) if len(provided) <= K.BROADCAST_KEYS else given, "__key", "left_anti")
            for t, k in targets:
                on = ["__key", "__doc"] if k.scoped else ["__key"]
                rows = rows.join(self._accepted_keys(t, k), on, "left_anti")
            out.append(rows.select(*b.ids, F.lit(r.reasons[0]).alias("reason"), F.lit(r.kind).alias("keyword"), F.lit(r.pointer).alias("pointer"), F.col("__key").alias("key")))
        return reduce(DataFrame.unionByName, out) if out else self._nothing(b)

    def dangling(self, uri: str) -> DataFrame:
        """ids, reason, keyword, pointer: references, with values or not, to a
        schema whose documents have no key."""
        b, out = self.bound[uri], []
        for r in b.schema.refs:
            if r.refers_to is not None:
                continue
            if self._has_keys(r):
                continue
            rows = self.survivors(uri).select(*b.ids)
            out.append(rows.select(*b.ids, F.lit(r.reasons[1]).alias("reason"), F.lit(r.kind).alias("keyword"), F.lit(r.pointer).alias("pointer"), F.lit(None).cast("string").alias("key")))
        return reduce(DataFrame.unionByName, out) if out else self._nothing(b)

    def _nothing(self, b: Bound, *more: str) -> DataFrame:
        return b.df.select(*b.ids, *[F.lit(None).cast("string").alias(c) for c in ("reason", "keyword", "pointer", "key", *more)]).filter(F.lit(False))

    def provider_errors(self, spark: SparkSession) -> DataFrame:
        """(schema_id, doc_id, ...) of keys that several providers of a schema
        give, unless that is allowed; the holder names all of them."""
        rows = []
        for uri, entry in self.schemas.valid.items():
            for k in entry.keys:
                if k.kind == "primary_key" and k.owner == uri:
                    rows += [(uri, PROVIDERS, "dup_pk", k.kind, k.pointer, "", key, ", ".join(sources)) for key, sources in collisions(self.config, uri)]
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("schema_id", "doc_id", *DETAIL)))

    # --- results ---------------------------------------------------------------

    def errors(self, uri: str) -> DataFrame:
        """All errors of a schema's documents: ids and ``DETAIL``."""
        b = self.bound[uri]
        s = self.structural(uri).select(*b.ids, "reason", "keyword", "pointer", "path", F.lit(None).cast("string").alias("key"))
        parts = [s]
        if self._enforced(uri):
            parts.append(self.duplicates(uri))
        if b.schema.refs:
            parts += [self.stale(uri), self.dangling(uri)]
        for x in self.extensions:
            if x.second_pass is not None:
                extra = x.second_pass(self, uri)
                missing = {c: F.lit(x.keyword if c == "keyword" else None).cast("string") for c in DETAIL if c not in extra.columns}
                parts.append(extra.withColumns(missing))
        whole = [p if "path" in p.columns else p.withColumn("path", F.lit("")) for p in parts]
        whole = [p if "holder" in p.columns else p.withColumn("holder", F.lit(None).cast("string")) for p in whole]
        return reduce(DataFrame.union, [p.select(*b.ids, *DETAIL) for p in whole])

    def report(self, uri: str) -> DataFrame:
        """ids, n_errors and the sorted errors of every document."""
        b = self.bound[uri]
        by_doc = self.errors(uri).groupBy(*b.ids).agg(F.sort_array(F.collect_list(F.struct(*DETAIL))).alias("errors"))
        out = b.df.select(*b.ids).join(by_doc, b.ids, "left")
        return out.select(*b.ids, F.coalesce(F.size("errors"), F.lit(0)).alias("n_errors"), "errors")

    def all_errors(self) -> DataFrame:
        """(schema_id, doc_id, ...) over all bound schemas; doc_id is the JSON
        text of the identifying columns."""
        parts = []
        for uri, b in self.bound.items():
            doc = F.to_json(F.struct(*b.ids)) if len(b.ids) > 1 else F.col(f"`{b.ids[0]}`").cast("string")
            parts.append(self.errors(uri).select(F.lit(uri).alias("schema_id"), doc.alias("doc_id"), *DETAIL))
        if self._collide():
            parts.append(self.provider_errors(parts[0].sparkSession))
        return reduce(DataFrame.union, parts)

    def _collide(self) -> bool:
        return any(collisions(self.config, uri) for uri, e in self.schemas.valid.items() if any(k.kind == "primary_key" and k.owner == uri for k in e.keys))

    def stats(self) -> DataFrame:
        """(schema_id, n_docs, n_failed, n_errors): documents are counted, and
        only those that failed are grouped."""
        parts = []
        for uri, b in self.bound.items():
            failed = self.errors(uri).groupBy(*b.ids).count().agg(F.lit(uri).alias("schema_id"), F.count("*").alias("n_failed"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_errors"))
            n = b.df.agg(F.lit(uri).alias("schema_id"), F.count("*").alias("n_docs"))
            parts.append(n.join(failed, "schema_id").select("schema_id", "n_docs", "n_failed", "n_errors"))
        return reduce(DataFrame.union, parts)


__all__ = ["Bound", "Validator"]
