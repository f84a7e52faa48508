"""Validation of parsed documents: each finds its schema, or several are tried.

A document names its schema at a JSONPath; the first alternative that is
there counts and is looked up as it stands. Documents without a name are
tried against the schemas in load order if guessing is on: the first without
an error is theirs; if none fits, they have the errors of all. Keys play no
part in guessing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.paths import DEFAULT_ID_PATH, UnsupportedPath, found_texts, jsonpath, rooted
from veridoc.functions.values import VariantValue
from veridoc.operators.validate import DETAIL, Bound, Validator

ROW = ("doc_id", "schema_id", *DETAIL)


class Documents:
    """Validates ``docs`` (doc_id, ord, json, reason) against a validator's schemas.

    ``guess``: False, True, or a list of schema URIs to try."""

    def __init__(self, validator: Validator, docs: DataFrame, id_path: str = DEFAULT_ID_PATH, root_tag: str | None = None, guess: bool | list[str] = False):
        self.v, self.guess = validator, guess
        self.id_path = rooted(id_path, root_tag)
        self.docs = self._routed(docs)
        for uri, entry in validator.schemas.valid.items():
            mine = self.docs.filter(F.col("schema_id") == uri)
            validator.bind_as(Bound(entry, mine, ["doc_id"], ["ord"], VariantValue(F.col("json")), "json"))

    def _named(self) -> Column:
        try:
            found = [v.string() for v in jsonpath(VariantValue(F.col("json")), self.id_path)]
        except UnsupportedPath:
            found = [VariantValue(F.try_parse_json(found_texts(F.col("json"), self.id_path))).string()]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def _candidates(self) -> list[str]:
        loaded = list(self.v.schemas.valid)
        return [u for u in loaded if u in self.guess] if isinstance(self.guess, list) else loaded

    def _tries(self) -> Column:
        """(schema_id, errors) of every candidate, in load order."""
        parts = []
        for uri in self._candidates():
            b = Bound(self.v.schemas.valid[uri], self.docs_raw, ["doc_id"], ["ord"], VariantValue(F.col("json")), "json")
            parts.append(F.struct(F.lit(uri).alias("schema_id"), self.v._errors(b).alias("errors")))
        return F.array(*parts)

    def _routed(self, docs: DataFrame) -> DataFrame:
        self.docs_raw = docs
        readable = docs.withColumn("named", F.when(F.col("reason").isNull(), self._named()))
        known = list(self.v.schemas.valid)
        tries = self._tries() if self.guess and self._candidates() else None
        if tries is None:
            reason = F.when(F.col("named").isNotNull() & ~F.col("named").isin(known), "schema_unknown").when(F.col("named").isNull(), "schema_unknown" if self.guess else "no_id")
            out = readable.withColumn("schema_id", F.when(F.col("named").isin(known), F.col("named"))).withColumn("tries", F.lit(None).cast("string"))
        else:
            out = readable.withColumn("tries", F.when(F.col("named").isNull() & F.col("reason").isNull(), tries))
            won = F.get(F.filter("tries", lambda t: F.size(t["errors"]) == 0), F.lit(0))["schema_id"]
            out = out.withColumn("schema_id", F.when(F.col("named").isin(known), F.col("named")).otherwise(won))
            reason = F.when(F.col("named").isNotNull() & ~F.col("named").isin(known), "schema_unknown").when(F.col("named").isNull() & F.col("schema_id").isNull(), "guess")
        return out.withColumn("reason", F.coalesce("reason", reason))

    def unrouted(self) -> DataFrame:
        """Errors of documents without a schema of their own."""
        null = F.lit(None).cast("string")
        plain = self.docs.filter(F.col("reason").isNotNull() & (F.col("reason") != "guess")).select("doc_id", F.col("named").alias("schema_id"), "reason", null.alias("keyword"), null.alias("pointer"), null.alias("path"), null.alias("key"), null.alias("holder"))
        if "array" not in self.docs.schema["tries"].dataType.simpleString():
            return plain
        tried = self.docs.filter("reason = 'guess'").select("doc_id", F.explode("tries").alias("t")).select("doc_id", "t.schema_id", F.explode("t.errors").alias("e"))
        return plain.union(tried.select("doc_id", "schema_id", F.lit("schema_error"), "e.keyword", "e.pointer", "e.path", null, null))

    def errors(self) -> DataFrame:
        """(doc_id, schema_id, reason, keyword, pointer, path, key, holder) of
        all documents, and of providers that collide."""
        parts = [self.unrouted()]
        for uri in self.v.schemas.valid:
            parts.append(self.v.errors(uri).select("doc_id", F.lit(uri).alias("schema_id"), *DETAIL))
        if self.v._collide():
            parts.append(self.v.provider_errors(self.docs.sparkSession))
        return reduce(DataFrame.union, [p.select(*ROW) for p in parts])

    def report(self, annotation: str | None = None, errors_only: bool = False, verbose: bool = False) -> DataFrame:
        """One row a document: doc_id, schema_id, schema_hash (of the document
        as canonical JSON), n_errors, errors, with the value at ``annotation``
        and, if verbose, the document."""
        by_doc = self.errors().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("schema_id", *DETAIL))).alias("errors"))
        extra = []
        if annotation:
            try:
                annot = F.coalesce(*[v.canonical() for v in jsonpath(VariantValue(F.col("json")), annotation)])
            except UnsupportedPath:
                annot = found_texts(F.col("json"), annotation)
            extra.append(annot.alias("annot"))
        if verbose:
            extra.append(F.to_json("json").alias("json"))
        rows = self.docs.select("doc_id", "ord", "file", F.coalesce("schema_id", "named").alias("schema_id"), F.sha1(F.to_json("json")).alias("json_hash"), *extra)
        out = rows.join(by_doc, "doc_id", "left").withColumn("n_errors", F.coalesce(F.size("errors"), F.lit(0)))
        return out.filter("n_errors > 0") if errors_only else out

    def stats(self) -> DataFrame:
        """(status, n): ok, failed in pass 1, failed in pass 2, ignored."""
        second = F.col("reason").isin("stale_fk", "stale_jk", "dangling_fk", "dangling_jk")
        worst = self.errors().groupBy("doc_id").agg(F.max(F.when(F.col("reason") == "ignored", 3).when(second, 1).otherwise(2)).alias("w"))
        status = F.when(F.col("w") == 1, "failed_references").when(F.col("w") == 2, "failed").when(F.col("w") == 3, "ignored").otherwise("ok")
        return self.docs.select("doc_id").join(worst, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
