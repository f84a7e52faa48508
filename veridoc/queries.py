"""Driver queries of the validation engine, and their SQL.

Tables are bound to schemas; every query returns the identifying columns of
the documents that fail, with what failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.operators.validate import Validator
from veridoc.plans.catalog import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

D7 = "http://json-schema.org/draft-07/schema#"
D2019 = "https://json-schema.org/draft/2019-09/schema"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema(uri: str, dialect: str = D7, **body) -> dict:
    return {"$schema": dialect, "$id": f"urn:x:{uri}", "type": "object", **body}


def prop(name: str, **rule) -> dict:
    return {"properties": {name: rule}}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put


def failing(name: str, source, ids: list[str], body: dict, sql: str, dialect: str = D7) -> None:
    """A query for the structural errors of a table: ids and reason."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir) if callable(source) else table(spark, sf_dir, source)
        v = Validator(load(schema("doc", dialect, **body))).bind("urn:x:doc", df, ids)
        return v.structural("urn:x:doc").select(*ids, "reason")

    query(name, f"SELECT {', '.join(ids)}, 'schema_error' AS reason FROM {sql}")(run)


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("props", F.try_parse_json("props"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with their items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("i"))
    return items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("i").alias("items"))


ITEMS = "(SELECT l_orderkey AS o_orderkey, list(struct_pack(l_partkey, l_quantity, l_returnflag)) AS items FROM lineitem GROUP BY 1)"

# --- keywords -----------------------------------------------------------------

failing("kw_minimum", "customer", ["c_custkey"], prop("c_acctbal", minimum=0), "customer WHERE NOT c_acctbal >= 0")
failing("kw_enum", "events", ["event_id"], prop("event_type", enum=["view", "click", "purchase"]), "events WHERE event_type NOT IN ('view', 'click', 'purchase')")
failing("kw_pattern", "pages", ["page_id"], prop("url", pattern="^https://"), "pages WHERE NOT regexp_matches(url, '^https://')")
failing("kw_max_length", "documents", ["doc_id"], prop("text", maxLength=2000), "documents WHERE length(text) > 2000")
failing("kw_min_length", "documents", ["doc_id"], prop("text", minLength=50), "documents WHERE length(text) < 50")
failing("kw_type_integer", "customer", ["c_custkey"], prop("c_acctbal", type="integer"), "customer WHERE c_acctbal <> floor(c_acctbal)")
failing("kw_const", "lineitem", ["l_orderkey", "l_linenumber"], prop("l_linestatus", const="O"), "lineitem WHERE l_linestatus <> 'O'")
failing("kw_exclusive_minimum", "lineitem", ["l_orderkey", "l_linenumber"], prop("l_discount", exclusiveMinimum=0), "lineitem WHERE NOT l_discount > 0")
failing("kw_multiple_of", "lineitem", ["l_orderkey", "l_linenumber"], prop("l_quantity", multipleOf=5), "lineitem WHERE l_quantity % 5 <> 0")
failing("kw_any_of", "part", ["p_partkey"], {"anyOf": [prop("p_size", maximum=10), prop("p_retailprice", minimum=950)]}, "part WHERE NOT (p_size <= 10 OR p_retailprice >= 950)")
failing("kw_one_of", "part", ["p_partkey"], {"oneOf": [prop("p_size", maximum=25), prop("p_retailprice", minimum=950)]}, "part WHERE (p_size <= 25) = (p_retailprice >= 950)")
failing("kw_all_of", "part", ["p_partkey"], {"allOf": [prop("p_size", maximum=25), {"not": prop("p_retailprice", minimum=950)}]}, "part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'schema_error' FROM part WHERE p_retailprice >= 950")
failing("kw_not", "events", ["event_id"], {"not": prop("event_type", const="error")}, "events WHERE event_type = 'error'")
failing("kw_if_then", "events", ["event_id"], {"if": prop("event_type", const="purchase"), "then": prop("value", minimum=10)}, "events WHERE event_type = 'purchase' AND NOT value >= 10")
failing("kw_format_uri", "pages", ["page_id"], prop("url", format="uri"), "pages WHERE NOT regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^ ]+')")
failing("kw_dependencies", "customer", ["c_custkey"], {"dependencies": {"c_custkey": prop("c_nationkey", maximum=20)}}, "customer WHERE c_nationkey > 20")
failing("kw_dependent_required", "nation", ["n_nationkey"], {"dependentRequired": {"n_name": ["n_comment"]}}, "nation", D2019)
failing("kw_max_properties", "region", ["r_regionkey"], {"maxProperties": 1}, "region")
failing("kw_ref", "supplier", ["s_suppkey"], {"definitions": {"money": {"minimum": 0}}, "properties": {"s_acctbal": {"$ref": "#/definitions/money"}}}, "supplier WHERE s_acctbal < 0")
failing("kw_items_maximum", order_items, ["o_orderkey"], {"properties": {"items": {"items": prop("l_quantity", maximum=45)}}}, f"{ITEMS} o, unnest(o.items) AS t(i) WHERE i.l_quantity > 45")
failing("kw_contains", order_items, ["o_orderkey"], prop("items", contains=prop("l_returnflag", const="R")), f"{ITEMS} WHERE len(list_filter(items, lambda i: i.l_returnflag = 'R')) = 0")
failing("kw_min_contains", order_items, ["o_orderkey"], prop("items", contains=prop("l_returnflag", const="R"), minContains=2), f"{ITEMS} WHERE len(list_filter(items, lambda i: i.l_returnflag = 'R')) < 2", D2019)
failing("kw_min_items", order_items, ["o_orderkey"], prop("items", minItems=2), f"{ITEMS} WHERE len(items) < 2")
failing("kw_max_items", order_items, ["o_orderkey"], prop("items", maxItems=7), f"{ITEMS} WHERE len(items) > 7")
failing("kw_json_maximum", events_json, ["event_id"], {"properties": {"props": prop("k", type="integer", maximum=50)}}, "events WHERE (props ->> '$.k')::INT > 50")
failing("kw_additional_properties", events_json, ["event_id"], {"properties": {"props": {"properties": {"v": True}, "additionalProperties": False}}}, "events WHERE len(list_filter(json_keys(props), lambda k: k <> 'v')) > 0")
failing("kw_property_names", events_json, ["event_id"], prop("props", propertyNames={"pattern": "^[a-j]$"}), "events WHERE len(list_filter(json_keys(props), lambda k: NOT regexp_matches(k, '^[a-j]$'))) > 0")


@query("kw_items_float", "SELECT vec_id, 'schema_error' AS reason FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.3)) > 0")
def kw_items_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("doc", **prop("embedding", items={"maximum": 0.3})))).bind("urn:x:doc", table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), ["vec_id"])
    return v.structural("urn:x:doc").select("vec_id", "reason").distinct()


@query("kw_unique_items", f"SELECT o_orderkey, 'schema_error' AS reason FROM {ITEMS} WHERE len(list_distinct(list_transform(items, lambda i: i.l_partkey))) < len(items)")
def kw_unique_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_items(spark, sf_dir).select("o_orderkey", F.col("items.l_partkey").alias("parts"))
    v = Validator(load(schema("doc", **prop("parts", uniqueItems=True)))).bind("urn:x:doc", df, ["o_orderkey"])
    return v.structural("urn:x:doc").select("o_orderkey", "reason")


@query("kw_required", "SELECT doc_id, 'schema_error' AS reason FROM documents ANTI JOIN labels USING (doc_id)")
def kw_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    v = Validator(load(schema("doc", required=["doc_id", "quality"]))).bind("urn:x:doc", df, ["doc_id"])
    return v.structural("urn:x:doc").select("doc_id", "reason")


# --- uniqueness ------------------------------------------------------------------

ALL_LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def duplicated(name: str, source, ids: list[str], body: dict, sql: str, order: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = Validator(load(schema("doc", **body))).bind("urn:x:doc", table(spark, sf_dir, source), ids, order)
        return v.duplicates("urn:x:doc").select(*ids, "reason")

    query(name, sql)(run)


def _window_sql(source: str, ids: str, by: str, order: str, reason: str) -> str:
    return f"SELECT {ids}, '{reason}' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS n FROM {source}) WHERE n > 1"


duplicated("unique_compound", "lineitem", ["l_orderkey", "l_linenumber"], {"unique": ["l_orderkey", "l_linenumber"]}, _window_sql("lineitem", "l_orderkey, l_linenumber", "l_orderkey, l_linenumber", ", ".join(ALL_LINEITEM), "dup_unique"), ALL_LINEITEM)
duplicated("unique_value", "documents", ["doc_id"], prop("text", unique=True), _window_sql("documents", "doc_id", "text", "doc_id", "dup_unique"))
duplicated("unique_name", "part", ["p_partkey"], {"unique": {"name": "by_name", "members": ["p_name"]}}, _window_sql("part", "p_partkey", "p_name", "p_partkey", "dup_unique"))
duplicated("pk_orders", "orders", ["o_orderkey"], {"primary_key": ["o_custkey"]}, _window_sql("orders", "o_orderkey", "o_custkey", "o_orderkey", "dup_pk"))


@query("unique_scoped", "SELECT conv_id, 'dup_unique' AS reason FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n > 1")
def unique_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    body = {"properties": {"turns": {"items": {"properties": {"role": {"unique": {"members": True, "limit_scope": True}}}}}}}
    v = Validator(load(schema("doc", **body))).bind("urn:x:doc", turns, ["conv_id"])
    return v.duplicates("urn:x:doc").select("conv_id", "reason")


@query("unique_multi")
def unique_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys a document: which documents are withdrawn depends on all
    earlier decisions, so this is the fix point, not a window."""
    body = {"properties": {}, "allOf": [{"unique": ["l_orderkey", "l_linenumber"]}, {"unique": ["l_partkey", "l_suppkey"]}]}
    df = table(spark, sf_dir, "lineitem")
    v = Validator(load(schema("doc", **body))).bind("urn:x:doc", df, ALL_LINEITEM)
    return v.rejected("urn:x:doc").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("index_postings", "SELECT concat('[', o_custkey, ']') AS key, count(*) AS n_docs FROM orders GROUP BY 1")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("doc", index=["o_custkey"]))).bind("urn:x:doc", table(spark, sf_dir, "orders"), ["o_orderkey"])
    return v.postings("urn:x:doc").select("key", "n_docs")


# --- references --------------------------------------------------------------------


def fk(target: str, *members: str, **more) -> dict:
    return {"foreign_keys": [{"schema_id": f"urn:x:{target}", "members": list(members), **more}]}


def stale(validator: Validator, uri: str, ids: list[str]) -> DataFrame:
    return validator.stale(f"urn:x:{uri}").select(*ids, "reason")


@query("fk_stale", "SELECT doc_id, 'stale_fk' AS reason FROM documents ANTI JOIN labels USING (doc_id)")
def fk_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("labels", primary_key=["doc_id"]), schema("documents", **fk("labels", "doc_id"))))
    v.bind("urn:x:labels", table(spark, sf_dir, "labels"), ["doc_id"]).bind("urn:x:documents", table(spark, sf_dir, "documents"), ["doc_id"])
    return stale(v, "documents", ["doc_id"])


def customers_and_orders(spark: SparkSession, sf_dir: str) -> Validator:
    schemas = load(
        schema("customer", primary_key=["c_custkey"], **prop("c_acctbal", minimum=0)),
        schema("orders", primary_key=["o_orderkey"], **fk("customer", "o_custkey")),
    )
    v = Validator(schemas).bind("urn:x:customer", table(spark, sf_dir, "customer"), ["c_custkey"])
    return v.bind("urn:x:orders", table(spark, sf_dir, "orders"), ["o_orderkey"])


@query("fk_after_forget", "SELECT o_orderkey, 'stale_fk' AS reason FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def fk_after_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale(customers_and_orders(spark, sf_dir), "orders", ["o_orderkey"])


@query("fk_compound", "SELECT o_orderkey, 'stale_fk' AS reason FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def fk_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("first"))
    v = Validator(load(schema("lineitem", primary_key=["l_orderkey", "l_linenumber"]), schema("orders", **fk("lineitem", "o_orderkey", "first"))))
    v.bind("urn:x:lineitem", table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ALL_LINEITEM).bind("urn:x:orders", orders, ["o_orderkey"])
    return stale(v, "orders", ["o_orderkey"])


@query("fk_named", "SELECT n_nationkey, 'stale_fk' AS reason FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name LIKE 'A%')")
def fk_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = schema("region", **prop("r_name", pattern="^A"), allOf=[{"primary_key": {"name": "pk", "members": ["r_regionkey"]}}, {"primary_key": {"name": "by_name", "members": ["r_name"]}}])
    v = Validator(load(region, schema("nation", **fk("region", "n_regionkey", refers_to="pk"))))
    v.bind("urn:x:region", table(spark, sf_dir, "region"), ["r_regionkey"]).bind("urn:x:nation", table(spark, sf_dir, "nation"), ["n_nationkey"])
    return stale(v, "nation", ["n_nationkey"])


@query("fk_dangling", "SELECT doc_id, 'dangling_fk' AS reason FROM labels")
def fk_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("documents", primary_key=["doc_id"], **prop("n_chars", maximum=-1)), schema("labels", **fk("documents", "doc_id"))))
    v.bind("urn:x:documents", table(spark, sf_dir, "documents"), ["doc_id"]).bind("urn:x:labels", table(spark, sf_dir, "labels"), ["doc_id"])
    return v.dangling("urn:x:labels").select("doc_id", "reason")


@query("jk_stale", "SELECT c_custkey, 'stale_jk' AS reason FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jk_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = schema("orders", index=["o_custkey"], **prop("o_orderpriority", const="1-URGENT"))
    customer = schema("customer", join_keys=[{"schema_id": "urn:x:orders", "members": ["c_custkey"]}])
    v = Validator(load(orders, customer)).bind("urn:x:orders", table(spark, sf_dir, "orders"), ["o_orderkey"])
    return stale(v.bind("urn:x:customer", table(spark, sf_dir, "customer"), ["c_custkey"]), "customer", ["c_custkey"])


@query("array_keys", "SELECT DISTINCT l_orderkey AS o_orderkey, concat('[', l_partkey, ']') AS key, 'stale_fk' AS reason FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)")
def array_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("part", primary_key=["p_partkey"], **prop("p_size", maximum=25)), schema("orders", **fk("part", "items.l_partkey"))))
    v.bind("urn:x:part", table(spark, sf_dir, "part"), ["p_partkey"]).bind("urn:x:orders", order_items(spark, sf_dir), ["o_orderkey"])
    return v.stale("urn:x:orders").select("o_orderkey", "key", "reason")


@query("fk_self", "SELECT n_nationkey, 'stale_fk' AS reason FROM nation WHERE n_regionkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey >= 3)")
def fk_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("own", F.when(F.col("n_nationkey") >= 3, F.col("n_nationkey")))
    v = Validator(load(schema("nation", primary_key=["own"], foreign_keys=[{"members": ["n_regionkey"]}]))).bind("urn:x:nation", nation, ["n_nationkey"])
    return stale(v, "nation", ["n_nationkey"])


# --- providers ------------------------------------------------------------------------


def _region_with(spark: SparkSession, sf_dir: str, keys: list, **more) -> Validator:
    config = {"primary_key": {"inline_provider": {"urn:x:region": keys}, **more}}
    v = Validator(load(schema("region", primary_key=["r_regionkey"]), schema("nation", **fk("region", "n_regionkey"))), config)
    return v.bind("urn:x:nation", table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("provider_inline", "SELECT n_nationkey, 'stale_fk' AS reason FROM nation WHERE n_regionkey NOT IN (0, 1, 2)")
def provider_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale(_region_with(spark, sf_dir, [0, 1, 2]), "nation", ["n_nationkey"])


@query("provider_taken", "SELECT r_regionkey, 'dup_pk' AS reason FROM region WHERE r_regionkey IN (1, 2)")
def provider_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _region_with(spark, sf_dir, [1, 2]).bind("urn:x:region", table(spark, sf_dir, "region"), ["r_regionkey"])
    return v.duplicates("urn:x:region").select("r_regionkey", "reason")


@query("provider_shadow", "SELECT n_nationkey, 'stale_fk' AS reason FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AND n_regionkey <> 4")
def provider_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _region_with(spark, sf_dir, [1, 4], allow_provider_duplicates=True).bind("urn:x:region", table(spark, sf_dir, "region").filter("r_regionkey < 2"), ["r_regionkey"])
    return stale(v, "nation", ["n_nationkey"])


@query("provider_collision", 'SELECT \'["one"]\' AS key, 2::BIGINT AS n_sources')
def provider_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.sources.providers import collisions

    lists = {"http://a/region/": "one\ntwo", "http://b/region/": "one\nthree"}
    config = {"primary_key": {"provider": ["http://a/", "http://b/"], "accept": "text/uri-list", "schema_prefix": "http://x/", "fetch": lambda url, accept: lists[url]}}
    return spark.createDataFrame([(k, len(s)) for k, s in collisions(config, "http://x/region")], "key string, n_sources bigint")


# --- reports ----------------------------------------------------------------------------


@query("report_by_doc", """
SELECT 'customer' AS kind, c_custkey AS id, 1 AS n_errors FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'orders', o_orderkey, 1 FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)""")
def report_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = customers_and_orders(spark, sf_dir)
    a = v.report("urn:x:customer").filter("n_errors > 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), "n_errors")
    b = v.report("urn:x:orders").filter("n_errors > 0").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), "n_errors")
    return a.union(b)


@query("validation_stats", """
SELECT 'urn:x:customer' AS schema_id, count(*) AS n_docs, count(*) FILTER (c_acctbal < 0) AS n_failed, count(*) FILTER (c_acctbal < 0) AS n_errors FROM customer
UNION ALL SELECT 'urn:x:orders', count(*), count(*) FILTER (NOT ok), count(*) FILTER (NOT ok)
FROM (SELECT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) AS ok FROM orders)""")
def validation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_and_orders(spark, sf_dir).stats()


@query("all_errors", """
SELECT 'urn:x:customer' AS schema_id, c_custkey::VARCHAR AS doc_id, 'schema_error' AS reason FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'urn:x:orders', o_orderkey::VARCHAR, 'stale_fk' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)""")
def all_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_and_orders(spark, sf_dir).all_errors().select("schema_id", "doc_id", "reason")


# --- literal documents ------------------------------------------------------------------


def literal(name: str, body: dict, docs: list[tuple[str, bool]], dialect: str = D7, **options) -> None:
    """A query over written-out documents: (n, ok), with what has to come out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "n int, t string").select("n", F.try_parse_json("t").alias("json"))
        v = Validator(load({"$schema": dialect, "id" if "draft-03" in dialect or "draft-04" in dialect else "$id": "urn:x:doc", **body}), **options).bind_json("urn:x:doc", df, ["n"])
        failed = v.structural("urn:x:doc").select("n").distinct().withColumn("bad", F.lit(True))
        return df.select("n").join(failed, "n", "left").select("n", F.col("bad").isNull().alias("ok"))

    rows = ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(docs))
    query(name, f"SELECT * FROM (VALUES {rows}) AS t(n, ok)")(run)


D4 = "http://json-schema.org/draft-04/schema#"
D2020 = "https://json-schema.org/draft/2020-12/schema"

literal("kw_formats", {"properties": {"d": {"format": "date-time"}, "e": {"format": "email"}, "i": {"format": "ipv6"}, "u": {"format": "uuid"}, "p": {"format": "json-pointer"}, "h": {"format": "hostname"}}}, [('{"d": "2024-02-29T10:00:00Z"}', True), ('{"d": "2023-02-29T10:00:00Z"}', False), ('{"e": "a@b"}', True), ('{"e": "a"}', False), ('{"i": "::1"}', True), ('{"i": "1::2::3"}', False), ('{"u": "123e4567-e89b-12d3-a456-426614174000"}', True), ('{"u": "1"}', False), ('{"p": "/a~1b"}', True), ('{"p": "a"}', False), ('{"h": "a.b-c"}', True), ('{"h": "-a"}', False), ('{"d": 1}', True)])
literal(
    "kw_formats_more",
    {"properties": {n: {"format": n} for n in ("time", "duration", "idn-email", "idn-hostname", "ipv4", "uri-reference", "iri", "iri-reference", "uri-template", "relative-json-pointer", "color", "date")}},
    [
        ('{"time": "23:59:59Z"}', True), ('{"time": "25:00:00Z"}', False), ('{"duration": "P1DT2H"}', True), ('{"duration": "1 day"}', False), ('{"idn-email": "é@ü.org"}', True), ('{"idn-email": "nobody"}', False),
        ('{"idn-hostname": "bücher.example"}', True), ('{"idn-hostname": "a b"}', False), ('{"ipv4": "10.0.0.255"}', True), ('{"ipv4": "10.0.0.256"}', False), ('{"uri-reference": "../x?y#z"}', True), ('{"uri-reference": "a b"}', False),
        ('{"iri": "http://é.org/ü"}', True), ('{"iri": "no scheme"}', False), ('{"iri-reference": "/é"}', True), ('{"iri-reference": "<x>"}', False), ('{"uri-template": "/a{/b}{?c,d*}"}', True), ('{"uri-template": "/{a"}', False),
        ('{"relative-json-pointer": "1/a"}', True), ('{"relative-json-pointer": "/a"}', False), ('{"color": "#12aBc9"}', True), ('{"color": "#12"}', False), ('{"date": "2024-02-29"}', True), ('{"date": "2023-02-29"}', False),
    ],
)
literal("kw_format_regex", {"items": {"format": "regex"}}, [('["a+", 1]', True), ('["a("]', False)])
literal("kw_pattern_properties", {"patternProperties": {"^x": {"type": "integer"}}}, [('{"x1": 1, "y": "a"}', True), ('{"x1": "a"}', False), ("[]", True)])
literal("kw_min_properties", {"minProperties": 1}, [('{"a": 1}', True), ("{}", False), ("[]", True)])
literal("kw_dependent_schemas", {"dependentSchemas": {"a": {"required": ["b"]}}}, [('{"a": 1, "b": 2}', True), ('{"a": 1}', False), ("{}", True)], D2019)
literal("kw_unevaluated_properties", {"properties": {"a": {}}, "anyOf": [{"properties": {"b": {"type": "string"}}, "required": ["b"]}, {}], "unevaluatedProperties": False}, [('{"a": 1, "b": "x"}', True), ('{"a": 1, "b": 2}', False), ('{"c": 1}', False)], D2019)
literal("kw_unevaluated_items", {"items": [{}], "unevaluatedItems": False}, [("[1]", True), ("[1, 2]", False)], D2019)
literal("kw_tuple_items", {"items": [{"type": "integer"}], "additionalItems": {"type": "string"}}, [('[1, "a"]', True), ('["a"]', False), ("[1, 2]", False), ("[]", True)])
literal("kw_prefix_items", {"prefixItems": [{"type": "integer"}], "items": False}, [("[1]", True), ('["a"]', False), ("[1, 2]", False)], D2020)
literal("kw_max_contains", {"contains": {"const": 1}, "maxContains": 1}, [("[1, 2]", True), ("[1, 1]", False)], D2019)
literal("kw_recursive_ref", {"required": ["v"], "properties": {"next": {"$ref": "#"}}}, [('{"v": 1, "next": {"v": 2}}', True), ('{"v": 1, "next": {}}', False)])
literal("kw_dynamic_ref", {"$dynamicAnchor": "node", "required": ["v"], "properties": {"next": {"$dynamicRef": "#node"}}}, [('{"v": 1, "next": {"v": 2}}', True), ('{"v": 1, "next": {}}', False)], D2020)
literal("kw_boolean_schemas", {"properties": {"a": True, "b": False}}, [('{"a": 1}', True), ('{"b": 1}', False)])
literal("kw_draft4_exclusive", {"minimum": 2, "exclusiveMinimum": True}, [("3", True), ("2", False)], D4)
literal("kw_enum_values", {"enum": [1, "1", None, {"a": [1, 2]}]}, [("1", True), ("1.0", True), ('"1"', True), ("null", True), ("true", False), ('{"a": [1, 2]}', True), ('{"a": [2, 1]}', False)])


def _extensions() -> dict:
    from veridoc.extensions import Extension
    from veridoc.functions.formats import Formats

    even = Extension("even", lambda value, s, v: F.coalesce(v.number() % 2 == 0, F.lit(True)), lambda value, s, v: v % 2 == 0)
    return {"extensions": [even], "formats": Formats({"sku": "[A-Z]{2}-[0-9]+"}), "types": {"whole": (lambda v: v.is_type("integer"), lambda v: isinstance(v, int))}}


literal("custom_keyword", {"even": True}, [("2", True), ("3", False), ('"x"', True)], **_extensions())
literal("custom_format", {"format": "sku"}, [('"AB-1"', True), ('"ab-1"', False), ("1", True)], **_extensions())

# --- schemas ------------------------------------------------------------------------------


@query("schema_faults", "SELECT * FROM (VALUES (0, 'no_schema'), (1, 'schema_unknown'), (3, 'dup_id'), (4, 'schema_error'), (5, 'fk_no_schema'), (6, 'unexpected'), (7, 'schema_error'), (7, 'schema_error')) AS t(n, reason)")
def schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [{"type": "object"}, {"$schema": "http://nowhere/"}, schema("a"), schema("a"), schema("b", minimum="x"), schema("c", **fk("missing", "k")), {"errors": []}, schema("d", unique=18, properties={"p": {"unique": ["a", 42]}})]
    rows = [(i, f.reason) for i, e in enumerate(load(*given).entries) for f in e.faults]
    return spark.createDataFrame(rows, "n int, reason string")


@query("schema_keys", "SELECT * FROM (VALUES ('primary_key', '', 'k', 2), ('unique', '/properties/p', NULL, 0), ('index', '/allOf/0', NULL, 1)) AS t(kind, pointer, name, n_members)")
def schema_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema("a", primary_key={"name": "k", "members": ["p", "q"]}, properties={"p": {"unique": True}, "unique": {"type": "string"}}, allOf=[{"index": ["p"]}])
    return load(s).key_table(spark).select("kind", "pointer", "name", F.coalesce(F.size("members"), F.lit(0)).alias("n_members"))


@query("schema_edges", "SELECT * FROM (VALUES ('urn:x:orders', 'urn:x:customer', 'foreign_keys', 'o_custkey'), ('urn:x:items', 'urn:x:orders', 'join_keys', 'l_orderkey')) AS t(source, target, kind, member)")
def schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.plans.graph import edges_table

    shown = {"properties": {"k": {}}}
    items = schema("items", join_keys=[{"schema_id": "urn:x:orders", "members": ["l_orderkey"]}], **shown)
    s = load(schema("customer", primary_key=["c_custkey"], **shown), schema("orders", index=["o_orderkey"], **fk("customer", "o_custkey"), **shown), items)
    return edges_table(spark, s).select("source", "target", "kind", "member")


# --- documents ------------------------------------------------------------------------------


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON documents that name their schema by their type."""
    from veridoc.sources.documents import parsed

    text = F.concat(F.lit('{"@schema": "urn:x:'), "event_type", F.lit('", "n": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("file"), text.alias("text"))
    return parsed(df).drop("text")


def _documents(spark: SparkSession, sf_dir: str, docs: DataFrame, *schemas: dict, **how):
    from veridoc.operators.documents import Documents

    return Documents(Validator(load(*schemas)), docs, **how)


LIMITS = [schema(kind, **{"properties": {"props": prop("k", maximum=most)}}) for kind, most in (("view", 50), ("click", 80))]


@query("route_documents", """
SELECT event_id::VARCHAR AS doc_id, 'schema_unknown' AS reason FROM events WHERE event_type NOT IN ('view', 'click')
UNION ALL SELECT event_id::VARCHAR, 'schema_error' FROM events WHERE (props ->> '$.k')::INT > CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 80 END""")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, event_documents(spark, sf_dir), *LIMITS).errors().select("doc_id", "reason")


@query("guess_schema", "SELECT event_id::VARCHAR AS doc_id, CASE WHEN (props ->> '$.k')::INT <= 30 THEN 'urn:x:low' WHEN (props ->> '$.k')::INT <= 60 THEN 'urn:x:mid' END AS schema_id FROM events")
def guess_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("event_id").alias("ord"), F.try_parse_json("props").alias("json"), F.lit(None).cast("string").alias("reason"))
    return _documents(spark, sf_dir, docs, schema("low", **prop("k", maximum=30)), schema("mid", **prop("k", maximum=60)), guess=True).docs.select("doc_id", "schema_id")


@query("no_id_documents", "SELECT event_id::VARCHAR AS doc_id, 'no_id' AS reason FROM events")
def no_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("event_id").alias("ord"), F.try_parse_json("props").alias("json"), F.lit(None).cast("string").alias("reason"))
    return _documents(spark, sf_dir, docs, schema("low")).errors().select("doc_id", "reason")


@query("array_documents", "SELECT concat(conv_id, ' [', n - 1, ']') AS doc_id, role FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) WHERE role <> 'user'")
def array_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element of a top-level array is a document."""
    from veridoc.sources.documents import shredded

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    docs = turns.select(F.col("conv_id").cast("string").alias("file"), F.parse_json(F.to_json(F.col("t"))).alias("json"), F.lit(None).cast("string").alias("reason"))
    docs = shredded(docs).select("doc_id", "json", F.try_variant_get("json", "$.role", "string").alias("role"))
    v = Validator(load(schema("turn", **prop("role", const="user")))).bind_json("urn:x:turn", docs, ["doc_id", "role"])
    return v.structural("urn:x:turn").select("doc_id", "role")


@query("yaml_documents", "SELECT r_name AS doc_id, CASE WHEN r_regionkey >= 2 THEN 'schema_error' END AS reason FROM region WHERE r_regionkey >= 2 UNION ALL SELECT 'broken', 'fatal'")
def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridoc.sources.documents import parsed

    text = F.concat(F.lit("'@schema': urn:x:region\nkey: "), F.col("r_regionkey").cast("string"), F.lit("\n"))
    docs = table(spark, sf_dir, "region").select(F.col("r_name").alias("doc_id"), text.alias("text"))
    docs = docs.union(spark.createDataFrame([("broken", "{a: [")], "doc_id string, text string"))
    docs = parsed(docs).select("doc_id", F.col("doc_id").alias("ord"), F.col("doc_id").alias("file"), "json", "reason")
    return _documents(spark, sf_dir, docs, schema("region", **prop("key", maximum=1))).errors().select("doc_id", "reason")


@query("report_annotation", "SELECT event_id::VARCHAR AS doc_id, (props ->> '$.k') AS annot, sha1(concat('{\"@schema\":\"urn:x:', event_type, '\",\"n\":', event_id, ',\"props\":{\"k\":', (props ->> '$.k'), '}}')) AS json_hash, ((props ->> '$.k')::INT > CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 80 ELSE -1 END)::INT AS n_errors FROM events")
def report_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir, event_documents(spark, sf_dir), *LIMITS)
    return d.report(annotation="props.k").select("doc_id", "annot", "json_hash", "n_errors")


@query("document_stats", """
SELECT CASE WHEN (props ->> '$.k')::INT > CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 80 ELSE -1 END THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, event_documents(spark, sf_dir), *LIMITS).stats()


@query("fk_scoped", "SELECT conv_id, concat('[', turn - 1, ']') AS key FROM (SELECT DISTINCT conv_id, turn FROM conversations) c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 1)")
def fk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference within the document: each turn to the one before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    docs = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", (F.col("turn") - 1).alias("after"))).alias("turns"))
    items = {"primary_key": {"members": ["turn"], "limit_scope": True}, "foreign_keys": [{"members": ["after"]}]}
    v = Validator(load(schema("doc", properties={"turns": {"items": items}}))).bind("urn:x:doc", docs, ["conv_id"])
    return v.stale("urn:x:doc").select("conv_id", "key")


@query("fk_name_missing", "SELECT n_nationkey, 'stale_fk' AS reason FROM nation")
def fk_name_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("region", primary_key=["r_regionkey"]), schema("nation", **fk("region", "n_regionkey", refers_to="nobody"))))
    v.bind("urn:x:region", table(spark, sf_dir, "region"), ["r_regionkey"]).bind("urn:x:nation", table(spark, sf_dir, "nation"), ["n_nationkey"])
    return stale(v, "nation", ["n_nationkey"])


@query("jk_dangling", "SELECT n_nationkey, 'dangling_jk' AS reason FROM nation")
def jk_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is no primary key and the other way round."""
    nation = schema("nation", join_keys=[{"schema_id": "urn:x:region", "members": ["n_regionkey"]}])
    v = Validator(load(schema("region", primary_key=["r_regionkey"]), nation)).bind("urn:x:region", table(spark, sf_dir, "region"), ["r_regionkey"])
    return v.bind("urn:x:nation", table(spark, sf_dir, "nation"), ["n_nationkey"]).dangling("urn:x:nation").select("n_nationkey", "reason")

# --- member paths and further declarations ---------------------------------------------


def indexed(name: str, source, ids: list[str], members: list[str], sql: str) -> None:
    """A query for the keys that member paths give: key, n_docs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir) if callable(source) else table(spark, sf_dir, source)
        return Validator(load(schema("doc", index=members))).bind("urn:x:doc", df, ids).postings("urn:x:doc").select("key", "n_docs")

    query(name, sql)(run)


def _keyed(expression: str, source: str) -> str:
    return f"SELECT key, count(DISTINCT id) AS n_docs FROM (SELECT o_orderkey AS id, {expression} AS key FROM {source}) WHERE key IS NOT NULL GROUP BY 1"


_LINES = "(SELECT l_orderkey AS o_orderkey, * FROM lineitem)"
_BY_LINE = "(SELECT o_orderkey, list(i ORDER BY i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_quantity, i.l_returnflag) AS items FROM (SELECT l_orderkey AS o_orderkey, struct_pack(l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS i FROM lineitem) GROUP BY 1)"


def sorted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).withColumn("items", F.sort_array("items"))


indexed("key_list_step", order_items, ["o_orderkey"], ["items[].l_partkey"], _keyed("concat('[', l_partkey, ']')", _LINES))
indexed("key_item_step", sorted_items, ["o_orderkey"], ["items[1].l_partkey"], _keyed("CASE WHEN len(items) > 1 THEN concat('[', items[2].l_partkey, ']') END", _BY_LINE))
indexed("key_product", order_items, ["o_orderkey"], ["items.l_returnflag", "items.l_linenumber"], _keyed("concat('[\"', a.l_returnflag, '\",', b.l_linenumber, ']')", "lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey, (SELECT 1), (SELECT 1)").replace("o_orderkey AS id", "a.l_orderkey AS id").replace(", (SELECT 1), (SELECT 1)", ""))
indexed("key_part", lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("r"), F.when(F.col("n_nationkey") % 2 == 0, "even").alias("p")).alias("at")), ["n_nationkey"], ["at"], "SELECT CASE n_nationkey % 2 WHEN 0 THEN concat('[{\"p\":\"even\",\"r\":', n_regionkey, '}]') ELSE concat('[{\"p\":null,\"r\":', n_regionkey, '}]') END AS key, count(*) AS n_docs FROM nation GROUP BY 1")
indexed("key_null_member", lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.array(F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 10)).alias("u")), ["event_id"], ["u"], "SELECT CASE WHEN user_id % 3 > 0 THEN concat('[', user_id % 10, ']') ELSE '[null]' END AS key, count(*) AS n_docs FROM events GROUP BY 1")


@query("key_itself", "SELECT concat('[', r_regionkey, ']') AS key, count(*) AS n_docs FROM region GROUP BY 1")
def key_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member "." is the value that declares the key."""
    v = Validator(load(schema("doc", **prop("r_regionkey", index=["."]))))
    return v.bind("urn:x:doc", table(spark, sf_dir, "region"), ["r_name"]).postings("urn:x:doc").select("key", "n_docs")


@query("key_by_pattern", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, key FROM (SELECT *, concat('[\"', l_returnflag, '\"]') AS key, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n > 1")
def key_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that is declared for members by an expression."""
    v = Validator(load(schema("doc", patternProperties={"^l_return": {"unique": True}})))
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return v.bind("urn:x:doc", table(spark, sf_dir, "lineitem"), ids).duplicates("urn:x:doc").select(*ids[:4], "key")


@query("unique_holder", "SELECT p_partkey, concat('{\"p_partkey\":', f, '}') AS holder FROM (SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS f FROM part) WHERE p_partkey <> f")
def unique_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(load(schema("doc", unique=["p_name"]))).bind("urn:x:doc", table(spark, sf_dir, "part"), ["p_partkey"])
    return v.duplicates("urn:x:doc").select("p_partkey", "holder")


@query("unique_in_turn", """
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM (SELECT c_custkey, c_nationkey AS a, c_custkey // 7 AS b FROM customer)
), g AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS id, false AS ok, []::BIGINT[] AS held_a, []::BIGINT[] AS held_b
  UNION ALL
  SELECT d.i, d.c_custkey, NOT (list_contains(held_a, d.a) OR list_contains(held_b, d.b)),
         CASE WHEN list_contains(held_a, d.a) OR list_contains(held_b, d.b) THEN held_a ELSE list_append(held_a, d.a::BIGINT) END,
         CASE WHEN list_contains(held_a, d.a) OR list_contains(held_b, d.b) THEN held_b ELSE list_append(held_b, d.b::BIGINT) END
  FROM g JOIN d ON d.i = g.i + 1
)
SELECT id AS c_custkey FROM g WHERE ok""")
def unique_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys a document: a document is accepted if none of its keys is held
    by one accepted before."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), F.expr("c_custkey div 7").alias("b"))
    v = Validator(load(schema("doc", allOf=[{"unique": ["a"]}, {"primary_key": ["b"]}]))).bind("urn:x:doc", df, ["c_custkey"])
    return v.survivors("urn:x:doc").select("c_custkey")


@query("provider_error", """
SELECT '(providers)' AS doc_id, '["one"]' AS key, 'http://a/, http://b/' AS holder
UNION ALL SELECT r_name, concat('["', r_name, '"]'), 'http://a/' FROM region WHERE r_name = (SELECT min(r_name) FROM region)""")
def provider_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers that give the same key, and a document that repeats one."""
    names = table(spark, sf_dir, "region")
    lists = {"http://a/region/": "one\n" + names.agg(F.min("r_name")).first()[0], "http://b/region/": "one"}
    own = {"provider": ["http://a/", "http://b/"], "accept": "text/plain", "schema_prefix": "http://x/", "fetch": lambda address, accept: lists[address]}
    v = Validator(load({**schema("region"), "$id": "http://x/region", "primary_key": ["r_name"]}), {"primary_key": own})
    return v.bind("http://x/region", names, ["r_name"]).all_errors().select("doc_id", "key", "holder")


@query("guess_restricted", "SELECT event_id::VARCHAR AS doc_id, CASE WHEN (props ->> '$.k')::INT <= 60 THEN 'urn:x:mid' END AS schema_id FROM events")
def guess_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("event_id").alias("ord"), F.try_parse_json("props").alias("json"), F.lit(None).cast("string").alias("reason"))
    return _documents(spark, sf_dir, docs, schema("low", **prop("k", maximum=30)), schema("mid", **prop("k", maximum=60)), guess=["urn:x:mid"]).docs.select("doc_id", "schema_id")


@query("schema_closure", "SELECT * FROM (VALUES ('urn:x:shared', 'primary_key', '/definitions/who'), ('urn:x:a', 'unique', '/properties/p')) AS t(owner_uri, kind, pointer)")
def schema_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of what a schema refers to belong to the schema that holds them."""
    shared = schema("shared", definitions={"who": {"primary_key": ["name"]}})
    s = load(shared, schema("a", properties={"p": {"unique": True}, "q": {"$ref": "urn:x:shared#/definitions/who"}}))
    return s.key_table(spark).filter("root_uri = 'urn:x:a'").select("owner_uri", "kind", "pointer")


@query("schema_drawing", "SELECT * FROM (VALUES ('edges', 1), ('schemas', 2), ('PK', 1), ('FK', 1), ('/^n_/', 1)) AS t(what, n)")
def schema_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the DOT text of a graph holds."""
    from veridoc.plans.graph import dot

    a = schema("region", primary_key=["r_regionkey"], properties={"r_regionkey": {"type": "integer"}})
    b = schema("nation", **fk("region", "n_regionkey"), properties={"n_regionkey": {"type": "integer"}}, patternProperties={"^n_": {"type": "string"}})
    text = "\n".join(dot(load(a, b)))
    found = [("edges", text.count("->")), ("schemas", text.count("<TABLE")), ("PK", text.count("PK")), ("FK", text.count("FK")), ("/^n_/", text.count("/^n_/"))]
    return spark.createDataFrame(found, "what string, n int")


@query("stream_structural", "SELECT event_id, 'enum' AS keyword FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def stream_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword check as a stream over the same files, to a Parquet sink."""
    import uuid

    from veridoc.operators.keys import shared_folder
    from veridoc.streaming.validate import structural

    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events*.parquet")
    v = Validator(load(schema("doc", **prop("event_type", enum=["view", "click", "purchase"]))))
    found = structural(v, "urn:x:doc", stream, ["event_id"]).select("event_id", "keyword")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")
