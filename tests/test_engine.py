"""Greedy uniqueness against a sequential oracle; references; graph, report,
command line, streams, and the driver queries against their SQL."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veridoc import queries as engine
from veridoc.cli import main
from veridoc.extensions import Extension
from veridoc.functions.paths import UnsupportedPath
from veridoc.operators.documents import Documents
from veridoc.operators.validate import Validator
from veridoc.plans import graph
from veridoc.plans.catalog import load
from veridoc.sources.documents import files, inline
from veridoc.sources.providers import key_list, opened
from veridoc.streaming import validate as streaming

D7 = "http://json-schema.org/draft-07/schema#"


def sequential(docs):
    """Reasons by document, one after the other, as a person would."""
    held = [{}, {}]
    failed = {}
    for i, (a, b, ok) in docs:
        keys = [k for k in ((0, a), (1, b)) if k[1] is not None]
        hits = [k for k in keys if k[1] in held[k[0]]]
        if hits or not ok:
            failed[i] = len(hits) if ok else 0
            continue
        for d, k in keys:
            held[d][k] = i
    return failed


@pytest.mark.parametrize("seed", range(3))
def test_greedy(spark, seed):
    rng = random.Random(seed)
    docs = [(i, (rng.choice([None, *range(25)]), rng.choice([None, *range(25)]), rng.random() < 0.9)) for i in range(120)]
    s = {"$schema": D7, "$id": "urn:d", "properties": {"ok": {"const": True}}, "allOf": [{"unique": ["a"]}, {"primary_key": ["b"]}]}
    df = spark.createDataFrame([(i, a, b, ok) for i, (a, b, ok) in docs], "i int, a int, b int, ok boolean")
    v = Validator(load(s)).bind("urn:d", df, ["i"])
    want = sequential(docs)
    assert {r.i for r in v.survivors("urn:d").collect()} == {i for i, _ in docs} - set(want)
    got = {}
    for r in v.duplicates("urn:d").collect():
        got[r.i] = got.get(r.i, 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def test_chain_needs_rounds(spark):
    """Each document shares a key with the next: every second one stays."""
    df = spark.createDataFrame([(i, i, i + 1) for i in range(12)], "i int, a int, b int")
    s = {"$schema": D7, "$id": "urn:d", "properties": {"k": {"items": {"unique": True}}}}
    df = df.select("i", F.array("a", "b").alias("k"))
    v = Validator(load(s)).bind("urn:d", df, ["i"])
    assert sorted(r.i for r in v.survivors("urn:d").collect()) == [0, 2, 4, 6, 8, 10]


def test_repeat_within_a_document(spark):
    s = {"$schema": D7, "$id": "urn:d", "properties": {"k": {"items": {"unique": True}}}}
    df = spark.createDataFrame([(1, [1, 1]), (2, [1]), (3, [2])], "i int, k array<int>")
    v = Validator(load(s)).bind("urn:d", df, ["i"])
    assert [(r.i, r.reason, r.key) for r in v.duplicates("urn:d").collect()] == [(1, "dup_unique", "[1]")]


def test_scoped_reference(spark):
    own = {"primary_key": {"members": ["id"], "limit_scope": True}}
    s = {"$schema": D7, "$id": "urn:d", "properties": {"parts": {"items": own}, "links": {"items": {"foreign_keys": [{"members": ["to"]}]}}}}
    docs = [{"file": "a", "errors": [], "json": {"@schema": "urn:d", "parts": [{"id": 1}, {"id": 2}], "links": [{"to": 2}, {"to": 3}]}}, {"file": "b", "errors": [], "json": {"@schema": "urn:d", "parts": [{"id": 1}, {"id": 3}], "links": [{"to": 1}]}}]
    got = Documents(Validator(load(s)), inline(spark, docs)).errors().collect()
    assert [(r.doc_id, r.reason, r.key) for r in got] == [("a", "stale_fk", "[3]")]


def test_reference_across_schemas(spark):
    """A key in a shared definition belongs to the schema that holds it."""
    shared = {"$schema": D7, "$id": "https://x.org/shared", "definitions": {"who": {"primary_key": ["name"]}}, "type": "object"}
    one = {"$schema": D7, "$id": "https://x.org/one", "properties": {"who": {"$ref": "shared#/definitions/who"}}}
    two = {"$schema": D7, "$id": "https://x.org/two", "foreign_keys": [{"schema_id": "shared", "members": ["of"]}]}
    docs = [{"file": n, "errors": [], "json": {"@schema": f"https://x.org/{s}", **j}} for n, s, j in (("a", "one", {"who": {"name": "x"}}), ("b", "two", {"of": "x"}), ("c", "two", {"of": "y"}), ("d", "one", {"who": {"name": "x"}}))]
    got = Documents(Validator(load(shared, one, two)), inline(spark, docs)).errors().collect()
    assert sorted((r.doc_id, r.reason) for r in got) == [("c", "stale_fk"), ("d", "dup_pk")]


def test_conditional_key(spark):
    s = {"$schema": D7, "$id": "urn:d", "if": {"properties": {"kind": {"const": "x"}}}, "then": {"unique": ["id"]}}
    docs = [{"file": str(i), "errors": [], "json": {"@schema": "urn:d", "kind": k, "id": 1}} for i, k in enumerate("xyyx")]
    got = Documents(Validator(load(s)), inline(spark, docs)).errors().collect()
    assert [(r.doc_id, r.reason) for r in got] == [("3", "dup_unique")]


def test_python_tier(spark):
    tree = {"$schema": D7, "$id": "urn:t", "required": ["v"], "properties": {"n": {"$ref": "#"}}}
    docs = [{"file": n, "errors": [], "json": {"@schema": "urn:t", **j}} for n, j in (("a", {"v": 1, "n": {"v": 2}}), ("b", {"v": 1, "n": {}}))]
    got = Documents(Validator(load(tree)), inline(spark, docs)).errors().collect()
    assert [(r.doc_id, r.keyword, r.path) for r in got] == [("b", "required", "/n")]


def test_extension(spark):
    even = Extension("even", lambda value, schema, v: F.coalesce(v.number() % 2 == 0, F.lit(True)), lambda value, schema, v: v % 2 == 0, second_pass=lambda v, uri: v.survivors(uri).filter("a = 4").select("i", F.lit("four").alias("reason")))
    v = Validator(load({"$schema": D7, "$id": "urn:d", "properties": {"a": {"even": True}}}), extensions=[even])
    v.bind("urn:d", spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "i int, a int"), ["i"])
    assert sorted((r.i, r.reason, r.keyword) for r in v.errors("urn:d").collect()) == [(1, "schema_error", "even"), (3, "four", "even")]
    with pytest.raises(ValueError):
        Validator(load(), extensions=[even, even])


def test_cache(spark, tmp_path):
    """Only key lists of providers are kept: documents are always read anew."""
    schemas = load({"$schema": D7, "$id": "https://x.org/p", "primary_key": ["k"]}, {"$schema": D7, "$id": "https://x.org/c", "foreign_keys": [{"schema_id": "p", "members": ["k"]}]})
    lists, asked = {"https://a.org/p/": "5\n6"}, []

    def fetch(address, accept):
        asked.append(address)
        return lists[address]

    config = {"cacheDir": str(tmp_path / "keys"), "primary_key": {"provider": "https://a.org/", "accept": "text/plain", "schema_prefix": "https://x.org/", "fetch": fetch}}

    def stale(held, **more):
        v = Validator(schemas, {**config, **more})
        v.bind("https://x.org/p", spark.createDataFrame([(x,) for x in held], "k string"), ["k"])
        v.bind("https://x.org/c", spark.createDataFrame([(x,) for x in "1256"], "k string"), ["k"])
        v.warm_up()
        return v, sorted(r.k for r in v.stale("https://x.org/c").collect())

    v, first = stale("1", **{"read-only": True})
    assert first == ["2"] and not (tmp_path / "keys").exists()
    assert stale("1")[1] == ["2"] and stale("2")[1] == ["1"] and len(asked) == 2
    v.bind("https://x.org/p", spark.createDataFrame([("2",)], "k string"), ["k"])
    assert [r.k for r in v.stale("https://x.org/c").collect()] == ["1"]
    lists["https://a.org/p/"] = "5"
    v = stale("1")[0]
    v.invalidate()
    assert stale("1")[1] == ["2", "6"]


def test_provider_files(spark, tmp_path):
    """Lists are opened by address by default; one that is not there is empty."""
    put(tmp_path / "list", "one\ntwo\n")
    assert key_list({}, opened, f"file://{tmp_path}/list", "text/plain") == ["one", "two"]
    own = {"provider": "file:///nowhere/", "accept": "text/plain", "schema_prefix": "https://x.org/"}
    assert Validator(load({"$schema": D7, "$id": "https://x.org/keys", "primary_key": ["k"]}), {"primary_key": own})._providers("https://x.org/keys") == []


def test_collision_in_a_run(spark):
    lists = {"https://a.org/p/": "one\ntwo", "https://b.org/p/": "one"}
    own = {"provider": ["https://a.org/", "https://b.org/"], "accept": "text/plain", "schema_prefix": "https://x.org/", "fetch": lambda address, accept: lists[address]}
    s = load({"$schema": D7, "$id": "https://x.org/p", "primary_key": ["k"]})
    docs = [{"file": n, "errors": [], "json": {"@schema": "https://x.org/p", "k": k}} for n, k in (("a", "two"), ("b", "three"))]
    found = Documents(Validator(s, {"primary_key": own}), inline(spark, docs)).errors().collect()
    assert sorted((r.doc_id, r.reason, r.key, r.holder) for r in found) == [("(providers)", "dup_pk", '["one"]', "https://a.org/, https://b.org/"), ("a", "dup_pk", '["two"]', "https://a.org/")]
    free = Validator(s, {"primary_key": {**own, "allow_provider_duplicates": True}})
    assert not Documents(free, inline(spark, docs)).errors().collect()


def test_holders(spark):
    """Which accepted document has the key, by one key and by several."""
    rows = [(1, 5, 5), (2, 5, 6), (3, 6, 5), (4, 6, 6), (5, 7, 7), (6, 7, 9)]
    df = spark.createDataFrame(rows, "i int, a int, b int")
    one = Validator(load({"$schema": D7, "$id": "urn:d", "unique": ["a"]})).bind("urn:d", df, ["i"])
    assert sorted((r.i, r.holder) for r in one.duplicates("urn:d").collect()) == [(2, '{"i":1}'), (4, '{"i":3}'), (6, '{"i":5}')]
    two = Validator(load({"$schema": D7, "$id": "urn:d", "allOf": [{"unique": ["a"]}, {"unique": ["b"]}]})).bind("urn:d", df, ["i"])
    assert sorted((r.i, r.key, r.holder) for r in two.duplicates("urn:d").collect()) == [(2, "[5]", '{"i":1}'), (3, "[5]", '{"i":1}'), (6, "[7]", '{"i":5}')]


def test_hot_key_is_split(spark):
    """A third of all rows on one key: the final plan splits the join."""
    df = spark.range(0, 600_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id").cast("int") % 300_000).alias("k"))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, x in small.items():
            spark.conf.set(k, x)
        found = Validator(load({"$schema": D7, "$id": "urn:d", "unique": ["k"]})).bind("urn:d", df, ["id"]).duplicates("urn:d")
        assert found.count() == 600_000 - df.select("k").distinct().count()
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


@pytest.mark.parametrize("finish", [0, 40])
def test_rounds_and_finish(spark, monkeypatch, finish):
    from veridoc.operators import keys

    monkeypatch.setattr(keys, "FINISH", finish)
    rng = random.Random(finish)
    docs = [(i, (rng.choice([None, *range(25)]), rng.choice([None, *range(25)]), True)) for i in range(120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in docs], "i int, a int, b int")
    v = Validator(load({"$schema": D7, "$id": "urn:d", "allOf": [{"unique": ["a"]}, {"primary_key": ["b"]}]})).bind("urn:d", df, ["i"])
    assert {r.i for r in v.survivors("urn:d").collect()} == {i for i, _ in docs} - set(sequential(docs))


def test_hot_key_among_several(spark, monkeypatch):
    """Places of a hot key are not sent to the one task of that key, however
    well they compress: it is a broadcast even where joins may not choose one."""
    from veridoc.operators import keys

    monkeypatch.setattr(keys, "HOT", 50, raising=False)
    monkeypatch.setattr(keys, "FINISH", 0)
    docs = [(i, (i % 2 or None, i // 3, True)) for i in range(400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in docs], "i int, a int, b int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        v = Validator(load({"$schema": D7, "$id": "urn:d", "allOf": [{"unique": ["a"]}, {"primary_key": ["b"]}]})).bind("urn:d", df, ["i"])
        found = v.duplicates("urn:d").select("i", "key", "holder")
        got = {}
        for r in found.collect():
            got[r.i] = got.get(r.i, 0) + 1
        assert got == {i: n for i, n in sequential(docs).items() if n}
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sort_moves_no_keys(spark, monkeypatch):
    """The sort reads its input twice; keys of the columns that it moves are
    made after it, once."""
    from veridoc.operators import keys

    monkeypatch.setattr(keys, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    s = load({"$schema": D7, "$id": "urn:d", "allOf": [{"unique": ["a"]}, {"unique": ["b"]}]})
    for order, after in ((["a", "b"], True), (["a"], False)):
        plans: list[str] = []
        v = Validator(s).bind("urn:d", spark.createDataFrame([(2, 1), (1, 1)], "a int, b int"), ["a"], order)
        v.rejected("urn:d")
        sort = plans[0].rindex("rangepartitioning")
        assert ("concat(" in plans[0][sort:]) is not after


def test_postings_keep_no_table(spark):
    """Keys are counted with no group for each key of each document; rows of
    one document count once, in each place of a declaration."""
    rows = [(1, 7, ["a", "b", "a"]), (1, 7, ["b"]), (2, None, ["a"]), (None, 7, ["a"]), (None, 7, []), (3, 8, [])]
    df = spark.createDataFrame(rows, "i int, a int, k array<string>")
    s = load({"$schema": D7, "$id": "urn:d", "allOf": [{"index": ["k"]}, {"index": ["a"]}]})
    got = Validator(s).bind("urn:d", df, ["i"]).postings("urn:d")
    want = {("/allOf/0", '["a"]', 3), ("/allOf/0", '["b"]', 1), ("/allOf/1", "[7]", 2), ("/allOf/1", "[8]", 1)}
    assert {tuple(r) for r in got.select("pointer", "key", "n_docs").collect()} == want
    groups = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(groups) == 1 and "i#" not in groups[0]


KEY = {"unique": True}


@pytest.mark.parametrize(
    "body,one,two,keys",
    [
        ({"patternProperties": {"^id": KEY}}, {"id1": 1, "x": 9}, {"id2": 1, "x": 9}, ["[1]"]),
        ({"properties": {"x": {}}, "patternProperties": {"^y": {}}, "additionalProperties": KEY}, {"x": 9, "y": 9, "z": 1}, {"x": 9, "y": 9, "w": 1}, ["[1]"]),
        ({"properties": {"l": {"items": [{}], "additionalItems": KEY}}}, {"l": [9, 1, 2]}, {"l": [9, 2, 3]}, ["[2]"]),
        ({"properties": {"l": {"contains": {"type": "string", "unique": True}}}}, {"l": [9, "a"]}, {"l": ["a", 9]}, ['["a"]']),
        ({"dependencies": {"kind": {"unique": ["id"]}}}, {"kind": 1, "id": 1}, {"kind": 1, "id": 1}, ["[1]"]),
        ({"dependencies": {"kind": {"unique": ["id"]}}}, {"id": 1}, {"kind": 1, "id": 1}, []),
        ({"properties": {"m": {"additionalProperties": {"properties": {"id": KEY}}}}}, {"m": {"a": {"id": 1}, "b": {"id": 2}}}, {"m": {"c": {"id": 2}}}, ["[2]"]),
    ],
)
def test_keys_in_every_applicator(spark, body, one, two, keys):
    s = load({"$schema": D7, "$id": "urn:d", **body})
    docs = [{"file": n, "errors": [], "json": {"@schema": "urn:d", **j}} for n, j in (("1", one), ("2", two))]
    # "@schema" is one of the other members too.
    found = Documents(Validator(s), inline(spark, docs)).errors().filter("key <> '[\"urn:d\"]'").collect()
    assert [(r.doc_id, r.key) for r in found] == [("2", k) for k in keys]
    rows = [json.dumps(one), json.dumps(two)]
    if "patternProperties" in body and "properties" not in body or "dependencies" in body:
        text = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "n int, j string")
        typed = text.select("n", F.from_json("j", "id int, id1 int, id2 int, kind int").alias("r")).select("n", "r.*")
        assert sorted(r.key for r in Validator(s).bind("urn:d", typed, ["n"]).duplicates("urn:d").collect()) == keys


def test_named_files_count_once(spark, tmp_path):
    for name in ("a.json", "deep/b.json", "deep/c.txt", ".hidden.json"):
        put(tmp_path / name, {"n": name})
    given = [str(tmp_path / "deep"), str(tmp_path / "a.json"), str(tmp_path), str(tmp_path / "deep/b.json"), str(tmp_path / "deep/c.txt"), f"file://{tmp_path}/"]
    df = files(spark, *given)
    assert sorted(os.path.basename(r.file) for r in df.collect()) == ["a.json", "b.json", "c.txt"]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


SCHEMA = {"$schema": D7, "$id": "https://x.org/s", "type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "title": "Id"}}, "primary_key": ["id"], "foreign_keys": [{"members": ["up"]}]}


def test_files_report_and_command_line(spark, tmp_path, capsys):
    put(tmp_path / "schemas/s.json", SCHEMA)
    put(tmp_path / "docs/a.json", {"@schema": "https://x.org/s", "id": 1, "up": 1})
    put(tmp_path / "docs/deep/b.yaml", "'@schema': https://x.org/s\nid: 2\nup: 7\n")
    put(tmp_path / "docs/c.json", '{"@schema": "https://x.org/s", "id": 9, "id": 1}')
    put(tmp_path / "docs/d.json", "{no: [json")
    put(tmp_path / "docs/.hidden.json", "{}")
    put(tmp_path / "docs/other.txt", "{}")
    args = [str(tmp_path / "schemas"), str(tmp_path / "docs")]
    out = tmp_path / "report.json"
    assert main(["--report", str(out), "--annotation", "id", *args]) == 2
    entries = json.loads(out.read_text())
    by_name = {os.path.basename(e["file"]): [x["reason"] for x in e["errors"]] for e in entries}
    assert by_name == {"s.json": [], "a.json": [], "b.yaml": ["stale_fk"], "c.json": ["dup_pk"], "d.json": ["fatal"]}
    assert {e.get("annot") for e in entries} == {None, "1", "2"}
    assert main([*args]) == 2 and len(capsys.readouterr().out.splitlines()) == 1
    assert main(["-c", *args]) == 2 and len(capsys.readouterr().out.splitlines()) == 3
    assert main([str(tmp_path / "docs")]) == 1
    assert main([args[0], str(tmp_path / "docs/a.json")]) == 0
    put(tmp_path / "list.json", [{"@schema": "https://x.org/s", "id": 1}, {"@schema": "https://x.org/s", "id": 1}])
    rows = Documents(Validator(load(SCHEMA)), files(spark, str(tmp_path / "list.json"), iter_arrays=True)).errors().collect()
    assert [(os.path.basename(r.doc_id), r.reason) for r in rows] == [("list.json [1]", "dup_pk")]


def test_fix_and_rows(spark, tmp_path, monkeypatch):
    """The editor is opened on what is wrong, until it is right."""
    put(tmp_path / "schemas/s.json", {**SCHEMA, "foreign_keys": []} | {"foreign_keys": [{"members": ["up"]}]})
    for n, up in ((1, 1), (2, 9)):
        put(tmp_path / f"docs/{n}.json", {"@schema": "https://x.org/s", "id": n, "up": up})
    put(tmp_path / "fix.sh", '#!/bin/sh\nsed -i "s/9/1/" "$@"\n')
    monkeypatch.setenv("EDITOR", f"sh {tmp_path}/fix.sh")
    monkeypatch.delenv("VISUAL", raising=False)
    args = [str(tmp_path / "schemas"), str(tmp_path / "docs")]
    assert main(["--report", f"{tmp_path}/rows/", *args]) == 2
    assert {r.n_errors for r in spark.read.json(f"{tmp_path}/rows").collect()} == {0, 1}
    assert main(["--fix", *args]) == 0 and json.loads((tmp_path / "docs/2.json").read_text())["up"] == 1
    put(tmp_path / "docs/2.json", {"@schema": "https://x.org/s", "id": 2, "up": 8})
    assert main(["--fix", *args]) == 2


def test_wide_paths(spark):
    s = load({"$schema": D7, "$id": "urn:d"})
    docs = [{"file": "a", "errors": [], "json": {"head": {"schema": "urn:d"}, "l": [{"n": 1}, {"n": "x"}]}}, {"file": "b", "errors": [], "json": {"h": {"schema": "urn:e"}}}]
    d = Documents(Validator(s), inline(spark, docs), id_path="$.*.schema")
    got = {r.doc_id: (r.schema_id, r.annot) for r in d.report(annotation="$..n|l[*]").collect()}
    assert got == {"a": ("urn:d", "1"), "b": ("urn:e", None)}
    assert [r.reason for r in d.errors().collect()] == ["schema_unknown"]
    with pytest.raises(UnsupportedPath):
        d.report(annotation="l[?(@.n > 1)]")


def test_hooks(spark):
    seen = []
    note = lambda what: lambda v, *more: seen.append((what, *more))
    x = Extension("own", lambda value, schema, v: F.lit(True), bootstrap=lambda v: {"urn:d": ["not quite"]}, warm_up=note("warm"), invalidate=note("drop"), forget=note("forget"), cleanup=note("end"))
    s = load({"$schema": D7, "$id": "urn:d", "own": 1})
    v = Validator(s, extensions=[x]).bind("urn:d", spark.range(1), ["id"])
    v.warm_up()
    v.invalidate()
    v.close()
    assert seen == [("forget", "urn:d"), ("warm",), ("drop",), ("end",)] and [f.description for f in s.valid["urn:d"].faults] == ["not quite"]


def test_stats(spark):
    docs = [{"file": str(i), "errors": [], "json": {"@schema": "https://x.org/s", **j}} for i, j in enumerate([{"id": 1}, {"id": "x"}, {"id": 2, "up": 5}])] + [{"json": 1}]
    d = Documents(Validator(load(SCHEMA)), inline(spark, docs))
    assert {r.status: r.n for r in d.stats().collect()} == {"ok": 1, "failed": 1, "failed_references": 1, "ignored": 1}


def test_graph(spark, tmp_path):
    named = {"$schema": D7, "$id": "https://x.org/t", "properties": {"a": {"items": {"properties": {"of": {"type": ["string", "null"]}}, "foreign_keys": [{"schema_id": "s", "members": ["of"]}]}}}}
    s = load(SCHEMA, named)
    assert [tuple(r) for r in graph.edges_table(spark, s).orderBy("source").collect()] == [("https://x.org/s", "https://x.org/s", "foreign_keys", ".", "up", None), ("https://x.org/t", "https://x.org/s", "foreign_keys", "a[]", "of", None)]
    text = "\n".join(graph.dot(s))
    assert text.count("->") == 2 and "<B>id</B>" in text and "PK" in text and graph.port("a[].of") in text and "string|null" in text
    graph.write_dot(s, str(tmp_path / "g.dot"))
    assert s.inlined("https://x.org/s") == SCHEMA


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, -1, "2024-01-01 00:00:01"), (2, 5, "2024-01-01 00:00:02"), (2, 6, "2024-01-01 00:00:03"), (3, 7, "2024-01-01 00:06:00")], "k int, v int, t string").select("k", "v", F.to_timestamp("t").alias("t")).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    body = {"$schema": D7, "$id": "urn:d", "properties": {"v": {"minimum": 0}}, "primary_key": ["k"]}

    def run(df, mode="append"):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out").collect()

    v = Validator(load(body))
    assert [(r.k, r.keyword) for r in run(streaming.structural(v, "urn:d", stream(), ["k"]))] == [(1, "minimum")]
    assert sorted(r.k for r in run(streaming.accepted(v, "urn:d", stream(), ["k"], "t", "1 hour"))) == [2, 3]
    rates = run(streaming.error_rates(v, "urn:d", stream(), ["k"], "t", "5 minutes", "1 minute"), "complete")
    assert sorted((r.n_docs, r.n_failed) for r in rates) == [(1, 0), (3, 1)]
    v2 = Validator(load(body, {"$schema": D7, "$id": "urn:r", "foreign_keys": [{"schema_id": "urn:d", "members": ["k"]}]}))
    v2.bind("urn:d", spark.read.parquet(src), ["k", "v"])
    found = []
    q = stream().writeStream.foreachBatch(streaming.check_references(v2, "urn:r", ["k", "v"], lambda df, n: found.extend(df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.k, r.reason) for r in found] == [(1, "stale_fk")]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = engine.QUERIES[name](spark, SF), c.execute(engine.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
