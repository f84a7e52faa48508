"""Each keyword: (schema, value, valid?), by Columns over VARIANT and by the
Python evaluator, which must agree."""

import json

import pytest
from pyspark.sql import functions as F

from veridoc.functions.evaluator import Evaluator
from veridoc.functions.formats import Formats
from veridoc.functions.keywords import Compiler, NotColumnar
from veridoc.functions.paths import jsonpath, key_texts, parse_jsonpath, rooted
from veridoc.functions.values import VariantValue
from veridoc.plans.catalog import load

D = {3: "http://json-schema.org/draft-03/schema#", 4: "http://json-schema.org/draft-04/schema#", 6: "http://json-schema.org/draft-06/schema#", 7: "http://json-schema.org/draft-07/schema#", 2019: "https://json-schema.org/draft/2019-09/schema", 2020: "https://json-schema.org/draft/2020-12/schema"}

# draft, schema, valid values, invalid values
TABLE = [
    (7, {"type": "integer"}, [1, -3, 1.0], [1.5, "1", True, None, [1], {}]),
    (4, {"type": "integer"}, [1], [1.5, "1"]),
    (7, {"type": ["string", "null"]}, ["a", None], [1, False]),
    (7, {"type": "boolean"}, [True, False], [0, "true"]),
    (7, {"type": "array"}, [[], [1]], [{}, "[]"]),
    (7, {"type": "object"}, [{}, {"a": 1}], [[], None]),
    (7, {"type": "number"}, [1, 1.5, 1e30], ["1", True]),
    (3, {"type": "any"}, [1, "a", None], []),
    (7, {"enum": ["a", 1, None, {"b": [1, 2]}]}, ["a", 1, 1.0, None, {"b": [1, 2]}], ["b", 2, True, {"b": [2, 1]}]),
    (7, {"const": {"b": 1, "a": "x"}}, [{"a": "x", "b": 1}], [{"a": "x"}, 1]),
    (7, {"const": False}, [False], [0, None, True]),
    (4, {"const": 1}, [2], []),
    (7, {"minimum": 2}, [2, 3, "x"], [1, 1.99]),
    (7, {"maximum": 2}, [2, -1, None], [2.01]),
    (7, {"exclusiveMinimum": 2}, [2.5], [2]),
    (7, {"exclusiveMaximum": 2}, [1], [2]),
    (4, {"minimum": 2, "exclusiveMinimum": True}, [3], [2]),
    (4, {"maximum": 2, "exclusiveMaximum": True}, [1], [2]),
    (7, {"multipleOf": 0.01}, [1.23, 4], [1.234]),
    (7, {"multipleOf": 3}, [9, "x"], [10]),
    (3, {"divisibleBy": 2}, [4], [3]),
    (7, {"minLength": 2}, ["ab", "😀😀", 1], ["a", "😀"]),
    (7, {"maxLength": 2}, ["", "😀😀"], ["abc"]),
    (7, {"pattern": "b+"}, ["abbc", 3], ["ac"]),
    (7, {"required": ["a"]}, [{"a": None}, []], [{}, {"b": 1}]),
    (3, {"properties": {"a": {"required": True}}}, [{"a": 1}, 3], [{}]),
    (7, {"properties": {"a": {"type": "string"}}}, [{"a": "x"}, {}, {"b": 1}, 4], [{"a": 1}]),
    (7, {"properties": {"a.b": {"type": "string"}, "it's": {"type": "string"}}}, [{"a.b": "x"}], [{"a.b": 1}, {"it's": 2}]),
    (7, {"patternProperties": {"^x": {"type": "integer"}}}, [{"x1": 1, "y": "a"}, {}], [{"x1": "a"}]),
    (7, {"properties": {"a": {}}, "patternProperties": {"^x": {}}, "additionalProperties": False}, [{"a": 1, "x": 2}, []], [{"b": 1}]),
    (7, {"additionalProperties": {"type": "integer"}}, [{"a": 1}], [{"a": "x"}]),
    (7, {"propertyNames": {"maxLength": 2}}, [{"ab": 1}, 7], [{"abc": 1}]),
    (7, {"minProperties": 1}, [{"a": 1}, []], [{}]),
    (7, {"maxProperties": 1}, [{"a": 1}], [{"a": 1, "b": 2}]),
    (7, {"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, [{"a": 1, "b": 2}, {}, {"c": 1, "d": 1}], [{"a": 1}, {"c": 1}]),
    (2019, {"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 1}, 3], [{"a": 1}]),
    (2019, {"dependentSchemas": {"a": {"required": ["b"]}}}, [{"a": 1, "b": 1}], [{"a": 1}]),
    (7, {"items": {"type": "integer"}}, [[1, 2], [], "x"], [[1, "a"]]),
    (7, {"items": [{"type": "integer"}, {"type": "string"}]}, [[1, "a", None], [1], []], [["a"], [1, 2]]),
    (7, {"items": [{}], "additionalItems": {"type": "integer"}}, [["x", 1], []], [["x", "y"]]),
    (7, {"items": [{}], "additionalItems": False}, [["x"]], [["x", 1]]),
    (2020, {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[1, "a"], [1]], [["a"], [1, 2]]),
    (7, {"contains": {"const": 1}}, [[1], [2, 1], "x"], [[], [2]]),
    (2019, {"contains": {"const": 1}, "minContains": 2}, [[1, 1]], [[1], []]),
    (2019, {"contains": {"const": 1}, "maxContains": 1}, [[1, 2]], [[1, 1]]),
    (2019, {"contains": {"const": 1}, "minContains": 0}, [[], [2]], []),
    (7, {"minItems": 1}, [[1], {}], [[]]),
    (7, {"maxItems": 1}, [[1]], [[1, 2]]),
    (7, {"uniqueItems": True}, [[1, True, "1"], [{"a": 1}, {"a": 2}]], [[1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    (7, {"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]),
    (3, {"extends": {"minimum": 1}}, [2], [0]),
    (7, {"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6], [4]),
    (7, {"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [1, 5.5], [6, 1.5]),
    (7, {"not": {"type": "string"}}, [1], ["a"]),
    (3, {"disallow": ["string"]}, [1], ["a"]),
    (7, {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ["ab", 3], ["a", 1]),
    (7, {"if": {"required": ["a"]}, "then": {"required": ["b"]}}, [{}, {"a": 1, "b": 1}], [{"a": 1}]),
    (7, {"definitions": {"x": {"minimum": 3}}, "$ref": "#/definitions/x", "maximum": 1}, [4], [2]),
    (2019, {"$defs": {"x": {"minimum": 3}}, "$ref": "#/$defs/x", "maximum": 5}, [4], [2, 6]),
    (7, {"properties": {"n": {"$ref": "#"}}, "required": ["v"]}, [{"v": 1}, {"v": 1, "n": {"v": 2}}], [{}, {"v": 1, "n": {}}]),
    (6, {"properties": {"a": False}}, [{}], [{"a": 1}]),
    (2019, {"properties": {"a": {}}, "allOf": [{"properties": {"b": {}}}], "unevaluatedProperties": False}, [{"a": 1, "b": 2}], [{"c": 1}]),
    (2019, {"items": [{}], "unevaluatedItems": False}, [[1]], [[1, 2]]),
    (2019, {"$recursiveAnchor": True, "properties": {"n": {"$recursiveRef": "#"}}, "required": ["v"]}, [{"v": 1, "n": {"v": 1}}], [{"v": 1, "n": {}}]),
    (2020, {"$dynamicAnchor": "node", "properties": {"n": {"$dynamicRef": "#node"}}, "required": ["v"]}, [{"v": 1, "n": {"v": 1}}], [{"v": 1, "n": {}}]),
]

FORMATS = [
    ("date-time", ["2024-02-29T10:00:00Z", "2024-01-01T10:00:00.5+02:00", 3], ["2023-02-29T10:00:00Z", "2024-01-01", "2024-01-01T25:00:00Z"]),
    ("date", ["2024-02-29"], ["2023-02-29", "2024-1-1"]),
    ("time", ["10:00:00Z", "23:59:60+01:00"], ["24:00:00Z", "10:00:00"]),
    ("duration", ["P1Y2M", "PT5S", "P3W"], ["P", "1Y", "PT"]),
    ("email", ["a@b.c"], ["a", "@b"]),
    ("hostname", ["a.example.com"], ["-a.com", "a..b"]),
    ("idn-hostname", ["bücher.example"], ["a..b"]),
    ("ipv4", ["1.2.3.4"], ["1.2.3", "256.1.1.1", "01.2.3.4"]),
    ("ipv6", ["::1", "2001:db8::ff00:42:8329"], ["1::2::3", "12345::"]),
    ("uri", ["https://a.b/c?d#e", "urn:x:y"], ["/a", "a b", "http://a b"]),
    ("uri-reference", ["/a/b", "#x", "https://a"], ["a b", "\\a"]),
    ("uri-template", ["/a/{b}", "x{?y,z*}"], ["/{", "/{a b}"]),
    ("json-pointer", ["", "/a/b~1c"], ["a", "/~2"]),
    ("relative-json-pointer", ["0", "1/a", "2#"], ["/a", "01"]),
    ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
    ("color", ["red", "#fff", "#A0B0C0"], ["reddish", "#12"]),
    ("regex", ["a+"], ["a("]),
    ("unknown", ["anything"], []),
]


def judge(spark, draft, schema, values, formats=None):
    schemas = load({"$schema": D[draft], "id" if draft <= 4 else "$id": "urn:t", **schema})
    assert "urn:t" in schemas.valid, schemas.entries[0].faults
    body = schemas.valid["urn:t"].body
    e = Evaluator(draft, schemas.resolve, formats)
    python = [sorted(e.errors(body, v, base="urn:t")) for v in values]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    value = VariantValue(F.col("v"))
    try:
        c = Compiler(draft, schemas.resolve, formats)
        rows = df.select("i", c.ok(body, value, "urn:t").alias("ok"), c.errors(body, value, F.lit(""), "", "urn:t").alias("e")).orderBy("i").collect()
    except NotColumnar:
        return [not p for p in python]
    for r, p in zip(rows, python, strict=True):
        assert r.ok == (not r.e), r
        assert r.ok == (not p), (schema, values[r.i], r.e, p)
        assert sorted(tuple(x) for x in r.e) == p
    return [r.ok for r in rows]


@pytest.mark.parametrize("row", TABLE, ids=lambda r: f"{r[0]}-{'-'.join(k.lstrip('$') for k in r[1])}")
def test_keyword(spark, row):
    draft, schema, good, bad = row
    assert judge(spark, draft, schema, good + bad) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize("row", FORMATS, ids=lambda r: r[0])
def test_format(spark, row):
    name, good, bad = row
    assert judge(spark, 7, {"format": name}, good + bad) == [True] * len(good) + [False] * len(bad)


def test_custom_format(spark):
    f = Formats({"even": "([0-9]*[02468])"})
    assert judge(spark, 7, {"format": "even"}, ["12", "13"], f) == [True, False]


def test_key_paths(spark):
    docs = [{"a": 1, "b": "x"}, {"a": [1, 2], "b": ["x", "y"]}, {"a": {"c": [{"d": 1}, {"d": [2, 3]}]}}, {"b": 1}, {"a": None, "b": {"q": 1, "p": 2}}, {"a": 1.0, "b": 'q"'}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "t string").select(F.parse_json("t").alias("v"))
    v = VariantValue(F.col("v"))
    rows = df.select(key_texts(v, ["a", "b"]).alias("ab"), key_texts(v, ["a.c.d"]).alias("acd"), key_texts(v, ["a[1]"]).alias("a1"), key_texts(v, ["."]).alias("dot")).collect()
    assert [r.ab for r in rows] == [['[1,"x"]'], ['[1,"x"]', '[1,"y"]', '[2,"x"]', '[2,"y"]'], [], [], ['[null,{"p":2,"q":1}]'], ['[1,"q\\""]']]
    assert rows[2].acd == ["[1]", "[2]", "[3]"] and rows[1].a1 == ["[2]"] and rows[3].dot == ['[{"b":1}]']


def test_jsonpath(spark):
    assert parse_jsonpath('"@schema"|a.b[0]["c d"]') == [["@schema"], ["a", "b", 0, "c d"]]
    assert rooted("a|b", "root") == '"root".a|"root".b|a|b'
    df = spark.createDataFrame([('{"a": {"b": [{"c d": 7}]}}',)], "t string").select(F.parse_json("t").alias("v"))
    got = jsonpath(VariantValue(F.col("v")), 'x|a.b[0]["c d"]')
    assert df.select(F.coalesce(*[g.canonical() for g in got]).alias("r")).first().r == "7"
