"""The fixture matrix: documents and schemas inline, expected failures by name."""

from collections import Counter

import pytest

from veridoc.operators.documents import Documents
from veridoc.operators.validate import Validator
from veridoc.plans.catalog import load
from veridoc.sources.documents import inline

D7 = "http://json-schema.org/draft-07/schema#"
TEXT = {"type": "string"}
#: A museum's records: exhibits with a shelf mark and a tag, and loans of them.
BASE = "https://museum.test/"


def schema(uri, properties, required=("mark",), **more):
    return {"$schema": D7, "$id": BASE + uri, "type": "object", "additionalProperties": False, "required": ["@schema", *required], "properties": {"@schema": {"const": BASE + uri}, **properties}, **more}


def doc(name, uri, **values):
    return {"file": name, "errors": [], "json": {"@schema": BASE + uri, **values}}


def own(rule):
    return {"mark": {**TEXT, "unique": rule("mark")}, "tag": {**TEXT, "unique": rule("tag")}}


PLAIN = {"mark": TEXT, "tag": TEXT}
MARKED = schema("marked", {"mark": {**TEXT, "unique": True}})
PAIRED = schema("paired", PLAIN, unique=["mark", "tag"])
BOTH = schema("both", own(lambda _: True))
NAMED = schema("both", own(lambda n: {"name": n, "members": True}))
UNNAMED = schema("both", own(lambda _: {"members": True}))
#: The name of the third key is taken: it counts without one.
THRICE = schema("both", own(lambda n: {"name": n, "members": True}), unique={"name": "tag", "members": ["mark", "tag"]})
EXHIBIT = schema("exhibit", PLAIN, primary_key=["mark", "tag"])
SHELF = schema("shelf", {"mark": TEXT, "note": TEXT}, primary_key=["mark"])
CASE = schema("case", {**PLAIN, "lock": {"type": "object", "properties": {"maker": TEXT, "serial": TEXT}, "primary_key": {"name": "by_lock", "members": ["maker", "serial"]}}}, ("mark", "lock"), primary_key={"name": "by_mark", "members": ["mark", "tag"]})


def lending(uri, target, members, **more):
    """A schema whose documents name a document of another in ``lent``."""
    lent = {"type": "object", "properties": {"of": TEXT, "as": TEXT}, "foreign_keys": [{"schema_id": BASE + target, "members": members, **more}]}
    return schema(uri, {"lent": lent}, ["lent"])


LOAN, SHELF_LOAN, CASE_LOAN = lending("loan", "exhibit", ["of", "as"]), lending("shelf_loan", "shelf", ["of"]), lending("case_loan", "case", ["of", "as"], refers_to="by_mark")

#: In order: b repeats the tag of a, c the mark of a, d repeats no accepted
#: pair though it repeats the withdrawn b and c, e repeats a whole, f is new.
PAIRS = {"a": ("vase", "red"), "b": ("bowl", "red"), "c": ("vase", "blue"), "d": ("bowl", "blue"), "e": ("vase", "red"), "f": ("lamp", "grey")}
WANTED = {"hit": ("vase", "red"), "wrong_mark": ("v", "red"), "wrong_tag": ("vase", "r"), "nothing": ("coin", "gold"), "hit_too": ("lamp", "grey")}


def exhibits(uri, names=PAIRS, second="tag", **more):
    return [doc(n, uri, mark=PAIRS[n][0], **{second: PAIRS[n][1]}, **{k: f(n) for k, f in more.items()}) for n in names]


def loans(uri, wanted=WANTED):
    return [doc(n, uri, lent={"of": a, "as": b}) for n, (a, b) in wanted.items()]


def failures(spark, schemas, docs, config=None):
    v = Validator(load(*schemas), config)
    found = Documents(v, inline(spark, docs)).errors().collect()
    return dict(Counter((r.doc_id, r.reason) for r in found))


def failed(reason, **counts):
    return {(n, reason): k for n, k in counts.items()}


#: d has both its values from withdrawn documents, so it is accepted; e repeats
#: both of a's.
TWO_KEYS = failed("dup_unique", b=1, c=1, e=2)
GIVEN = {"primary_key": {"inline_provider": {BASE + "exhibit": [["vase", "red"], ["lamp", "grey"]], BASE + "shelf": ["vase", "lamp"]}}}
LOCKS = {"lock": lambda n: {"maker": "x" if n in "be" else n, "serial": "1"}}

CASES = {
    "all different": ([MARKED], [doc(n, "marked", mark=n) for n in "abc"], {}, None),
    "a value twice": ([MARKED], [doc(n, "marked", mark=PAIRS[n][0]) for n in PAIRS], failed("dup_unique", c=1, d=1, e=1), None),
    "a pair twice": ([PAIRED], exhibits("paired"), failed("dup_unique", e=1), None),
    "two keys": ([BOTH], exhibits("both"), TWO_KEYS, None),
    "two named keys": ([NAMED], exhibits("both"), TWO_KEYS, None),
    "two keys without names": ([UNNAMED], exhibits("both"), TWO_KEYS, None),
    "a name twice": ([THRICE], exhibits("both"), {**TWO_KEYS, ("e", "dup_unique"): 3}, None),
    "a primary key twice": ([EXHIBIT], exhibits("exhibit"), failed("dup_pk", e=1), None),
    "references that hit": ([EXHIBIT, LOAN], exhibits("exhibit", "af") + loans("loan", {k: WANTED[k] for k in ("hit", "hit_too")}), {}, None),
    "stale references": ([EXHIBIT, LOAN], exhibits("exhibit") + loans("loan"), failed("dup_pk", e=1) | failed("stale_fk", wrong_mark=1, wrong_tag=1, nothing=1), None),
    "one member": ([SHELF, SHELF_LOAN], exhibits("shelf", second="note") + loans("shelf_loan"), failed("dup_pk", c=1, d=1, e=1) | failed("stale_fk", wrong_mark=1, nothing=1), None),
    "withdrawal": (
        [SHELF, SHELF_LOAN],
        exhibits("shelf", "af", second="note") + [doc("g", "shelf", mark="coin", note=7)] + loans("shelf_loan"),
        failed("schema_error", g=1) | failed("stale_fk", wrong_mark=1, nothing=1),
        None,
    ),
    "a key by its name": ([CASE, CASE_LOAN], exhibits("case", **LOCKS) + loans("case_loan", WANTED | {"by_lock": ("x", "1")}), failed("dup_pk", e=2) | failed("stale_fk", wrong_mark=1, wrong_tag=1, nothing=1, by_lock=1), None),
    "provided pairs": ([EXHIBIT, LOAN], loans("loan"), failed("stale_fk", wrong_mark=1, wrong_tag=1, nothing=1), GIVEN),
    "provided values": ([SHELF, SHELF_LOAN], loans("shelf_loan"), failed("stale_fk", wrong_mark=1, nothing=1), GIVEN),
    "dangling": ([EXHIBIT, LOAN], loans("loan", {"hit": WANTED["hit"]}), failed("dangling_fk", hit=1), None),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    schemas, docs, expected, config = CASES[name]
    assert failures(spark, schemas, docs, config) == expected


def test_wrong_declarations():
    wrong = schema("wrong", {"mark": {**TEXT, "unique": "mark"}, "tag": {**TEXT, "unique": ["mark", None]}})
    found = load(wrong)
    assert [f.reason for f in found.entries[0].faults] == ["schema_error", "schema_error"] and not found.valid


def test_schema_faults():
    s = load(MARKED, MARKED, {"type": "object"}, {"$schema": "http://nowhere/"}, {"errors": []}, lending("a", "missing", ["of"]))
    assert [[f.reason for f in e.faults] for e in s.entries] == [[], ["dup_id"], ["no_schema"], ["schema_unknown"], ["unexpected"], ["fk_no_schema"]]
    assert load({"$schema": D7}, config={"validate-no-id": False}).entries[0].faults[0].reason == "no_id"


def test_routing(spark):
    v = Validator(load(MARKED, PAIRED))
    docs = [doc("a", "marked", mark="1"), doc("b", "nowhere"), {"file": "c", "errors": [], "json": {"mark": "x"}}, {"file": "d", "json": 1}, {"file": "e", "errors": [], "json": {"_schema": BASE + "marked"}}]
    got = {(r.doc_id, r.reason) for r in Documents(v, inline(spark, docs)).errors().collect()}
    assert got == {("b", "schema_unknown"), ("c", "no_id"), ("d", "ignored"), ("e", "schema_error")}
    free = load({"$schema": D7, "$id": "urn:a", "required": ["p"]}, {"$schema": D7, "$id": "urn:b", "required": ["q"]})
    docs = [{"file": n, "errors": [], "json": j} for n, j in (("p", {"p": 1}), ("q", {"q": 1}), ("pq", {"p": 1, "q": 1}), ("none", {}))]
    d = Documents(Validator(free), inline(spark, docs), guess=True)
    assert {r.doc_id: r.schema_id for r in d.docs.collect()} == {"p": "urn:a", "q": "urn:b", "pq": "urn:a", "none": None}
    assert sorted((r.doc_id, r.schema_id) for r in d.errors().collect()) == [("none", "urn:a"), ("none", "urn:b")]
    d = Documents(Validator(free), inline(spark, docs), guess=["urn:b"])
    assert sorted({r.doc_id for r in d.errors().collect()}) == ["none", "p"]
