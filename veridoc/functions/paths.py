"""Member paths of key declarations, key encoding, and document JSONPaths.

A member path is a chain of steps ``a``, ``a[]`` or ``a[n]`` joined by dots;
"." or "" is the value itself. A list on the way is flattened by one level; a
missing member gives no value. A key is the cartesian product of its members'
values, each tuple as compact JSON array text, so 1 and 1.0 are equal, 1 and
"1" are not, and null equals null. Keys longer than ``LONG`` characters are
known by their SHA-256, so that no shuffle moves whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions.keywords import java_regex
from veridoc.functions.values import Missing, Row, TypedValue, Value, VariantValue

LONG = 128

_STEP = re.compile(r"^(?P<name>.*?)(?:\[(?P<at>[0-9]*)\])?$", re.S)


@dataclass(frozen=True)
class Step:
    name: str
    at: int | None = None


def parse_member(path: str) -> list[Step]:
    if path in ("", "."):
        return []
    out = []
    for part in path.split("."):
        m = _STEP.match(part)
        out.append(Step(m["name"], int(m["at"]) if m["at"] else None))
    return out


class Values:
    """Zero or more values of each row: either one (a ``Value``) or an array
    of elements that ``of`` turns into values."""

    def __init__(self, one: Value | None = None, many: Column | None = None, of=None):
        self.one, self.many, self.of = one, many, of

    def flat(self) -> Values:
        """Lists flattened by one level."""
        if self.many is None:
            items = self.one.items()
            if items is None:
                return self
            if isinstance(self.one, TypedValue):
                return Values(many=F.coalesce(items, F.array().cast(self.one.type)), of=self.one.of_item)
            alone = F.when(self.one.exists, F.array(self.one.col)).otherwise(F.array().cast("array<variant>"))
            return Values(many=F.coalesce(items, alone), of=VariantValue)
        sample = self.of(F.lit(None))
        if isinstance(sample, TypedValue) and isinstance(sample.type, T.ArrayType):
            return Values(many=F.flatten(F.filter(self.many, lambda x: x.isNotNull())), of=sample.of_item)
        if isinstance(sample, VariantValue):
            spread = F.transform(self.many, lambda x: F.coalesce(VariantValue(x).items(), F.array(x)))
            return Values(many=F.flatten(spread), of=VariantValue)
        return self

    def member(self, name: str) -> Values:
        """A member of each value, lists as they are."""
        if self.many is None:
            return Values(one=self.one.get(name))
        sample = self.of(F.lit(None)).get(name)
        if isinstance(sample, Missing):
            return Values(one=Missing())
        inner = F.filter(F.transform(self.many, lambda x: self.of(x).get(name).col), lambda y: y.isNotNull())
        return Values(many=inner, of=VariantValue if isinstance(sample, VariantValue) else (lambda c, t=sample.type: TypedValue(c, t)))

    def items(self) -> Values:
        """The elements of each value that is a list."""
        if self.many is None:
            items = self.one.items()
            return Values(one=Missing()) if items is None else Values(many=F.coalesce(items, F.slice(items, 1, 0)), of=self.one.of_item)
        sample = self.of(F.lit(None))
        if sample.items() is None:
            return Values(one=Missing())
        return Values(many=F.flatten(F.filter(F.transform(self.many, lambda x: self.of(x).items()), lambda y: y.isNotNull())), of=sample.of_item)

    def named(self, fits: Callable[[Column], Column]) -> Values:
        """The members of each value whose names fit."""
        if self.many is None:
            inside = self.one.members()
            if inside is not None:
                return Values(many=F.map_values(F.map_filter(inside, lambda k, _: fits(k))), of=self.one.of_member)
            names = static_names(self.one)
            if not names:
                return Values(one=Missing())
            each = [F.when(fits(F.lit(n)), as_variant(self.one.get(n))) for n in names]
            return Values(many=F.array_compact(F.array(*each)), of=VariantValue)
        sample = self.of(F.lit(None))
        if sample.members() is None:
            if not static_names(sample):
                return Values(one=Missing())
            inner = F.transform(self.many, lambda x: F.array_compact(F.array(*[F.when(fits(F.lit(n)), as_variant(self.of(x).get(n))) for n in static_names(sample)])))
            return Values(many=F.flatten(F.filter(inner, lambda y: y.isNotNull())), of=VariantValue)
        inner = F.transform(self.many, lambda x: F.map_values(F.map_filter(self.of(x).members(), lambda k, _: fits(k))))
        return Values(many=F.flatten(F.filter(inner, lambda y: y.isNotNull())), of=sample.of_member)

    def rest(self, first: int) -> Values:
        """The elements, from one on, of each value that is a list."""
        tail = lambda items: F.slice(items, first + 1, F.greatest(F.size(items), F.lit(1)))
        if self.many is None:
            items = self.one.items()
            return Values(one=Missing()) if items is None else Values(many=tail(items), of=self.one.of_item)
        sample = self.of(F.lit(None))
        if sample.items() is None:
            return Values(one=Missing())
        return Values(many=F.flatten(F.filter(F.transform(self.many, lambda x: tail(self.of(x).items())), lambda y: y.isNotNull())), of=sample.of_item)

    def step(self, step: Step) -> Values:
        if self.many is None:
            got = self.one.get(step.name)
            if step.at is not None:
                return Values(one=got.item(step.at)).flat()
            return Values(one=got).flat()
        sample = self.of(F.lit(None)).get(step.name)
        if isinstance(sample, Missing):
            return Values(one=Missing())
        inner = F.filter(F.transform(self.many, lambda x: self.of(x).get(step.name).col), lambda y: y.isNotNull())
        of = VariantValue if isinstance(sample, VariantValue) else (lambda c, t=sample.type: TypedValue(c, t))
        got = Values(many=inner, of=of)
        if step.at is not None:
            picked = F.filter(F.transform(self.many, lambda x: _col(self.of(x).get(step.name).item(step.at))), lambda y: y.isNotNull())
            one = sample.item(step.at)
            return Values(many=picked, of=VariantValue if isinstance(one, VariantValue) else (lambda c, t=one.type: TypedValue(c, t)))
        return got.flat()

    def texts(self) -> Column:
        """Canonical texts as array<string>."""
        if self.many is None:
            if isinstance(self.one, Missing):
                return F.array().cast("array<string>")
            return F.when(self.one.exists, F.array(key_text(self.one))).otherwise(F.array().cast("array<string>"))
        return F.coalesce(F.transform(self.many, lambda x: key_text(self.of(x))), F.array().cast("array<string>"))

    def single(self) -> Column | None:
        """The one text, null where missing, if there is never more than one."""
        if self.many is not None:
            return None
        return F.lit(None).cast("string") if isinstance(self.one, Missing) else key_text(self.one)


def static_names(v: Value) -> list[str]:
    """Names of the members of a value whose type tells them."""
    kind = v.schema if isinstance(v, Row) else getattr(v, "type", None)
    return list(kind.names) if isinstance(kind, T.StructType) else []


def as_variant(v: Value) -> Column:
    """A member as VARIANT, null where it is missing."""
    if isinstance(v, VariantValue):
        return v.col
    if isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(v.col.isNotNull(), F.to_variant_object(v.col))
    return v.col.cast("variant")


def key_text(v: Value) -> Column:
    """Canonical text of a member of a key; of a long string its digest."""
    if isinstance(v, VariantValue) or isinstance(v, TypedValue) and isinstance(v.type, T.StringType):
        s = v.string()
        return F.when(F.length(s) > LONG, F.concat(F.lit('"sha256:'), F.sha2(s, 256), F.lit('"'))).otherwise(v.canonical())
    return v.canonical()


def _col(v: Value) -> Column:
    return F.lit(None) if isinstance(v, Missing) else v.col


def member_values(v: Value, path: str) -> Values:
    got = Values(one=v).flat() if not isinstance(v, Row) else Values(one=v)
    if not parse_member(path):
        return got
    got = Values(one=v)
    for step in parse_member(path):
        got = got.step(step)
    return got


def short_key(text: Column) -> Column:
    return F.when(F.length(text) > LONG, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def single_key(v: Value, members: list[str] | None) -> Column | None:
    """The one key of a value, null where there is none; None if a value may
    have several. A null member makes the text null: no key."""
    if members is None:
        text = F.when(v.exists, F.concat(F.lit("["), key_text(v), F.lit("]")))
        return text if _bounded(v) else short_key(text)
    values = [member_values(v, m) for m in members]
    singles = [x.single() for x in values]
    if any(s is None for s in singles):
        return None
    text = F.concat(F.lit("["), *_joined(singles), F.lit("]"))
    return text if len(values) <= 3 and all(_bounded(x.one) for x in values) else short_key(text)


def _bounded(v: Value) -> bool:
    """Whether the text of a value is short by its type."""
    return isinstance(v, TypedValue) and isinstance(v.type, (T.NumericType, T.BooleanType, T.DateType))


def key_texts(v: Value, members: list[str] | None) -> Column:
    """All keys of a value as array<string>."""
    one = single_key(v, members)
    if one is not None:
        return F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    values = [member_values(v, m) for m in members]
    tuples = values[0].texts()
    for more in values[1:]:
        tuples = F.flatten(F.transform(tuples, _with_each(more)))
    return F.transform(tuples, lambda t: short_key(F.concat(F.lit("["), t, F.lit("]"))))


def _with_each(more: Values):
    return lambda a: F.transform(more.texts(), lambda b: F.concat(a, F.lit(","), b))


def _joined(parts: list[Column]) -> list[Column]:
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(","), p]
    return out


# --- JSONPath of documents: children, indexes, brackets and unions ----------

_UNION = re.compile(r"\s*\|\s*")
_TOKEN = re.compile(r"""\s*(?:\.?\s*(?:"([^"]*)"|'([^']*)'|\[\s*(?:"([^"]*)"|'([^']*)'|([0-9]+))\s*\]|(\$)|([^\s.\[\]"'|()*]+)))""")

DEFAULT_ID_PATH = '"@schema"|"_schema"|"$schema"'


class UnsupportedPath(ValueError):
    """A path that Columns cannot follow; ``found_texts`` may."""


_WIDE = re.compile(r"""\s*(?:(\.\.)|\.?\s*(?:(\*)|\[\s*(\*)\s*\]|\[\s*([0-9]+)\s*\]|\[?\s*(?:"([^"]*)"|'([^']*)')\s*\]?|(\$)|([^\s.\[\]"'|()*?]+)))""")
#: Steps that a worker knows again.
_ANY, _BELOW = None, ...


def _wide_steps(path: str) -> list[list]:
    out = []
    for part in _UNION.split(path.strip()):
        steps: list = []
        at = 0
        while at < len(part.rstrip()):
            m = _WIDE.match(part, at)
            if not m or m.end() == at:
                raise UnsupportedPath(path)
            if m[1]:
                steps.append(_BELOW)
            elif m[2] or m[3]:
                steps.append(_ANY)
            elif m[4] is not None:
                steps.append(int(m[4]))
            elif m[7] is None:
                steps.append(next(g for g in (m[5], m[6], m[8]) if g is not None))
            at = m.end()
        out.append(steps)
    return out


def _follow(value, steps: list) -> Iterator:
    if not steps:
        yield value
        return
    step, rest = steps[0], steps[1:]
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    if step is _BELOW:
        yield from _follow(value, rest)
        for x in inner:
            yield from _follow(x, steps)
    elif step is _ANY:
        for x in inner:
            yield from _follow(x, rest)
    elif isinstance(step, int):
        if isinstance(value, list) and step < len(value):
            yield from _follow(value[step], rest)
    elif isinstance(value, dict) and step in value:
        yield from _follow(value[step], rest)


def found_texts(document: Column, path: str) -> Column:
    """JSON text of the first value, in document order, of the first
    alternative that has one: for paths with wildcards and descendants, in
    Python. Filters raise ``UnsupportedPath``."""
    wanted = _wide_steps(path)

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            value = json.loads(text)
            for steps in wanted:
                for x in _follow(value, steps):
                    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)
            return None

        return texts.map(one)

    return first(F.to_json(document))


def parse_jsonpath(path: str) -> list[list[str | int]]:
    """Alternatives of a JSONPath, each as steps."""
    out = []
    for part in _UNION.split(path.replace("(", " ").replace(")", " ").strip()):
        steps: list[str | int] = []
        at = 0
        while at < len(part):
            m = _TOKEN.match(part, at)
            if not m or m.end() == at:
                raise UnsupportedPath(path)
            if m[5] is not None:
                steps.append(int(m[5]))
            elif m[6] is None:
                steps.append(next(g for g in (m[1], m[2], m[3], m[4], m[7]) if g is not None))
            at = m.end()
            while at < len(part) and part[at].isspace():
                at += 1
        out.append(steps)
    return out


def jsonpath(v: Value, path: str) -> list[Value]:
    """One value for each alternative, the first to exist wins."""
    out = []
    for steps in parse_jsonpath(path):
        got = v
        for s in steps:
            got = got.item(s) if isinstance(s, int) else got.get(s)
        out.append(got)
    return out


def rooted(path: str, root_tag: str | None) -> str:
    """The path first below a root tag, then as it is."""
    if not root_tag:
        return path
    parts = _UNION.split(path)
    return "|".join([f'"{root_tag}".{p}' for p in parts] + parts)


def _outside(names: tuple[str, ...], patterns: tuple[str, ...]) -> Callable[[Column], Column]:
    def fits(n: Column) -> Column:
        out = ~n.isin(*names) if names else F.lit(True)
        for p in patterns:
            out = out & ~n.rlike(java_regex(p))
        return out

    return fits


def located(root: Value, location: tuple[tuple[str, object], ...]) -> Values:
    """The values at a place of a schema."""
    got = Values(one=root)
    for kind, what in location:
        if kind == "member":
            got = got.member(what)
        elif kind == "items":
            got = got.items()
        elif kind == "rest":
            got = got.rest(what)
        elif kind == "pattern":
            got = got.named(lambda n, p=what: n.rlike(java_regex(p)))
        elif kind == "others":
            got = got.named(_outside(*what))
        else:
            got = Values(one=got.one.item(what)) if got.many is None else got.items()
    return got
