"""JSON Schema keywords compiled to Columns.

``Compiler.ok`` gives one boolean for a value, ``Compiler.errors`` an array
with one struct (keyword, pointer, path) for each violated keyword. Whatever a
Column cannot say (recursive references, dynamic scopes, unevaluated members)
raises ``NotColumnar``; such schemas go to the Python evaluator.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions.formats import Formats
from veridoc.functions.values import Missing, Row, TypedValue, Value, VariantValue, literal_text, no, yes

ERROR = "struct<keyword:string,pointer:string,path:string>"
#: Schemas of more keywords than this are left to the Python evaluator, as
#: such plans cost more to compile than they save.
MOST_KEYWORDS = 400

Custom = Callable[[object, dict, Value], Column]


class NotColumnar(Exception):
    """The schema needs the Python evaluator."""


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else yes()


def some(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else no()


def java_regex(pattern: str) -> str:
    """A pattern in Java's dialect, where it differs from Python's."""
    if re.search(r"\(\?P[=>]|\(\?\(", pattern):
        raise NotColumnar(f"pattern {pattern!r}")
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


class Compiler:
    """Compiles schemas of one draft. ``resolve`` maps a reference, seen from
    a base URI, to (schema, base URI); ``custom`` are keywords of the caller."""

    def __init__(self, draft: int, resolve: Callable[[str, str], tuple[object, str]], formats: Formats | None = None, custom: dict[str, Custom] | None = None, types: dict[str, Callable[[Value], Column]] | None = None):
        self.draft, self.resolve = draft, resolve
        self.formats, self.custom, self.types = formats or Formats(), custom or {}, types or {}
        self.open: list[tuple[str, str]] = []
        self.count = 0

    # --- the two results -------------------------------------------------

    def ok(self, schema, v: Value, base: str = "") -> Column:
        if isinstance(schema, bool):
            return yes() if schema else ~v.exists
        parts = [self._holds(name, value, schema, v, base) for name, value in self._keywords(schema)]
        return every([p for p in parts if p is not None])

    def errors(self, schema, v: Value, path: Column, pointer: str = "", base: str = "") -> Column:
        if isinstance(schema, bool):
            return self._when(no() if not schema else yes(), "false schema", pointer, path)
        found = []
        for name, value in self._keywords(schema):
            where = f"{pointer}/{name}"
            nested = self._nested(name, value, schema, v, path, where, base)
            if nested is None:
                holds = self._holds(name, value, schema, v, base)
                if holds is not None:
                    found.append(self._when(holds, name, where, path))
            else:
                found += nested
        return F.concat(*found) if found else F.array().cast(f"array<{ERROR}>")

    def _when(self, holds: Column, name: str, pointer: str, path: Column) -> Column:
        error = F.struct(F.lit(name).alias("keyword"), F.lit(pointer).alias("pointer"), path.alias("path"))
        return F.when(~holds, F.array(error)).otherwise(F.array().cast(f"array<{ERROR}>"))

    def _keywords(self, schema: dict):
        """Keywords that count: siblings of a reference do not up to draft 7."""
        if "$ref" in schema and self.draft <= 7:
            names = ["$ref"]
        else:
            names = [n for n in schema if n in self.custom or hasattr(self, "_kw_" + n.lstrip("$")) or n in _NESTED or n in _PYTHON_ONLY]
        self.count += len(names)
        if self.count > MOST_KEYWORDS:
            raise NotColumnar("too many keywords")
        for name in names:
            if name in _PYTHON_ONLY:
                raise NotColumnar(name)
            yield name, schema[name]

    def _holds(self, name: str, value, schema: dict, v: Value, base: str) -> Column | None:
        if name in self.custom:
            return self.custom[name](value, schema, v)
        out = getattr(self, "_kw_" + name.lstrip("$"))(value, schema, v, base)
        if out is None or self._plain(name, v):
            return out
        return F.coalesce(out, yes())

    @staticmethod
    def _plain(name: str, v: Value) -> bool:
        """Whether a check is null only where the value is missing, which the
        check of the member around it settles. Such checks stay bare, so that
        they reach the scan as filters."""
        if isinstance(v, Row):
            return name in _NEVER_NULL
        if not isinstance(v, TypedValue) or v.element:
            return False
        return isinstance(v.type, T.NumericType) and name in _NUMERIC or isinstance(v.type, T.StringType) and name in _STRING

    # --- nested errors: keywords that pass on the errors of subschemas ----

    def _nested(self, name: str, value, schema: dict, v: Value, path: Column, where: str, base: str) -> list[Column] | None:
        if name in self.custom:
            return None
        at = lambda key: F.concat(path, F.lit("/"), key)
        if name == "properties":
            out = [self._if(v.get(k).exists & v.is_type("object"), self.errors(s, v.get(k), at(F.lit(k)), f"{where}/{k}", base)) for k, s in value.items()]
            missing = [k for k, s in value.items() if self.draft == 3 and isinstance(s, dict) and s.get("required") is True]
            return out + [self._when(v.get(k).exists | ~v.is_type("object"), name, where, path) for k in missing]
        if name == "$ref":
            return self._inside(value, base, lambda s, b: [self.errors(s, v, path, where, b)])
        if name == "allOf" or name == "extends":
            return [self.errors(s, v, path, f"{where}/{i}", base) for i, s in enumerate(value if isinstance(value, list) else [value])]
        if name in ("items", "prefixItems", "additionalItems") and v.items() is not None:
            return self._item_errors(name, value, schema, v, at, where, base)
        return None

    def _if(self, condition: Column, errors: Column) -> Column:
        return F.when(condition, errors).otherwise(F.array().cast(f"array<{ERROR}>"))

    def _item_errors(self, name, value, schema, v, at, where, base) -> list[Column]:
        many = [(i, s) for i, s in enumerate(value)] if isinstance(value, list) else []
        if many or isinstance(value, list):
            return [self._if(v.count() > i, self.errors(s, v.item(i), at(F.lit(str(i))), f"{where}/{i}", base)) for i, s in many]
        first = self._first_rest(name, schema)
        if first is None:
            return []
        def one(x: Column, i: Column) -> Column:
            inner = self.errors(value, v.of_item(x), at(i.cast("string")), where, base)
            return inner if first == 0 else self._if(i >= first, inner)
        return [F.coalesce(F.flatten(F.transform(v.items(), one)), F.array().cast(f"array<{ERROR}>"))]

    def _first_rest(self, name: str, schema: dict) -> int | None:
        """From which element on ``items`` or ``additionalItems`` holds."""
        if name == "additionalItems":
            return len(schema["items"]) if isinstance(schema.get("items"), list) else None
        return len(schema.get("prefixItems", ())) if self.draft >= 2020 else 0

    def _inside(self, ref: str, base: str, fn):
        schema, new_base = self.resolve(ref, base)
        key = (new_base, str(id(schema)))
        if key in self.open:
            raise NotColumnar(f"recursive {ref}")
        self.open.append(key)
        try:
            return fn(schema, new_base)
        finally:
            self.open.pop()

    # --- any value -------------------------------------------------------

    def _type_ok(self, name, v: Value, base: str) -> Column:
        if isinstance(name, dict):
            return self.ok(name, v, base)
        if name in self.types:
            return self.types[name](v)
        if name == "integer" and self.draft <= 4 and isinstance(v, VariantValue):
            # Up to draft 4 a number with a fraction part is no integer; a
            # VARIANT keeps that apart only as a different stored type.
            return v.kind.rlike("^BIGINT|^DECIMAL\\([0-9]+,0\\)")
        return v.is_type(name)

    def _kw_type(self, value, schema, v, base):
        return some([self._type_ok(t, v, base) for t in (value if isinstance(value, list) else [value])]) | ~v.exists

    def _kw_disallow(self, value, schema, v, base):
        return ~some([self._type_ok(t, v, base) for t in (value if isinstance(value, list) else [value])]) if self.draft == 3 else None

    def _kw_enum(self, value, schema, v, base):
        if isinstance(v, TypedValue) and v.type.typeName() == "string" and all(isinstance(x, str) for x in value):
            return v.col.isin(value)
        return some([v.equals(x) for x in value]) | ~v.exists

    def _kw_const(self, value, schema, v, base):
        return (v.equals(value) | ~v.exists) if self.draft >= 6 else None

    def _kw_format(self, value, schema, v, base):
        if self.formats.needs_python(value):
            raise NotColumnar(f"format {value}")
        return self.formats.column(value, v.string())

    # --- numbers ---------------------------------------------------------

    def _kw_minimum(self, value, schema, v, base):
        return v.number() > value if self.draft <= 4 and schema.get("exclusiveMinimum") is True else v.number() >= value

    def _kw_maximum(self, value, schema, v, base):
        return v.number() < value if self.draft <= 4 and schema.get("exclusiveMaximum") is True else v.number() <= value

    def _kw_exclusiveMinimum(self, value, schema, v, base):
        return None if isinstance(value, bool) else v.number() > value

    def _kw_exclusiveMaximum(self, value, schema, v, base):
        return None if isinstance(value, bool) else v.number() < value

    def _kw_multipleOf(self, value, schema, v, base):
        x = v.number()
        if float(value).is_integer():
            return x % F.lit(int(value)) == 0
        part = x.cast("decimal(38,12)") / F.lit(str(value)).cast("decimal(38,12)")
        return part == F.floor(part)

    def _kw_divisibleBy(self, value, schema, v, base):
        return self._kw_multipleOf(value, schema, v, base) if self.draft == 3 else None

    # --- strings ---------------------------------------------------------

    def _kw_minLength(self, value, schema, v, base):
        return F.char_length(v.string()) >= value

    def _kw_maxLength(self, value, schema, v, base):
        return F.char_length(v.string()) <= value

    def _kw_pattern(self, value, schema, v, base):
        return v.string().rlike(java_regex(value))

    # --- objects ---------------------------------------------------------

    def _kw_required(self, value, schema, v, base):
        if isinstance(value, bool):
            return None  # draft 3: part of ``properties``
        return every([v.get(k).exists for k in value]) | ~v.is_type("object")

    def _kw_properties(self, value, schema, v, base):
        parts = [self.ok(s, v.get(k), base) | ~v.get(k).exists for k, s in value.items()]
        if self.draft == 3:
            parts += [v.get(k).exists for k, s in value.items() if isinstance(s, dict) and s.get("required") is True]
        return every(parts) | ~v.is_type("object")

    def _member(self, v: Value, test: Callable[[Column, Value], Column]) -> Column:
        """Whether ``test(name, value)`` holds for all members."""
        members = v.members()
        if members is not None:
            return F.forall(F.map_entries(members), lambda e: test(e["key"], v.of_member(e["value"])))
        names = self._static_names(v)
        return every([test(F.lit(n), v.get(n)) | ~v.get(n).exists for n in names])

    @staticmethod
    def _static_names(v: Value) -> list[str]:
        if isinstance(v, TypedValue):
            return list(getattr(v.type, "names", ()))
        return [] if isinstance(v, Missing) else list(getattr(getattr(v, "schema", None), "names", ()))

    def _kw_patternProperties(self, value, schema, v, base):
        return self._member(v, lambda n, x: every([~n.rlike(java_regex(p)) | self.ok(s, x, base) for p, s in value.items()]))

    def _kw_additionalProperties(self, value, schema, v, base):
        if value is True or value == {}:
            return None
        known, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
        covered = lambda n: some([n.isin(known)] * bool(known) + [n.rlike(java_regex(p)) for p in patterns])
        return self._member(v, lambda n, x: covered(n) | (no() if value is False else self.ok(value, x, base)))

    def _kw_propertyNames(self, value, schema, v, base):
        from pyspark.sql import types as T

        if self.draft < 6:
            return None
        return F.forall(v.names(), lambda n: self.ok(value, TypedValue(n, T.StringType()), base))

    def _kw_minProperties(self, value, schema, v, base):
        return F.when(v.names().isNotNull(), F.size(v.names()) >= value)

    def _kw_maxProperties(self, value, schema, v, base):
        return F.when(v.names().isNotNull(), F.size(v.names()) <= value)

    def _kw_dependencies(self, value, schema, v, base):
        out = []
        for k, need in value.items():
            if isinstance(need, str):
                need = [need]
            then = every([v.get(n).exists for n in need]) if isinstance(need, list) else self.ok(need, v, base)
            out.append(~v.get(k).exists | then)
        return (every(out) | ~v.is_type("object")) if self.draft <= 7 else None

    def _kw_dependentRequired(self, value, schema, v, base):
        return every([~v.get(k).exists | every([v.get(n).exists for n in need]) for k, need in value.items()]) | ~v.is_type("object")

    def _kw_dependentSchemas(self, value, schema, v, base):
        return every([~v.get(k).exists | self.ok(s, v, base) for k, s in value.items()]) | ~v.is_type("object")

    # --- arrays ----------------------------------------------------------

    def _kw_items(self, value, schema, v, base):
        if v.items() is None:
            return None
        if isinstance(value, list):
            return every([self.ok(s, v.item(i), base) | (F.coalesce(v.count(), F.lit(0)) <= i) for i, s in enumerate(value)])
        return self._rest(value, v, self._first_rest("items", schema), base)

    def _kw_prefixItems(self, value, schema, v, base):
        return None if self.draft < 2020 or v.items() is None else every([self.ok(s, v.item(i), base) | (F.coalesce(v.count(), F.lit(0)) <= i) for i, s in enumerate(value)])

    def _kw_additionalItems(self, value, schema, v, base):
        first = self._first_rest("additionalItems", schema)
        return None if first is None or self.draft >= 2020 or v.items() is None else self._rest(value, v, first, base)

    def _rest(self, value, v: Value, first: int, base: str) -> Column:
        items = v.items() if not first else F.slice(v.items(), first + 1, F.greatest(F.size(v.items()), F.lit(1)))
        return F.forall(items, lambda x: self.ok(value, v.of_item(x), base))

    def _matching(self, schema: dict, v: Value, base: str) -> Column:
        return F.size(F.filter(v.items(), lambda x: self.ok(schema["contains"], v.of_item(x), base)))

    def _kw_contains(self, value, schema, v, base):
        if self.draft < 6 or v.items() is None:
            return None
        if self.draft >= 2019 and schema.get("minContains") is not None:
            return None  # minContains says it
        return F.exists(v.items(), lambda x: self.ok(value, v.of_item(x), base))

    def _kw_minContains(self, value, schema, v, base):
        return self._matching(schema, v, base) >= value if self.draft >= 2019 and "contains" in schema and v.items() is not None else None

    def _kw_maxContains(self, value, schema, v, base):
        return self._matching(schema, v, base) <= value if self.draft >= 2019 and "contains" in schema and v.items() is not None else None

    def _kw_minItems(self, value, schema, v, base):
        return v.count() >= value

    def _kw_maxItems(self, value, schema, v, base):
        return v.count() <= value

    def _kw_uniqueItems(self, value, schema, v, base):
        if not value or v.items() is None:
            return None
        texts = F.transform(v.items(), lambda x: v.of_item(x).canonical())
        return F.size(F.array_distinct(texts)) == F.size(texts)

    # --- combinations ----------------------------------------------------

    def _kw_allOf(self, value, schema, v, base):
        return every([self.ok(s, v, base) for s in value])

    def _kw_extends(self, value, schema, v, base):
        return self._kw_allOf(value if isinstance(value, list) else [value], schema, v, base) if self.draft == 3 else None

    def _kw_anyOf(self, value, schema, v, base):
        return some([self.ok(s, v, base) for s in value])

    def _kw_oneOf(self, value, schema, v, base):
        return reduce(lambda a, b: a + b, [self.ok(s, v, base).cast("int") for s in value]) == 1

    def _kw_not(self, value, schema, v, base):
        return ~self.ok(value, v, base)

    def _kw_if(self, value, schema, v, base):
        if self.draft < 7 or not ("then" in schema or "else" in schema):
            return None
        return F.when(self.ok(value, v, base), self.ok(schema.get("then", True), v, base)).otherwise(self.ok(schema.get("else", True), v, base))

    def _kw_ref(self, value, schema, v, base):
        return self._inside(value, base, lambda s, b: self.ok(s, v, b))


_NESTED = frozenset({"properties", "allOf", "items", "prefixItems", "additionalItems", "$ref"})
_NUMERIC = frozenset({"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"})
_STRING = frozenset({"minLength", "maxLength", "pattern"})
#: Never null where the value itself is always there.
_NEVER_NULL = frozenset({"properties", "required", "type", "allOf"})
_PYTHON_ONLY = frozenset({"$recursiveRef", "$dynamicRef", "unevaluatedProperties", "unevaluatedItems"})

__all__ = ["ERROR", "Compiler", "NotColumnar", "literal_text"]
