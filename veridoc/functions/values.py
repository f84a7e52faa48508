"""JSON values as Columns, over VARIANT columns and over typed columns.

The keyword compiler and the key extractor only see this interface, so a
schema compiles to the same checks for parsed JSON text and for the columns
of a Parquet table. Predicates are never null. Number comparison is by value;
booleans are no numbers.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def yes() -> Column:
    return F.lit(True)


def no() -> Column:
    return F.lit(False)


def literal_text(value) -> str:
    """Canonical JSON text of a literal, as ``Value.canonical`` gives it."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float, Decimal)):
        return int(value) if value == int(value) and abs(value) < 10**18 else float(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value]


def number_text(x: Column) -> Column:
    """Numbers that are integral in value have the text of the integer."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e18))
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def string_text(x: Column) -> Column:
    """A string as JSON text; escapes cost only where there are any."""
    plain = F.concat(F.lit('"'), x, F.lit('"'))
    escaped = F.to_json(F.array(x))
    return F.when(x.rlike('["\\\\\\x00-\\x1f]'), F.substring(escaped, F.lit(2), F.length(escaped) - 2)).otherwise(plain)


class Value(ABC):
    """One JSON value of each row; ``exists`` is false where it is missing."""

    @property
    @abstractmethod
    def exists(self) -> Column: ...

    @abstractmethod
    def is_type(self, name: str) -> Column: ...

    @abstractmethod
    def get(self, name: str) -> Value: ...

    @abstractmethod
    def number(self) -> Column:
        """The number, null for any other type."""

    @abstractmethod
    def string(self) -> Column:
        """The string, null for any other type."""

    @abstractmethod
    def items(self) -> Column | None:
        """The array's elements, null for any other type; None if it cannot be one."""

    @abstractmethod
    def of_item(self, element: Column) -> Value: ...

    @abstractmethod
    def names(self) -> Column:
        """Names of an object's members, null for any other type."""

    @abstractmethod
    def members(self) -> Column | None:
        """An object as a map of its members; None if members differ in type."""

    @abstractmethod
    def of_member(self, element: Column) -> Value: ...

    @abstractmethod
    def canonical(self) -> Column:
        """Canonical JSON text."""

    def equals(self, literal) -> Column:
        return F.coalesce(self.canonical() == literal_text(literal), no())

    def any_item(self, test: Callable[[Value], Column]) -> Column:
        items = self.items()
        return no() if items is None else F.coalesce(F.exists(items, lambda x: test(self.of_item(x))), no())

    def all_items(self, test: Callable[[Value], Column]) -> Column:
        items = self.items()
        return yes() if items is None else F.coalesce(F.forall(items, lambda x: test(self.of_item(x))), yes())

    def item(self, i: int) -> Value:
        items = self.items()
        return Missing() if items is None else self.of_item(F.get(items, F.lit(i)))

    def count(self) -> Column:
        items = self.items()
        return F.lit(None).cast("int") if items is None else F.size(items)


class Missing(Value):
    """A value that no row has."""

    @property
    def exists(self) -> Column:
        return no()

    def is_type(self, name: str) -> Column:
        return no()

    def get(self, name: str) -> Value:
        return self

    def number(self) -> Column:
        return F.lit(None).cast("double")

    def string(self) -> Column:
        return F.lit(None).cast("string")

    def items(self) -> None:
        return None

    def of_item(self, element: Column) -> Value:
        return self

    def names(self) -> Column:
        return F.lit(None).cast("array<string>")

    def members(self) -> None:
        return None

    def of_member(self, element: Column) -> Value:
        return self

    def canonical(self) -> Column:
        return F.lit(None).cast("string")


class VariantValue(Value):
    """A VARIANT column: parsed JSON."""

    def __init__(self, col: Column):
        self.col = col

    @property
    def kind(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.col), F.lit(""))

    @property
    def exists(self) -> Column:
        return self.col.isNotNull()

    def is_type(self, name: str) -> Column:
        t = self.kind
        if name == "integer":
            x = self.number()
            return F.coalesce(x == F.floor(x), no())
        if name == "number":
            return t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if name == "string":
            return t.rlike("^(STRING|DATE|TIMESTAMP|BINARY)")
        if name == "object":
            return t.startswith("OBJECT")
        if name == "array":
            return t.startswith("ARRAY")
        return {"null": t == "VOID", "boolean": t == "BOOLEAN", "any": self.exists}.get(name, no())

    def get(self, name: str) -> Value:
        if "'" not in name:
            return VariantValue(F.try_variant_get(self.col, F.lit(f"$['{name}']"), "variant"))
        if '"' not in name:
            return VariantValue(F.try_variant_get(self.col, F.lit(f'$["{name}"]'), "variant"))
        return VariantValue(F.try_element_at(self.members(), F.lit(name)))

    def number(self) -> Column:
        return F.when(self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.col, "$", "double"))

    def decimal(self) -> Column:
        return F.when(self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.col, "$", "decimal(38,12)"))

    def string(self) -> Column:
        return F.when(self.is_type("string"), F.try_variant_get(self.col, "$", "string"))

    def items(self) -> Column:
        return F.when(self.is_type("array"), F.try_variant_get(self.col, "$", "array<variant>"))

    def of_item(self, element: Column) -> Value:
        return VariantValue(element)

    def names(self) -> Column:
        return F.map_keys(self.members())

    def members(self) -> Column:
        return F.when(self.is_type("object"), F.try_variant_get(self.col, "$", "map<string,variant>"))

    def of_member(self, element: Column) -> Value:
        return VariantValue(element)

    def canonical(self) -> Column:
        x = self.number()
        return F.when(x.isNotNull(), F.when((x == F.floor(x)) & (F.abs(x) < 1e15), number_text(x)).otherwise(F.to_json(self.col))).otherwise(F.to_json(self.col))


class TypedValue(Value):
    """A column of a static type. A null is a missing member, or, as an
    element of an array or a map, JSON null."""

    def __init__(self, col: Column, kind: T.DataType, element: bool = False):
        self.col, self.type, self.element = col, kind, element

    @property
    def exists(self) -> Column:
        return yes() if self.element else self.col.isNotNull()

    def is_type(self, name: str) -> Column:
        kind, there = self.type, self.col.isNotNull()
        if name == "null":
            return self.col.isNull() if self.element else no()
        if name == "any":
            return self.exists
        if name == "integer" and isinstance(kind, T.NumericType):
            return there if isinstance(kind, T.IntegralType) else F.coalesce(self.col == F.floor(self.col), no())
        static = {
            "number": isinstance(kind, T.NumericType),
            "boolean": isinstance(kind, T.BooleanType),
            "string": isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)),
            "object": isinstance(kind, (T.StructType, T.MapType)),
            "array": isinstance(kind, T.ArrayType),
        }
        return there if static.get(name) else no()

    def get(self, name: str) -> Value:
        if isinstance(self.type, T.StructType) and name in self.type.names:
            return TypedValue(self.col[name], self.type[name].dataType)
        if isinstance(self.type, T.MapType):
            return TypedValue(F.try_element_at(self.col, F.lit(name)), self.type.valueType)
        return Missing()

    def number(self) -> Column:
        return self.col if isinstance(self.type, T.NumericType) else F.lit(None).cast("double")

    def string(self) -> Column:
        kind = self.type
        if isinstance(kind, T.StringType):
            return self.col
        return self.col.cast("string") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("string")

    def items(self) -> Column | None:
        return self.col if isinstance(self.type, T.ArrayType) else None

    def of_item(self, element: Column) -> Value:
        return TypedValue(element, self.type.elementType, True)

    def names(self) -> Column:
        if isinstance(self.type, T.MapType):
            return F.map_keys(self.col)
        if isinstance(self.type, T.StructType):
            present = [F.when(self.col[n].isNotNull(), F.lit(n)) for n in self.type.names]
            return F.when(self.col.isNotNull(), F.array_compact(F.array(*present)))
        return F.lit(None).cast("array<string>")

    def members(self) -> Column | None:
        return self.col if isinstance(self.type, T.MapType) else None

    def of_member(self, element: Column) -> Value:
        return TypedValue(element, self.type.valueType, True)

    def canonical(self) -> Column:
        kind = self.type
        if isinstance(kind, T.IntegralType):
            text = self.col.cast("string")
        elif isinstance(kind, T.NumericType):
            text = number_text(self.col)
        elif isinstance(kind, T.BooleanType):
            text = self.col.cast("string")
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            text = F.to_json(F.to_variant_object(self.col))
        else:
            text = string_text(self.col.cast("string"))
        return F.coalesce(text, F.lit("null")) if self.element else text

    def equals(self, literal) -> Column:
        kind = self.type
        if isinstance(literal, bool):
            return F.coalesce(self.col == literal, no()) if isinstance(kind, T.BooleanType) else no()
        if isinstance(literal, str):
            return F.coalesce(self.string() == literal, no())
        if isinstance(literal, (int, float)):
            return F.coalesce(self.col == literal, no()) if isinstance(kind, T.NumericType) else no()
        return super().equals(literal)


class Row(Value):
    """The columns of a table as one object; null columns are missing members."""

    @property
    def exists(self) -> Column:
        return yes()

    def __init__(self, schema: T.StructType, skip: frozenset[str] = frozenset()):
        self.schema = T.StructType([f for f in schema.fields if f.name not in skip])

    def is_type(self, name: str) -> Column:
        return yes() if name in ("object", "any") else no()

    def get(self, name: str) -> Value:
        if name not in self.schema.names:
            return Missing()
        kind = self.schema[name].dataType
        col = F.col(f"`{name}`")
        return VariantValue(col) if isinstance(kind, T.VariantType) else TypedValue(col, kind)

    def number(self) -> Column:
        return F.lit(None).cast("double")

    def string(self) -> Column:
        return F.lit(None).cast("string")

    def items(self) -> None:
        return None

    def of_item(self, element: Column) -> Value:
        return Missing()

    def names(self) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n in self.schema.names]))

    def members(self) -> None:
        return None

    def of_member(self, element: Column) -> Value:
        return Missing()

    def canonical(self) -> Column:
        cols = [F.col(f"`{n}`") for n in self.schema.names]
        return F.to_json(F.to_variant_object(F.struct(*cols)))
