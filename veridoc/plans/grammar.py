"""Shapes of keywords: the declarations of keys and references, and the
keywords of each draft, as far as a schema can be wrong."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

KEY_KINDS = ("index", "unique", "primary_key")
REF_KINDS = {"foreign_keys": "primary_key", "join_keys": "index"}

# Dialects by their identifier without the trailing "#".
DRAFTS = {
    "http://json-schema.org/draft-03/schema": 3,
    "http://json-schema.org/draft-04/schema": 4,
    "http://json-schema.org/draft-06/schema": 6,
    "http://json-schema.org/draft-07/schema": 7,
    "https://json-schema.org/draft/2019-09/schema": 2019,
    "https://json-schema.org/draft/2020-12/schema": 2020,
    "http://json-schema.org/draft-03/hyper-schema": 3,
    "http://json-schema.org/draft-04/hyper-schema": 4,
    "http://json-schema.org/draft-06/hyper-schema": 6,
    "http://json-schema.org/draft-07/hyper-schema": 7,
    "https://json-schema.org/draft/2019-09/hyper-schema": 2019,
    "https://json-schema.org/draft/2020-12/hyper-schema": 2020,
}
DELETE_HINTS = ("RESTRICT", "CASCADE", "DELETE")
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")


def draft_of(uri) -> int | None:
    return DRAFTS.get(uri.removesuffix("#")) if isinstance(uri, str) else None


def _names(x) -> bool:
    return isinstance(x, list) and bool(x) and all(isinstance(n, str) and n for n in x) and len(set(x)) == len(x)


def is_key_declaration(x) -> bool:
    """A boolean, member names, or an object with ``members``."""
    if isinstance(x, bool) or _names(x):
        return True
    if not isinstance(x, dict) or "members" not in x:
        return False
    if not (isinstance(x["members"], bool) or _names(x["members"])):
        return False
    name = x.get("name", "-")
    return isinstance(name, str) and bool(name) and isinstance(x.get("limit_scope", False), bool)


def is_ref_declaration(x) -> bool:
    if not isinstance(x, list) or any(a == b for i, a in enumerate(x) for b in x[:i]):
        return False
    for r in x:
        if not isinstance(r, dict) or not _names(r.get("members")):
            return False
        if any(not (isinstance(r.get(k, "-"), str) and r.get(k, "-")) for k in ("schema_id", "refers_to")):
            return False
        if r.get("on_delete_hint", "RESTRICT") not in DELETE_HINTS:
            return False
    return True


def key_members(x) -> list[str] | None:
    """Member paths of a key declaration; None is the whole value."""
    x = x["members"] if isinstance(x, dict) else x
    return None if isinstance(x, bool) else list(x)


def key_enabled(x) -> bool:
    return bool(x["members"] if isinstance(x, dict) else x)


# --- keywords ---------------------------------------------------------------


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _count(x) -> bool:
    return _number(x) and x >= 0 and x == int(x)


def _regex(x) -> bool:
    try:
        return isinstance(x, str) and re.compile(x) is not None
    except re.error:
        return False


def _strings(x) -> bool:
    return isinstance(x, list) and all(isinstance(n, str) for n in x) and len(set(x)) == len(x)


Shape = Callable[[object, int], bool]
LEAVES: dict[str, Shape] = {
    "enum": lambda x, d: isinstance(x, list) and (bool(x) or d >= 6),
    "minimum": lambda x, d: _number(x),
    "maximum": lambda x, d: _number(x),
    "exclusiveMinimum": lambda x, d: isinstance(x, bool) if d <= 4 else _number(x),
    "exclusiveMaximum": lambda x, d: isinstance(x, bool) if d <= 4 else _number(x),
    "multipleOf": lambda x, d: _number(x) and x > 0,
    "minLength": lambda x, d: _count(x),
    "maxLength": lambda x, d: _count(x),
    "pattern": lambda x, d: _regex(x),
    "format": lambda x, d: isinstance(x, str),
    "required": lambda x, d: isinstance(x, bool) if d == 3 else _strings(x) and (bool(x) or d >= 6),
    "minProperties": lambda x, d: _count(x),
    "maxProperties": lambda x, d: _count(x),
    "minItems": lambda x, d: _count(x),
    "maxItems": lambda x, d: _count(x),
    "minContains": lambda x, d: _count(x),
    "maxContains": lambda x, d: _count(x),
    "uniqueItems": lambda x, d: isinstance(x, bool),
    "dependentRequired": lambda x, d: isinstance(x, dict) and all(_strings(n) for n in x.values()),
    "$ref": lambda x, d: isinstance(x, str),
    "$id": lambda x, d: isinstance(x, str),
    "title": lambda x, d: isinstance(x, str),
    "description": lambda x, d: isinstance(x, str),
}
MAPS = ("properties", "patternProperties", "definitions", "$defs", "dependentSchemas")
LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
ONES = ("additionalProperties", "propertyNames", "additionalItems", "contains", "not", "if", "then", "else", "unevaluatedItems", "unevaluatedProperties")


def schema_faults(schema, draft: int, pointer: str = "") -> Iterator[tuple[str, str]]:
    """(pointer, message) of each keyword whose value has the wrong shape."""
    if isinstance(schema, bool) and draft >= 6:
        return
    if not isinstance(schema, dict):
        yield pointer, "a schema must be an object" + " or a boolean" * (draft >= 6)
        return
    for name, value in schema.items():
        at = f"{pointer}/{name}"
        if name in LEAVES:
            if not LEAVES[name](value, draft):
                yield at, f"{name} has the wrong shape"
        elif name == "type":
            allowed = TYPES if draft > 3 else (*TYPES, "any")
            given = value if isinstance(value, list) else [value]
            if not given or any(not (isinstance(t, str) and (t in allowed or draft == 3) or draft == 3 and isinstance(t, dict)) for t in given) or len({str(t) for t in given}) < len(given):
                yield at, "type has the wrong shape"
        elif name in KEY_KINDS:
            if not is_key_declaration(value):
                yield at, f"{name} is no key declaration"
        elif name in REF_KINDS:
            if not is_ref_declaration(value):
                yield at, f"{name} is no list of references"
        elif name in MAPS:
            if not isinstance(value, dict):
                yield at, f"{name} must be an object of schemas"
                continue
            for k, s in value.items():
                if name == "patternProperties" and not _regex(k):
                    yield f"{at}/{k}", "no regular expression"
                yield from schema_faults(s, draft, f"{at}/{k}")
        elif name in LISTS:
            if not isinstance(value, list) or not value:
                yield at, f"{name} must be a non-empty list of schemas"
                continue
            for i, s in enumerate(value):
                yield from schema_faults(s, draft, f"{at}/{i}")
        elif name == "items" and isinstance(value, list) and draft < 2020:
            for i, s in enumerate(value):
                yield from schema_faults(s, draft, f"{at}/{i}")
        elif name == "items" or name in ONES:
            if not (isinstance(value, bool) and name.startswith("additional")):
                yield from schema_faults(value, draft, at)
        elif name == "dependencies" and isinstance(value, dict):
            for k, need in value.items():
                if not (_strings(need) or draft == 3 and isinstance(need, str)):
                    yield from schema_faults(need, draft, f"{at}/{k}")
