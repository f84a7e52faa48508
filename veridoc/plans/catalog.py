"""Schema sets: loading, identifiers, checks, keys and references.

All of it runs on the driver, as schemas are few; the result is an immutable
description from which Columns are compiled.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession

from veridoc.functions.values import literal_text
from veridoc.plans.grammar import KEY_KINDS, REF_KINDS, draft_of, is_key_declaration, is_ref_declaration, key_enabled, key_members, schema_faults


@dataclass(frozen=True)
class Fault:
    reason: str
    description: str
    path: str = ""


#: A step of where a declaration is in a document: ("member", name),
#: ("item", n), ("items", None), ("rest", n) for items from n on, ("pattern",
#: expression) for members of such names, or ("others", (names, expressions))
#: for all other members.
Location = tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Guard:
    """A subschema that must hold, or must not, at a location."""

    location: Location
    schema: object
    base: str
    holds: bool = True


@dataclass(frozen=True)
class KeyDef:
    root: str
    owner: str
    kind: str
    pointer: str
    name: str | None
    members: tuple[str, ...] | None
    scoped: bool
    location: Location = ()
    guards: tuple[Guard, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.owner}#{self.pointer}"


@dataclass(frozen=True)
class RefDef:
    root: str
    owner: str
    kind: str
    pointer: str
    target: str
    members: tuple[str, ...]
    refers_to: str | None
    hint: str
    location: Location = ()
    guards: tuple[Guard, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.owner}#{self.pointer}"

    @property
    def target_kind(self) -> str:
        return REF_KINDS[self.kind]

    @property
    def reasons(self) -> tuple[str, str]:
        return ("stale_fk", "dangling_fk") if self.kind == "foreign_keys" else ("stale_jk", "dangling_jk")


@dataclass
class Schema:
    file: str
    body: dict
    uri: str | None = None
    draft: int | None = None
    faults: list[Fault] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    keys: list[KeyDef] = field(default_factory=list)
    refs: list[RefDef] = field(default_factory=list)

    @property
    def hash(self) -> str:
        """SHA-1 of the JSON text with sorted members."""
        return hashlib.sha1(json.dumps(self.body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def schema_files(path: str) -> Iterator[str]:
    """A file as given; in folders, at any depth, names with ".json" or
    ".yaml" in them, but not those that begin with a dot."""
    if not os.path.isdir(path):
        yield path
        return
    for name in sorted(os.listdir(path)):
        inner = os.path.join(path, name)
        if name.startswith("."):
            continue
        if os.path.isdir(inner) or ".json" in name or ".yaml" in name:
            yield from schema_files(inner)


def parse_text(text: str):
    """JSON, else YAML."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


class SchemaSet:
    """Schemas by identifier. ``config`` keys: ``validate-no-id`` (default
    true: schemas without an identifier get a random one)."""

    def __init__(self, config: dict | None = None):
        self.config = config or {}
        self.entries: list[Schema] = []
        self.valid: dict[str, Schema] = {}
        self._claimed: set[str] = set()

    # --- loading -----------------------------------------------------------

    def load(self, *sources: str | dict) -> SchemaSet:
        """Adds files, folders, schemas as dicts, or inline entries
        {"schema": ..., "errors": [...]}."""
        new: list[Schema] = []
        for n, source in enumerate(sources):
            if isinstance(source, dict):
                new.append(self._inline(source, len(self.entries) + n))
                continue
            for file in schema_files(source):
                entry = Schema(file, {})
                try:
                    with open(file, encoding="utf-8") as f:
                        entry.body = parse_text(f.read())
                    if not isinstance(entry.body, dict):
                        raise ValueError("not an object")
                except Exception as e:  # noqa: BLE001 - any unreadable file is reported
                    entry.body = {}
                    entry.faults.append(Fault("fatal", f"unable to read {file}: {e}"))
                new.append(entry)
        for entry in new:
            self._identify(entry)
        self.entries += new
        for entry in new:
            if not entry.faults:
                self.valid[entry.uri] = entry
        for entry in self.valid.values():
            entry.keys, entry.refs = [], []
            self._declare(entry)
        return self

    def _inline(self, source: dict, n: int) -> Schema:
        if "schema" in source and "errors" in source:
            return Schema(source.get("file", f"(inline schema {n})"), source["schema"])
        if "errors" in source:
            return Schema(f"(inline schema {n})", {}, faults=[Fault("unexpected", "an inline entry needs a schema")])
        return Schema(f"(inline schema {n})", source)

    def _identify(self, entry: Schema) -> None:
        if entry.faults:
            return
        body = entry.body
        if "$schema" not in body:
            entry.faults.append(Fault("no_schema", "there is no $schema", "/"))
            return
        entry.draft = draft_of(body["$schema"])
        if entry.draft is None:
            entry.faults.append(Fault("schema_unknown", f"unknown dialect {body['$schema']!r}", "/$schema"))
            return
        uri = body.get("$id", body.get("id"))
        if uri is None and self.config.get("validate-no-id", True):
            uri = f"urn:uuid:{uuid.uuid4()}"
        if not isinstance(uri, str):
            entry.faults.append(Fault("no_id", "there is no identifier", "/$id"))
            return
        entry.uri = uri
        if uri in self._claimed:
            entry.faults.append(Fault("dup_id", f"{uri} is there already", "/$id"))
            return
        self._claimed.add(uri)
        entry.faults += [Fault("schema_error", message, pointer) for pointer, message in schema_faults(body, entry.draft)]

    # --- references between schemas ------------------------------------------

    def resolve(self, ref: str, base: str) -> tuple[object, str]:
        """(schema, base URI) of a reference seen from ``base``."""
        whole = ref if not base else (urljoin(base, ref) if urlsplit(base).scheme not in ("", "urn") else (base + ref if ref.startswith("#") else ref))
        uri, fragment = urldefrag(whole)
        for candidate in (uri, uri + "#", base if ref.startswith("#") else uri):
            if candidate in self.valid:
                return self._at(self.valid[candidate].body, fragment, candidate)
        for entry in self.valid.values():
            found = _embedded(entry.body, uri, entry.uri)
            if found is not None:
                return self._at(found, fragment, uri)
        if draft_of(uri) is not None:
            return True, uri  # a meta-schema: shapes are checked elsewhere
        raise KeyError(f"unresolved reference {ref} in {base}")

    @staticmethod
    def _at(schema, fragment: str, base: str) -> tuple[object, str]:
        if not fragment or fragment == "/":
            return schema, base
        if not fragment.startswith("/"):
            found = _anchored(schema, fragment)
            if found is None:
                raise KeyError(f"no anchor {fragment} in {base}")
            return found, base
        for part in fragment[1:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~").replace("%25", "%").replace("%22", '"')
            schema = schema[int(part)] if isinstance(schema, list) else schema[part]
        return schema, base

    # --- keys and references of documents -------------------------------------

    def _declare(self, entry: Schema) -> None:
        names: set[tuple[str, str]] = set()
        for owner, pointer, schema, location, guards in self._walk(entry.body, entry.uri, "", (), (), entry.draft, frozenset()):
            for kind in KEY_KINDS:
                value = schema.get(kind)
                if value is None or not is_key_declaration(value) or not key_enabled(value):
                    continue
                name = value.get("name") if isinstance(value, dict) else None
                if name is not None and (kind, name) in names:
                    entry.warnings.append(f"the name {name} of a {kind} is used again at {pointer}")
                    name = None
                names.add((kind, name))
                members = key_members(value)
                entry.keys.append(KeyDef(entry.uri, owner, kind, pointer, name, None if members is None else tuple(members), isinstance(value, dict) and value.get("limit_scope", False), location, guards))
            for kind in REF_KINDS:
                value = schema.get(kind)
                if not is_ref_declaration(value):
                    continue
                for i, r in enumerate(value):
                    target = r.get("schema_id", owner)
                    if "schema_id" in r and urlsplit(owner).scheme in ("http", "https", "file", "ftp"):
                        target = urljoin(owner, target)
                    entry.refs.append(RefDef(entry.uri, owner, kind, f"{pointer}/{i}", target, tuple(r["members"]), r.get("refers_to"), r.get("on_delete_hint", "RESTRICT"), location, guards))
        entry.faults = [f for f in entry.faults if f.reason != "fk_no_schema"]
        entry.faults += [Fault("fk_no_schema", f"there is no schema {r.target}", r.pointer) for r in entry.refs if r.target not in self.valid]

    def _walk(self, schema, owner: str, pointer: str, location: Location, guards: tuple[Guard, ...], draft: int, seen: frozenset):
        """(owner, pointer, schema, location, guards) of every subschema that
        describes a part of a document. References are followed; their
        siblings do not count up to draft 7."""
        if not isinstance(schema, dict) or id(schema) in seen:
            return  # a recursive reference ends the walk
        seen = seen | {id(schema)}
        own = schema.get("$id") or (schema.get("id") if draft <= 4 and isinstance(schema.get("id"), str) else None)
        if pointer and isinstance(own, str) and not own.startswith("#"):
            owner = urljoin(owner, own) if urlsplit(owner).scheme not in ("", "urn") else own
        if "$ref" in schema:
            try:
                target, base = self.resolve(schema["$ref"], owner)
                at = urldefrag(schema["$ref"])[1]
                yield from self._walk(target, base, at, location, guards, draft, seen)
            except (KeyError, ValueError, IndexError):
                pass  # reported when documents are checked against it
            if draft <= 7:
                return
        yield owner, pointer, schema, location, guards
        go = lambda s, p, loc=location, g=guards: self._walk(s, owner, f"{pointer}/{p}", loc, g, draft, seen)
        for k, s in _dict(schema.get("properties")).items():
            yield from go(s, f"properties/{k}", (*location, ("member", k)))
        items = schema.get("items")
        for name, value in (("items", items), ("prefixItems", schema.get("prefixItems"))):
            for i, s in enumerate(value if isinstance(value, list) else ()):
                yield from go(s, f"{name}/{i}", (*location, ("item", i)))
        first = len(schema.get("prefixItems") or ()) if draft >= 2020 else 0
        if isinstance(items, dict):
            yield from go(items, "items", (*location, ("rest", first) if first else ("items", None)))
        if isinstance(items, list) and draft < 2020:
            yield from go(schema.get("additionalItems"), "additionalItems", (*location, ("rest", len(items))))
        patterns = _dict(schema.get("patternProperties"))
        for k, s in patterns.items():
            yield from go(s, f"patternProperties/{k}", (*location, ("pattern", k)))
        known = (tuple(_dict(schema.get("properties"))), tuple(patterns))
        yield from go(schema.get("additionalProperties"), "additionalProperties", (*location, ("others", known)))
        if draft >= 6 and isinstance(schema.get("contains"), dict):
            # Of the elements, those that are what the array has to contain.
            at = (*location, ("items", None))
            yield from go(schema["contains"], "contains", at, (*guards, Guard(at, schema["contains"], owner)))
        for s_name in ("dependentSchemas", "dependencies"):
            for k, s in _dict(schema.get(s_name)).items():
                yield from go(s, f"{s_name}/{k}", location, (*guards, Guard(location, {"required": [k]}, owner)))
        for s_name in ("allOf", "extends"):
            value = schema.get(s_name, ())
            for i, s in enumerate(value if isinstance(value, list) else [value]):
                yield from go(s, f"{s_name}/{i}")
        for s_name in ("anyOf", "oneOf"):
            for i, s in enumerate(_list(schema.get(s_name))):
                yield from go(s, f"{s_name}/{i}", location, (*guards, Guard(location, s, owner)))
        for s_name, holds in (("then", True), ("else", False)):
            if "if" in schema and s_name in schema:
                yield from go(schema[s_name], s_name, location, (*guards, Guard(location, schema["if"], owner, holds)))

    # --- tables ---------------------------------------------------------------

    def schemas_table(self, spark: SparkSession) -> DataFrame:
        """(file, schema_id, schema_hash, draft, reason, description, path):
        one row a fault, or one without a reason."""
        rows = []
        for e in self.entries:
            for f in e.faults or [Fault(None, None, None)]:
                rows.append((e.file, e.uri, e.hash, e.draft, f.reason, f.description, f.path))
        return spark.createDataFrame(rows, "file string, schema_id string, schema_hash string, draft int, reason string, description string, path string")

    def key_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k.root, k.owner, k.kind, k.pointer, k.name, None if k.members is None else list(k.members), k.members is None, k.scoped) for e in self.valid.values() for k in e.keys]
        return spark.createDataFrame(rows, "root_uri string, owner_uri string, kind string, pointer string, name string, members array<string>, whole boolean, limit_scope boolean")

    def ref_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.root, r.owner, r.kind, r.pointer, r.target, list(r.members), r.refers_to, r.hint) for e in self.valid.values() for r in e.refs]
        return spark.createDataFrame(rows, "root_uri string, owner_uri string, kind string, pointer string, target_uri string, members array<string>, refers_to string, on_delete_hint string")

    def stats(self) -> dict[str, int]:
        """How many schemas are there, usable, or have a fault of each reason."""
        out = {"loaded": len(self.entries), "valid": len(self.valid)}
        for e in self.entries:
            for reason in {f.reason for f in e.faults}:
                out[reason] = out.get(reason, 0) + 1
        return out

    def inlined(self, uri: str):
        """A schema with its references replaced by what they refer to;
        recursive ones stay."""

        def go(node, base, stack):
            if isinstance(node, list):
                return [go(x, base, stack) for x in node]
            if not isinstance(node, dict):
                return node
            ref = node.get("$ref")
            if isinstance(ref, str):
                try:
                    target, new = self.resolve(ref, base)
                except (KeyError, ValueError, IndexError):
                    return dict(node)
                if id(target) in stack:
                    return dict(node)
                return go(target, new, stack | {id(target)})
            return {k: go(v, base, stack) for k, v in node.items()}

        body = self.valid[uri].body
        return go(body, uri, frozenset({id(body)}))


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x) -> list:
    return x if isinstance(x, list) else []


def _embedded(schema, uri: str, base: str):
    """The subschema that has ``uri`` as its identifier."""
    if isinstance(schema, dict):
        own = schema.get("$id")
        if isinstance(own, str):
            base = urljoin(base, own) if urlsplit(base).scheme not in ("", "urn") else own
            if base == uri:
                return schema
        schema = list(schema.values())
    for x in schema if isinstance(schema, list) else ():
        found = _embedded(x, uri, base)
        if found is not None:
            return found
    return None


def _anchored(schema, name: str):
    if isinstance(schema, dict):
        if name in (schema.get("$anchor"), schema.get("$dynamicAnchor")) or schema.get("$id") == f"#{name}":
            return schema
        schema = list(schema.values())
    for x in schema if isinstance(schema, list) else ():
        found = _anchored(x, name)
        if found is not None:
            return found
    return None


def load(*sources: str | dict, config: dict | None = None) -> SchemaSet:
    return SchemaSet(config).load(*sources)


def document_hash(value) -> str:
    """SHA-1 of a document's canonical text."""
    return hashlib.sha1(literal_text(value).encode()).hexdigest()

