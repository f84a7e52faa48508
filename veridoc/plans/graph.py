"""The graph of a schema set: tables of nodes and edges, and DOT text."""

from __future__ import annotations

import hashlib
import html
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from veridoc.plans.catalog import KeyDef, RefDef, SchemaSet

COMBINATORS = ("allOf", "anyOf", "oneOf")


def data_path(location: tuple) -> str:
    """Where in a document: members by name, or by "/expression/", or "*",
    list elements as []."""
    out = ""
    for kind, what in location:
        if kind in ("member", "pattern", "others"):
            name = {"member": what, "pattern": f"/{what}/", "others": "*"}[kind]
            out += f".{name}" if out else str(name)
        else:
            out += f"[{what}]" if kind == "item" else "[]"
    return out or "."


def joined(location: tuple, member: str) -> str:
    at = data_path(location)
    return member if at == "." else (at if member in ("", ".") else f"{at}.{member}")


def port(path: str) -> str:
    return "p" + hashlib.sha1(path.encode()).hexdigest()


def properties(schema, path: str = "", depth: int = 0) -> dict[str, dict]:
    """By document path: types, whether required, title. Subschemas that are
    combined or conditional add to what they stand in."""
    out: dict[str, dict] = {}

    def add(p: str, s, required: bool) -> None:
        row = out.setdefault(p, {"types": [], "required": False, "title": None})
        s = s if isinstance(s, dict) else {}
        types = s.get("type", [])
        for t in types if isinstance(types, list) else [types]:
            if isinstance(t, str) and t not in row["types"]:
                row["types"].append(t)
        row["required"] |= required
        row["title"] = row["title"] or s.get("title")
        for k, v in properties(s, p, depth + 1).items():
            known = out.setdefault(k, {"types": [], "required": False, "title": None})
            known["types"] += [t for t in v["types"] if t not in known["types"]]
            known["required"] |= v["required"]
            known["title"] = known["title"] or v["title"]

    if not isinstance(schema, dict) or depth > 24:
        return out
    needed = schema.get("required") if isinstance(schema.get("required"), list) else []
    for name, s in (schema.get("properties") or {}).items():
        own = isinstance(s, dict) and s.get("required") is True
        add(f"{path}.{name}" if path else name, s, own or name in needed)
    below = f"{path}." if path else ""
    for pattern, s in (schema.get("patternProperties") or {}).items():
        add(f"{below}/{pattern}/", s, False)
    if isinstance(schema.get("propertyNames"), dict) and "pattern" in schema["propertyNames"]:
        add(f"{below}/{schema['propertyNames']['pattern']}/", schema.get("additionalProperties"), False)
    items = schema.get("items")
    for s in items if isinstance(items, list) else [items] if isinstance(items, dict) else []:
        add(f"{path}[]" if path else "[]", s, False)
    parts = [s for c in COMBINATORS for s in schema.get(c) or ()] + [schema[c] for c in ("then", "else") if c in schema]
    for s in parts:
        for k, v in properties(s, path, depth + 1).items():
            row = out.setdefault(k, {"types": [], "required": False, "title": None})
            row["types"] += [t for t in v["types"] if t not in row["types"]]
            row["required"] |= v["required"]
            row["title"] = row["title"] or v["title"]
    return out


def drawable(schemas: SchemaSet) -> list[str]:
    """Schemas with something to show."""
    return [u for u in schemas.valid if any(k in schemas.inlined(u) for k in ("properties", *COMBINATORS))]


def keys_and_refs(schemas: SchemaSet) -> tuple[list[KeyDef], list[RefDef]]:
    shown = set(drawable(schemas))
    return [k for u in shown for k in schemas.valid[u].keys], [r for u in shown for r in schemas.valid[u].refs]


def edges_table(spark: SparkSession, schemas: SchemaSet) -> DataFrame:
    """(source, target, kind, path, member, refers_to): one row for each
    member of each reference."""
    rows = [(r.root, r.target, r.kind, data_path(r.location), m, r.refers_to) for _, r in sorted((str(x), x) for x in keys_and_refs(schemas)[1]) for m in r.members]
    return spark.createDataFrame(rows, "source string, target string, kind string, path string, member string, refers_to string")


def _short(uri: str, prefix: str) -> str:
    return uri.removeprefix(prefix) or uri


def common_prefix(schemas: SchemaSet) -> str:
    """What all identifiers begin with, up to a slash."""
    import os

    uris = list(schemas.valid)
    found = os.path.commonprefix(uris) if len(uris) > 1 else ""
    return found[: found.rfind("/") + 1]


def dot(schemas: SchemaSet, name: str = "schemas") -> Iterator[str]:
    """DOT text by lines: a table for each schema, an arrow for each member
    of a reference to the key member at the same place."""
    prefix = common_prefix(schemas)
    keys, refs = keys_and_refs(schemas)
    yield f"digraph {_quoted(name)} {{"
    yield "  rankdir=LR;"
    yield "  node [shape=plain, fontname=Helvetica];"
    for uri in drawable(schemas):
        yield f"  {_quoted(uri)} [label=<{_label(schemas, uri, prefix, keys, refs)}>];"
    for r in refs:
        targets = [k for k in keys if k.owner == r.target and k.kind == r.target_kind and k.members is not None and r.refers_to in (None, k.name)]
        for i, m in enumerate(r.members):
            start = f"{_quoted(r.root)}:{port(joined(r.location, m))}"
            ends = {f"{_quoted(k.root)}:{port(joined(k.location, k.members[i]))}" for k in targets if i < len(k.members)} or ({_quoted(r.target)} if r.target in schemas.valid else set())
            style = "solid" if r.kind == "foreign_keys" else "dashed"
            for end in sorted(ends):
                yield f"  {start} -> {end} [style={style}];"
    yield "}"


def _label(schemas: SchemaSet, uri: str, prefix: str, keys: list[KeyDef], refs: list[RefDef]) -> str:
    body = schemas.inlined(uri)
    marks: dict[str, list[str]] = {}
    for k in keys:
        if k.root == uri:
            for m in k.members or (".",):
                marks.setdefault(joined(k.location, m), []).append({"primary_key": "PK", "unique": "UQ", "index": "IX"}[k.kind])
    for r in refs:
        if r.root == uri:
            for m in r.members:
                marks.setdefault(joined(r.location, m), []).append("FK" if r.kind == "foreign_keys" else "JK")
    e = html.escape
    rows = [f'<TR><TD COLSPAN="3" BGCOLOR="lightgrey"><B>{e(_short(uri, prefix))}</B></TD></TR>']
    found = properties(body)
    for path in marks:
        found.setdefault(path, {"types": [], "required": False, "title": None})
    for path, p in found.items():
        shown = f"<B>{e(path)}</B>" if p["required"] else e(path)
        rows.append(f'<TR><TD ALIGN="LEFT" PORT="{port(path)}">{shown}</TD><TD>{e("|".join(p["types"]))}</TD><TD>{e(" ".join(dict.fromkeys(marks.get(path, []))))}</TD></TR>')
    return f'<TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0">{"".join(rows)}</TABLE>'


def _quoted(x: str) -> str:
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'


def write_dot(schemas: SchemaSet, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in dot(schemas))
