"""Sinks of a validation: tables of rows, or one JSON array as a file."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from veridoc.plans.catalog import SchemaSet


def schema_entries(schemas: SchemaSet) -> Iterator[dict]:
    """One entry a schema: file, schema_id, schema_hash and its errors."""
    for e in schemas.entries:
        errors = [{"reason": f.reason, "description": f.description, "path": f.path} for f in e.faults]
        yield {"file": e.file, "schema_id": e.uri, "schema_hash": e.hash, "errors": errors, "warnings": e.warnings}


def write_rows(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The report as JSON lines, by all executors."""
    report.write.mode(mode).json(path)


def write_array(schemas: SchemaSet, report: DataFrame, path: str) -> int:
    """Schema entries, then document entries, as one JSON array; rows pass
    through the driver partition by partition. Returns how many documents
    have errors."""
    failed = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        first = True
        for entry in schema_entries(schemas):
            f.write(("" if first else ",") + "\n" + json.dumps(entry, sort_keys=True))
            first = False
        for row in report.toLocalIterator():
            entry = {k: v for k, v in row.asDict(recursive=True).items() if k not in ("ord", "n_errors")}
            entry["errors"] = entry.get("errors") or []
            failed += bool(entry["errors"])
            f.write(("" if first else ",") + "\n" + json.dumps(entry, sort_keys=True, default=str))
            first = False
        f.write("\n]\n")
    return failed
