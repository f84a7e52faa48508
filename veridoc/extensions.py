"""Keywords of the caller.

An extension is a keyword with a shape (``fits``), a Column predicate and,
for schemas that are evaluated in Python, the same as a Python predicate. It
may add a second pass over the documents that the first accepts: a function
of (validator, schema URI) to a DataFrame of the identifying columns and
``reason``. Hooks take the validator: ``bootstrap`` when it is made, giving
faults of the schema set by URI; ``warm_up`` and ``invalidate`` with its own
caches; ``forget`` with a schema URI, when other documents are bound to it;
``cleanup`` when it is closed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from veridoc.functions.values import Value


@dataclass(frozen=True)
class Extension:
    keyword: str
    column: Callable[[object, dict, Value], Column]
    python: Callable[[object, dict, object], bool] | None = None
    fits: Callable[[object], bool] = lambda value: True
    second_pass: Callable[[object, str], DataFrame] | None = None
    bootstrap: Callable[[object], dict[str, list[str]]] | None = None
    warm_up: Callable[[object], None] | None = None
    invalidate: Callable[[object], None] | None = None
    forget: Callable[[object, str], None] | None = None
    cleanup: Callable[[object], None] | None = None


def keywords(extensions: list[Extension]) -> dict[str, tuple]:
    """The keyword table of a validator; no keyword can be taken twice."""
    out: dict[str, tuple] = {}
    for x in extensions:
        if x.keyword in out:
            raise ValueError(f"the keyword {x.keyword} is taken")
        out[x.keyword] = (x.column, x.python)
    return out
