"""Command line: schemas, then documents to validate against them.

Exit codes: 0 all is well, 1 no usable schema, 2 an invalid document, 3 a
schema with errors and no document to validate.
"""

from __future__ import annotations

import argparse
import hashlib
import logging
import os
import shlex
import subprocess
import sys
from urllib.parse import unquote, urlsplit

from veridoc.functions.paths import DEFAULT_ID_PATH

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("veridoc", description="Validates JSON and YAML documents against a set of JSON Schemas with keys and references.")
    p.add_argument("--log-file")
    p.add_argument("--log-format", default="%(asctime)s %(levelname)s %(message)s")
    volume = p.add_mutually_exclusive_group()
    volume.add_argument("-q", "--quiet", action="store_true")
    volume.add_argument("-v", "--verbose", action="store_true")
    volume.add_argument("-d", "--debug", action="store_true")
    p.add_argument("-C", "--config", help="YAML file: primary_key providers, cacheDir, validate-no-id")
    p.add_argument("--cache-dir")
    p.add_argument("-c", "--continue", dest="go_on", action="store_true", help="report all invalid documents, not only the first")
    p.add_argument("--schema_id_path", default=DEFAULT_ID_PATH)
    which = p.add_mutually_exclusive_group()
    which.add_argument("--guess-schema", action="store_true")
    which.add_argument("--use-schemas", nargs="+", metavar="URI")
    p.add_argument("--fix", action="store_true", help="open the files of invalid documents in $VISUAL or $EDITOR, then check again, until all are valid or none was changed")
    p.add_argument("--report", help="write a JSON array of all entries, or, to a path that ends in a slash, JSON lines by all executors")
    p.add_argument("--annotation", help="JSONPath of a value to add to each entry")
    p.add_argument("--verbose-report", action="store_true", help="entries hold their document")
    p.add_argument("--error-report", action="store_true", help="only documents with errors")
    p.add_argument("--dot-report", help="write the graph of the schemas")
    state = p.add_mutually_exclusive_group()
    state.add_argument("--invalidate", action="store_true")
    state.add_argument("--read-only", action="store_true", help="leave the cache folder as it is")
    warm = p.add_mutually_exclusive_group()
    warm.add_argument("--warm-up", action="store_true")
    warm.add_argument("--lazy-load", action="store_true", help="read key lists when they are needed, as without --warm-up")
    p.add_argument("--iter-arrays", action="store_true", help="elements of a top-level array are documents")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    p.add_argument("schemas", help="file or folder")
    p.add_argument("documents", nargs="*", help="files or folders")
    return p


def edited(paths: list[str]) -> bool:
    """Opens local files in the user's editor; whether one has changed."""
    command = shlex.split(os.environ.get("VISUAL") or os.environ.get("EDITOR") or "vi")
    files = [p for p in (unquote(urlsplit(x).path) for x in paths) if os.path.isfile(p)]
    digests = lambda: [hashlib.sha256(open(p, "rb").read()).digest() for p in files]  # noqa: E731, SIM115
    before = digests()
    return bool(files) and subprocess.call([*command, *files]) == 0 and before != digests()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    level = logging.DEBUG if a.debug else logging.INFO if a.verbose else logging.ERROR if a.quiet else logging.WARNING
    logging.basicConfig(filename=a.log_file, format=a.log_format, level=level, force=True)
    log = logging.getLogger("veridoc")
    config: dict = {}
    if a.config:
        import yaml

        with open(a.config, encoding="utf-8") as f:
            config = yaml.safe_load(f) or {}
    if a.cache_dir:
        config["cacheDir"] = a.cache_dir
    if a.read_only:
        config["read-only"] = True

    from veridoc.plans.catalog import load
    from veridoc.plans.graph import write_dot

    schemas = load(a.schemas, config=config)
    faulty = [e for e in schemas.entries if e.faults and not all(f.reason == "no_schema" for f in e.faults)]
    for e in schemas.entries:
        for fault in e.faults:
            log.warning("schema %s: %s: %s", e.file, fault.reason, fault.description)
    if a.dot_report:
        write_dot(schemas, a.dot_report)
    if not schemas.valid:
        print("no usable schema", file=sys.stderr)
        return 1
    if not a.documents:
        return 3 if faulty else 0

    from pyspark.sql import SparkSession

    from veridoc.operators.documents import Documents
    from veridoc.operators.report import write_array, write_rows
    from veridoc.operators.validate import Validator
    from veridoc.sources.documents import files

    spark = SparkSession.builder.appName("veridoc").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    validator = Validator(schemas, config)
    if a.invalidate:
        validator.invalidate()
    docs = Documents(validator, files(spark, *a.documents, iter_arrays=a.iter_arrays), a.schema_id_path, guess=a.use_schemas or a.guess_schema)
    if a.warm_up:
        validator.warm_up()
    report = docs.report(a.annotation, a.error_report, a.verbose_report)
    if a.report and a.report.endswith("/"):
        write_rows(report, a.report)
        return 0 if report.filter("n_errors > 0").isEmpty() else 2
    if a.report:
        return 2 if write_array(schemas, report, a.report) else 0
    bad = report.filter("n_errors > 0").orderBy("doc_id")
    failed, names = 0, []
    for row in (bad if a.go_on else bad.limit(1)).toLocalIterator():
        failed += 1
        names.append(row.file)
        for e in row.errors:
            print(f"{row.doc_id}: {e.reason} {e.pointer or ''} {e.path or e.key or ''}{f' held by {e.holder}' if e.holder else ''}".rstrip())
    for row in docs.stats().collect() if a.verbose or a.debug else ():
        log.info("%s: %d", row.status, row.n)
    if a.fix and names and edited(sorted(set(names))):
        return main(argv)
    return 2 if failed else 0
