"""String formats, each as one pattern for Columns and for the Python
evaluator, with date checks where a pattern cannot tell.

``register`` adds custom formats: a pattern, or a pair of a Column function
and a Python predicate.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammars of the formats, from the RFCs that the JSON Schema
# specifications cite. Both regex dialects read them alike.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
_IPV6 = (
    rf"(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
    rf"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{1,6}}|:(?:(?::{_H}){{1,7}}|:)"
    rf"|(?:{_H}:){{6}}{_IPV4}|::(?:[fF]{{4}}:)?{_IPV4}|(?:{_H}:){{1,5}}:{_IPV4})"
)
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_HOST = rf"(?=.{{1,253}}$){_LABEL}(?:\.{_LABEL})*"
_IDN_LABEL = r"[A-Za-z0-9\u0080-￿](?:[A-Za-z0-9\u0080-￿-]{0,61}[A-Za-z0-9\u0080-￿])?"
_DATE = "[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:[.][0-9]+)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
_PCHAR = "(?:[A-Za-z0-9._~!$&'()*+,;=:@-]|%[0-9A-Fa-f]{2})"
_URI_TAIL = rf"(?:[?](?:{_PCHAR}|[/?])*)?(?:#(?:{_PCHAR}|[/?])*)?"
_AUTHORITY = r"//(?:(?:[A-Za-z0-9._~!$&'()*+,;=:-]|%[0-9A-Fa-f]{2})*@)?(?:\[[0-9A-Fa-f:.v]+\]|(?:[A-Za-z0-9._~!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*)(?::[0-9]*)?"
_URI = rf"[A-Za-z][A-Za-z0-9+.-]*:(?:{_AUTHORITY}(?:/{_PCHAR}*)*|/?(?:{_PCHAR}+(?:/{_PCHAR}*)*)?){_URI_TAIL}"
_RELATIVE = rf"(?:{_AUTHORITY}(?:/{_PCHAR}*)*|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|(?:[A-Za-z0-9._~!$&'()*+,;=@-]|%[0-9A-Fa-f]{{2}})+(?:/{_PCHAR}*)*|){_URI_TAIL}"
_DURATION = r"P(?=[0-9T])(?:[0-9]+W|(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?)?)"
_POINTER = "(?:/(?:[^~/]|~[01])*)*"
_COLORS = "aqua black blue fuchsia gray green lime maroon navy olive orange purple red silver teal white yellow"

PATTERNS = {
    "date-time": rf"{_DATE}[Tt ]{_TIME}",
    "date": _DATE,
    "time": _TIME,
    "duration": _DURATION,
    "email": r"[^@\s]+@[^@\s]+",
    "idn-email": r"[^@\s]+@[^@\s]+",
    "hostname": _HOST,
    "idn-hostname": rf"{_IDN_LABEL}(?:[.。．｡]{_IDN_LABEL})*",
    "ipv4": _IPV4,
    "ip-address": _IPV4,
    "ipv6": _IPV6,
    "uri": _URI,
    "uri-reference": rf"(?:{_URI}|{_RELATIVE})",
    "iri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*",
    "iri-reference": r"[^\s<>\"{}|\\^`]*",
    "uri-template": r"(?:[^\s\"'<>\\^`{|}]|\{[+#./;?&=,!@|]?[A-Za-z0-9_.%]+(?::[1-9][0-9]{0,3}|[*])?(?:,[A-Za-z0-9_.%]+(?::[1-9][0-9]{0,3}|[*])?)*\})*",
    "json-pointer": _POINTER,
    "relative-json-pointer": rf"(?:0|[1-9][0-9]*)(?:#|{_POINTER})",
    "uuid": "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "color": rf"(?:{_COLORS.replace(' ', '|')}|#(?:[0-9A-Fa-f]{{3}}|[0-9A-Fa-f]{{6}}))",
}

#: Formats with a calendar date, which must exist.
_DATED = ("date", "date-time")

Check = tuple[Callable[[Column], Column], Callable[[str], bool]]


class Formats:
    """Known formats; unknown names hold for any string, as the specifications say."""

    def __init__(self, custom: dict[str, str | Check] | None = None):
        self.custom: dict[str, Check] = {}
        for name, rule in (custom or {}).items():
            self.register(name, rule)

    def register(self, name: str, rule: str | Check) -> None:
        if isinstance(rule, str):
            rule = (lambda c, p=rule: c.rlike(f"^(?:{p})$"), lambda s, p=rule: re.fullmatch(p, s) is not None)
        self.custom[name] = rule

    def needs_python(self, name: str) -> bool:
        """Only a regex can judge whether a string is a regex."""
        return name == "regex" and name not in self.custom

    def column(self, name: str, x: Column) -> Column:
        if name in self.custom:
            return self.custom[name][0](x)
        if name not in PATTERNS:
            return F.lit(True)
        ok = x.rlike(f"^(?:{PATTERNS[name]})\\z")
        return F.when(ok, F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd").isNotNull()).otherwise(ok) if name in _DATED else ok

    def python(self, name: str, x: str) -> bool:
        if name in self.custom:
            return self.custom[name][1](x)
        if name == "regex":
            try:
                re.compile(x)
            except re.error:
                return False
            return True
        if name not in PATTERNS:
            return True
        if re.fullmatch(PATTERNS[name], x) is None:
            return False
        if name in _DATED:
            try:
                datetime.date.fromisoformat(x[:10])
            except ValueError:
                return False
        return True
