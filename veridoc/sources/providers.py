"""Keys from outside the documents, as the configuration names them.

``primary_key``:
  ``inline_provider``            {schema URI: [value, or [value, ...], ...]}
  ``provider``, ``accept``, ``schema_prefix``
                                 base URLs; a key list is fetched from
                                 base + last path segment of the schema URI + "/"
  ``allow_provider_duplicates``  provided keys serve references only
  ``fetch``                      a function of (address, accept) that reads
                                 such a list; by default the address is opened

``cacheDir`` keeps fetched lists, by address; with ``read-only`` it is not
written. A list that cannot be fetched is logged and empty.
"""

from __future__ import annotations

import hashlib
import logging
import os
import shutil
import urllib.request
from collections import defaultdict
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from veridoc.functions.paths import LONG
from veridoc.functions.values import literal_text

Fetch = Callable[[str, str], str]


def key_text(value) -> str:
    """The key of one provided value, or of a tuple of them."""
    parts = value if isinstance(value, (list, tuple)) else [value]
    text = "[" + ",".join(_part(p) for p in parts) + "]"
    return text if len(text) <= LONG else "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def _part(value) -> str:
    long = isinstance(value, str) and len(value) > LONG
    return f'"sha256:{hashlib.sha256(value.encode()).hexdigest()}"' if long else literal_text(value)


def remote_address(base: str, uri: str) -> str:
    return urljoin(base, urlsplit(uri).path.rstrip("/").rsplit("/", 1)[-1] + "/")


def opened(address: str, accept: str) -> str:
    """The text at an address of any scheme that the standard library opens."""
    with urllib.request.urlopen(urllib.request.Request(address, headers={"Accept": accept})) as f:
        return f.read().decode("utf-8")


def key_list(config: dict, fetch: Fetch, address: str, accept: str) -> list[str]:
    """The lines of a fetched list, from the cache folder where it has them;
    ``lists`` of the configuration holds those of a run."""
    held = config.get("lists")
    if held is None:
        return _key_list(config, fetch, address, accept)
    if (address, accept) not in held:
        held[address, accept] = _key_list(config, fetch, address, accept)
    return held[address, accept]


def _key_list(config: dict, fetch: Fetch, address: str, accept: str) -> list[str]:
    folder = config.get("cacheDir")
    path = os.path.join(folder, "keys", hashlib.sha1(f"{accept} {address}".encode()).hexdigest()) if folder else None
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()
    try:
        lines = [x for x in fetch(address, accept).splitlines() if x]
    except (OSError, ValueError) as e:
        logging.getLogger("veridoc").error("no keys from %s: %s", address, e)
        return []
    if path and not config.get("read-only"):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
            f.write("\n".join(lines))
        os.replace(f"{path}.{os.getpid()}", path)
    return lines


def forget_lists(config: dict) -> None:
    """Removes the cached lists."""
    (config.get("lists") or {}).clear()
    if config.get("cacheDir") and not config.get("read-only"):
        shutil.rmtree(os.path.join(config["cacheDir"], "keys"), ignore_errors=True)


def provider_keys(config: dict, uri: str, fetch: Fetch | None = None) -> list[tuple[str, str]]:
    """(source, key) of all providers of a schema."""
    own = config.get("primary_key") or {}
    out = [("__inline__", key_text(v)) for v in (own.get("inline_provider") or {}).get(uri, ())]
    fetch = fetch or own.get("fetch") or opened
    accept = own.get("accept")
    if accept and own.get("schema_prefix") != uri and uri.startswith(own.get("schema_prefix") or ""):
        bases = own.get("provider") or []
        for base in [bases] if isinstance(bases, str) else bases:
            out += [(base, key_text(line)) for line in key_list(config, fetch, remote_address(base, uri), accept)]
    return out


def collisions(config: dict, uri: str, fetch: Fetch | None = None) -> list[tuple[str, list[str]]]:
    """Keys that several providers give, unless that is allowed."""
    if (config.get("primary_key") or {}).get("allow_provider_duplicates"):
        return []
    by_key: dict[str, list[str]] = defaultdict(list)
    for source, key in provider_keys(config, uri, fetch):
        by_key[key].append(source)
    return sorted((k, s) for k, s in by_key.items() if len(s) > 1)
