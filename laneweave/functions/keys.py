"""Routing keys as file names: escaping, its inverse, templates, collisions.

Escaping is a composition of built-in functions; only the digest of names that
are too long needs Python, and only those rows reach it.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, OutputError

#: Fixed values of the naming scheme.
SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.+~")
EMPTY = "%-"
DEVICES = frozenset(["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]])
LONGEST, PREFIX = 200, 182


def encode_key(key: bytes) -> str:
    """A name that any file system takes; equal keys, equal names, and different ones unless two digests collide."""
    if not key:
        return EMPTY
    parts = [chr(b) if b in SAFE else f"%{b:02X}" for b in key]
    stem = key.split(b".")[0].decode("latin-1").lower()
    if key in (b".", b"..") or stem in DEVICES:
        parts[0] = f"%{key[0]:02X}"
    if key.endswith(b"."):
        parts[-1] = f"%{key[-1]:02X}"
    name = "".join(parts)
    if len(name) <= LONGEST:
        return name
    cut = 0
    for p in parts:
        if cut + len(p) > PREFIX:
            break
        cut += len(p)
    return f"{name[:cut]}--{xxhash.xxh3_64_hexdigest(key)}"


def decode_key(name: str) -> bytes | None:
    """The key of a name, None if an escape is broken (shortened names don't come back)."""
    if name == EMPTY:
        return b""
    if not re.fullmatch(r"(?:[^%]|%[0-9A-Fa-f]{2})*", name):
        return None
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), name.encode("utf-8"))


def is_safe_component(name: str) -> bool:
    """Whether a name is one plain path component."""
    return bool(name) and name not in (".", "..") and not re.search(r"[/\\\x00-\x1f]", name) and not name.endswith(".") and name.split(".")[0].lower() not in DEVICES


def encoded(key: Column) -> Column:
    """``encode_key`` of a string column as a column expression, for keys whose name stays within the limit.

    The key's bytes in hexadecimal are taken two by two; safe ones become
    characters again. Longer names raise an error; those go through
    :func:`encode_key`.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(key, "UTF-8")), F.lit("(..)"), F.lit(1))
    safe = F.array(*[F.lit(f"{b:02X}") for b in sorted(SAFE)])
    size = F.size(pairs)
    stem = F.lower(F.split(key, r"\.", 2)[0])
    first_escaped = key.isin(".", "..") | stem.isin(*sorted(DEVICES))

    def one(pair: Column, i: Column) -> Column:
        escape = (first_escaped & (i == 0)) | ((i == size - 1) & (pair == "2E"))
        return F.when(F.array_contains(safe, pair) & ~escape, F.decode(F.unhex(pair), "UTF-8")).otherwise(F.concat(F.lit("%"), pair))

    name = F.array_join(F.transform(pairs, one), "")
    return (
        F.when(key == "", F.lit(EMPTY))
        .when(F.length(name) > LONGEST, F.raise_error(F.concat(F.lit("key needs a digest: "), F.substring(key, 1, 40))).cast("string"))
        .otherwise(name)
    )


def collisions(names: DataFrame, name_col: str = "name", key_col: str = "key") -> DataFrame:
    """Names that more than one key wants (without regard to case): name, keys."""
    return names.groupBy(F.lower(name_col).alias("name")).agg(F.count_distinct(key_col).alias("keys")).filter(F.col("keys") > 1)


class Template:
    """``{key}`` (must be there), ``{index}``, and doubled braces for braces."""

    def __init__(self, text: str = "{key}.bam"):
        self.parts: list[tuple[str, str]] = []
        for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}|[{}]|[^{}]+", text):
            token = m.group()
            if token in ("{{", "}}"):
                self.parts.append(("text", token[0]))
            elif token in ("{", "}"):
                raise ConfigError(f"unbalanced brace in template {text!r}")
            elif m.group(1) is not None:
                if m.group(1) not in ("key", "index"):
                    raise ConfigError(f"unknown placeholder {{{m.group(1)}}} in template {text!r}")
                self.parts.append((m.group(1), ""))
            else:
                self.parts.append(("text", token))
        if not any(kind == "key" for kind, _ in self.parts):
            raise ConfigError("a template needs {key}")

    def render(self, name: str, index: int) -> str:
        return "".join({"text": text, "key": name, "index": str(index)}[kind] for kind, text in self.parts)


def assign_names(keys: list[bytes], template: Template) -> dict[bytes, str]:
    """File names of keys in output order; keys that meet in one name are an error."""
    out: dict[bytes, str] = {}
    taken: dict[str, bytes] = {}
    for i, key in enumerate(keys):
        name = template.render(encode_key(key), i)
        if not is_safe_component(name):
            raise OutputError(f"{name!r} is no plain file name")
        if name.lower() in taken:
            raise OutputError(f"keys {taken[name.lower()]!r} and {key!r} both want the name {name!r}")
        taken[name.lower()] = key
        out[key] = name
    return out
