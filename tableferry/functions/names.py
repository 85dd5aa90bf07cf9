"""Identifier rules and glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters and length a table or column name may have.
NAME_PATTERN = "[A-Za-z0-9_]{1,63}"


def is_valid_name(name: str) -> bool:
    return re.fullmatch(NAME_PATTERN, name) is not None


def validate_columns(df: DataFrame, on_invalid: str = "drop") -> DataFrame:
    """Keep only columns a target table can have.

    ``drop`` skips a column with a bad name, ``rename`` replaces its bad
    characters by ``_`` and shortens it, ``fail`` raises.
    """
    bad = [c for c in df.columns if not is_valid_name(c)]
    if not bad:
        return df
    if on_invalid == "fail":
        raise ValueError(f"invalid column names: {bad}")
    if on_invalid == "drop":
        return df.select([quoted(c) for c in df.columns if c not in bad])
    if on_invalid != "rename":
        raise ValueError("on_invalid is 'drop', 'rename' or 'fail'")
    taken = {c.lower() for c in df.columns if c not in bad}
    out = []
    for name in df.columns:
        new = name
        if name in bad:
            stem = re.sub(r"[^A-Za-z0-9_]", "_", name)[:63] or "column"
            new, n = stem, 1
            while new.lower() in taken:
                n += 1
                new = f"{stem[:60]}_{n}"
            taken.add(new.lower())
        out.append(quoted(name).alias(new))
    return df.select(out)


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for ``*``, ``?`` and ``[...]``; none of them crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and (close := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + body + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_matches(path: Column, pattern: str) -> Column:
    """Does the base name of a path match a glob? An empty pattern matches all."""
    return base_name(path).rlike(glob_to_regex(pattern)) if pattern else F.lit(True)


def key_matches(key: Column, pattern: str) -> Column:
    """Glob over a whole key, where ``*`` and ``?`` match any character, ``/`` too."""
    regex = glob_to_regex(pattern or "*").replace("[^/]", "(?s:.)")
    return key.rlike(regex)
