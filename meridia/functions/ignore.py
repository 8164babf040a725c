"""Ignore rules of a file tree as one column expression.

Patterns are taken in order, the last that matches a name decides, and ``!`` takes a name back in. What lies
below an ignored folder is ignored, whatever later patterns say of it. ``*``, ``?`` and ``[...]``
stay within one part of a path; ``**`` as a whole part stands for any number of them; a pattern with a
``/`` at its start or inside is anchored at the root, others match at any depth; one that ends in ``/``
matches folders alone; ``\\`` takes the sign after it as it is; blank lines and lines that begin with
``#`` are none, spaces at the end don't count. ``?`` and a class stand for one character (of any
number of bytes); a class ends within its part.

Nothing is joined and nothing leaves the JVM: each pattern is a regular expression, and the rules are
one ``when`` over them for each folder of a path. Null and empty paths are null and kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a walk without ignore rules leaves out.
USUAL = (".git/", "__pycache__/", "test-results/")


def _glob(part: str) -> str:
    """A part of a pattern as a regular expression within one part of a path."""
    out, k = "", 0
    while k < len(part):
        sign = part[k]
        k += 1
        if sign == "*":
            out += "[^/]*"
        elif sign == "?":
            out += "[^/]"
        elif sign == "\\" and k < len(part):
            out += re.escape(part[k])
            k += 1
        elif sign == "[":
            end = part.find("]", k + 1 + (part[k : k + 1] in ("!", "^")))
            if end < 0:
                return "(?!)"  # a class without an end matches nothing
            inner, k = part[k:end], end + 1
            negated = inner[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", inner[1:] if negated else inner)
            out += f"(?!/)[{'^' if negated else ''}{inner}]"
        else:
            out += re.escape(sign)
    return out


def compiled(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression of a whole path, ignore, folders alone) of a line, or None."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    ignore = not line.startswith("!")
    line = line if ignore else line[1:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    anchored = "/" in line
    parts = line.removeprefix("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _glob(part) + ("" if last else "/")
    return f"(?s)^{out}$", ignore, folders


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the rules leave out a file of this path (parts joined by ``/``, none at the start)."""
    rules = [r for r in map(compiled, patterns) if r]
    if not rules:
        return F.when(path.isNotNull(), F.lit(False))

    def decided(name: Column, folder: bool) -> Column:
        found = None
        for pattern, ignore, folders in reversed(rules):
            if folder or not folders:
                found = F.when(name.rlike(pattern), F.lit(ignore)) if found is None else found.when(name.rlike(pattern), F.lit(ignore))
        return F.lit(False) if found is None else found.otherwise(F.lit(False))

    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    above = F.exists(depths, lambda n: decided(F.array_join(F.slice(parts, F.lit(1), n), "/"), True))
    return F.when(path.isNotNull(), (path != "") & (above | decided(path, False)))


def selected(files: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """The rows whose path the rules keep; rows without a path stay."""
    return files.filter(~F.coalesce(ignored(F.col(path), patterns), F.lit(False)))
