"""Columns over node ids and paths, and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id_problem(node_id: Column) -> Column:
    """Why a node id is not valid, or null. A null id counts as empty."""
    x = F.coalesce(node_id, F.lit(""))
    return (
        F.when(x == "", "empty")
        .when(x.contains("\\"), "backslash")
        .when(x.startswith("./"), "leading_dot_slash")
        .when(x.endswith("/"), "trailing_slash")
        .when(x.startswith("/"), "leading_slash")
        .when(F.array_contains(F.split(x, "/"), ".."), "parent_component")
    )


def order_key(path: Column) -> Column:
    """Sorts paths component by component."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; names that only begin with a dot keep it."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def extension(path: Column) -> Column:
    """With its dot; empty where there is none."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1)


def parent(path: Column) -> Column:
    """The folder; empty at the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def normalized(path: Column) -> Column:
    """Slashes for backslashes, without `.` components."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != ".") & (p != ""))
    return F.array_join(parts, "/")


def glob_regex(glob: str) -> str:
    """An anchored pattern for a glob in which `*` and `?` also match slashes.

    Knows `*`, `**`, `?`, `[...]` with `!` or `^`, `{a,b}` (nested too) and `\\` before a literal character. Raises
    ValueError for brackets that are not closed.
    """
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            start = i == 0 or glob[i - 1] == "/"
            if glob[i : i + 3] == "**/" and start:
                out.append("(?:.*/)?")
                i += 3
                continue
            if glob[i : i + 2] == "**" and i + 2 == len(glob) and i and glob[i - 1] == "/":
                out.append(".+")
                i += 2
                continue
            while glob[i : i + 1] == "*":
                i += 1
            out.append(".*")
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 1)
            end = glob.find("]", end + 1) if end == i + 1 else end
            if end < 0:
                raise ValueError(f"a bracket is not closed in {glob!r}")
            inner = glob[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            inner = inner[1:] if negated else inner
            out.append("[" + "^" * negated + inner.replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"a brace is not closed in {glob!r}")
    return f"^(?s:{''.join(out)})$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; those that are not valid are skipped."""
    out = F.lit(False)
    for glob in globs:
        try:
            out = out | path.rlike(glob_regex(glob))
        except ValueError:
            continue
    return out
