"""Computed fields: named SQL expressions over columns and each other, ordered by what they need."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Literals and quoted names; what is left of an expression between them holds plain names.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`((?:[^`]|``)+)`")
_NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*+(?!\s*\()")


class CycleError(ValueError):
    """Computed fields that need each other."""


def names_in(expression: str) -> set[str]:
    """The names that a SQL expression may refer to: identifiers that open a path, but no functions and nothing in literals."""
    quoted = {m[1].replace("``", "`") for m in _QUOTED.finditer(expression) if m[1]}
    return quoted | set(_NAME.findall(_QUOTED.sub(" ", expression)))


def levels(fields: dict[str, str], wanted: list[str] | None = None, present: set[str] | frozenset[str] = frozenset()) -> list[list[str]]:
    """The fields in as few steps as their chains of needs are long; each needs only columns and fields of steps before.

    wanted: only these and what they need. A field of the name of a column that is present may refer to that column.
    """
    needs = {k: {n for n in names_in(e) if n in fields and not (n == k and k in present)} for k, e in fields.items()}
    depth: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]) -> int:
        if name in path:
            raise CycleError(" -> ".join([*path[path.index(name) :], name]))
        if name not in depth:
            depth[name] = 1 + max((visit(n, (*path, name)) for n in sorted(needs[name])), default=-1)
        return depth[name]

    for name in fields if wanted is None else wanted:
        visit(name, ())
    return [[n for n in fields if depth.get(n) == k] for k in range(max(depth.values(), default=-1) + 1)]


def with_computed(df: DataFrame, fields: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
    """df with computed fields: one projection a level. A field that no column and no field supports is Spark's error; a cycle is refused before anything runs."""
    for level in levels(fields, wanted, set(df.columns)):
        df = df.withColumns({n: F.expr(fields[n]) for n in level})
    return df
