"""Registered queries: a Spark plan and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.plans.inputs import CTES, Inputs


class Entry(NamedTuple):
    run: Callable[[Inputs], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        CATALOG[name] = Entry(fn, sql)
        return fn
    return register


def oracle(body: str) -> str:
    """Put the input definitions that ``body`` uses in front of it."""
    order: list[str] = []

    def visit(text: str, skip: str = ""):
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in CTES and word not in order and word != skip:
                visit(CTES[word], word)
                if word not in order:
                    order.append(word)

    visit(body)
    ctes = [f"{n} AS ({CTES[n].strip()})" for n in order]
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        ctes.append(body[m.end():].strip())
        return "WITH RECURSIVE " + ",\n".join(ctes)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


def rnd(c: Column | str, n: int = 6) -> Column:
    """Round to n places with the cut a little below the half, so that both engines agree on ties."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(10.0 ** n) + F.lit(0.5001)) / F.lit(10.0 ** n)


def sql_rnd(expr: str, n: int = 6) -> str:
    return f"floor(({expr}) * 1e{n} + CAST(0.5001 AS DOUBLE)) / 1e{n}"
