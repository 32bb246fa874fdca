"""How a registered query is declared: a DataFrame, its columns, its SQL twin.

``cols`` names every output column with a type letter: ``s`` text, ``i`` whole
number, ``b`` boolean, ``d<n>`` DOUBLE rounded to n decimals. The same
declaration shapes the DataFrame and the SQL result, so both sides compare.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.catalog.views import VIEWS

Build = Callable[[SparkSession, str], DataFrame]


def parse(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def nudge(kind: str) -> float:
    """An offset far below the last kept digit.

    Means of short decimals often end in an exact half, where the last bit of
    the sum decides the rounding; the offset moves them off that border.
    """
    return 0.0123 * 10.0 ** -int(kind[1:])


def shape(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in parse(cols):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double") + F.lit(nudge(kind)), int(kind[1:])) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def _needed(text: str, views: dict[str, str]) -> list[str]:
    """Views the text uses, each after the views it uses itself."""
    order: list[str] = []

    def visit(body: str) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", body))
        for name, text_of in views.items():
            if name in words and name not in order:
                visit(text_of)
                order.append(name)

    visit(text)
    return order


def oracle(sql: str, cols: str, views: dict[str, str]) -> str:
    out = []
    for name, kind in parse(cols):
        if kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        else:
            c = (f"round(CAST({name} AS DOUBLE) + CAST({nudge(kind)!r} AS DOUBLE), {kind[1:]})"
                 " + CAST(0.0 AS DOUBLE)")
        out.append(f"{c} AS {name}")
    used = _needed(sql, views)
    ctes = [f"{name} AS ({views[name].strip()})" for name in used]
    ctes.append(f"result_rows AS ({sql.strip()})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT " + ", ".join(out) + " FROM result_rows"


@dataclass
class Catalog:
    builds: dict[str, Build] = field(default_factory=dict)
    sqls: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, cols: str, sql: str | None = None,
              views: dict[str, str] | None = None) -> Callable[[Build], Build]:
        """Register a DataFrame function under ``name``."""
        def register(fn: Build) -> Build:
            if name in self.builds:
                raise ValueError(f"{name} registered twice")
            self.builds[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), cols)
            if sql is not None:
                self.sqls[name] = oracle(sql, cols, {**VIEWS, **(views or {})})
            return fn
        return register


CATALOG = Catalog()
query = CATALOG.query
