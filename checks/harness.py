"""Registry of checked queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from checks.domain import DOMAIN

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def references(text: str) -> list[str]:
    seen = [name for _, name, _, _ in Formatter().parse(text) if name]
    return list(dict.fromkeys(seen))


class Tables:
    """Driver tables and the domain tables derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in RAW:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in DOMAIN:
                self._made[name] = self.joined(DOMAIN[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def joined(self, text: str) -> DataFrame:
        """``text`` with the tables it joins sorted: keyed rows are many times their file, too many to go through the driver."""
        names = references(text)
        return self.spark.sql(text, **{n: getattr(self, n).hint("merge") if len(names) > 1 else getattr(self, n) for n in names})

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in references(text)})


def oracle_text(text: str) -> str:
    """Expand {names} to CTEs over the driver tables."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in references(sql):
            if name in DOMAIN and name not in order:
                visit(DOMAIN[name])
                order.append(name)

    visit(text)
    names = {n: n for n in (*RAW, *DOMAIN)}
    ctes = [f"{n} AS (\n{DOMAIN[n].format(**names).strip()}\n)" for n in order]
    body = text.format(**names).strip()
    if not ctes:
        return body
    extra = re.match(r"WITH\s+(RECURSIVE\s+)?(.*)", body, re.S | re.I)
    head = ("WITH RECURSIVE " if extra and extra.group(1) else "WITH ") + ",\n".join(ctes)
    return f"{head},\n{extra.group(2)}" if extra else f"{head}\n{body}"


def check(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return register
