"""Where queries and their DuckDB SQL are registered.

Sums of doubles depend on the order of addition, so both sides of a comparison are rounded the same way: to nine significant digits, numbers
under 1e-12 to zero. Values a shade over a half are rounded down, so that exact halves never sit on the edge.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}

_HALF = 0.49937


def rounded(c: Column) -> Column:
    size = F.floor(F.log10(F.abs(c))).cast("int")
    up = F.pow(F.lit(10.0), (F.lit(8) - size).cast("double"))
    down = F.pow(F.lit(10.0), (size - F.lit(8)).cast("double"))
    near = lambda v: F.floor(v + F.lit(_HALF)).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(None)).when(F.abs(c) < 1e-12, 0.0).when(F.abs(c) == F.lit(float("inf")), c).when(size <= 8, near(c * up) / up).otherwise(near(c / down) * down)


def _rounded_sql(c: str) -> str:
    size = f"CAST(floor(log10(abs({c}))) AS INTEGER)"
    return (
        f"CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL WHEN abs({c}) < 1e-12 THEN 0.0::DOUBLE WHEN isinf({c}) THEN {c} WHEN {size} <= 8 "
        f"THEN floor({c} * pow(10.0::DOUBLE, 8 - {size}) + {_HALF}) / pow(10.0::DOUBLE, 8 - {size}) ELSE floor({c} / pow(10.0::DOUBLE, {size} - 8) + {_HALF}) * pow(10.0::DOUBLE, {size} - 8) END"
    )


def query(name: str, oracle: str | None = None, floats: tuple[str, ...] = (), rest: bool = True):
    """Register a query; ``oracle`` is equivalent DuckDB SQL where SQL can express it, ``floats`` the columns that are rounded, ``rest`` whether there are others."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if not oracle:
                return df
            kinds = dict(df.dtypes)
            return df.select(*[rounded(F.col(f"`{c}`").cast("double")).alias(c) if c in floats or kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])

        QUERIES[name] = run
        if oracle:
            cols = [f"{_rounded_sql(c)} AS {c}" for c in floats] + ([f"* EXCLUDE ({', '.join(floats)})"] if rest and floats else ["*"] if rest else [])
            ORACLES[name] = f"SELECT {', '.join(cols)} FROM ({oracle})"
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
