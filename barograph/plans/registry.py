"""Query registration.

A query names its output columns with a type each, and both sides are cast and rounded
the same way: ``s`` text, ``d`` date (as ISO text), ``i`` whole number, ``b`` boolean
(as 0/1) or a number of decimals for a double.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.sources.checkpoint import stored


# tables already built for the query under construction; None where nothing is shared
_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


def shared(store: bool = False):
    """Build a table once per query; ``store`` also writes it to the shared folder.

    A query that uses its bars several times would otherwise scan the raw ticks once per
    use, because every use prunes different columns. Nothing outlives the query.
    """

    def wrap(make: Callable[[SparkSession, str], DataFrame]):
        @wraps(make)
        def table(spark: SparkSession, sf_dir: str) -> DataFrame:
            built = _SHARED.get()
            if built is None:
                return make(spark, sf_dir)
            name = f"{make.__module__}.{make.__qualname__}"
            if name not in built:
                df = make(spark, sf_dir)
                built[name] = stored(df, make.__name__) if store else df
            return built[name]

        return table

    return wrap


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    reuse: bool = False
    long: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _SHARED.set({} if self.reuse else None)
        try:
            df = self.build(spark, sf_dir)
        finally:
            _SHARED.reset(token)
        return df.select(*[_spark_cell(c, kind, self.long) for c, kind in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cells = ", ".join(_sql_cell(c, kind) for c, kind in self.columns)
        return f"SELECT {cells} FROM ({self.sql}) AS q"


def quick_round(c: Column, places: int) -> Column:
    """What ``round`` gives, without decimals but next to halves, where the product may have slipped over one.

    ``rint`` is a whole number there, so the quotient is the double nearest to the rounded decimal as well.
    """
    scaled = c * F.lit(10.0**places)
    whole = F.rint(scaled)
    clear = (F.abs(F.abs(scaled - whole) - 0.5) > 1e-3) & (F.abs(scaled) < 2.0**40)
    return F.when(clear, whole / F.lit(10.0**places) + 0.0).otherwise(F.round(c, places))


def _spark_cell(name: str, kind: str, long: bool = False) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("s", "d"):
        return c.cast("string").alias(name)
    if kind in ("i", "b"):
        return c.cast("bigint").alias(name)
    c = c.cast("double")
    return F.when(~F.isnan(c), (quick_round if long else F.round)(c, int(kind))).alias(name)


def _sql_cell(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind in ("s", "d"):
        return f"CAST({c} AS VARCHAR) AS {c}"
    if kind in ("i", "b"):
        return f"CAST({c} AS BIGINT) AS {c}"
    r = f"round(CAST({c} AS DOUBLE), {kind})"
    return f"CASE WHEN isnan({r}) THEN NULL WHEN {r} = 0 THEN 0.0 ELSE {r} END AS {c}"


QUERIES: dict[str, Query] = {}


def register(
    name: str,
    columns: str,
    build: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
    reuse: bool = False,
    long: bool = False,
) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    spec = tuple(tuple(c.rsplit(":", 1)) for c in columns.split())
    QUERIES[name] = Query(name, spec, build, sql, reuse, long)


# for queries that use their bars more than once
register_reusing = partial(register, reuse=True)
# for queries of so many rows that rounding through decimals is most of their time
register_long = partial(register, long=True)
