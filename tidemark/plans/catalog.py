"""Registry of the named queries: a Spark plan and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.inputs import with_ctes

Plan = Callable[[SparkSession, str], DataFrame]

MODULES = ("panels", "series", "forecasts", "evaluation", "monitoring", "leads", "texts", "files", "streams")

PLANS: dict[str, Plan] = {}
_BODIES: dict[str, tuple[str, tuple[str, ...]]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text and small integers widened, so any client compares the values alike."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind == "date":
            c = c.cast("string")
        elif kind in ("byte", "short", "integer"):
            c = c.cast("long")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def near(c: str, digits: int) -> Column:
    """Rounded level. The nudge settles exact halves the same way in every engine."""
    return F.round(F.col(c) + 1e-7, digits).alias(c.split(".")[-1])


def register(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Plan], Plan]:
    def add(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = lambda spark, d: plain(fn(spark, d))
        if sql is not None:
            _BODIES[name] = (sql, needs)
        return fn

    return add


def load_all() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"tidemark.plans.{module}")


def sql_texts() -> dict[str, str]:
    return {name: with_ctes(body, *needs) for name, (body, needs) in _BODIES.items()}
