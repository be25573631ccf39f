"""Aggregates: name to builder of an aggregate column."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.errors import AnalysisError
from quiver.functions.scalar import Typed

_NUMBERS = ("int", "float", "null")


def aggregate(name: str, x: Typed | None, distinct: bool, extra: Typed | None = None) -> Typed:
    """Without an argument, COUNT(*). SUM of nothing is 0, COLLECT keeps nulls, the rest skips them."""
    if x is None:
        return Typed(F.count(F.lit(1)), "int")
    c = x.column
    if name == "COUNT":
        return Typed(F.count_distinct(c) if distinct else F.count(c), "int")
    if name in ("SUM", "AVG", "STDDEV", "PERCENTILE") and x.type not in _NUMBERS:
        if name in ("SUM", "AVG"):  # values that are no numbers don't count
            return Typed(F.coalesce(F.sum(F.lit(None).cast("bigint")), F.lit(0)), "int") if name == "SUM" else Typed(F.avg(F.lit(None).cast("double")), "float")
        raise AnalysisError(f"{name} does not take {x.type}")
    if name == "SUM":
        kind = "float" if x.type == "float" else "int"
        of = "double" if kind == "float" else "bigint"
        total = F.sum_distinct(c.cast(of)) if distinct else F.sum(c.cast(of))
        return Typed(F.coalesce(total, F.lit(0).cast(of)), kind)
    if name == "AVG":
        if distinct:
            return Typed(F.sum_distinct(c.cast("double")) / F.count_distinct(c.cast("double")), "float")
        return Typed(F.avg(c.cast("double")), "float")
    if name in ("MIN", "MAX"):
        return Typed(F.min(c) if name == "MIN" else F.max(c), x.type)
    if name == "COLLECT":
        if distinct:
            return Typed(F.collect_set(c), "list", x.type)
        return Typed(F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"]), "list", x.type)
    if name == "STDDEV":
        return Typed(F.stddev_samp(c.cast("double")), "float")
    if name == "PERCENTILE":
        return Typed(F.percentile(c.cast("double"), F.lit(0.5) if extra is None else extra.column), "float")
    raise AnalysisError(f"no aggregate {name}")
