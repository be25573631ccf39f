"""Scalar functions: name to builder of a typed column. The registry is open."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.errors import AnalysisError


class Typed(NamedTuple):
    """A column and its type in the language: null, bool, int, float, str, date, time, datetime, duration, list, map, node, edge, path, bytes."""

    column: Column
    type: str
    element: str | None = None


_REGISTRY: dict[str, Callable[..., Typed]] = {}


def register_function(name: str, builder: Callable[..., Typed]) -> None:
    """Make a function known to queries; the builder takes typed columns and returns one."""
    _REGISTRY[name.lower()] = builder


def function(name: str) -> Callable[..., Typed]:
    if name.lower() not in _REGISTRY:
        raise AnalysisError(f"unknown function {name}")
    return _REGISTRY[name.lower()]


def _fail(message: str, like: str) -> Column:
    return F.raise_error(F.lit(message)).cast(like)


def to_string(x: Typed) -> Typed:
    if x.type == "float":
        text = x.column.cast("string")
        return Typed(F.regexp_replace(text, r"\.0$", ""), "str")
    if x.type == "duration":
        return Typed(duration_text(x.column), "str")
    if x.type == "datetime":
        return Typed(F.date_format(x.column, "yyyy-MM-dd'T'HH:mm:ss"), "str")
    if x.type in ("list", "map"):
        return Typed(F.to_json(x.column), "str")
    return Typed(x.column.cast("string"), "str")


def to_integer(x: Typed) -> Typed:
    if x.type == "str":
        good = x.column.rlike(r"^[+-]?\d+$")
        return Typed(F.when(x.column.isNull(), None).when(good, F.when(good, x.column).cast("bigint")).otherwise(_fail("toInteger: not a whole number", "bigint")), "int")
    if x.type == "float":
        return Typed(F.when(x.column >= 2.0**63, F.lit(2**63 - 1)).when(x.column <= -(2.0**63), F.lit(-(2**63))).when(F.isnan(x.column), F.lit(0)).otherwise(_truncate(x.column)), "int")
    if x.type in ("int", "bool", "null"):
        return Typed(x.column.cast("bigint"), "int")
    raise AnalysisError(f"toInteger does not take {x.type}")


def _truncate(c: Column) -> Column:
    inside = F.when((c < 2.0**63) & (c > -(2.0**63)), c)
    return F.when(inside >= 0, F.floor(inside)).otherwise(F.ceil(inside)).cast("bigint")


def to_float(x: Typed) -> Typed:
    if x.type in ("int", "float", "str", "null"):
        return Typed(x.column.cast("double"), "float")
    raise AnalysisError(f"toFloat does not take {x.type}")


def size(x: Typed) -> Typed:
    if x.type == "str":
        return Typed(F.length(x.column).cast("bigint"), "int")
    if x.type in ("list", "path"):
        return Typed(F.when(x.column.isNotNull(), F.size(x.column)).cast("bigint"), "int")
    if x.type == "null":
        return Typed(F.lit(None).cast("bigint"), "int")
    raise AnalysisError(f"size does not take {x.type}")


def _parsed(x: Typed, name: str, of: str, *patterns: tuple[str, Callable[[Column], Column]]) -> Typed:
    if x.type not in ("str", "null"):
        raise AnalysisError(f"{name} takes a string")
    text = x.column.cast("string")
    out = F.when(text.isNull(), F.lit(None).cast(of))
    for pattern, build in patterns:
        good = text.rlike(pattern)
        out = out.when(good, build(F.when(good, text)))
    return out.otherwise(_fail(f"{name}: the text has another format", of))


def to_date(x: Typed) -> Typed:
    if x.type == "date":
        return x
    return Typed(_parsed(x, "date", "date", (r"^\d{4}-\d{2}-\d{2}$", lambda s: F.to_date(s, "yyyy-MM-dd"))), "date")


def to_time(x: Typed) -> Typed:
    two = "(?:[01][0-9]|2[0-3])"
    return Typed(_parsed(x, "time", "string", (rf"^{two}:[0-5]\d:[0-5]\d$", lambda s: s), (rf"^{two}:[0-5]\d$", lambda s: F.concat(s, F.lit(":00")))), "time")


def to_datetime(x: Typed) -> Typed:
    if x.type == "datetime":
        return x
    day, clock = r"^\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}"
    ntz = lambda fmt: lambda s: F.to_timestamp_ntz(s, F.lit(fmt))
    return Typed(
        _parsed(x, "datetime", "timestamp_ntz", (rf"{day}T{clock}:\d{{2}}$", ntz("yyyy-MM-dd'T'HH:mm:ss")), (rf"{day} {clock}:\d{{2}}$", ntz("yyyy-MM-dd HH:mm:ss")), (rf"{day}T{clock}$", ntz("yyyy-MM-dd'T'HH:mm")), (rf"{day}T{clock}:\d{{2}}\.\d{{1,6}}$", lambda s: s.cast("timestamp_ntz"))), "datetime"
    )


DURATION = "struct<months:int,days:int,nanos:bigint>"
_DURATION = r"^P(?=.)(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+)(?:\.(\d{1,9}))?S)?)?$"


def to_duration(x: Typed) -> Typed:
    def build(s: Column) -> Column:
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, _DURATION, i), F.lit("")).cast("bigint"), F.lit(0))
        second = F.lit(10**9)
        fraction = F.rpad(F.regexp_extract(s, _DURATION, 8), 9, "0").cast("bigint")
        sign = F.when(F.startswith(F.regexp_extract(s, _DURATION, 7), F.lit("-")), -1).otherwise(1)
        nanos = part(5) * 3600 * second + part(6) * 60 * second + part(7) * second + sign * fraction
        return F.struct((part(1) * 12 + part(2)).cast("int").alias("months"), (part(3) * 7 + part(4)).cast("int").alias("days"), nanos.alias("nanos"))

    return Typed(_parsed(x, "duration", DURATION, (_DURATION, build)), "duration")


def duration_text(c: Column) -> Column:
    """ISO 8601 text of a duration."""
    months, days, nanos = c["months"], c["days"], c["nanos"]
    some = lambda v, unit: F.when(v != 0, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
    whole = lambda v, by: F.when(v >= 0, F.floor(v / by)).otherwise(F.ceil(v / by)).cast("bigint")
    seconds = whole(nanos, 10**9)
    hours, minutes = whole(seconds, 3600), whole(seconds % 3600, 60)
    rest, fraction = seconds % 60, F.abs(nanos % 10**9)
    tail = F.when(fraction > 0, F.concat(F.when((rest == 0) & (nanos < 0), "-0").otherwise(rest.cast("string")), F.lit("."), F.regexp_replace(F.lpad(fraction.cast("string"), 9, "0"), "0+$", ""), F.lit("S"))).otherwise(some(rest, "S"))
    clock = F.concat(some(hours, "H"), some(minutes, "M"), tail)
    text = F.concat(F.lit("P"), some(whole(months, 12), "Y"), some(months % 12, "M"), some(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.when(c.isNull(), None).when(text == "P", F.lit("PT0S")).otherwise(text)


for _name, _builder in {
    "tostring": to_string, "tointeger": to_integer, "tofloat": to_float, "size": size, "date": to_date, "time": to_time,
    "datetime": to_datetime, "timestamp": to_datetime, "duration": to_duration,
}.items():
    register_function(_name, _builder)
