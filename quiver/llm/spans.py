"""Places of regular expressions in texts, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """Array whose i-th element combines elements 0 to i in order (null: no element), of the array type ``kind``.

    Doubling: after k rounds each element covers 2**k of them, so n elements cost n * log(n), and no array grows by
    one element at a time. ``combine(earlier, later)`` must be associative.
    """
    distances = F.array(*(F.lit(1 << k) for k in range(31)))

    def double(acc: Column, d: Column) -> Column:
        moved = F.transform(acc, lambda x, i: F.when(i >= d, combine(F.get(acc, i - d), x)).otherwise(x))
        return F.when(F.size(acc) > d, moved).otherwise(acc).cast(kind)

    return F.aggregate(distances, items.cast(kind), double)


def find_spans(text: Column, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), in code points, end exclusive.

    The text is cut at its matches; the running sum of the lengths of pieces and matches gives the places.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = "array<struct<end:int,value:string>>"

    def places(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern), found, lambda gap, value: F.struct((F.length(gap) + F.length(value)).alias("end"), value.alias("value")))
        ends = running(F.filter(steps, lambda s: s["value"].isNotNull()), kind, lambda a, b: F.struct((a["end"] + b["end"]).alias("end"), b["value"].alias("value")))
        spans = F.transform(ends, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(F.size(found) > 0, spans.cast(SPAN)).otherwise(no_spans())

    return bind(F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1)), places)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def outside(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by one sort and two running extremes."""
    kind = "array<struct<start:int,end:int,mine:boolean,value:string,reach:int>>"
    mark = lambda mine: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mine).alias("mine"), s["value"].alias("value"), F.when(F.lit(not mine), s["end"]).alias("reach"))

    def further(a: Column, b: Column) -> Column:
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), b["mine"].alias("mine"), b["value"].alias("value"), F.greatest(a["reach"], b["reach"]).alias("reach"))

    def nearer(a: Column, b: Column) -> Column:
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), b["mine"].alias("mine"), b["value"].alias("value"), F.least(a["reach"], b["reach"]).alias("reach"))

    # forwards: the furthest end of the others so far; backwards: the first start of the others to come
    forward = running(F.array_sort(F.concat(F.transform(spans, mark(True)), F.transform(others, mark(False))).cast(kind)), kind, further)
    clear = F.transform(forward, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["mine"] & (F.coalesce(s["reach"], F.lit(0)) <= s["start"])).alias("mine"), s["value"].alias("value"), F.when(~s["mine"], s["start"]).alias("reach")))
    backward = running(F.reverse(clear), kind, nearer)
    kept = F.filter(backward, lambda s: s["mine"] & (F.coalesce(s["reach"], s["end"]) >= s["end"]))
    free = F.transform(F.reverse(kept), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)
    return F.when(F.size(spans) == 0, no_spans()).when(F.size(others) == 0, spans).otherwise(free)


#: Code points of the pieces in which a text is looked up.
_CHUNK = 1024


def chunks(text: Column) -> Column:
    """The text in pieces, so that a lookup never walks from the text's beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{_CHUNK}}})"), F.lit(1))


def stretch(pieces: Column, first: Column, last: Column) -> Column:
    """Code points first to last, the latter exclusive, of a text in pieces; both must lie in the text."""
    a, b = F.floor(first / _CHUNK).cast("int"), F.floor(last / _CHUNK).cast("int")
    inner = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    head = F.substr(F.get(pieces, a), first % _CHUNK + 1, F.lit(_CHUNK))
    tail = F.substr(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), last % _CHUNK)
    return F.when(first >= last, F.lit("")).when(a == b, F.substr(F.get(pieces, a), first % _CHUNK + 1, last - first)).otherwise(F.concat(head, inner, tail))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span (sorted by start) replaced by its kind in brackets; a span that begins inside an earlier one adds nothing."""
    kind = "array<struct<start:int,end:int,kind:string,reach:int>>"

    def build(pieces: Column) -> Column:
        marked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["end"].alias("reach")))
        reached = running(marked, kind, lambda a, b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.greatest(a["reach"], b["reach"]).alias("reach")))

        def join(reached: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reached, i - 1)["reach"], F.lit(0))
            parts = F.transform(reached, lambda s, i: F.when(s["start"] >= before(i), F.concat(stretch(pieces, before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), stretch(pieces, before(F.size(reached)), F.length(text)))

        return bind(reached, join)

    return F.when(F.size(spans) == 0, text).otherwise(bind(chunks(text), build))
