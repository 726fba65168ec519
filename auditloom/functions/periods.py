"""Periods: extraction from context ids, comparison and normalisation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of context ids that tell the kind of period, in order of trial.
KINDS = (("duration", "duration"), ("period", "duration"), ("from", "duration"), ("asof", "instant"), ("instant", "instant"), ("as_of", "instant"), ("at", "instant"))
_SEP, _TO = r"[_\-.]", r"[_\-.]?(?:to|through|thru)[_\-.]?"
_MDY, _YMD = rf"(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}})", rf"(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})"
_LONG, _POINT = rf"^(?:duration|period|from){_SEP}", rf"^(?:asof|instant|as_of|at){_SEP}"


def is_dimensional(context_id: Column) -> Column:
    return F.lower(context_id).rlike("axis|member")


def _date(text: Column, pattern: str, y: int, m: int, d: int) -> Column:
    part = lambda g: F.regexp_extract(text, pattern, g)
    return F.concat(part(y), F.lit("-"), F.lpad(part(m), 2, "0"), F.lit("-"), F.lpad(part(d), 2, "0"))


def kind_of(context_id: Column) -> Column:
    t, out = F.lower(context_id), F
    for start, kind in KINDS:
        out = out.when(t.startswith(start), kind)
    return out.otherwise("unknown")


def period(context_id: Column, year_only: bool = False) -> Column:
    """Struct of kind, start, end (text dates), year and key.

    Recognised are a duration or an instant with dates as month-day-year or year-month-day. Otherwise the first four
    digits in a row are the year and the key. year_only: dates are not looked for.
    """
    t = F.lower(context_id)
    tries = [] if year_only else [(_LONG + _MDY + _TO + _MDY, (3, 1, 2), (6, 4, 5)), (_LONG + _YMD + _TO + _YMD, (1, 2, 3), (4, 5, 6)), (_POINT + _MDY, None, (3, 1, 2)), (_POINT + _YMD, None, (1, 2, 3))]
    start, end = F, F
    for pattern, first, last in tries:
        start = start.when(t.rlike(pattern), _date(t, pattern, *first) if first else F.lit(None).cast("string"))
        end = end.when(t.rlike(pattern), _date(t, pattern, *last))
    none = F.lit(None).cast("string")
    start, end = (start.otherwise(none), end.otherwise(none)) if tries else (none, none)
    year = F.coalesce(F.substring(end, 1, 4), F.nullif(F.regexp_extract(t, r"(\d{4})", 1), F.lit("")))
    key = F.when(start.isNotNull(), F.concat(F.lit("d_"), start, F.lit("_"), end)).when(end.isNotNull(), F.concat(F.lit("i_"), end)).when(year.isNotNull(), F.concat(F.lit("y_"), year))
    return F.struct(kind_of(context_id).alias("kind"), start.alias("start"), end.alias("end"), year.alias("year"), key.alias("key"))


def periods_match(a: Column, b: Column) -> Column:
    """Same key; or same known kind and year; or, loosely, the same year."""
    both = lambda f: a[f].isNotNull() & b[f].isNotNull() & (a[f] == b[f])
    return both("key") | ((a["kind"] != "unknown") & (a["kind"] == b["kind"]) & a["year"].eqNullSafe(b["year"])) | both("year")


def match_key(p: Column) -> Column:
    """A text that two periods share exactly if periods_match: the year or, without one, the kind if it is known. Null matches nothing.

    Periods of the same key or kind and year have the same year, so that matching ones meet in an equi-join.
    """
    return F.coalesce(p["year"], F.when(p["kind"] != "unknown", F.concat(F.lit("kind:"), p["kind"])))


def contexts_compatible(parent: Column, child: Column, strict: bool = False) -> Column:
    some = (F.coalesce(parent, F.lit("")) != "") & (F.coalesce(child, F.lit("")) != "")
    return some & ((parent == child) if strict else (parent == child) | periods_match(period(parent), period(child)))


def units_equal(a: Column, b: Column) -> Column:
    """Units are equal, or one of them is missing."""
    some = lambda u: F.coalesce(u, F.lit("")) != ""
    return ~some(a) | ~some(b) | (a == b)


def date_or_null(c: Column) -> Column:
    """The date that a text begins with (ISO); null where it does not."""
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def label(kind: Column, start: Column, end: Column) -> Column:
    show = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.when(kind == "instant", F.concat(F.lit("As of "), show(end))).when(kind == "duration", F.concat(show(start), F.lit(" to "), show(end))).otherwise("forever")


def instant_within(instant: Column, start: Column, end: Column) -> Column:
    return instant.between(start, end)


def dates_near(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(a, b)) <= days
