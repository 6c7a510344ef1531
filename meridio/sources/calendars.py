"""Holidays of the United States and of some states, from rules on a sequence of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _nth(month: int, n: int, day: str) -> str:
    return f"date_add(next_day(date_sub(make_date(y, {month}, 1), 1), '{day}'), {7 * (n - 1)})"


_LAST_MAY = "next_day(make_date(y, 5, 24), 'Mon')"
_THANKS = _nth(11, 4, "Thu")
#: (name, rule, first year, scopes beyond the federal one, whether it is moved from weekends)
RULES = [
    ("New Year's Day", "make_date(y, 1, 1)", 0, ["US"], True),
    ("Martin Luther King Jr. Day", _nth(1, 3, "Mon"), 1986, ["US"], False),
    ("Washington's Birthday", _nth(2, 3, "Mon"), 1971, ["US"], False),
    ("Memorial Day", _LAST_MAY, 1971, ["US"], False),
    ("Juneteenth", "make_date(y, 6, 19)", 2021, ["US"], True),
    ("Independence Day", "make_date(y, 7, 4)", 0, ["US"], True),
    ("Labor Day", _nth(9, 1, "Mon"), 0, ["US"], False),
    ("Columbus Day", _nth(10, 2, "Mon"), 1971, ["US"], False),
    ("Veterans Day", "make_date(y, 11, 11)", 1978, ["US"], True),
    ("Thanksgiving", _THANKS, 1942, ["US"], False),
    ("Christmas Day", "make_date(y, 12, 25)", 0, ["US"], True),
    ("Mardi Gras", "date_sub(easter, 47)", 0, ["LA"], False),
    ("Good Friday", "date_sub(easter, 2)", 0, ["PA", "LA"], False),
    ("Day After Thanksgiving", f"date_add({_THANKS}, 1)", 1975, ["PA", "FL"], False),
]
STATES = ["PA", "FL", "LA"]


def holidays(spark: SparkSession, first: int = 2005, last: int = 2022, *, states: list[str] | None = None) -> DataFrame:
    """(day, holiday, scope): federal days in scope US and again for each state, with the state's own.

    A fixed day that falls on a weekend is listed as it is, and once more, marked as observed, on the Friday before a Saturday or
    the Monday after a Sunday, if that is in the years asked for. No years give no rows.
    """
    states = STATES if states is None else states
    y = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    y = y.selectExpr("y", "y % 19 a", "y div 100 b", "y % 100 c").selectExpr("*", "(19 * a + b - b div 4 - (b - (b + 8) div 25 + 1) div 3 + 15) % 30 h")
    y = y.selectExpr("*", "(32 + 2 * (b % 4) + 2 * (c div 4) - h - c % 4) % 7 l").selectExpr("*", "(a + 11 * h + 22 * l) div 451 m")
    y = y.selectExpr("y", "make_date(y, cast((h + l - 7 * m + 114) div 31 as int), cast((h + l - 7 * m + 114) % 31 + 1 as int)) easter")
    rows = None
    for name, rule, since, scopes, moves in RULES:
        own = [s for s in (["US", *states] if scopes == ["US"] else [x for x in scopes if x in states])]
        if not own:
            continue
        part = y.where(F.col("y") >= since).select(F.expr(rule).alias("day"), F.lit(name).alias("holiday"), F.explode(F.array(*map(F.lit, own))).alias("scope"))
        if moves:
            off = F.when(F.dayofweek("day") == 7, -1).when(F.dayofweek("day") == 1, 1)
            part = part.unionAll(part.where(off.isNotNull()).select(F.date_add("day", off).alias("day"), F.concat("holiday", F.lit(" (observed)")), "scope"))
        rows = part if rows is None else rows.unionAll(part)
    return rows.where(F.year("day").between(first, last))
