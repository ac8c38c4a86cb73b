"""Trading calendars as date dimensions, built from rules as Column arithmetic.

A calendar is a small table of dates. Its ordinal column numbers the open days,
so the open days inside any interval are a subtraction of two ordinals and no
range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: one-off closures, equinox dates, moved and special days
AD_HOC_CLOSURES = (
    ("2018-12-05", "National day of mourning, George H. W. Bush"),
    ("2025-01-09", "National day of mourning, Jimmy Carter"),
)
JPX_YEARS = (2017, 2023)
JPX_EQUINOXES = (
    (2017, "2017-03-20", "2017-09-23"), (2018, "2018-03-21", "2018-09-23"), (2019, "2019-03-21", "2019-09-23"),
    (2020, "2020-03-20", "2020-09-22"), (2021, "2021-03-20", "2021-09-23"), (2022, "2022-03-21", "2022-09-23"),
    (2023, "2023-03-21", "2023-09-23"),
)
JPX_SPECIAL = (
    ("2019-04-30", "Abdication"), ("2019-05-01", "Enthronement"), ("2019-05-02", "Bridge holiday"),
    ("2019-10-22", "Enthronement ceremony"), ("2020-07-23", "Marine Day (moved)"), ("2020-07-24", "Sports Day (moved)"),
    ("2020-08-10", "Mountain Day (moved)"), ("2021-07-22", "Marine Day (moved)"), ("2021-07-23", "Sports Day (moved)"),
    ("2021-08-09", "Mountain Day (observed)"),
)
JPX_MOVED_YEARS = (2020, 2021)
CALENDARS = ("nyse", "jpx")
SATURDAY, SUNDAY = 5, 6


def _date(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    first = _date(year, month, 1)
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(_date(year, month, 1))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def with_easter(years: DataFrame) -> DataFrame:
    """Adds `easter`, Easter Sunday of `year`, by Oudin's integer formula (Gregorian, any year).

    Every step is a column of its own: as one expression each step would be repeated
    wherever the next one uses it.
    """
    steps = (("_c", "year div 100"), ("_n", "year % 19"), ("_k", "(_c - 17) div 25"),
             ("_i", "(_c - _c div 4 - (_c - _k) div 3 + _n * 19 + 15) % 30"),
             ("_h", "_i - (_i div 28) * (1 - (_i div 28) * (29 div (_i + 1)) * ((21 - _n) div 11))"),
             ("_l", "_h - (year + year div 4 + _h + 2 - _c + _c div 4) % 7"), ("_m", "(_l + 40) div 44 + 3"),
             ("easter", "make_date(year, int(_m), int(_l + 28 - (_m div 4) * 31))"))
    out = years
    for name, step in steps:
        out = out.withColumn(name, F.expr(step))
    return out.select(*years.columns, "easter")


def observed(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    wd = F.weekday(day)
    return F.when(wd == SATURDAY, F.date_sub(day, 1)).when(wd == SUNDAY, F.date_add(day, 1)).otherwise(day)


def after_sunday(day: Column) -> Column:
    return F.when(F.weekday(day) == SUNDAY, F.date_add(day, 1)).otherwise(day)


def _years(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))


def _closures(years: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    cell = F.explode(F.array(*[F.struct(d.alias("date"), F.lit(n).alias("name")) for n, d in rules]))
    return (years.select("year", cell.alias("_c")).select("year", "_c.date", "_c.name")
            .where(F.col("date").isNotNull() & (F.year("date") == F.col("year")) & (F.weekday("date") < SATURDAY)))


def nyse_closures(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Full-day closures; a Saturday New Year falls out with the year check."""
    y = F.col("year")
    rules = [
        ("New Year's Day", observed(_date(y, 1, 1))),
        ("Martin Luther King Jr. Day", nth_weekday(y, 1, 0, 3)),
        ("Washington's Birthday", nth_weekday(y, 2, 0, 3)),
        ("Good Friday", F.date_sub("easter", 2)),
        ("Memorial Day", last_weekday(y, 5, 0)),
        ("Juneteenth National Independence Day", F.when(y >= 2022, observed(_date(y, 6, 19)))),
        ("Independence Day", observed(_date(y, 7, 4))),
        ("Labor Day", nth_weekday(y, 9, 0, 1)),
        ("Thanksgiving Day", nth_weekday(y, 11, 3, 4)),
        ("Christmas Day", observed(_date(y, 12, 25))),
    ]
    ruled = _closures(with_easter(_years(spark, lo, hi)), rules).select("date", "name")
    extra = _literal(spark, AD_HOC_CLOSURES).where(F.year("date").between(lo, hi))
    return ruled.unionByName(extra).select(F.lit("nyse").alias("calendar"), "date", "name")


def jpx_closures(spark: SparkSession, lo: int = JPX_YEARS[0], hi: int = JPX_YEARS[1]) -> DataFrame:
    """Closures for the encoded years only; outside them nothing is claimed."""
    lo, hi = max(lo, JPX_YEARS[0]), min(hi, JPX_YEARS[1])
    y = F.col("year")
    eq = {k: None for k in ("v", "a")}
    for year, v, a in JPX_EQUINOXES:
        for k, iso in (("v", v), ("a", a)):
            d = F.to_date(F.lit(iso))
            eq[k] = F.when(y == year, d) if eq[k] is None else eq[k].when(y == year, d)
    kept = ~y.isin(*JPX_MOVED_YEARS)
    rules = [(f"January holiday, no session", _date(y, 1, d)) for d in (1, 2, 3)]
    rules += [
        ("December holiday, no session", _date(y, 12, 31)),
        ("Coming of Age Day", nth_weekday(y, 1, 0, 2)),
        ("National Foundation Day", after_sunday(_date(y, 2, 11))),
        ("Emperor's Birthday", F.when(y >= 2020, after_sunday(_date(y, 2, 23)))),
        ("Emperor's Birthday", F.when(y <= 2018, after_sunday(_date(y, 12, 23)))),
        ("Vernal Equinox", after_sunday(eq["v"])), ("Autumnal Equinox", after_sunday(eq["a"])),
        ("Showa Day", after_sunday(_date(y, 4, 29))),
        ("Marine Day", F.when(kept, nth_weekday(y, 7, 0, 3))),
        ("Mountain Day", F.when(kept, after_sunday(_date(y, 8, 11)))),
        ("Respect for the Aged Day", nth_weekday(y, 9, 0, 3)),
        ("Sports Day", F.when(kept, nth_weekday(y, 10, 0, 2))),
        ("Culture Day", after_sunday(_date(y, 11, 3))),
        ("Labour Thanksgiving Day", after_sunday(_date(y, 11, 23))),
    ]
    # the three days of early May are one block: a Sunday inside it pushes that
    # day and every later day of the block forward by one
    sunday = F.lit(False)
    for d, name in ((3, "Constitution Memorial Day"), (4, "Greenery Day"), (5, "Children's Day")):
        day = _date(y, 5, d)
        sunday = sunday | (F.weekday(day) == SUNDAY)
        rules.append((name, F.when(sunday, F.date_add(day, 1)).otherwise(day)))
    special = _literal(spark, JPX_SPECIAL).where(F.year("date").between(lo, hi) & (F.weekday("date") < SATURDAY))
    ruled = _closures(_years(spark, lo, hi), rules).select("date", "name")
    # a special day replaces the name of a ruled day on the same date
    return special.unionByName(ruled.join(special.select("date"), "date", "left_anti")).select(
        F.lit("jpx").alias("calendar"), "date", "name")


def _literal(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "d string, name string").select(
        F.to_date("d").alias("date"), "name")


def closures(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    return nyse_closures(spark, lo, hi).unionByName(jpx_closures(spark, lo, hi))


def covered(calendar: Column, date: Column) -> Column:
    """Whether the encoded rules can speak about a day."""
    return F.when(calendar == "jpx", F.year(date).between(*JPX_YEARS)).otherwise(calendar == "nyse")


def trading_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(calendar, date, is_open, name, covered, ordinal) for both calendars.

    The window runs over one row per calendar day, a few thousand rows.
    """
    lo, hi = int(start[:4]), int(end[:4])
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    cal = days.select(F.explode(F.array(*[F.lit(c) for c in CALENDARS])).alias("calendar"), "date")
    d = cal.join(closures(spark, lo, hi), ["calendar", "date"], "left")
    d = d.withColumn("covered", covered(F.col("calendar"), F.col("date"))).withColumn(
        "is_open", F.col("covered") & (F.weekday("date") < SATURDAY) & F.col("name").isNull())
    run = Window.partitionBy("calendar").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("ordinal", F.sum(F.col("is_open").cast("int")).over(run))
