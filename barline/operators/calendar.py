"""Trading sessions, alignment to them, and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import backward_fill, forward_fill
from barline.operators.blocks import time_block


def sessions(bounds: DataFrame, start: str = "start", end: str = "end", holidays: DataFrame | None = None) -> DataFrame:
    """Monday to Friday between the dates of the one row of ``bounds``, without ``holidays`` (column date).

    The holidays within the bounds are at most one row a day, whatever the table has.
    """
    days = bounds.select(F.explode(F.sequence(start, end)).alias("date")).where(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays.select("date").distinct(), "date", "left_anti")


def sessions_of(panel: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    return sessions(panel.agg(F.min("date").alias("start"), F.max("date").alias("end")), holidays=holidays)


def present_sessions(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def _with_gaps(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows of panel on sessions with __gaps, the sessions from there to the asset's next row that have none.

    The first row of an asset also has the sessions before it; an asset without any row on a session has one row
    here, with all sessions (its __at is 0). The list of sessions is one row, 15,000 days in 60 years, and an asset
    has no more rows than sessions but for repeats.
    """
    listed = calendar.agg(F.sort_array(F.collect_set("date")).alias("__days"))
    # For each calendar day from the first session on, the number of the last session so far: a row finds its own by one look.
    spans = F.transform("__days", lambda d, i: F.array_repeat(i + 1, F.coalesce(F.date_diff(F.get("__days", i + 1), d), F.lit(1))))
    listed = listed.withColumn("__upto", F.flatten(spans))
    offset = F.date_diff("date", F.get("__days", F.lit(0)))
    number = F.get("__upto", F.when(offset >= 0, offset))
    at = F.when(F.get("__days", number - 1) == F.col("date"), number).otherwise(0)
    w = Window.partitionBy("asset").orderBy("__at", "date")  # rows off sessions come first
    ahead, behind = F.lead("__at", 1).over(w), F.lag("__at", 1).over(w)
    known = panel.join(F.broadcast(listed)).withColumn("__at", at).withColumns({"__next": ahead, "__first": F.coalesce(behind, F.lit(0)) == 0})
    placed = known.where("__at > 0 OR __next IS NULL")
    after = F.slice("__days", F.col("__at") + 1, F.greatest(F.coalesce("__next", F.size("__days") + 1) - F.col("__at") - 1, F.lit(0)))
    before = F.slice("__days", F.lit(1), F.greatest(F.col("__at") - 1, F.lit(0)))
    return placed.withColumn("__gaps", F.when(F.col("__first"), F.concat(before, after)).otherwise(after))


def align(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row for each session and asset; gaps are null, other days are dropped.

    Each row explodes to its own session and those without a row up to the asset's next one, so the panel is read
    once and joined with nothing but the list of sessions. Rows that repeat a day stay.
    """
    values = [c for c in panel.columns if c not in ("asset", "date")]
    dates = F.concat(F.when(F.col("__at") > 0, F.array("date")).otherwise(F.array().cast("array<date>")), F.col("__gaps"))
    out = _with_gaps(panel, calendar).select("asset", F.col("date").alias("__own"), *(f"`{c}`" for c in values), F.explode(dates).alias("date"))
    here = F.col("date") == F.col("__own")
    return out.select("asset", "date", *(F.when(here, F.col(f"`{c}`")).alias(c) for c in values))


def daily_last(ticks: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """The last non-missing value of each column by asset and day; of values at one instant the greatest."""
    return ticks.groupBy("asset", F.to_date(ts).alias("date")).agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("ts"), F.col(c).alias("last"))))["last"].alias(c) for c in columns))


def fill(panel: DataFrame, columns: list[str], how: str = "ffill", key: str = "asset", block: Column | None = None) -> DataFrame:
    """Fills missing values in time order: ffill, bfill or none.

    With ``block`` (a rising function of the date, such as time_block()) no task sees more than a key's block: values
    are filled within it, and each block hands its last one (bfill: its first) on, one row a block.
    """
    fills = {"ffill": forward_fill, "bfill": backward_fill}
    if how == "none":
        return panel
    if how not in fills:
        raise ValueError(f"unknown fill {how!r}")
    if block is None:
        return panel.withColumns({c: fills[how](F.col(c), key) for c in columns})
    ahead = how == "ffill"
    inside = Window.partitionBy(key, "__block").orderBy("date")
    near = inside.rowsBetween(Window.unboundedPreceding, 0) if ahead else inside.rowsBetween(0, Window.unboundedFollowing)
    nearest, edge = (F.last, F.max_by) if ahead else (F.first, F.min_by)
    cut = panel.withColumn("__block", block)
    ends = cut.groupBy(F.col(key).alias("__k"), F.col("__block").alias("__b")).agg(*(edge(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns))
    others = Window.partitionBy("__k").orderBy("__b")
    beyond = others.rowsBetween(Window.unboundedPreceding, -1) if ahead else others.rowsBetween(1, Window.unboundedFollowing)
    handed = ends.select("__k", "__b", *(nearest(c, ignorenulls=True).over(beyond).alias(f"__{c}") for c in columns))
    met = cut.join(handed, F.col(key).eqNullSafe(F.col("__k")) & F.col("__block").eqNullSafe(F.col("__b")))
    filled = {c: F.coalesce(nearest(c, ignorenulls=True).over(near), F.col(f"__{c}")) for c in columns}
    return met.withColumns(filled).select(*(f"`{c}`" for c in panel.columns))


def risk_free_on(rates: DataFrame, calendar: DataFrame, percent: str = "percent") -> DataFrame:
    """Annual rate as a decimal on every session from the first observation on, filled forward."""
    first = rates.agg(F.min("date").alias("first"))
    open_days = calendar.join(F.broadcast(first)).where(F.col("date") >= F.col("first")).select("date")
    known = rates.select("date", percent)
    aligned = open_days.join(known, "date", "left").withColumn("one", F.lit(1))
    return aligned.select("date", (forward_fill(F.col(percent), "one") / 100).alias("risk_free_annual"))


def as_of(days: DataFrame, slow: DataFrame, value: str, key: str | None = None, block: Column | None = None) -> DataFrame:
    """The latest value of a slow series on or before each row of days, by key if one is given.

    Both are merged in time order and filled forward within blocks of time (a year by default); the last value of
    each block, one row a block, is handed on to the blocks after it.
    """
    keys = [key] if key else []
    of, at = ([F.col(key).alias("__k")] if key else [F.lit(1).alias("__k")]), (time_block("date") if block is None else block)
    # Days are counted and values of one day reduced before anything is sorted.
    wanted = days.groupBy(*of, "date").agg(F.count("*").alias("__wanted"), F.lit(None).cast("double").alias("__v"))
    known = slow.where(F.col(value).isNotNull()).groupBy(*of, "date").agg(F.lit(0).cast("long").alias("__wanted"), F.max(F.col(value).cast("double")).alias("__v"))
    merged = wanted.unionByName(known).groupBy("__k", "date").agg(F.max("__v").alias("__v"), F.sum("__wanted").alias("__wanted")).withColumn("__block", at)
    ends = merged.groupBy("__k", "__block").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("date"))).alias("__end"))
    earlier = Window.partitionBy("__k").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(F.col("__k").alias("__of"), F.col("__block").alias("__b"), F.last("__end", ignorenulls=True).over(earlier).alias("__held"))
    met = merged.join(handed, F.col("__k").eqNullSafe(F.col("__of")) & F.col("__block").eqNullSafe(F.col("__b")))
    inside = Window.partitionBy("__k", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = met.withColumn("__now", F.coalesce(F.last("__v", ignorenulls=True).over(inside), "__held")).where("__wanted > 0")
    rows = filled.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__wanted")))
    return rows.select(*([F.col("__k").alias(key)] if keys else []), "date", F.col("__now").alias(value))


def gap_report(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions that an asset has no row for."""
    return _with_gaps(panel.select("asset", "date"), calendar).select("asset", F.explode("__gaps").alias("date"))


def common_dates(panel: DataFrame, value: str) -> DataFrame:
    """Rows on the dates on which all assets have a value."""
    assets = panel.agg(F.count_distinct("asset").alias("n_assets"))
    full = panel.groupBy("date").agg(F.count(value).alias("n")).join(F.broadcast(assets)).where("n = n_assets").select("date")
    return panel.join(full, "date", "left_semi")


def month_starts(rates: DataFrame, value: str) -> DataFrame:
    """A slow series: the mean of each month, dated on its first day."""
    return rates.groupBy(F.trunc("date", "month").alias("date")).agg(F.avg(value).alias(value))


def between(date: Column, start: str, end: str) -> Column:
    return date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
