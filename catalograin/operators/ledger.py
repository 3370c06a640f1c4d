"""Operational analytics: spending, prices, interval usage, percentiles, capacity and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNEE_SHARE = 0.95
PER_TOKENS = 1_000_000


def usage_windows(usage: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: cost and calls of today, the last `days` days and all time, estimated cost and unpriced calls, in one pass. Columns ts, cost, estimated."""
    today, recent = F.col("ts") >= F.date_trunc("day", now), F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")
    return usage.agg(
        F.sum(F.when(today, F.col("cost"))).alias("today"), F.sum(F.when(recent, F.col("cost"))).alias("recent"), F.sum("cost").alias("all_time"),
        F.count_if(today).alias("calls_today"), F.count_if(recent).alias("calls_recent"), F.count("*").alias("calls"), F.count_if(F.col("cost").isNull()).alias("unpriced"),
    )


def usage_by(usage: DataFrame, *groups: str) -> DataFrame:
    return usage.groupBy(*groups).agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def usage_summary(usage: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Spending in all groupings from one pass: (part, purpose, provider, model, funding, calls, unpriced, cost, estimated, today, recent, prompt_tokens, completion_tokens).

    part is `all`, `purpose`, `model` (by provider and model; a missing provider is `openrouter`) or `funding`. estimated is the cost of those calls whose
    price was estimated, today what was spent since midnight, recent in the last `days` days. Columns of usage: ts, purpose, provider, model, funding, cost,
    cost_estimated, prompt_tokens, completion_tokens.
    """
    rows = usage.withColumns({"provider": F.coalesce("provider", F.lit("openrouter")), "day": F.col("ts") >= F.date_trunc("day", now), "month": F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")})
    names = ["purpose", "provider", "model", "funding"]
    sets = {"all": [], "purpose": ["purpose"], "model": ["provider", "model"], "funding": ["funding"]}
    spent = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("cost"))), F.lit(0.0)).alias(name)
    summed = rows.groupingSets([[F.col(c) for c in s] for s in sets.values()], *names).agg(
        F.grouping_id(*names).alias("which"), F.count("*").alias("calls"), F.count_if(F.col("cost").isNull()).alias("unpriced"), spent(F.lit(True), "cost"), spent(F.col("cost_estimated"), "estimated"), spent(F.col("day"), "today"),
        spent(F.col("month"), "recent"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )
    part = F.lit(None).cast("string")
    for name, s in sets.items():
        bits = sum((c not in s) << (len(names) - 1 - i) for i, c in enumerate(names))
        part = F.when(F.col("which") == bits, name).otherwise(part)
    return summed.select(part.alias("part"), *names, "calls", "unpriced", "cost", "estimated", "today", "recent", "prompt_tokens", "completion_tokens")


def spent_since(usage: DataFrame, user_id: int, since: Column) -> DataFrame:
    """One row: what the platform paid for a user since a time."""
    return usage.where((F.col("user_id") == user_id) & (F.col("funding") == "platform") & (F.col("ts") >= since)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def with_cost(usage: DataFrame, prices: DataFrame, search_fee: float = 0.0) -> DataFrame:
    """`usage` with an estimated cost, null without a price.

    prices: (provider, model, input, output, cache_read, cache_write) for a million tokens. A model without a price of its own takes that
    of its name without `models/` before it, then without `:variant` after it. Cached tokens without a price of theirs cost as fresh ones.
    """
    bare = F.regexp_replace("model", "^models/", "")
    tried = {"own": F.col("model"), "bare": bare, "plain": F.regexp_replace(bare, ":.*$", "")}
    rows = usage
    for place, name in tried.items():  # a price list joins as it is broadcast or shuffled by Spark's own measure
        of = prices.select(F.col("provider").alias(f"{place} provider"), F.col("model").alias(f"{place} model"), F.struct("input", "output", "cache_read", "cache_write").alias(f"{place} price"))
        rows = rows.join(of, (F.col("provider") == F.col(f"{place} provider")) & (name == F.col(f"{place} model")), "left").drop(f"{place} provider", f"{place} model")
    rows = rows.withColumn("p", F.coalesce(*(F.col(f"{place} price") for place in tried))).drop(*(f"{place} price" for place in tried))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in usage.columns else F.lit(0)
    fresh = F.greatest(n("prompt_tokens") - n("cached_tokens") - n("written_tokens"), F.lit(0))
    total = fresh * F.col("p.input") + n("cached_tokens") * F.coalesce("p.cache_read", "p.input") + n("written_tokens") * F.coalesce("p.cache_write", "p.input") + n("completion_tokens") * F.col("p.output")
    return rows.withColumn("estimate", total / PER_TOKENS + n("web_searches") * search_fee).drop("p")


def prorated(intervals: DataFrame, start: str, end: str, value: str, low: Column, high: Column) -> DataFrame:
    """`intervals` that overlap [low, high), with `share` of the value and `seconds` of overlap. Empty intervals and missing ends at the window's end."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    stop = F.coalesce(F.col(end), high)
    overlap = F.least(seconds(stop), seconds(high)) - F.greatest(seconds(F.col(start)), seconds(low))
    whole = seconds(stop) - seconds(F.col(start))
    return intervals.withColumn("seconds", overlap).where(F.col("seconds") > 0).withColumn("share", F.col(value) * F.col("seconds") / whole)


def nearest_rank(column: str, p: float) -> Column:
    """The smallest value that at least a share p of the values do not exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def floor_index(values: DataFrame, column: str, p: float, *groups: str, near: float = 0.001) -> DataFrame:
    """(groups, value): the value at index min(n - 1, floor(p * n)) of the sorted values.

    Approximate percentiles on both sides bracket it; what lies below is counted, and only the distinct values within the bracket are put in order.
    """
    rows = values.where(F.col(column).isNotNull()).select(*groups, F.col(column).alias("v"))
    at = lambda q: F.percentile_approx("v", min(1.0, max(0.0, q)), F.lit(int(4 / near)))
    ends = rows.groupBy(*groups).agg(F.count("*").alias("n"), at(p - near).alias("low"), at(p + near).alias("high"), F.min("v").alias("least"), F.max("v").alias("most"))
    low = F.when(F.col("n") * near < 4, F.col("least")).otherwise(F.col("low"))
    high = F.when(F.col("n") * near < 4, F.col("most")).otherwise(F.col("high"))
    ends = ends.select(*groups, F.least(F.col("n") - 1, F.floor(F.col("n") * p)).alias("i"), low.alias("low"), high.alias("high"))
    placed = rows.join(ends, list(groups)) if groups else rows.crossJoin(F.broadcast(ends))  # without groups one row
    below = placed.where("v < low").groupBy(*groups).agg(F.count("*").alias("below"))
    inside = placed.where("v BETWEEN low AND high").groupBy(*groups, "v").agg(F.count("*").alias("k"), F.first("i").alias("i"))
    inside = inside.join(below, list(groups), "left") if groups else inside.crossJoin(F.broadcast(below))
    upto = F.coalesce("below", F.lit(0)) + F.sum("k").over(Window.partitionBy(*groups).orderBy("v"))
    return inside.withColumn("upto", upto).where(F.col("upto") > F.col("i")).groupBy(*groups).agg(F.min("v").alias("value"))


def knee(steps: DataFrame) -> DataFrame:
    """(run_id, knee): the fewest tabs without errors that reach 95 % of the best pages per minute, null if none does. Columns run_id, tabs, pages_per_min, errors."""
    best = F.max(F.when(F.col("errors") == 0, F.col("pages_per_min"))).over(Window.partitionBy("run_id"))
    return steps.withColumn("best", best).groupBy("run_id").agg(F.min(F.when((F.col("errors") == 0) & (F.col("pages_per_min") >= KNEE_SHARE * F.col("best")), F.col("tabs"))).alias("knee"))


def timings(rows: DataFrame) -> DataFrame:
    """(bucket, n, total, mean) of `rows(bucket, ms)`."""
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.avg("ms").alias("mean"))
