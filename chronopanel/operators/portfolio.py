"""Portfolios of ranked members: weights under caps, halts after losses, and the size that costs and liquidity allow.

Caps make weights a water level: every member's weight grows in proportion to its score until the member or its sector is
full, and the level is where the weights sum to one.  What a level gives is piecewise linear, so it is found from sorted
breakpoints and running sums, without rounds of redistribution; those would end at the same weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Half-spreads in basis points by what is traded a day, in dollars: the first whose bound is passed.
SPREADS = ((100e6, 5.0), (10e6, 15.0), (0.0, 40.0))
IMPACT_BPS, IMPACT_CAP_BPS = 10.0, 50.0


def _level(rows: DataFrame, keys: list[str], slope: Column, full: Column, target: Column, name: str) -> DataFrame:
    """(keys..., name): the level t at which the sum over rows of slope * min(t, full) is ``target``; null where it never is.

    rows: one group a ``keys``.  Up to the k-th smallest ``full`` the sum grows by the slopes that aren't full yet."""
    order = Window.partitionBy(*keys).orderBy("__full").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # rows that are full at the same level are one
    r = rows.select(*keys, slope.alias("__slope"), full.alias("__full"), target.alias("__target")).groupBy(*keys, "__full").agg(F.sum("__slope").alias("__slope"), F.first("__target").alias("__target"))
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    r = r.withColumns({"__held": before(F.col("__slope") * F.col("__full")), "__open": F.sum("__slope").over(whole) - before(F.col("__slope"))})
    reach = F.col("__held") + F.col("__full") * F.col("__open")
    at = (F.col("__target") - F.col("__held")) / F.col("__open")
    return r.where(reach >= F.col("__target") - 1e-15).groupBy(*keys).agg(F.min_by(at, "__full").alias(name))


def capped_weights(rows: DataFrame, score: str, by: str = "asof", sector: str = "sector", member: str = "security_id", position_cap: float = 0.05, sector_cap: float = 0.3) -> DataFrame:
    """(by, member, sector, weight): weights in proportion to positive scores, of which none is above ``position_cap``, no
    sector's sum above ``sector_cap``, and the sum is one, or as near as the caps allow.

    Members with a score of zero, below or null have no weight and no row."""
    held = rows.where(F.col(score) > 0).select(by, member, sector, (F.col(score) / F.sum(score).over(Window.partitionBy(by))).alias("__s"))
    alone = F.lit(position_cap) / F.col("__s")
    sectors = _level(held, [by, sector], F.col("__s"), alone, F.lit(sector_cap), "__sector")
    stops = held.join(sectors, [by, sector], "left").withColumn("__stop", F.least(alone, F.coalesce("__sector", alone)))
    levels = _level(stops, [by], F.col("__s"), F.col("__stop"), F.lit(1.0), "__all")
    weight = F.col("__s") * F.least(F.col("__stop"), F.coalesce("__all", "__stop"))
    return stops.join(levels, by, "left").select(by, member, sector, weight.alias("weight"))


def weight_faults(weights: DataFrame, by: str = "asof", position_cap: float = 0.05, sector_cap: float = 0.3, top10_cap: float | None = None) -> DataFrame:
    """(by, fault): what is wrong with a date's weights: a position, a sector, the ten largest, or their sum."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight")))
    sectors = weights.groupBy(by, "sector").agg(F.sum("weight").alias("w")).groupBy(by).agg(F.max("w").alias("sector"))
    dates = weights.withColumn("k", rank).groupBy(by).agg(F.max("weight").alias("most"), F.sum("weight").alias("total"), F.sum(F.when(F.col("k") <= 10, F.col("weight"))).alias("top10")).join(sectors, by)
    checks = [F.when(F.col("most") > position_cap + 1e-9, "position"), F.when(F.col("sector") > sector_cap + 1e-9, "sector"), F.when(F.abs(F.col("total") - 1) > 1e-9, "sum")]
    if top10_cap is not None:
        checks.append(F.when(F.col("top10") > top10_cap + 1e-9, "top10"))
    return dates.select(by, F.explode(F.array_compact(F.array(*checks))).alias("fault"))


def halts(path: DataFrame, days: int = 30, halt: float = -0.10, resume: float = -0.05) -> DataFrame:
    """(series, date, rolling, halted, event): whether new entries are paused on each date of an equity path.

    rolling: the growth since the newest date at least ``days`` days before, null at first.  Below ``halt`` entries pause,
    and they stay paused until it is ``resume`` or more; a date on which that changes has an event."""
    number = F.unix_date(F.col("date").cast("date"))
    past = Window.partitionBy("series").orderBy(number).rangeBetween(Window.unboundedPreceding, -days)
    along = Window.partitionBy("series").orderBy("date")
    rolling = F.col("equity") / F.last("equity").over(past) - 1
    signal = F.when(F.col("rolling") < halt, True).when(F.col("rolling") >= resume, False)
    state = F.coalesce(F.last(signal, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    rows = path.withColumn("rolling", rolling).withColumn("halted", state)
    before = F.coalesce(F.lag("halted").over(along), F.lit(False))
    return rows.select("series", "date", "rolling", "halted", F.when(F.col("halted") & ~before, "drawdown_halt").when(~F.col("halted") & before, "resumed").alias("event"))


def half_spread_bps(adv: Column) -> Column:
    out = F.lit(SPREADS[-1][1])
    for bound, bps in reversed(SPREADS[:-1]):
        out = F.when(adv > bound, bps).otherwise(out)
    return out


def capacity(positions: DataFrame, by: str = "asof", turnover: float = 1.0, adv_share: float = 0.05, cost_share: float = 0.2) -> DataFrame:
    """(by, liquidity, impact, capacity): the largest size in dollars that all of a date's positions allow.

    positions: by, weight, adv, expected (the portfolio's expected return, the same in all rows of a date).  liquidity: what
    is traded of each position, weight * size * turnover, is at most ``adv_share`` of what trades a day.  impact: spread and
    impact of all trades cost at most ``cost_share`` of the expected return; the impact of a trade is 10 basis points times
    the root of its share of the day's volume, 50 at most, so the cost is piecewise linear in the root of the size and is
    solved at sorted breakpoints.  A size is null where nothing bounds it, and zero where the spread alone costs too much."""
    w, adv = F.col("weight"), F.col("adv")
    rows = positions.where((w > 0) & (adv > 0))
    per_root = F.lit(IMPACT_BPS) * F.sqrt(w * turnover / adv)  # basis points for each root of a dollar
    budget = F.first(F.col("expected") * cost_share * 1e4) - F.sum(w * turnover * half_spread_bps(adv))
    totals = rows.groupBy(by).agg(F.min(F.lit(adv_share) * adv / (w * turnover)).alias("liquidity"), budget.alias("__budget"))
    held = rows.join(totals, by)
    level = _level(held.where("__budget > 0"), [by], w * turnover * per_root, F.lit(IMPACT_CAP_BPS) / per_root, F.col("__budget"), "__root")
    out = totals.join(level, by, "left").withColumn("impact", F.when(F.col("__budget") <= 0, 0.0).otherwise(F.col("__root") * F.col("__root")))
    return out.select(by, "liquidity", "impact", F.least("liquidity", F.coalesce("impact", "liquidity")).alias("capacity"))


def capacity_mode(size: Column, degraded: float = 5e6, halted: float = 1e6) -> Column:
    return F.when(size < halted, "halted").when(size < degraded, "degraded").otherwise("normal")
