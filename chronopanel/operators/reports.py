"""Coverage diagnostics, attribution, verdicts and registry rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.operators.backtest import split_sessions

HORIZONS = (5, 21, 63, 126, 252)


def coverage(members: DataFrame, prices: DataFrame, features: DataFrame, labels: DataFrame, joined: DataFrame) -> DataFrame:
    """One row a member: rows and date range of every layer, and what lacks its counterpart.

    Each layer is aggregated by itself before it meets the members, so no layer multiplies another."""

    def layer(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("security_id").agg(F.count("*").alias(f"{name}_rows"), F.min("session").alias(f"{name}_start"), F.max("session").alias(f"{name}_end"))

    key = ["security_id", "session"]
    alone = labels.join(features, key, "left_anti").groupBy("security_id").agg(F.count("*").alias("label_without_feature_rows"))
    other = features.join(labels, key, "left_anti").groupBy("security_id").agg(F.count("*").alias("feature_without_label_rows"))
    out = members
    for df, name in ((prices, "price"), (features, "feature"), (labels, "label"), (joined, "joined")):
        out = out.join(layer(df, name), "security_id", "left").withColumn(f"{name}_rows", F.coalesce(f"{name}_rows", F.lit(0)))
    out = out.join(alone, "security_id", "left").join(other, "security_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("label_without_feature_rows", "feature_without_label_rows")})


def attribution(ranked: DataFrame, splits: DataFrame) -> DataFrame:
    """(security_id, selected_rows, selected_dates, windows, mean_return) of the rows selected inside test windows."""
    inside = ranked.join(split_sessions(splits.select("split", "test_from", "test_to"), "test").select("split", "idx"), "idx")
    return inside.groupBy("security_id").agg(
        F.count_if("selected").alias("selected_rows"), F.countDistinct(F.when(F.col("selected"), F.col("asof"))).alias("selected_dates"),
        F.countDistinct(F.when(F.col("selected"), F.col("split"))).alias("windows"), F.avg(F.when(F.col("selected"), F.col("ret"))).alias("mean_return"),
    )


def top_selected(tickers: DataFrame, limit: int) -> DataFrame:
    return tickers.orderBy(F.desc("selected_rows"), F.desc("windows"), F.desc_nulls_last("mean_return"), F.desc("security_id")).limit(limit)


def concentration(tickers: DataFrame) -> DataFrame:
    """One row: total, Herfindahl index, effective count, top-1 and top-5 share of selections."""
    total = tickers.agg(F.sum("selected_rows").alias("total"))
    top = top_selected(tickers, 5).agg(F.sum("selected_rows").alias("top5"), F.max("selected_rows").alias("top1"))
    squares = tickers.join(F.broadcast(total), F.lit(True)).groupBy("total").agg(F.sum(F.pow(F.try_divide("selected_rows", "total"), F.lit(2))).alias("hhi"))
    row = squares.join(F.broadcast(top), F.lit(True))
    return row.select(
        "total", "hhi", F.try_divide(F.lit(1.0), "hhi").alias("effective"), F.try_divide("top1", "total").alias("top1_share"), F.try_divide("top5", "total").alias("top5_share"),
    )


def selection_overlap(target: DataFrame, other: DataFrame) -> DataFrame:
    """One row: securities of the target that the other also selects, and the share of selections they cover."""
    chosen = target.where("selected_rows > 0")
    theirs = other.where("selected_rows > 0").select("security_id", F.lit(True).alias("both"))
    joined = chosen.join(theirs, "security_id", "left")
    covered = F.sum(F.when(F.col("both"), F.col("selected_rows")).otherwise(0))
    return joined.agg(F.count("both").alias("overlap"), F.count("*").alias("target"), F.try_divide(covered, F.sum("selected_rows")).alias("covered_share"))


def walk_forward_evidence(windows: DataFrame, min_windows: int, min_rate: float, by: list[str]) -> DataFrame:
    """(by..., scored, positive, positive_rate, mean_difference, status, failure_reason)."""
    base = windows.groupBy(*by).agg(F.count("*").alias("scored"), F.count_if(F.col("difference") > 0).alias("positive"), F.avg("difference").alias("mean_difference"))
    rows = base.withColumn("positive_rate", F.try_divide("positive", "scored"))
    few, weak = F.col("scored") < min_windows, F.coalesce(F.col("positive_rate") < min_rate, F.lit(True)) | F.coalesce(F.col("mean_difference") <= 0, F.lit(True))
    return rows.withColumn("status", F.when(few, "insufficient_data").when(weak, "failed").otherwise("passed")).withColumn(
        "failure_reason", F.when(few, "insufficient_walk_forward_windows").when(weak, "walk_forward_unstable")
    )


def harder_status(failure: Column, scramble_pass: Column) -> Column:
    """Struct (status, reason): what the evidence and the permutation test add to a verdict; null where nothing."""
    pair = lambda a, b: F.struct(F.lit(a).alias("status"), b.alias("reason"))
    return (
        F.when(failure.isNotNull(), pair("rejected", failure)).when(scramble_pass == F.lit(False), pair("rejected", F.lit("label_scramble_failed")))
        .when(scramble_pass.isNull(), pair("failed", F.lit("label_scramble_missing")))
    )


def evaluation_status(status: Column, scramble_pass: Column) -> Column:
    """Registry status inferred from a finished or unfinished run."""
    done = status == "succeeded"
    return (
        F.when(status == "running", "running").when(status == "failed", "failed").when(status == "insufficient_data", "rejected")
        .when(done & (scramble_pass == F.lit(False)), "rejected").when(done & scramble_pass, "promising").otherwise("failed")
    )


def evaluation_reason(status: Column, scramble_pass: Column) -> Column:
    """Why a run's registry status is what ``evaluation_status`` says, where it needs a reason."""
    done = status == "succeeded"
    return (
        F.when(status == "running", F.lit(None).cast("string")).when(status == "failed", "backtest_failed").when(status == "insufficient_data", "insufficient_data")
        .when(done & (scramble_pass == F.lit(False)), "label_scramble_failed").when(done & scramble_pass, F.lit(None).cast("string")).otherwise(F.concat(F.lit("unsupported_backtest_status:"), status))
    )


def year_drivers(windows: DataFrame) -> DataFrame:
    """(year, windows, total, mean, positive, worst, best, share): what each year of test windows adds to the whole."""
    whole = windows.agg(F.sum("difference").alias("whole"))
    per = windows.groupBy(F.year("test_start").cast("bigint").alias("year")).agg(
        F.count("*").alias("windows"), F.sum("difference").alias("total"), F.avg("difference").alias("mean"), F.count_if(F.col("difference") > 0).alias("positive"), F.min("difference").alias("worst"), F.max("difference").alias("best"))
    return per.join(F.broadcast(whole), F.lit(True)).withColumn("share", F.try_divide("total", "whole")).drop("whole")


#: What the reasons of verdicts mean.
MEANINGS = {
    "passed": "beats the equal-weight baseline after costs", "baseline_failed": "does not beat the equal-weight baseline after costs", "insufficient_data": "too few sessions for a window", "running": "not finished",
    "insufficient_walk_forward_windows": "too few scored windows to tell", "walk_forward_unstable": "too few windows beat the baseline, or their mean does not", "label_scramble_failed": "permuted labels do as well",
}


def glossary(cells: DataFrame) -> DataFrame:
    """(reason, n, meaning, example) of the reasons that occur."""
    meaning = F.lit(None).cast("string")
    for name, text in MEANINGS.items():
        meaning = F.when(F.col("reason") == name, text).otherwise(meaning)
    key = F.concat("base_key", F.lit("__h"), F.col("horizon").cast("string"))
    return cells.groupBy("reason").agg(F.count("*").alias("n"), F.min(key).alias("example")).select("reason", "n", meaning.alias("meaning"), "example")


def derived_verdict(rows: DataFrame) -> DataFrame:
    """Adds verdict and reason.  rows: run_id, status, evaluation, failure, scramble_pass, difference."""
    s, f, net = F.col("status"), F.col("failure"), F.col("difference")
    steps = [
        (F.col("run_id").isNull(), "untested", F.lit("not_run")),
        (s == "running", "running", F.coalesce(f, F.lit("running"))),
        (s == "failed", "failed", F.coalesce(f, F.lit("backtest_failed"))),
        (s == "insufficient_data", "insufficient_data", F.coalesce(f, F.lit("insufficient_data"))),
        (s.isNull() | (s != "succeeded"), "failed", F.coalesce(f, F.concat(F.lit("unsupported_status:"), F.coalesce(s, F.lit("None"))))),
        (f.isNotNull() & (F.col("evaluation") == "rejected"), "rejected", f),
        (F.col("scramble_pass") == F.lit(False), "rejected", F.coalesce(f, F.lit("label_scramble_failed"))),
        (net.isNull(), "rejected", F.coalesce(f, F.lit("baseline_missing"))),
        (net <= 0, "rejected", F.coalesce(f, F.lit("baseline_failed"))),
        (F.col("evaluation") == "accepted", "accepted", F.lit("passed")),
    ]
    verdict, reason = F.lit("promising"), F.lit("passed")
    for test, name, why in reversed(steps):
        verdict, reason = F.when(test, name).otherwise(verdict), F.when(test, why).otherwise(reason)
    return rows.withColumn("verdict", verdict).withColumn("reason", reason)


def adjacent_health(cells: DataFrame) -> DataFrame:
    """Adds health: what the neighbouring horizons of the same hypothesis say.  cells: base_key, horizon, verdict, difference."""
    place = F.array_position(F.array(*[F.lit(h).cast("bigint") for h in HORIZONS]), F.col("horizon"))
    cells = cells.withColumn("place", place)
    near = cells.select("base_key", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), F.col("verdict").isin("accepted", "promising").alias("good"), (F.col("difference").isNull() | (F.col("difference") <= 0)).alias("bad"))
    told = near.groupBy("base_key", "place").agg(F.bool_or("good").alias("good"), F.bool_or("bad").alias("bad"))
    health = F.when(F.col("good").isNull(), "unknown").when(F.col("good"), "supportive").when(F.col("bad"), "weak").otherwise("mixed")
    return cells.join(told, ["base_key", "place"], "left").withColumn("health", health).drop("place", "good", "bad")


def cost_multiple(difference: Column, cost_bps: Column) -> Column:
    return F.when(cost_bps > 0, difference / (cost_bps / 10_000.0))


def cost_class(multiple: Column) -> Column:
    return F.when(multiple.isNull(), "unknown").when(multiple >= 5, "low").when(multiple >= 1, "medium").otherwise("high")


def promising_recommendation(edge: Column, p_value: Column, rate: Column, multiple: Column, health: Column) -> Column:
    """deep_dive, watch or demote for a promising cell."""
    return (
        F.when(p_value.isNull(), "watch").when(edge.isNull(), "demote").when(multiple < 1, "demote").when(rate < 0.60, "demote")
        .when((edge >= 0.01) & (multiple.isNull() | (multiple >= 5)) & (health != "weak"), "deep_dive").otherwise("watch")
    )


def deep_dive_recommendation(verdict: Column, edge: Column, rate: Column, multiple: Column, health: Column, top_share: Column) -> Column:
    """continue, watch or demote for a cell under closer review; a missing cost multiple is a concern, not a demotion."""
    concern = rate.isNull() | (rate < 0.65) | health.isin("weak", "mixed", "unknown") | multiple.isNull() | top_share.isNull() | (top_share >= 0.20)
    return (
        F.when(verdict != "promising", "demote").when(edge.isNull() | (edge <= 0), "demote").when(multiple < 1, "demote").when(rate < 0.60, "demote")
        .when(concern, "watch").otherwise("continue")
    )


def horizon_matrix(cells: DataFrame) -> DataFrame:
    """base_key x horizon verdicts, ``pending`` where a cell has not been run."""
    wide = cells.groupBy("base_key").pivot("horizon", list(HORIZONS)).agg(F.first("verdict"))
    return wide.select("base_key", *[F.coalesce(F.col(str(h)), F.lit("pending")).alias(f"h{h}") for h in HORIZONS])


def bucket_heatmap(windows: DataFrame) -> DataFrame:
    """(year, signs, total, positive): + where a window's difference is above zero, in window order."""
    sign = F.when(F.col("difference") > 0, "+").otherwise("-")
    per = windows.groupBy(F.year("test_start").cast("bigint").alias("year")).agg(
        F.sort_array(F.collect_list(F.struct("test_start", sign.alias("sign")))).alias("marks"), F.sum("difference").alias("total"), F.count_if(F.col("difference") > 0).alias("positive")
    )
    return per.select("year", F.array_join(F.col("marks.sign"), "").alias("signs"), "total", "positive")


def temporal_concentration(windows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., top_share, windows): the largest positive window as a share of all positive ones; null without any."""
    gains = F.sum(F.when(F.col("difference") > 0, F.col("difference")))
    return windows.groupBy(*by).agg(F.when(gains > 0, F.max("difference") / gains).alias("top_share"), F.count("*").alias("windows"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def research_results(hypotheses: DataFrame, runs: DataFrame, keep: str = "succeeded") -> DataFrame:
    """hypotheses (hypothesis) with run, score and evaluation of the newest run of status ``keep``, and counts of all runs and of those.

    runs: hypothesis, run, status, at, score, evaluation; a tie in time goes to the larger run.  Without such a run the
    evaluation is ``not_evaluated``."""
    newest = F.max(F.when(F.col("status") == keep, F.struct("at", "run", "score", "evaluation"))).alias("best")
    per = runs.groupBy("hypothesis").agg(newest, F.count("*").alias("runs"), F.count_if(F.col("status") == keep).alias(keep))
    rows = hypotheses.join(per, "hypothesis", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("hypothesis", "best.run", "best.score", F.coalesce("best.evaluation", F.lit("not_evaluated")).alias("evaluation"), zero("runs"), zero(keep))


def base_key(hypothesis: Column) -> Column:
    """The key without its ``__h`` horizon suffix."""
    return F.regexp_replace(hypothesis, r"__h[^_]*$", "")


def family(feature: Column) -> Column:
    fundamental = ["revenue_growth_yoy", "gross_margin", "operating_margin", "net_margin", "diluted_shares_change_yoy"]
    return F.when(feature.isin(*fundamental), "fundamentals").when(feature == "unknown", "unknown").otherwise("price")


def benjamini_hochberg(p: DataFrame, alpha: float) -> DataFrame:
    """Adds q_value and rejected for a small table of p-values (beyond the reference: its specification only)."""
    n, k = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy("p_value", "key"))
    raw = p.withColumn("k", k).withColumn("q", F.least(F.lit(1.0), F.col("p_value") * n / k))
    q = F.min("q").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("q_value", q).withColumn("rejected", F.col("q_value") <= alpha).drop("k", "q")
