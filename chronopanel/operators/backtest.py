"""Walk-forward ranking tests: splits, scores, windows, regressions, regimes and label permutation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

def feature_label_rows(features: DataFrame, labels: DataFrame, members: DataFrame | None = None, direction: str = "high") -> DataFrame:
    """(security_id, asof, idx, horizon_session, feature, ret): the inner join on security and as-of session.

    ``low`` ranks by the negated feature; the target is the excess return where there is one.  Members are a small
    dimension whose interval is a residual of the equi-join."""
    f = features.where("status = 'ok'").select("security_id", F.col("session").alias("asof"), "idx", F.col("value").alias("raw_feature"))
    ls = labels.where("skip_reason is null").select("security_id", F.col("session").alias("asof"), "horizon_session", F.coalesce("excess_return", "raw_return").alias("ret"))
    rows = f.join(ls, ["security_id", "asof"])
    if members is not None:
        m = members.select(F.col("security_id").alias("m_id"), "valid_from", "valid_to")
        rows = rows.join(m, (F.col("security_id") == F.col("m_id")) & (F.col("asof") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("asof") <= F.col("valid_to")))).drop("m_id", "valid_from", "valid_to")
    return rows.withColumn("feature", -F.col("raw_feature") if direction == "low" else F.col("raw_feature")).drop("raw_feature")


def splits_within(bounds: DataFrame, horizon: int | Column, min_train: int, test: int, step: int, max_train: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., split, train_from, train_to, test_from, test_to) as session numbers, with a gap of ``horizon`` sessions.

    bounds: by..., base, n: the first session number and how many there are.  No row where they are too few."""
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    first, last = (F.lit(min_train) + h).cast("bigint"), (F.col("n") - test - h).cast("bigint")
    starts = bounds.where(last >= first).select(*by, "base", h.alias("__h"), F.posexplode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("split", "at"))
    train_to = F.col("at") - F.col("__h") - 1
    train_from = F.greatest(F.lit(0), train_to - (max_train - 1)) if max_train else F.lit(0)
    return starts.select(
        *by, F.col("split").cast("bigint").alias("split"), (F.col("base") + train_from).alias("train_from"), (F.col("base") + train_to).alias("train_to"),
        (F.col("base") + F.col("at")).alias("test_from"), (F.col("base") + F.col("at") + test - 1).alias("test_to"),
    )


def plan_splits(sessions: DataFrame, horizon: int, min_train: int, test: int, step: int, max_train: int | None = None) -> DataFrame:
    """The splits of a table of consecutive session numbers idx."""
    return splits_within(sessions.agg(F.min("idx").alias("base"), F.count("*").alias("n")), horizon, min_train, test, step, max_train)


def split_sessions(splits: DataFrame, phase: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., split, idx, ...): a row for each session of the splits' ``train`` or ``test`` phase, so rows meet it by equality."""
    rest = [c for c in splits.columns if c not in (*by, "split")]
    return splits.select(*by, "split", *rest, F.explode(F.sequence(f"{phase}_from", f"{phase}_to")).alias("idx"))


def covered_sessions(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """The sessions from the first as-of to the last outcome of ``rows``."""
    bounds = rows.agg(F.min("asof").alias("a"), F.max("horizon_session").alias("b"))
    return sessions.join(F.broadcast(bounds), (F.col("session") >= F.col("a")) & (F.col("session") <= F.col("b"))).drop("a", "b")


def select_top_half(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rn, n, selected: rank per date by feature, then security; the best max(1, n // 2) are selected."""
    by_date = Window.partitionBy(*by, "asof")
    rn = F.row_number().over(by_date.orderBy(F.desc("feature"), F.asc("security_id"))).cast("bigint")
    ranked = rows.withColumn("rn", rn).withColumn("n", F.count("*").over(by_date))
    return ranked.withColumn("selected", F.col("rn") <= F.greatest(F.lit(1), F.expr("n div 2")))


def date_scores(rows: DataFrame, cost_bps: float = 20.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Per ``by`` and date: candidates, selected, strategy and equal-weight return net of cost."""
    cost = cost_bps / 10_000.0
    return select_top_half(rows, by).groupBy(*by, "asof", "idx").agg(
        F.count("*").alias("candidates"), F.sum(F.col("selected").cast("bigint")).alias("selected"),
        (F.avg(F.when(F.col("selected"), F.col("ret"))) - cost).alias("strategy_net"), (F.avg("ret") - cost).alias("baseline_net"),
    )


def window_scores(scores: DataFrame, splits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per ``by`` and split with train and test rows: dates, observations, mean net returns and their difference.

    Dates, not rows, meet the splits: the panel is reduced to one row a date, and splits are laid out by session."""
    keyed = [*by, "split"]
    trained = scores.join(split_sessions(splits, "train", by), [*by, "idx"]).groupBy(*keyed).agg(F.sum("candidates").alias("train_rows"))
    tested = scores.join(split_sessions(splits, "test", by), [*by, "idx"]).groupBy(*keyed).agg(
        F.count("*").alias("test_dates"), F.sum("candidates").alias("test_rows"), F.min("asof").alias("test_start"), F.max("asof").alias("test_end"),
        F.avg("strategy_net").alias("strategy_net"), F.avg("baseline_net").alias("baseline_net"),
    )
    return trained.join(tested, keyed).withColumn("difference", F.col("strategy_net") - F.col("baseline_net"))


def headline(windows: DataFrame) -> DataFrame:
    """One row over the windows; ratios are null where the deviation is null or zero."""
    sd = F.stddev_samp("difference")
    return windows.agg(
        F.count("*").alias("windows"), F.sum("test_dates").alias("dates"), F.avg("strategy_net").alias("mean_strategy"), F.avg("baseline_net").alias("mean_baseline"),
        F.avg("difference").alias("mean_difference"), F.avg(F.when(F.col("difference") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), sd.alias("sd_difference"),
        F.try_divide(F.avg("difference"), F.nullif(sd, F.lit(0.0))).alias("mean_over_sd"),
    )


def failure_modes(row: Column, skipped_train: Column, skipped_test: Column) -> Column:
    """Codes of what weakens a result, in a fixed order."""
    return F.array_compact(F.array(
        F.when(skipped_train > 0, "windows_without_train"), F.when(skipped_test > 0, "windows_without_test"),
        F.when((row["dates"] > 0) & (row["dates"] < 5), "small_sample"), F.when(row["mean_strategy"] <= row["mean_baseline"], "baseline_not_exceeded"),
    ))


def walk_forward_ols(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, train_pairs, slope, intercept, fitted): one-regressor least squares per split.

    Counts, means and central moments per date come first; a split merges those of its dates, which loses no digits
    where the mean is large against the spread.  A constant feature has slope 0 and the mean return as intercept."""
    per = rows.groupBy("idx").agg(
        F.count("*").alias("n"), F.avg("feature").alias("mx"), F.avg("ret").alias("my"), F.var_pop("feature").alias("vx"), F.covar_pop("feature", "ret").alias("cxy"),
        F.min("feature").alias("low"), F.max("feature").alias("high"))
    held = per.join(split_sessions(splits, "train"), "idx")
    n = F.col("n")
    means = held.groupBy("split").agg(F.sum("n").alias("pairs"), (F.sum(n * F.col("mx")) / F.sum("n")).alias("ax"), (F.sum(n * F.col("my")) / F.sum("n")).alias("ay"), (F.min("low") < F.max("high")).alias("varies"))
    dx, dy = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")
    total = held.join(means, "split").groupBy("split", "pairs", "ax", "ay", "varies").agg(F.sum(n * (F.col("vx") + dx * dx)).alias("sxx"), F.sum(n * (F.col("cxy") + dx * dy)).alias("sxy"))
    slope = F.when(F.col("varies") & (F.col("sxx") > 0), F.col("sxy") / F.col("sxx"))
    out = total.withColumn("fitted", slope.isNotNull()).withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    return out.select("split", F.col("pairs").alias("train_pairs"), "slope", (F.col("ay") - F.col("slope") * F.col("ax")).alias("intercept"), "fitted")


def predictions(rows: DataFrame, splits: DataFrame, models: DataFrame) -> DataFrame:
    """Test rows of each split with the model's score."""
    s = split_sessions(splits.select("split", "test_from", "test_to"), "test").select("split", "idx").join(models.select("split", "slope", "intercept"), "split")
    return rows.join(s, "idx").withColumn("score", F.col("intercept") + F.col("slope") * F.col("feature"))


def long_short(rows: DataFrame, score: str, quantile: float, by: list[str]) -> DataFrame:
    """(by..., dates, spread): mean over dates of the best bucket's return minus the worst one's."""
    w = Window.partitionBy(*by, "asof")
    ranked = rows.withColumn("k", F.row_number().over(w.orderBy(F.asc(score), F.asc("security_id")))).withColumn("n", F.count("*").over(w))
    size = F.greatest(F.lit(1), F.floor(F.col("n") * quantile))
    ranked = ranked.withColumn("b", F.when(size * 2 > F.col("n"), F.expr("n div 2")).otherwise(size)).where("b >= 1")
    per = ranked.groupBy(*by, "asof").agg((F.avg(F.when(F.col("k") > F.col("n") - F.col("b"), F.col("ret"))) - F.avg(F.when(F.col("k") <= F.col("b"), F.col("ret")))).alias("spread"))
    return per.groupBy(*by).agg(F.count("*").alias("dates"), F.avg("spread").alias("spread"))


def long_short_cost(horizon: int, turnover: float = 1.0, half_spread_bps: float = 5.0, impact_bps: float = 5.0, borrow_bps: float = 50.0) -> float:
    return 2 * turnover * (half_spread_bps + impact_bps) / 1e4 + borrow_bps / 1e4 * horizon / 252


def guard_violations(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows whose label would not have been known: train labels at or after the test start, outcomes before as-ofs.

    rows: idx, outcome_idx.  An empty result is a pass; nothing is dropped silently."""
    train = rows.join(split_sessions(splits, "train"), "idx").where(F.col("outcome_idx") >= F.col("test_from"))
    order = rows.where(F.col("outcome_idx") <= F.col("idx"))
    return train.select("security_id", "idx", "split", F.lit("train_label_late").alias("fault")).union(order.select("security_id", "idx", F.lit(None).cast("bigint"), F.lit("outcome_before_asof")))


def regime_summary(samples: DataFrame, regimes: DataFrame, date: str, value: str) -> DataFrame:
    """Per regime: counts, mean, deviation, extremes and hit rate; empty regimes stay; an uncovered date is an error.

    regimes: name, start_date, end_date, a small dimension."""
    covered = samples.join(F.broadcast(regimes), F.col(date).between(F.col("start_date"), F.col("end_date")), "left")
    checked = covered.withColumn("name", F.coalesce("name", F.raise_error(F.concat(F.lit("no regime covers "), F.col(date).cast("string"))).cast("string")))
    stats = checked.groupBy("name").agg(
        F.count("*").alias("sample_count"), F.count(value).alias("value_count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(F.when(F.col(value) > 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("hit_rate"),
    )
    out = regimes.select("name").join(stats, "name", "left")
    return out.withColumn("sample_count", F.coalesce("sample_count", F.lit(0))).withColumn("value_count", F.coalesce("value_count", F.lit(0)))


def regime_faults(regimes: DataFrame) -> DataFrame:
    """(name, fault): reversed, overlapping, not contiguous or repeated regimes; a small dimension."""
    order = Window.orderBy("start_date")
    r = regimes.withColumn("before", F.lag("end_date").over(order)).withColumn("times", F.count("*").over(Window.partitionBy("name")))
    fault = (
        F.when(F.col("start_date") > F.col("end_date"), "reversed").when(F.col("start_date") <= F.col("before"), "overlap")
        .when(F.datediff("start_date", "before") > 1, "gap").when(F.col("times") > 1, "repeated")
    )
    return r.withColumn("fault", fault).where("fault is not null").select("name", "fault")


#: Modulus of the permutations' keys, a prime below 2**31, so products of two of them fit in 64 bits.
_PRIME = 2147483647


def scramble_hash(sample_id: Column, seed: int) -> Column:
    """The number that a sample's keys in all trials come from: the first 32 bits of md5("seed|sample_id")."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), sample_id.cast("string"))), 1, 8), 16, 10).cast("long")


def trial_keys(hashes: np.ndarray, trials: int) -> np.ndarray:
    """Keys (trial, sample) by which a trial orders a group: two rounds of products modulo a prime, exact in any engine."""
    x = (hashes[None, :] + np.arange(1, trials + 1)[:, None] * 1000003) % _PRIME
    for add in (40014, 30011):
        x = x * 48271 % _PRIME
        x = x * (x % 65536 + add) % _PRIME
    return x


def scramble_trials(samples: DataFrame, trials: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., trial, group_key, m): the mean label of samples with feature 1 after permuting labels within groups.

    samples: by..., sample_id, group_key, feature, label.  In a trial a group's labels are put in the order of their samples'
    keys, ties by id, and laid on the samples in the order of ids.  The order is a function of seed, trial and id alone, not
    of a generator that is drawn from in turn, so groups are independent and any engine gives the same; p-values differ from
    those of a sequential generator as two seeds' do.  All that share a group key, the cross-sections of one date, are a
    task's unit; only means leave it."""
    keyed = samples.select(*by, "group_key", "sample_id", "feature", "label", scramble_hash(F.col("sample_id"), seed).alias("h"))

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, rows in (part.groupby(list(by), sort=False) if by else [((), part)]):
            rows = rows.sort_values("sample_id", kind="stable")
            chosen, labels = rows["feature"].to_numpy(float) == 1, rows["label"].to_numpy(float)
            if chosen.any():
                drawn = np.argsort(trial_keys(rows["h"].to_numpy(np.int64), trials), axis=1, kind="stable")
                means = labels[drawn][:, chosen].mean(axis=1)
            else:
                means = np.full(trials, np.nan)
            out.append(pd.DataFrame({**dict(zip(by, name)), "group_key": rows["group_key"].iloc[0], "m": means, "trial": np.arange(1, trials + 1)}))
        found = pd.concat(out)
        return found.assign(m=found["m"].astype("Float64"))[[*by, "trial", "group_key", "m"]]

    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "trial long", f"group_key {kinds['group_key']}", "m double"])
    return keyed.groupBy("group_key").applyInPandas(draw, schema)


def selected_mean(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., score): per group the mean label of samples with feature 1, then the mean over groups."""
    per = rows.groupBy(*by, "group_key").agg(F.avg(F.when(F.col("feature") == 1, F.col("label"))).alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("score"))


def scramble_p_value(samples: DataFrame, trials: int = 100, seed: int = 44, alternative: str = "greater", alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., observed, rank, trials, p_value = rank / (trials + 1), passed), a row for each of ``by``."""
    observed = selected_mean(samples, by).withColumnRenamed("score", "observed")
    scores = scramble_trials(samples, trials, seed, by).groupBy(*by, "trial").agg(F.avg("m").alias("score"))
    extreme = {"greater": F.col("score") >= F.col("observed"), "less": F.col("score") <= F.col("observed"), "two_sided": F.abs("score") >= F.abs("observed")}[alternative]
    both = scores.join(observed, list(by)) if by else scores.join(F.broadcast(observed), F.lit(True))  # one row
    rank = both.groupBy(*by, "observed").agg((F.sum(extreme.cast("bigint")) + 1).alias("rank"), F.count("*").alias("trials"))
    out = rank.withColumn("p_value", F.col("rank") / (F.col("trials") + 1))
    return out.withColumn("passed", F.col("p_value") <= alpha)
