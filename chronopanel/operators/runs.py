"""Results of a falsifier run: outcome and failure modes, pooled metrics, fingerprints, replay, traceability, report text."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.operators import backtest as B
from chronopanel.operators import ranks


def planned_windows(scores: DataFrame, splits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every planned split with its train and test rows and, where it has both, its scores; ``skipped`` says what it lacks."""
    keyed = [*by, "split"]

    def rows_of(phase: str) -> DataFrame:
        return scores.join(B.split_sessions(splits, phase, by), [*by, "idx"]).groupBy(*keyed).agg(F.sum("candidates").alias(f"{phase}_rows"))

    scored = B.window_scores(scores, splits, by).drop("train_rows", "test_rows")
    out = splits.join(rows_of("train").withColumnRenamed("train_rows", "trained"), keyed, "left").join(rows_of("test").withColumnRenamed("test_rows", "tested"), keyed, "left").join(scored, keyed, "left")
    return out.withColumn("skipped", F.when(F.col("trained").isNull(), "no_train").when(F.col("tested").isNull(), "no_test"))


def falsifier_result(planned: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: status, planned and scored windows, skips by reason, mean net returns and the failure modes in order.

    planned: ``planned_windows``; rows: the joined inputs, whose absence is a failure mode of its own."""
    totals = planned.agg(
        F.count("*").alias("planned"), F.count_if(F.col("skipped").isNull()).alias("windows"), F.count_if(F.col("skipped") == "no_train").alias("without_train"),
        F.count_if(F.col("skipped") == "no_test").alias("without_test"), F.coalesce(F.sum("test_dates"), F.lit(0)).alias("dates"), F.avg("strategy_net").alias("mean_strategy"), F.avg("baseline_net").alias("mean_baseline"))
    inputs = rows.limit(1).agg(F.count("*").alias("inputs"))
    row = totals.join(inputs, F.lit(True))
    none, unplanned = F.col("inputs") == 0, (F.col("inputs") > 0) & (F.col("planned") == 0)
    some = (F.col("inputs") > 0) & (F.col("planned") > 0)
    modes = F.array_compact(F.array(
        F.when(none, "no_inputs"), F.when(unplanned, "too_few_sessions"), F.when(some & (F.col("windows") == 0), "no_scorable_window"), F.when(some & (F.col("without_train") > 0), "windows_without_train"),
        F.when(some & (F.col("without_test") > 0), "windows_without_test"), F.when((F.col("dates") > 0) & (F.col("dates") < 5), "small_sample"), F.when(F.col("mean_strategy") <= F.col("mean_baseline"), "baseline_not_exceeded"),
    ))
    return row.withColumn("status", F.when(F.col("windows") > 0, "succeeded").otherwise("insufficient_data")).withColumn("failure_modes", modes).drop("inputs")


def model_window(planned: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: source, train_from, train_to, test_from, test_to: of scorable windows, else of planned ones, else of the inputs."""
    ends = [F.min_by(c, "split").alias(c) for c in ("train_from", "train_to", "test_from")] + [F.max("test_to").alias("test_to")]
    tiers = [("scorable", planned.where("skipped is null").agg(*ends)), ("planned", planned.agg(*ends))]
    inputs = rows.agg(F.min("idx").alias("train_from"), F.max("idx").alias("train_to"), (F.max("idx") + 1).alias("test_from"), F.max("outcome_idx").alias("test_to"))
    out = None
    for order, (name, table) in enumerate([*tiers, ("inputs", inputs)]):
        part = table.where("train_from is not null").select(F.lit(order).alias("order"), F.lit(name).alias("source"), "train_from", "train_to", "test_from", "test_to")
        out = part if out is None else out.union(part)
    return out.agg(F.min(F.struct("order", "source", "train_from", "train_to", "test_from", "test_to")).alias("w")).where("w is not null").select("w.source", "w.train_from", "w.train_to", "w.test_from", "w.test_to")


def pooled_metrics(pred: DataFrame, horizon: int, quantile: float) -> DataFrame:
    """One row: rank correlation, gross and net spread of the model's score and of the raw feature over all test rows, and how much the model adds."""
    one = pred.withColumn("all", F.lit(1))
    cost, out = B.long_short_cost(horizon), None
    for name, score in (("model", "score"), ("baseline", "feature")):
        correlation = ranks.spearman(one, score, "ret", ["all"]).select("all", "pairs", F.col("rank_correlation").alias(f"{name}_rank"))
        spread = B.long_short(one, score, quantile, ["all"]).select("all", F.col("spread").alias(f"{name}_gross"), (F.col("spread") - cost).alias(f"{name}_net"))
        part = correlation.join(spread, "all", "left")
        out = part if out is None else out.join(part.drop("pairs"), "all")
    return out.drop("all").withColumn("rank_delta", F.col("model_rank") - F.col("baseline_rank")).withColumn("net_delta", F.col("model_net") - F.col("baseline_net"))


def regime_metrics(scores: DataFrame, regimes: DataFrame) -> DataFrame:
    """(name, measure, ...) of the strategy, the baseline and their difference by regime; one pass over the dates."""
    rows = scores.withColumn("net_difference", F.col("strategy_net") - F.col("baseline_net"))
    long = rows.unpivot(["asof"], ["strategy_net", "baseline_net", "net_difference"], "measure", "value")
    keyed = regimes.join(spark_measures(regimes), F.lit(True))
    stats = long.join(regimes, F.col("asof").between(F.col("start_date"), F.col("end_date"))).groupBy("name", "measure").agg(
        F.count("*").alias("sample_count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.avg(F.when(F.col("value") > 0, 1.0).when(F.col("value").isNotNull(), 0.0)).alias("hit_rate"))
    return keyed.select("name", "measure").join(stats, ["name", "measure"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def spark_measures(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([(m,) for m in ("strategy_net", "baseline_net", "net_difference")], "measure string")


def _floor(x: Column) -> Column:
    """floor as a double: numbers of 2**53 and more are whole already, and would not fit a long."""
    return F.when(x >= F.lit(2.0**53), x).otherwise(F.floor(x).cast("double"))


def exact(x: Column) -> Column:
    """All digits of a number as text: its whole part and three further parts of 30 bits, so two that differ by more than 2**-90,
    as all do that are not far below 2**-30, give different texts.  Products with powers of two and their floors are exact,
    so every engine gives the same; numbers are below 2**63."""
    size = F.abs(x)
    parts = [F.floor(size).cast("long")] + [(_floor(size * F.lit(2.0 ** (30 * k))) - _floor(size * F.lit(2.0 ** (30 * (k - 1)))) * F.lit(2.0**30)).cast("long") for k in (1, 2, 3)]
    return F.concat(F.when(x < 0, "-").otherwise("+"), F.concat_ws(".", *[p.cast("string") for p in parts]))


def fingerprint(rows: DataFrame, group: str, order: str, columns: list[Column]) -> DataFrame:
    """One row ``fingerprint``: SHA-256 over the rows in the order of ``group`` and ``order``.

    A row is the SHA-256 of its columns as text, nulls told from empty texts; a group the SHA-256 of its rows' in order, and
    the whole that of its groups'.  So each step holds one group, the cross-section of a date, or one text a group."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns])
    hashed = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.sha2(text, 256).alias("h"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["h"]), "")
    groups = hashed.groupBy("g").agg(F.sha2(joined(F.struct("o", "h")), 256).alias("h"))
    return groups.agg(F.sha2(joined(F.struct("g", "h")), 256).alias("fingerprint"))


def drifted(stored: DataFrame, rerun: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., field, stored, rerun): fields of a replayed claim that are not what was stored, rows on one side only included."""
    old = stored.select(*keys, *[F.col(f).cast("string").alias(f"__{f}") for f in fields], F.lit(True).alias("__a"))
    new = rerun.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields], F.lit(True).alias("__b"))
    both = old.join(new, keys, "full_outer")
    sides = [F.struct(F.lit("row").alias("field"), F.when(F.col("__a"), "present").alias("stored"), F.when(F.col("__b"), "present").alias("rerun"))]
    sides += [F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("stored"), F.col(f).alias("rerun")) for f in fields]
    here = F.col("__a") & F.col("__b")
    rows = both.select(*keys, here.alias("here"), F.explode(F.array(*sides)).alias("x")).select(*keys, "here", "x.*")
    return rows.where("not (stored <=> rerun) and (field = 'row' or coalesce(here, false))").drop("here")


def trace_faults(claim: dict[str, str], stored: DataFrame) -> DataFrame:
    """(field, expected, found): what a report would say that the stored run doesn't; stored is one row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(str(v)).alias("expected"), F.col(k).cast("string").alias("found")) for k, v in claim.items()])
    return stored.select(F.explode(pairs).alias("x")).select("x.*").where("not (expected <=> found)")


def checked_policies(pairs: DataFrame) -> DataFrame:
    """(name, version) of distinct policies; two versions of a name are an error."""
    found = pairs.select("name", "version").distinct().groupBy("name").agg(F.min("version").alias("version"), F.count("*").alias("n"))
    version = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting versions of "), "name")).cast("bigint")).otherwise(F.col("version"))
    return found.select("name", version.alias("version"))


def checked_target_kind(rows: DataFrame) -> DataFrame:
    """One row ``kind``: raw or excess; a mixture is an error, no rows are ``none``.  rows: raw_return, excess_return."""
    counted = rows.agg(F.count("*").alias("n"), F.count("excess_return").alias("excess"))
    mixed = (F.col("excess") > 0) & (F.col("excess") < F.col("n"))
    kind = F.when(F.col("n") == 0, "none").when(mixed, F.raise_error(F.lit("raw and excess targets are mixed")).cast("string")).when(F.col("excess") > 0, "excess").otherwise("raw")
    return counted.select("n", "excess", kind.alias("kind"))


def input_messages(cover: DataFrame) -> DataFrame:
    """(kind, message, tickers): what blocks a run and what is only a gap, from the coverage of members."""
    checks = [
        ("blocking", "prices_missing", F.col("price_rows") == 0), ("blocking", "features_missing", F.col("feature_rows") == 0), ("blocking", "labels_missing", F.col("label_rows") == 0),
        ("blocking", "no_overlap", F.col("joined_rows") == 0), ("gap", "labels_without_features", F.col("label_without_feature_rows") > 0), ("gap", "features_without_labels", F.col("feature_without_label_rows") > 0),
    ]
    told = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("message"))) for kind, name, test in checks]))
    rows = cover.select("ticker", F.explode(told).alias("m"))
    return rows.groupBy("m.kind", "m.message").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("ticker")), ", ").alias("tickers"))


def percent(x: Column, places: int = 4) -> Column:
    """+1.2500%; n/a for nothing."""
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%+.{places}f%%", x * 100))


def number(x: Column, places: int = 4) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%.{places}f", x))


def date_range(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "n/a").when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit(".."), b.cast("string")))


def report_lines(headline: DataFrame, windows: DataFrame) -> DataFrame:
    """(section, line, text) of a run's report, in order: a handful of lines from rollups that are small already."""
    h = headline.select(F.explode(F.array(*[
        F.struct(F.lit("headline").alias("section"), F.lit(k).cast("bigint").alias("line"), F.concat(F.lit(f"{label}: "), text).alias("text"))
        for k, (label, text) in enumerate([
            ("windows", F.col("windows").cast("string")), ("dates", F.col("dates").cast("string")), ("mean strategy", percent(F.col("mean_strategy"))), ("mean baseline", percent(F.col("mean_baseline"))),
            ("mean difference", percent(F.col("mean_difference"))), ("hit rate", percent(F.col("hit_rate"), 1)), ("mean over sd", number(F.col("mean_over_sd"), 3)),
        ])])).alias("x")).select("x.*")
    w = windows.select(F.lit("windows").alias("section"), F.col("split").alias("line"), F.concat(date_range(F.col("test_start"), F.col("test_end")), F.lit(" "), percent(F.col("difference"))).alias("text"))
    return h.union(w)


def markdown(lines: DataFrame, title: str) -> str:
    """The report as Markdown; ``lines`` are of a report's size."""
    rows = sorted(lines.collect(), key=lambda r: (["headline", "windows"].index(r["section"]), r["line"]))
    sections = functools.reduce(lambda out, r: out | {r["section"]: [*out.get(r["section"], []), f"- {r['text']}"]}, rows, {})
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n" + "\n".join(body) for name, body in sections.items()]]) + "\n"


def latest_version(definitions: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The row of the highest version of each name."""
    order = Window.partitionBy(name).orderBy(F.desc(version))
    return definitions.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def require_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, or an error naming the first of them whose keys aren't among the known."""
    marked = rows.join(known.select(*keys).distinct().withColumn("__known", F.lit(True)), keys, "left")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ok = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown: "), name)).cast("boolean")).otherwise(F.lit(True))
    return marked.where(ok).select(*rows.columns)


def set_faults(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., fault): missing and unexpected members; none where the sets are equal."""
    a, b = found.select(*keys).distinct(), wanted.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("fault", F.lit("missing")).unionByName(a.join(b, keys, "left_anti").withColumn("fault", F.lit("unexpected")))
