"""The record of a run: everything it claims as (section, field, value) rows, stored, replayed, traced and reported.

A record is small, whatever the run: each part is a rollup.  As rows of text it is compared, stored as JSON and printed by the
same few operations, and a field that is added needs nothing else.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sections of a report, in order.
SECTIONS = ("status", "config", "coverage", "membership", "identity", "inputs", "model_window", "headline", "costs", "regimes", "label_scramble", "comparisons", "traceability")
#: What is said of a run that isn't accepted.
NO_CLAIM = "no claim of excess return is made"
RECORD = "section string, field string, value string"


def text(c: Column, places: int = 8) -> Column:
    """Numbers with a fixed number of places, n/a for nothing; minus zero is zero."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%.{places}f", F.round(c, places) + 0.0))


def fields(rows: DataFrame, section: str, columns: dict[str, Column], prefix: Column | None = None) -> DataFrame:
    """The columns of each row as fields of a section; ``prefix`` tells several rows apart."""
    name = lambda k: F.lit(k) if prefix is None else F.concat(prefix, F.lit(f".{k}"))
    told = F.array(*[F.struct(name(k).alias("field"), F.coalesce(v.cast("string"), F.lit("n/a")).alias("value")) for k, v in columns.items()])
    return rows.select(F.explode(told).alias("x")).select(F.lit(section).alias("section"), "x.*")


def together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def to_json(record: DataFrame, key: Column) -> DataFrame:
    """(key, metrics): a record as one registry row."""
    held = record.agg(F.sort_array(F.collect_list(F.struct("section", "field", "value"))).alias("rows"))
    return held.select(key.alias("key"), F.to_json("rows").alias("metrics"))


def from_json(runs: DataFrame) -> DataFrame:
    """(key, section, field, value) of registry rows; metrics that aren't a record are an error."""
    parsed = F.from_json("metrics", f"array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})
    return runs.select("key", F.inline(parsed))


def run_key(record: DataFrame, kind: str, length: int = 32) -> DataFrame:
    """One row ``key``: the kind and the start of the hash of what identifies a run, its config, inputs and hashes."""
    own = record.where(F.col("section").isin("config", "identity", "inputs"))
    line = F.concat_ws("=", F.concat_ws(".", "section", "field"), "value")
    joined = F.array_join(F.sort_array(F.collect_list(line)), "|")
    return own.agg(F.concat(F.lit(f"{kind}-"), F.left(F.sha2(joined, 256), F.lit(length))).alias("key"))


def compare(stored: DataFrame, rerun: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(section, field, stored, rerun, fault): ``drifted`` values, and fields that one side lacks."""
    of = lambda df, name: df.where(F.col("section").isin(*sections)).select("section", "field", F.col("value").alias(name))
    both = of(stored, "stored").join(of(rerun, "rerun"), ["section", "field"], "full_outer")
    fault = F.when(F.col("stored").isNull(), "not_stored").when(F.col("rerun").isNull(), "not_rerun").when(F.col("stored") != F.col("rerun"), "drifted")
    return both.withColumn("fault", fault).where("fault is not null")


def replay(stored: DataFrame, rerun: DataFrame) -> DataFrame:
    """One row: verdict, drifted and missing fields, and the sections they are in.

    Inputs are checked before results: where the inputs themselves drifted, results are no replay of the claim."""
    found = compare(stored, rerun)
    inputs = F.count_if(F.col("section").isin("config", "identity", "inputs"))
    row = found.agg(inputs.alias("__inputs"), F.count_if(F.col("fault") == "drifted").alias("drifted"), F.count_if(F.col("fault") != "drifted").alias("missing"), F.array_join(F.sort_array(F.collect_set("section")), ",").alias("sections"))
    verdict = F.when(F.col("__inputs") > 0, "other_inputs").when(F.col("drifted") + F.col("missing") > 0, "drifted").otherwise("reproduced")
    return row.select(verdict.alias("verdict"), "drifted", "missing", "sections")


def report_rows(record: DataFrame) -> DataFrame:
    """(section, line, text): the report's lines, sections in order of SECTIONS; a section without fields says so."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    told = record.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("rows"))
    every = record.sparkSession.createDataFrame([(s,) for s in SECTIONS], "section string").join(told, "section", "left")
    lines = F.coalesce(F.transform("rows", lambda r: F.concat(r["field"], F.lit(": "), r["value"])), F.array(F.lit("nothing recorded")))
    return every.withColumn("place", place).select("place", "section", F.posexplode(lines).alias("line", "text")).select("place", "section", F.col("line").cast("bigint").alias("line"), "text")


def markdown(lines: DataFrame, title: str) -> str:
    """The report as Markdown; its lines are of a report's size."""
    out, last = [f"# {title}"], None
    for r in sorted(lines.collect(), key=lambda r: (r["place"], r["line"])):
        if r["section"] != last:
            out.append(f"\n## {r['section'].replace('_', ' ')}\n")
            last = r["section"]
        out.append(f"- {r['text']}")
    return "\n".join(out) + "\n"
