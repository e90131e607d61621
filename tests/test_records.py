"""Records of runs: replay, report and keys; permutation keys; portable digits; text of pages."""

from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import backtest as B
from chronopanel.operators import records, runs
from chronopanel.sources import vendor


def record(spark, rows):
    return spark.createDataFrame(rows, records.RECORD)


def test_replay_tells_drift_from_other_inputs(spark):
    rows = [("config", "horizon", "5"), ("inputs", "fingerprint", "ab"), ("headline", "windows", "3"), ("headline", "hit_rate", "n/a")]
    stored = records.from_json(records.to_json(record(spark, rows), F.lit("k"))).drop("key")
    same = records.replay(stored, record(spark, rows[::-1])).first()
    assert (same["verdict"], same["drifted"], same["missing"], same["sections"]) == ("reproduced", 0, 0, "")
    other = records.replay(stored, record(spark, [*rows[:2], ("headline", "windows", "4"), ("headline", "new", "1")])).first()
    assert (other["verdict"], other["drifted"], other["missing"], other["sections"]) == ("drifted", 1, 2, "headline")
    assert records.replay(stored, record(spark, [("config", "horizon", "6"), *rows[1:]])).first()["verdict"] == "other_inputs"
    keys = {records.run_key(record(spark, x), "backtest").first()["key"] for x in (rows, rows[::-1], [*rows[:2], ("headline", "windows", "9")])}
    assert len(keys) == 1 and records.run_key(record(spark, [("config", "horizon", "6")]), "backtest").first()["key"] not in keys
    with pytest.raises(Exception):
        records.from_json(spark.createDataFrame([("k", "{no")], "key string, metrics string")).collect()


def test_reports_have_all_sections_in_order(spark):
    text = records.markdown(records.report_rows(record(spark, [("headline", "b", "2"), ("headline", "a", "1"), ("status", "run", "succeeded")])), "Run")
    heads = [line[3:].replace(" ", "_") for line in text.splitlines() if line.startswith("## ")]
    assert heads == list(records.SECTIONS) and "- a: 1\n- b: 2\n" in text and text.count("nothing recorded") == len(records.SECTIONS) - 2


def test_permutations_put_every_label_anywhere(spark):
    keys = B.trial_keys(np.arange(6, dtype=np.int64) * 12345678901 % (1 << 32), 3000)
    order = np.argsort(keys, axis=1, kind="stable")
    assert (keys >= 0).all() and (keys < B._PRIME).all() and 690 < len({tuple(x) for x in order.tolist()}) <= 720  # 709 are expected
    for place in range(6):
        assert all(400 < n < 600 for n in Counter(order[:, place].tolist()).values())
    rows = [(c, f"{g}-{k}", g, float(k < 2), float(k * (c + 1))) for c in (0, 1) for g in ("a", "b", "c") for k in range(5)]
    df = spark.createDataFrame(rows, "cell int, sample_id string, group_key string, feature double, label double")
    both = {r["cell"]: r for r in B.scramble_p_value(df, 50, 7, by=("cell",)).collect()}
    for c in (0, 1):
        alone = B.scramble_p_value(df.where(F.col("cell") == c), 50, 7).first()
        assert (both[c]["observed"], both[c]["rank"], both[c]["p_value"]) == (alone["observed"], alone["rank"], alone["p_value"])
    low = {a: B.scramble_p_value(df.where("cell = 0"), 50, 7, alternative=a).first()["p_value"] for a in ("greater", "less", "two_sided")}
    assert low["greater"] > 0.9 and low["less"] < 0.2 and low["two_sided"] == low["greater"]


def test_digits_of_unlike_numbers_are_unlike(spark):
    values = [0.1, 0.1 + 2**-56, -0.1, 0.0, 1e-9, 1e-9 + 2**-83, 123456.789, 3.0, 2.0**-90, 2.0**40 + 0.5]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(runs.exact(F.col("v")).alias("x")).collect()]
    assert len(set(got)) == len(values)
    assert runs.exact(F.lit(0.5)) is not None and got[7] == "+3.0.0.0"


def test_text_of_pages_is_what_a_parser_gives(spark):
    pages = [
        "<p>a<b>b</b>&amp;c &lt;d&gt; &eacute;&#233;&#xe9;&nbsp;x</p>", "<script>var a = '<p>';</script>kept<style media='x'>p{}</STYLE >too", "<!-- <p>no</p> -->yes", "a &unknown; & b &amp;amp; &#0; 5 < 6", "", "<br/>one<br>two", "x<script>never closed", "&Oslash;&yuml;&sect;",
    ]

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    got = {r["html"]: r["text"] for r in spark.createDataFrame([(p,) for p in pages], "html string").select("html", vendor.html_text("html").alias("text")).collect()}
    for page in pages:
        parser = Text()
        parser.feed(page)
        parser.close()
        want = " ".join(" ".join(parser.parts).split())
        assert got[page] == want.replace("�", "&#0;"), page
    assert spark.range(1).select(vendor.html_text(F.lit(None).cast("string")).alias("t")).first()["t"] is None
