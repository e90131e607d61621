"""Shards, media archives, URL rules, quality scores and the pipeline."""

import hashlib
import random
import shutil
import zipfile
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import SF, documents, empty, prose

from chronopanel.llm import media, quality, sharding, url_filter
from chronopanel.llm.common import scratch


def test_shards_are_even_gapless_and_keep_groups_together(spark):
    rows = [(k, f"text {k}") for k in range(200)] + [(1000 + k, "hot") for k in range(100)] + [(2000 + k, f"pair {k // 2}") for k in range(60)] + [(3000, None), (3001, ""), (3000, None), (None, "x")]
    placed = sharding.balanced_shards(documents(spark, rows), 8).collect()
    assert len(placed) == len(rows)
    sizes = Counter(x["shard"] for x in placed)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(x["slot"] for x in placed if x["shard"] == k) == list(range(n))
    pairs = Counter((x["text_crc32"], x["shard"]) for x in placed if (x["doc_id"] or 0) in range(2000, 2060))
    assert sum(n == 2 for n in pairs.values()) >= 20  # of 30 pairs; hashing alone would keep about 4
    hot = [x["shard"] for x in placed if (x["doc_id"] or 0) in range(1000, 1100)]
    assert sum(sorted(Counter(hot).values())[-3:]) >= 80  # a group of 100 needs three shards of 46
    by_id = {x["doc_id"]: x for x in placed}
    assert by_id[3000]["size"] == 16 and by_id[3000]["text_crc32"] == 0 and by_id[0]["size"] == 16 + len("text 0")


def test_shards_of_few_or_no_rows(spark):
    assert sharding.balanced_shards(empty(spark), 40).count() == 0
    assert sorted(x["slot"] for x in sharding.balanced_shards(documents(spark, [(1, "a"), (1, "a")]), 40).collect()) == [0, 0]


@pytest.mark.parametrize("form", ["png", "wav"])
def test_media_round_trip(spark, form):
    rows = [(0, None), (1, ""), (2, "é" * 96), (3, prose(1, 5000)), (4, "x" * 193), (4, "x" * 193), (None, "y")]
    folder = scratch(spark, "media")
    media.pack_texts(documents(spark, rows), folder, form, archive_bytes=4096)
    got = media.read_media(spark, folder, form, range_bytes="2048").collect()
    assert len(got) == len(rows) and all(x["error"] is None for x in got)
    text = dict(rows)
    for x in got:
        raw = (text[x["doc_id"]] or "").encode()
        assert x["n_bytes"] == len(raw) and bytes(x["payload"]) == raw.ljust(max(192, -(-len(raw) // 192) * 192))
    nothing = scratch(spark, "media")
    media.pack_texts(empty(spark), nothing, form)
    assert media.read_media(spark, nothing, form).count() == 0


def test_damaged_member_is_a_row_with_an_error(spark):
    folder = scratch(spark, "media")
    media.pack_texts(documents(spark, [(k, prose(k, 300)) for k in range(6)]).coalesce(1), folder)
    fs, base = media.open_uri(folder)
    name = spark.read.parquet(f"{folder}/manifest").first()["archive"]
    with open(f"{base}/{name}", "r+b") as f:
        f.seek(400)
        f.write(b"\xff\xfe\xfd")
    got = media.read_media(spark, folder, retries="0").collect()
    assert sum(x["error"] is not None for x in got) == 1 and len(got) == 6


def test_foreign_and_truncated_archives_are_rows_with_errors(spark):
    folder = scratch(spark, "media")
    media.pack_texts(documents(spark, [(k, prose(k, 300)) for k in range(3)]).coalesce(1), folder)
    fs, base = media.open_uri(folder)
    with zipfile.ZipFile(f"{base}/other.zip", "w") as z:
        z.writestr("readme.png", b"not a picture")
        z.writestr("7.png", media.encode_png(b" " * 192, 0)[:40])
    with open(f"{base}/cut.zip", "wb") as f:
        f.write(b"PK\3\4" + b"x" * 500)
    shutil.rmtree(f"{base}/manifest")
    got = media.read_media(spark, folder, retries="0").collect()
    assert sum(x["error"] is None for x in got) == 3 and sum(x["error"] is not None for x in got) == 3
    wavs = scratch(spark, "media")
    media.pack_texts(documents(spark, [(1, "x")]).coalesce(1), wavs, "wav")
    fs, base = media.open_uri(wavs)
    with zipfile.ZipFile(f"{base}/short.zip", "w") as z:
        z.writestr("2.wav", media.encode_wav(b" " * 192, 0)[:30])
    shutil.rmtree(f"{base}/manifest")
    assert sorted(x["error"] is None for x in media.read_media(spark, wavs, "wav", retries="0").collect()) == [False, True]


def test_media_query_digests(spark):
    texts = {x["doc_id"]: (x["text"] or "").encode() for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = media.op5_media_columns(spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        padded = texts[x["doc_id"]].ljust(max(192, -(-len(texts[x["doc_id"]]) // 192) * 192))
        image = media.encode_png(padded, len(texts[x["doc_id"]]))
        assert (x["media_bytes"], x["media_sha256"], x["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.features(padded))
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(texts[x["doc_id"]]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def plain_judgement(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), p, h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules_equal_all_comparisons(spark):
    rules = [*url_filter.RULES, ("a.b.com", "", "block"), ("b.com", "/x", "block"), ("b.com", "/x/y", "allow"), ("com", "/z", "block"), ("xcom", "/", "block"), ("co", "/", "block"), ("com-x", "/", "block")]
    hosts = ["com", "example.com", "WWW.Example.com", "m.www.example.com", "notexample.com", "b.com", "a.b.com", "q.a.b.com", "ab.com", "net", "x.net", "xcom", "com-x", "a.com-x", "co", "x.co", "com.", "", "é.com", "org"]
    paths = ["", "/", "/en/", "/en/x?y", "/en", "?q", "#f", "/es/a#b", "/fr/", "/x/y/z", "/x", "/z", "/a://b/en/"]
    urls = [None, "", "no scheme", "http:/x"] + [f"{s}://{h}{p}" for h in hosts for p in paths for s in ("http", "https")]
    pages = spark.createDataFrame([(k, u, "x", "y", "z") for k, u in enumerate(urls)] + [(0, None, "x", "y", "z")], "page_id long, url string, host string, rule string, stack string")
    for known in (rules, [*rules, ("", "/x", "block")], []):
        table = spark.createDataFrame(known, "host string, path string, verdict string")
        got = url_filter.judge_urls(pages, table).collect()
        assert len(got) == len(urls) + 1
        for x in got:
            assert (x["host"], x["path"], x["rule"], x["verdict"]) == plain_judgement(urls[x["page_id"]], known), urls[x["page_id"]]
    assert url_filter.judge_urls(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_url_query_equals_duckdb(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    found = db.execute(url_filter.OP6_SQL)
    names = [x[0] for x in found.description]
    assert sorted(str(tuple(x[c] for c in names)) for x in url_filter.op6_url_filters(spark, SF).collect()) == sorted(map(str, found.fetchall()))


def test_quality_on_held_out_labels(spark):
    """Fitted on two thirds of the labels, held against the last third."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = {x["doc_id"]: x for x in labels.where("doc_id % 3 = 0").collect()}
    got = [x for x in quality.score(docs, model).collect() if x["doc_id"] in held]
    right = sum(x["keep"] == (held[x["doc_id"]]["quality"] == 1 and held[x["doc_id"]]["toxic"] == 0) for x in got)
    clean = [x["keep"] for x in got if held[x["doc_id"]]["quality"] == 1 and held[x["doc_id"]]["toxic"] == 0]
    assert len(got) > 100 and right / len(got) >= 0.85 and sum(clean) / len(clean) >= 0.95


def test_views_exchange_labels_and_leave_the_tested_rows_alone(spark):
    """Made-up documents of which both views tell the target: each passes labels of both kinds to the other, and the pool
    holds no labelled document."""
    r = random.Random(3)
    rows, marks = [], []
    for k in range(900):
        bad = k % 2
        words = [r.choice(["awful", "junk"] if bad and r.random() < 0.4 else ["fine", "plain", "text", "here"]) for _ in range(40)]
        rows.append((k, " ".join(words), "xx" if bad and r.random() < 0.9 else "en", f"src{bad if r.random() < 0.9 else r.randrange(4)}", 200))
        marks.append((k, 1 - bad, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks[:400], "doc_id long, quality int, toxic int")
    report = quality.fit(docs, labels).report["low"]
    for view in ("content", "meta"):
        assert report["passed_to"][view]["positive"] > 0 and report["passed_to"][view]["negative"] > 0
    assert report["accuracy"] >= 0.9 and report["tested"] > 50 and report["labelled"] == 400
    few = quality.fit(docs, labels.where("doc_id < 4"))
    assert few.low is not None and few.toxic is None  # both kinds of quality, one of toxicity


def test_quality_defined_results(spark):
    rows = documents(spark, [(1, None), (2, ""), (3, "word " * 30000), (3, "word " * 30000), (None, "x")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(rows, quality.fit(rows, labels)).collect()
    assert len(got) == 5 and all(x["keep"] and x["low_score"] is None for x in got)
    model = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    kept = quality.kept_documents(rows, model)
    assert kept.columns == rows.columns and quality.score(rows, model).count() == 5
    assert quality.score(empty(spark), model).count() == 0
