"""The stages of the pipeline, each against a brute-force version, and on rows that are odd in every way."""

import pytest
from helpers import SF, documents, empty, prose
from pyspark.sql import functions as F

import corpus_pipeline
from chronopanel.llm import decontaminate, quality
from chronopanel.llm.common import cut, table


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def odd_rows():
    """Nulls, empties, repeats, missing and shared ids, near copies and a shared passage."""
    a, b, passage = prose(1, 120), prose(2, 120), prose(3, 60)
    near = a.split()
    near[60] = "changed"
    return [
        (1, a), (2, " ".join(near)), (2, b), (None, a), (None, None), (5, None), (6, ""), (7, f"{prose(4, 40)} {passage}"), (7, f"{prose(5, 40)} {passage} {prose(6, 20)}"), (8, prose(7, 30)), (8, prose(7, 30)), (9, "long " * 30000),
    ]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, stage):
    docs = documents(spark, odd_rows())
    out = stage(spark, docs, SF)
    if name != "byte_level_bpe":
        assert out.columns == docs.columns
    assert out.count() <= docs.count() and stage(spark, empty(spark), SF).count() == 0


def test_near_duplicate_stage_against_all_pairs(spark):
    rows = odd_rows()
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), SF).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None or [i for i, _ in rows].count(rows[k][0]) > 1, rows[k][0] or 0))
    stays = []
    for k in order:
        s = shingles(rows[k][1])
        alike = [o for o in stays if (s == shingles(rows[o][1]) if not s else len(s & shingles(rows[o][1])) >= 0.8 * len(s | shingles(rows[o][1])))]
        if not alike:
            stays.append(k)
    assert sorted(map(str, (rows[k][1] or "" for k in stays))) == sorted(map(str, (t or "" for _, t in kept)))
    assert (1, rows[0][1]) in kept and (2, rows[2][1]) in kept


def test_passage_stage_cuts_rows_of_their_own_passages_only(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    got = corpus_pipeline.cut_repeated_passages(spark, docs, SF).collect()
    assert len(got) == len(rows)
    passage = prose(3, 60)
    assert sum(passage in (x["text"] or "") for x in got) == 1 and sum(prose(4, 40) in (x["text"] or "") for x in got) == 1 and sum(prose(6, 20) in (x["text"] or "") for x in got) == 1
    assert sum(x["text"] is None for x in got) == 2 and sum(prose(2, 120) == x["text"] for x in got) == 1


def test_contamination_and_quality_stages_equal_their_row_by_row_versions(spark):
    docs = table(spark, SF, "documents")
    found = {x["doc_id"] for x in decontaminate.contamination(docs, table(spark, SF, "benchmark")).collect()}
    kept = [x["doc_id"] for x in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(x["doc_id"] for x in docs.collect() if x["doc_id"] not in found) and found
    model = quality.fit(docs, table(spark, SF, "labels"))
    heads = (model.low, 0.5), (model.toxic, 0.8)

    def stays(row):
        dense, words = quality.shape(row["text"] or "")
        hashes, meta = quality.word_hashes(words), quality.metadata(row["lang"], row["source"], row["n_chars"])
        return all(h is None or h.score(h.text_view(dense, hashes)[None], meta[None])[0] < at for h, at in heads)

    assert sorted(x["doc_id"] for x in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == sorted(x["doc_id"] for x in docs.collect() if stays(x))


def test_quality_stage_sends_a_text_once(spark, monkeypatch):
    """Batches of the whole rows and of their texts beside them took an executor's memory; columns of other types are cast beside the row."""
    docs = table(spark, SF, "documents")
    model, sent, judge = quality.fit(docs, table(spark, SF, "labels")), [], quality.judge
    monkeypatch.setattr(quality, "judge", lambda rows, *more: sent.append(rows.columns) or judge(rows, *more))
    plain = quality.kept_documents(docs, model)
    other = quality.kept_documents(docs.select(F.lit(0).alias("row"), F.col("text").cast("binary").alias("text"), F.col("n_chars").cast("int").alias("n_chars"), "source", "lang", "doc_id"), model)
    assert sent == [["row"], ["row", "text", "n_chars"]]
    assert sorted(x["doc_id"] for x in plain.collect()) == sorted(x["doc_id"] for x in other.collect()) == sorted(x["doc_id"] for x in quality.score(docs, model).where("keep").collect())


def test_run_applies_the_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
