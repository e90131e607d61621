"""Spelling variants, centroids and nearest neighbours against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import CLASHING, SF, documents, empty
from pyspark.sql import functions as F

from chronopanel.llm import centroids, nearest, spelling


def plain_spelling(rows):
    """All words, forms and roots from dictionaries of words without a letter."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    patterns, near = {}, {w: set() for w in words}
    for w in words:
        for p in range(len(w)):
            patterns.setdefault((w[:p], w[p + 1 :]), set()).add(w)
    for group in patterns.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    for w in words:
        for p in range(len(w)):
            v = w[:p] + w[p + 1 :]
            if v in words:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants_of(words, seed, n):
    """Words of ``words`` and what one edit makes of them, in texts of a few words each."""
    r, letters = random.Random(seed), "abcdefghéÿ×"
    said = []
    for _ in range(n):
        w = r.choice(words)
        p, kind = r.randrange(len(w)), r.randrange(12)
        said.append({0: w[:p] + w[p + 1 :], 1: w[:p] + r.choice(letters) + w[p:], 2: w[:p] + r.choice(letters) + w[p + 1 :]}.get(kind, w.upper() if kind == 3 else w))
    return [(k, " ".join(said[k * 7 : k * 7 + 7]) + ", ") for k in range(n // 7)]


@pytest.mark.parametrize("limit", [1 << 16, 3])
def test_spelling_variants_equal_a_plain_version(spark, limit):
    words = ["abcdefgh", "abcdefghab", "aaaaaaaa", "aaaaaaab", "hgfedcba", "éabcdeff", "abababab", "a" * 100, "a" * 70 + "b" * 30]
    rows = variants_of(words, 1, 2100) + [(None, "abcdefgh"), (5, None), (6, ""), (7, "12 !"), (8, "abcdefgh"), (8, "abcdefgh"), (9, "Z" * 5000), (9, "Z" * 5000), (10, "z" * 5001 + " " + "z" * 5001)]
    got = [tuple(r) for r in spelling.spelling_variants(documents(spark, rows), limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_spelling(rows)
    assert sum(r[1] is not None for r in got) > 20 and any(r[4] > 5 for r in got)


def test_common_letters_at_both_ends_meet_exactly(spark):
    """Words of five middle letters between long common ends, all beyond the limit."""
    r = random.Random(3)
    words = sorted({"commonprefix" + "".join(r.choice("ab") for _ in range(r.choice([4, 5, 6]))) + "commonsuffix" for _ in range(120)})
    rows = [(k, " ".join(words)) for k in range(3)]
    got = {tuple(r) for r in spelling.spelling_variants(documents(spark, rows), limit=4).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_spelling(rows) and sum(r[4] for r in got) > 100


def test_spelling_variants_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_spelling(rows)
    assert spelling.spelling_variants(empty(spark)).count() == 0


def test_a_wavelet_tree_reports_what_lies_in_a_rectangle():
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 64, 200):
        values = r.permutation(n)
        first, low = r.integers(0, n + 1, 50), r.integers(0, n + 1, 50)
        stop, high = r.integers(0, n + 1, 50), r.integers(0, n + 1, 50)
        query, value = spelling.Wavelet(values).report(first, stop, low, high)
        want = {(q, v) for q in range(50) for v in values[first[q] : stop[q]].tolist() if low[q] <= v < high[q]}
        assert set(zip(query.tolist(), value.tolist())) == want and len(query) == len(want)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "q", "n", "x", "g", "cluster", "best", "nth", "qb", "cb", "dims", "own"]})


def odd_vectors(dims):
    nan, inf = float("nan"), float("inf")
    return [(None, [0.25] * dims), (7, None), (8, []), (9, [0.5] * (dims - 1) + [None]), (10, [0.5] * (dims - 1) + [nan]), (11, [inf] + [0.0] * (dims - 1)), (20, [0.0] * dims), (21, [0.5] * (dims + 1))]


def plain_lloyd(rows, dims, k, rounds, salt):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    c = [q for _, q in seeds]
    place = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        got = [(place(q)[1], q) for _, q in kept]
        for j in range(len(c)):
            if own := [q for at, q in got if at == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *place(q)) for i, q in kept]
    total, by = sum(d for _, d, _ in last), Counter()
    for _, d, j in last:
        by[j] += d
    return [(i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last]


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize(("n", "dims", "k"), [(200, 4, 8), (3, 4, 8), (40, 64, 3)])
def test_clusters_equal_plain_lloyd(spark, n, dims, k):
    r = random.Random(n)
    rows = [(i, [r.choice([-0.3, 0.1, 0.7]) + round(r.gauss(0, 0.1), 2) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(1, rows[1][1]), (1, rows[2][1])] + odd_vectors(dims)
    got = centroids.cluster_vectors(vectors(spark, rows), dims=dims, k=k, rounds=6)
    assert by_text(tuple(x) for x in got.collect()) == by_text(plain_lloyd(rows, dims, k, 6, "3:"))


def test_clusters_of_nothing_and_of_too_much(spark):
    assert centroids.cluster_vectors(vectors(spark, [])).count() == 0
    assert centroids.cluster_vectors(vectors(spark, odd_vectors(64)[1:6])).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e9] * 64)])).count()


def plain_nearest(rows, k):
    whole = [(i, n, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, n, v in whole:
        if i is not None and i % 20 == 0:
            scored = [(-sum((np.float64(np.float32(a)) * np.float64(np.float32(b)) for a, b in zip(v, w)), np.float64(0)), j is None, j, m) for j, m, w in whole if m != n and len(w) == len(v)]
            out += [(i, at + 1, j, float(-s) + 0.0) for at, (s, _, j, _) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k])]
    return out


@pytest.mark.parametrize(("n", "dims"), [(700, 6), (12, 3), (300, 1500)])
def test_neighbours_equal_all_pairs(spark, n, dims):
    r = random.Random(n)
    rows = [(i, [r.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(120)]  # a crowd of equal vectors, some of them queries
    rows += [(6000 + i, [x + r.gauss(0, 1e-6) for x in rows[0][1]]) for i in range(60)]  # nearer than int8 tells
    rows += [(0, rows[3][1]), (40, [1e-30] * dims), (60, [2.0**60] * dims), (41, [2e-30] * dims)] + odd_vectors(dims)
    got = nearest.nearest_vectors(vectors(spark, rows))
    assert by_text(tuple(x) for x in got.collect()) == by_text(plain_nearest(rows, 20))


def test_neighbours_of_nothing(spark):
    assert nearest.nearest_vectors(vectors(spark, [])).count() == 0
    assert nearest.nearest_vectors(vectors(spark, [(20, [1.0])])).count() == 0


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_nearest_neighbours"])
def test_vector_queries_equal_sql(spark, name):
    from chronopanel.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got, want = QUERIES[name](spark, SF), db.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert by_text(tuple(x) for x in got.select(*names).collect()) == by_text(want.fetchall())


def test_vectors_far_apart_in_size_keep_their_bounds():
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 9)) * 10.0 ** r.integers(-150, 150, (40, 1))
    block = nearest.Block(x)
    near, off = block.bounds(block, slice(0, 40), slice(0, 40))
    assert (np.abs(near - x @ x.T) <= off).all()
