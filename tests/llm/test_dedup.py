"""Near duplicates, repeated passages and leaked benchmarks against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from helpers import SF, documents, empty, prose

from chronopanel.llm import compact_windows, decontaminate, simhash, suffix_array
from chronopanel.llm.common import connected_components
from chronopanel.llm.tokens import PLACE, Words, mix


def components(ids, linked):
    """{id: smallest id reachable}, by union of all linked pairs."""
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def plain_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_all_pairs(spark):
    r = random.Random(3)
    texts = [None, "", "one", "One\ttwo", "é È x"]
    for k in range(12):
        words = prose(k, 300).split()
        texts.append(" ".join(words))
        for _ in range(4):
            own = list(words)
            own[r.randrange(300)] = "zz"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    expected = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(set(expected.values())) < len(expected) - 5
    for crowd in (simhash.CROWD, 1):  # 1: every shared cell is split
        got = simhash.near_duplicate_components(documents(spark, rows), crowd=crowd).collect()
        assert {x["doc_id"]: x["fp"] % (1 << 64) for x in got} == prints
        assert {x["doc_id"]: x["component_id"] for x in got} == expected


def test_simhash_links_over_dense_neighbourhoods(spark):
    """Fingerprints one or two bits apart around a centre, and a chain: components equal those of all pairs."""
    r = random.Random(5)
    values = {r.getrandbits(63)}
    for _ in range(150):
        values.add(random.Random(len(values)).choice(sorted(values)) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)))
    values |= {r.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = components(sorted(values), lambda a, b: (a ^ b).bit_count() <= 2)
    from chronopanel.llm.common import connected_components, cut

    close = {(a, b) for a, b in itertools.combinations(sorted(values), 2) if (a ^ b).bit_count() <= 2}
    for crowd in (2048, 8):
        links = cut(simhash.fingerprint_links(df, 2, crowd), "links")
        assert sorted((x["a"], x["b"]) for x in links.collect()) == sorted(close)
        got = {x["node"]: x["component"] for x in connected_components(links).collect()}
        assert {v: got.get(v, v) for v in values} == expected


def five_word_similarity(a, b):
    s, t = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


def test_similar_components_against_all_pairs(spark):
    """Pairs with one to six changed words of 300: nine in ten of those at 0.8 or more are linked, none of the others."""
    r = random.Random(1)
    rows, pairs = [], []
    for k in range(150):
        a, b = prose(k, 300).split(), prose(k, 300).split()
        for _ in range(r.choice([1, 3, 5, 6, 9])):
            b[r.randrange(300)] = f"zz{r.randrange(999)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append(five_word_similarity(*[x[1] for x in rows[-2:]]) >= 0.8)
    rows += [(900, None), (901, ""), (902, "few words"), (903, "Few words"), (904, "word " * 30000)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_components(documents(spark, rows)).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(150)]
    assert len(got) == len(rows) and not any(x and not p for x, p in zip(linked, pairs))
    assert sum(x for x, p in zip(linked, pairs) if p) >= 0.9 * sum(pairs)
    assert [got[k] for k in (900, 901, 902, 903, 904)] == [900, 900, 902, 902, 904]


def test_a_crowd_of_near_copies_is_one_component(spark):
    base, r = prose(9, 200).split(), random.Random(2)
    rows = []
    for k in range(60):
        own = list(base)
        own[r.randrange(200)] = f"y{k}"
        rows.append((k, " ".join(own)))
    assert {x["component_id"] for x in simhash.similar_components(documents(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("others", [0, 22, 300])
def test_chains_in_a_crowded_cell_are_found_whoever_else_is_in_it(spark, others):
    """Four texts, each like the next only, in a cell of unlike ones and of a group of near copies."""
    words = prose(77, 140).split()
    chain = [" ".join(words[10 * k : 10 * k + 104]) for k in range(4)]
    assert [five_word_similarity(chain[a], chain[b]) >= 0.8 for a, b in ((0, 1), (1, 2), (2, 3), (0, 2), (1, 3))] == [True, True, True, False, False]
    copies = [" ".join([*prose(78, 120).split(), f"z{k}"]) for k in range(30)]
    texts = {5: chain[2], 17: chain[0], 900: chain[3], 901: chain[1], **{100 + k: c for k, c in enumerate(copies)}, **{200 + k: prose(1000 + k, 90) for k in range(others)}, 2000: " ".join([chain[0]] * 3)}
    rows = spark.createDataFrame(list(texts.items()), "row long, text string")
    crowd = rows.selectExpr("cast(1 as long) as key", "row", "cast(7 as long) as fp")
    found = spark.createDataFrame([], "a long, b long")
    of = {x["node"]: x["component"] for x in connected_components(simhash.crowd_links(rows, crowd, found, 16, 5, 0.8)).collect()}
    assert {k: of[k] for k in (5, 17, 900, 901)} == dict.fromkeys((5, 17, 900, 901), 5)
    assert {of[100 + k] for k in range(30)} == {100} and not {200 + k for k in range(others)} & set(of) and len(set(of.values())) == 2


def test_first_of_each_component_is_chosen_by_row(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = documents(spark, [(1, a), (2, a), (2, b), (3, b), (None, a), (4, "other words in here"), (None, "alone"), (2, b)])
    kept = simhash.first_of_each_component(docs)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or -1, x["text"]) for x in kept.collect()) == sorted([(1, a), (3, b), (4, "other words in here"), (-1, "alone")])
    assert simhash.near_duplicate_components(empty(spark)).count() == 0 and simhash.first_of_each_component(empty(spark)).count() == 0


def with_passages(n=14):
    """Rows with a passage of 60 words in documents 1, 5 and 7, and a near copy of one of 80 words in 2 and 8."""
    rows = [(k, prose(100 + k, 200)) for k in range(n)]
    shared, near = prose(1, 60), prose(2, 80).split()
    text = dict(rows)
    for k in (1, 5, 7):
        text[k] = prose(200 + k, 30 + k) + " " + shared + " " + prose(300 + k, 40)
    text[2] += " " + " ".join(near)
    near[40] = "changed"
    text[8] = " ".join(near) + " " + text[8]
    return [*text.items(), (n, None), (n + 1, ""), (n + 2, "word " * 3000), (n + 3, "word " * 500), (n + 4, "few words")], shared


def test_compact_windows_find_the_planted_passages(spark):
    rows, shared = with_passages()
    docs = documents(spark, rows)
    found = compact_windows.repeated_passages(docs)
    got = found.collect()
    assert {(x["doc_id"], x["other"]) for x in got} >= {(5, 1), (7, 1), (8, 2), (17, 16)}
    assert {x["doc_id"] for x in got} == {5, 7, 8, 17}
    text = dict(rows)
    for x in got:
        a = text[x["doc_id"]].lower().split()[x["start"] : x["start"] + 50]
        b = text[x["other"]].lower().split()[x["other_start"] : x["other_start"] + 50]
        s, t = ({tuple(w[k : k + 5]) for k in range(46)} for w in (a, b))
        assert len(s & t) / len(s | t) >= 0.5 and x["similarity"] >= 0.8
    cleaned = compact_windows.remove_passages(docs, found)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    after = {x["doc_id"]: x["text"] for x in cleaned.collect()}
    assert shared in after[1] and shared[50:200] not in after[5] and shared[50:200] not in after[7]
    assert all(after[k] == text[k] for k in (0, 1, 2, 3, 4, 6, 9, 10, 14, 15, 18))
    assert compact_windows.repeated_passages(empty(spark)).count() == 0


def test_compact_windows_meet_all_documents_of_a_common_signature(spark):
    """Documents with one long line in common, of which only the last two also share the words around it."""
    rows = []
    for k in range(12):
        line, shared = prose(7000 + k, 34), prose(7100 + k, 16).split()
        for j in range(14):
            around = shared if j > 11 else prose(7200 + 20 * k + j, 16).split()
            rows.append((100 * k + j, " ".join([prose(8000 + 20 * k + j, 20), *around[:8], line, *around[8:], prose(9000 + 20 * k + j, 20)])))
    got = {(x["doc_id"], x["other"]) for x in compact_windows.repeated_passages(documents(spark, rows)).collect()}
    assert got == {(100 * k + 13, 100 * k + 12) for k in range(12)}


def test_prefixes_of_similar_windows_meet():
    r = random.Random(4)
    for _ in range(200):
        a = r.sample(range(60), 46)
        b = [r.choice(a) if r.random() < 0.5 else v for v in a[:5]] + a[5:]
        counts = {v: r.choice([1, 2, 5]) for v in range(60)} | {v: 2 for v in set(a) & set(b)}
        same = len(set(a) & set(b)) / len(set(a) | set(b))
        x, y = (compact_windows.window_prefixes(np.array(v), counts, 46, 0.8) for v in (a, b))
        kinds = [(0, 0)] if len(set(b)) == 46 else [(1, 2)]
        assert same < 0.8 or any(set(x[i]) & set(y[j]) for i, j in kinds)


def near_copies():
    """300 copies of a passage, each with one or two words of its own, in texts that share nothing else."""
    r, base, rows = random.Random(6), prose(4, 90).split(), []
    for k in range(300):
        own = list(base)
        for j in r.sample(range(90), r.choice([1, 2])):
            own[j] = f"y{k}x{j}"
        rows.append((k, " ".join([prose(100 + k, 20), *own, prose(500 + k, 20)])))
    return rows


def test_open_starts_of_a_crowd_meet_few_others(spark, monkeypatch):
    """Members unlike the first of their part met all others, at all starts; results link the same documents by either way to rank shingles."""
    met, verify, crowds, docs = [], compact_windows.verify, compact_windows.in_crowds, documents(spark, near_copies())
    monkeypatch.setattr(compact_windows, "verify", lambda d, m, *more: met.append(m.distinct().count()) or verify(d, m, *more))
    found = {(x["doc_id"], x["start"], x["n_words"], x["other"], x["other_start"]) for x in compact_windows.repeated_passages(docs).collect()}
    assert len({x[0] for x in found}) == 295 and sum(met) < 30000  # as before, with 54289 pairs
    monkeypatch.setattr(compact_windows, "in_crowds", lambda *a: crowds(*a, whole=1))
    assert found == {(x["doc_id"], x["start"], x["n_words"], x["other"], x["other_start"]) for x in compact_windows.repeated_passages(docs).collect()}


def test_prefixes_of_whole_signatures_equal_those_of_each_run():
    r = random.Random(1)
    for _ in range(20):
        key, low, slices, starts = [], [], [], []
        for g in range(r.randint(1, 5)):
            base = [r.randrange(1, 500) for _ in range(120)]
            for _ in range(r.randint(1, 12)):
                n, a = r.randint(50, 95), r.randint(0, 20)
                words = [r.choice(base) if r.random() < 0.02 else w for w in base[a : a + n]] if r.random() < 0.7 else [base[k % 7] for k in range(n)]
                key.append(7 * g - 3)
                low.append(-r.randint(0, 40))
                slices.append(np.array(words, "<u4").tobytes())
                starts.append(sorted(r.sample(range(low[-1], low[-1] + n - 49), r.randint(0, n - 49))))
        rows = compact_windows.key_prefixes(np.array(key), np.array(low), slices, starts, 5, 46, 0.8)
        ids, want = [compact_windows.shingle_ids(np.frombuffer(x, "<u4"), 5).view(np.int64) for x in slices], set()
        for i, x in enumerate(ids):
            counts = {v: sum(v in y for k, y in zip(key, ids) if k == key[i]) for v in set(x.tolist())}
            for kind, told in enumerate(compact_windows.window_prefixes(x, counts, 46, 0.8, {s - low[i] for s in starts[i]})):
                want |= {(i, v, kind, bool(asks), first, last) for v, (asks, first, last) in told.items()}
        assert set(zip(*(x.tolist() for x in rows))) == want


def test_cartesian_tree_and_windows_against_every_passage():
    r = np.random.default_rng(0)
    for t in range(200):
        texts = [" ".join(f"w{v}" for v in r.integers(0, 9 if t % 2 else 500, r.integers(1, 90))).encode() for _ in range(3)]
        words = Words(texts)
        shingles, whole = words.runs(5), words.whole(5)
        if len(shingles) < 46:
            continue
        node, first, last = compact_windows.compact_windows(shingles, whole, t % 8, 46)
        order = mix(shingles ^ np.uint64(0xA24BAED4963EE407 * (t % 8 + 1) % (1 << 64))) & ~PLACE
        want = {s: s + int(np.argmin(order[s : s + 46])) for s in range(len(shingles) - 45) if whole[s : s + 46].all()}
        assert {s: c for c, a, b in zip(node, first, last) for s in range(a, b + 1)} == want


@pytest.mark.parametrize("edit", ["change", "insert", "delete"])
def test_compact_windows_recall_of_one_edit(spark, edit):
    """Passages of 50 words, one of them changed, put in or left out in the middle, at similarity 0.80: at least nine in ten."""
    rows = []
    for k in range(100):
        a = prose(k, 50 + (edit == "delete")).split()
        b = a[:25] + (["zz"] if edit != "delete" else []) + a[25 + (edit != "insert") :]
        rows += [(2 * k, " ".join([prose(5000 + k, 30), *a, prose(6000 + k, 30)])), (2 * k + 1, " ".join([prose(7000 + k, 30), *b, prose(8000 + k, 30)]))]
    got = {(x["doc_id"], x["other"]) for x in compact_windows.repeated_passages(documents(spark, rows)).collect()}
    assert len(got & {(2 * k + 1, 2 * k) for k in range(100)}) >= 95 and all(a == b + 1 for a, b in got)


def test_compact_windows_tell_equal_passages_around_a_common_line(spark):
    """60 pairs of documents share 50 words of which 40 are common to all 120."""
    line = prose(1, 40)
    rows = [(k, f"{prose(1000 + k, 30)} {line} {prose(500 + k // 2, 10)} {prose(3000 + k, 30)}") for k in range(120)]
    got = {(x["doc_id"], x["other"]) for x in compact_windows.repeated_passages(documents(spark, rows)).collect()}
    assert {(2 * k + 1, 2 * k) for k in range(60)} <= got


def test_compact_windows_of_a_crowd_of_similar_passages(spark):
    """Forty near copies of a passage, each with a word of its own: every one but the first is told, by a smaller id."""
    base, rows = prose(4, 60).split(), []
    for k in range(40):
        own = list(base)
        own[k] = f"own{k}"
        rows.append((k, " ".join([prose(100 + k, 30), *own, prose(200 + k, 30)])))
    got = [(x["doc_id"], x["other"]) for x in compact_windows.repeated_passages(documents(spark, rows)).collect()]
    assert {a for a, _ in got} >= set(range(1, 40)) - {1} and all(b < a for a, b in got)
    told = components(range(40), lambda a, b: (b, a) in set(got))
    assert len(set(told.values())) == 1


def test_suffixes_around_a_common_line_lose_no_link(spark):
    """120 documents share a line of 35 to 49 words; pairs of them share the words behind it, 50 in all."""
    for size in (35, 42, 49):
        line = prose(1, size)
        rows = [(k, f"{prose(1000 + k, 30)} {line} {prose(500 + k // 2, 50 - size)} {prose(3000 + k, 30)}") for k in range(120)]
        got = {(x["doc_id"], x["other"]) for x in suffix_array.repeated_substrings(documents(spark, rows)).collect()}
        text = dict(rows)
        assert got >= {(2 * k + 1, 2 * k) for k in range(60)} and all(shares(text[a], text[b]) for a, b in got)


def test_positions_beyond_four_million_words(spark):
    """A passage behind word 4,300,000 of one text is found by both operators."""
    shared = prose(1, 60)
    rows = [(1, prose(2, 40) + " " + shared), (2, " ".join(map(str, range(4_300_000))) + " " + shared)]
    docs = documents(spark, rows).repartition(2)
    got = [(x["doc_id"], x["start"], x["n_words"], x["other_start"]) for x in suffix_array.repeated_substrings(docs).collect()]
    assert got == [(2, 4_300_000, 60, 40)]
    got = [(x["doc_id"], x["other"]) for x in compact_windows.repeated_passages(docs).collect()]
    assert set(got) == {(2, 1)}


def test_passage_finders_on_repeated_and_missing_ids(spark):
    shared = prose(1, 70)
    rows = [(1, shared), (1, shared), (2, shared + " more"), (2, prose(3, 80)), (None, shared), (3, None), (4, ""), (5, prose(3, 80))]
    for find in (compact_windows.repeated_passages, suffix_array.repeated_substrings):
        assert {(x["doc_id"], x["other"]) for x in find(documents(spark, rows)).collect()} == {(2, 1), (5, 2)}


def shares(a, b, n=50):
    runs = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in ((t or "").lower().split() for t in (a, b))]
    return bool(runs[0] & runs[1])


def test_suffix_array_finds_every_document_that_shares_a_passage(spark):
    rows, _ = with_passages()
    r = random.Random(9)
    rows += [(40 + k, prose(900 + k, 90) + " " + " ".join(prose(500 + k % 3, 120).split()[: r.randint(50, 120)]) + " " + prose(950 + k, r.randint(0, 60))) for k in range(9)]
    rows += [(60 + k, " ".join(["one two three four five six seven"] * (12 + 9 * k))) for k in range(4)] + [(70, rows[0][1]), (71, rows[0][1])]
    text = dict(rows)
    expected = {i for a, b in itertools.combinations(text, 2) if shares(text[a], text[b]) for i in (a, b)}
    got = suffix_array.repeated_substrings(documents(spark, [*rows, rows[3], (None, rows[1][1])])).collect()
    assert {i for x in got for i in (x["doc_id"], x["other"])} == expected
    for x in got:
        a, b = (text[x[d]].lower().split()[x[s] : x[s] + x["n_words"]] for d, s in (("doc_id", "start"), ("other", "other_start")))
        assert a == b and len(a) == x["n_words"] >= 50
    whole = [x for x in got if {x["doc_id"], x["other"]} <= {0, 70, 71}]
    assert all((x["start"], x["n_words"]) == (0, 200) for x in whole) and whole
    covered = max(x["start"] + x["n_words"] for x in got if x["doc_id"] == 63)
    assert covered == len(text[63].split())  # the longest periodic text is laid out to its end
    assert suffix_array.repeated_substrings(empty(spark)).count() == 0


def plain_distance(item, text):
    """Smallest edit distance of the item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contamination_equals_all_distances(spark):
    r = random.Random(1)
    items = [(k, prose(k, 8 + k)) for k in range(6)] + [(6, None), (7, "!!"), (8, prose(0, 8))]
    docs = [(0, None), (1, ""), (2, prose(50, 80))]
    for k in range(24):
        own = list(items[k % 6][1])
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 1)] = r.choice(["", "q", "qq"])
        docs.append((10 + k, prose(60 + k, 10) + " " + "".join(own).upper() + ", " + prose(90 + k, 10)))
    expected = set()
    for (i, text), (j, item) in itertools.product(docs, items):
        a, b = decontaminate.normalize(item), decontaminate.normalize(text)
        if a and plain_distance(a, b) <= len(a) // decontaminate.CHARS_PER_EDIT:
            expected.add((i, j, plain_distance(a, b)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 40):
        got = decontaminate.contamination(documents(spark, docs), bench, block_chars=block).collect()
        assert {(x["doc_id"], x["item_id"], x["distance"]) for x in got} == expected and len(got) == len(expected)
    found = {i for i, _, _ in expected}
    hit = next(x for x in docs if x[0] in found)
    repeated = decontaminate.contamination(documents(spark, [hit, hit, (None, hit[1])]), bench).collect()
    assert {x["doc_id"] for x in repeated} == {hit[0], None} and len(repeated) % 3 == 0
    clean = decontaminate.clean_documents(documents(spark, [*docs, *docs[:3]]), bench)
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted([i for i, _ in docs if i not in found] + [i for i, _ in docs[:3] if i not in found])
    assert decontaminate.contamination(empty(spark), bench).count() == 0 and decontaminate.clean_documents(empty(spark), bench).count() == 0
    assert decontaminate.contamination(documents(spark, docs), bench.where("false")).count() == 0


def test_queries_cover_the_exact_copies_of_the_table(spark):
    """Equal texts of at least 50 words are in one component and are all told by the passage finders."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    groups = {}
    for x in docs:
        groups.setdefault(x["text"], []).append(x["doc_id"])
    same = [sorted(v) for t, v in groups.items() if len(v) > 1 and len((t or "").split()) >= 50]
    comps = {x["doc_id"]: x["component_id"] for x in simhash.op8_simhash_near_dedup(spark, SF).collect()}
    later = {x["doc_id"] for x in compact_windows.op4_substring_dedup(spark, SF).collect()}
    told = {i for x in suffix_array.op7_suffix_array_dedup(spark, SF).collect() for i in (x["doc_id"], x["other"])}
    for ids in same:
        assert len({comps[i] for i in ids}) == 1 and set(ids[1:]) <= later and set(ids) <= told


def test_passages_are_ranked_by_the_worker_that_cuts_them(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 2}{n}" for n in range(70))) for k in range(4)], "doc_id long, text string")
    runs = suffix_array.suffixes(docs)
    ranked = suffix_array.passage_ranks(docs, spark.createDataFrame(runs.collect(), runs.schema))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # was two, each with workers of its own
    passages = {(r["doc_id"], r["at"] + r["low"]): r["key"] for r in ranked.collect()}
    assert {p for _, p in passages} == set(range(21)) and all(passages[d, p] == passages[d + 2, p] for d in (0, 1) for p in range(21))
    assert all(r["low"] == r["high"] for r in ranked.collect()) and not {passages[0, p] for p in range(21)} & {passages[1, p] for p in range(21)}
