"""Spelling variants (operator 11): words one edit apart, found as points in rectangles by wavelet trees.

Put words in order, and again in the order of their reversed forms: each word is a point.  The words that differ from w at
place p only are those with the prefix w[:p] and the suffix after p, an interval of either order, so they are the points in
a rectangle, which a wavelet tree reports.  One tree for each length of word, so replaced letters are looked for in the tree
of w's own length and put-in ones in that of the next; a deleted letter is one put in, seen from the other word.

Words are dealt to workers by their first letters and, once more, by their last ones.  A prefix of more than ``LIMIT`` words
is split by its next letter, and so on, and likewise a suffix.  An edit behind the letters that w was dealt by is found
among words dealt by prefix, one before the letters that it was dealt by in reverse among those dealt by suffix.  Where both
are so common that neither is so, the words meet by what is left without the letter, an exact key that at most one word a
letter of the alphabet has.  So nothing is capped, and no worker holds more than a block of words.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, table

#: Letters: A-Z, a-z and the code points from U+00C0 to U+00FF, so a word is a byte a letter in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: Most words that share the letters they are dealt by; code points that a worker gathers before it builds trees.
LIMIT, CHUNK = 1 << 16, 1 << 20
#: Letters that words are dealt by at first.
START = 3
_WIDTH = 64
_BATCH = 1 << 17


class Wavelet:
    """A permutation as a wavelet tree by levels: which values stand in a span of places, for many spans at once."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])  # zeros before each place
            self.levels.append((bit, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, first: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [low, high) at a place in [first, stop), of each query."""
        query = np.nonzero((first < stop) & (low < high))[0]
        first, stop, base = first[query], stop[query], np.zeros(len(query), np.int64)
        for bit, zeros in self.levels:
            half = 1 << bit
            a0, b0 = zeros[first], zeros[stop]
            a1, b1 = zeros[-1] + first - a0, zeros[-1] + stop - b0
            lower = (a0 < b0) & (base < high[query]) & (base + half > low[query])
            upper = (a1 < b1) & (base + half < high[query]) & (base + 2 * half > low[query])
            query, first, stop, base = (
                np.concatenate([x[lower], y[upper]]) for x, y in ((query, query), (a0, a1), (b0, b1), (base, base + half))
            )
        return query, base


def common_prefixes(words: list[bytes]) -> np.ndarray:
    """Letters that each word shares with the one before; the first shares none."""
    n = len(words)
    padded = np.frombuffer(b"".join(w[:_WIDTH].ljust(_WIDTH, b"\0") for w in words), np.uint8).reshape(n, _WIDTH)
    out = np.zeros(n, np.int64)
    differ = padded[1:] != padded[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), _WIDTH)
    size = np.array([len(w) for w in words], np.int64)
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    for i in np.nonzero(out >= _WIDTH)[0].tolist():  # long words, few of which share as much
        m = min(len(words[i]), len(words[i - 1]))
        a, b = np.frombuffer(words[i], np.uint8, m), np.frombuffer(words[i - 1], np.uint8, m)
        out[i] = m if (a == b).all() else int((a != b).argmax())
    return out


class Order:
    """Words in order; the interval of those that share the first letters of one of them."""

    def __init__(self, words: list[bytes]):
        self.order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        shared = common_prefixes([words[i] for i in self.order.tolist()])
        self.most = np.maximum(shared, np.append(shared[1:], 0))[self.rank]  # letters that a word shares with any other
        self.table = [shared]  # smallest of 1, 2, 4, ... values from each place on
        while 2 << (len(self.table) - 1) <= len(words):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def interval(self, word: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank + 1 of the words that share so many first letters with ``word``."""
        first = self.rank[word].copy()
        stop = first + 1
        n = len(self.rank)
        for level in range(len(self.table) - 1, -1, -1):
            step, least = 1 << level, self.table[level]
            up = stop + step <= n
            up[up] = least[stop[up]] >= letters[up]
            stop[up] += step
            down = first - step >= 0
            down[down] = least[first[down] - step + 1] >= letters[down]
            first[down] -= step
        return first, stop


def near_pairs(words: list[bytes], low: np.ndarray, high: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of distinct words one edit apart, where the place p of the edit in i is within ``low[i]`` and ``high[i]``.

    A letter of i is replaced at p, in either direction of the pair by itself, or one is put into i before p to make j, for p
    up to ``longer[i]``; of several such places the first is taken, so a pair is told once."""
    size = np.array([len(w) for w in words], np.int64)
    forward, backward = Order(words), Order([w[::-1] for w in words])
    letters = np.frombuffer(b"".join(words), np.uint8)
    offset = np.cumsum(size) - size
    trees = {}
    for length in np.unique(size).tolist():
        of = size[forward.order] == length
        ranks, back = np.nonzero(of)[0], np.sort(backward.rank[size == length])
        trees[length] = (ranks, back, forward.order[ranks], Wavelet(np.searchsorted(back, backward.rank[forward.order[ranks]])))
    by_back = backward.order
    left, right = [], []
    for more in (0, 1):
        # only places where another word shares what is before and another what is behind
        tail = size - 1 + more
        a = np.maximum(low, tail - backward.most)
        b = np.minimum(longer if more else high, forward.most)
        count = np.maximum(b - a + 1, 0)
        total = np.cumsum(count)
        start = 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _BATCH)))
            own = np.repeat(np.arange(start, stop), count[start:stop])
            place = np.arange(len(own)) - np.repeat(np.cumsum(count[start:stop]) - count[start:stop], count[start:stop]) + a[own]
            start = stop
            first, last = forward.interval(own, place)
            r_first, r_last = backward.interval(own, tail[own] - place)
            target = size[own] + more
            for length in np.unique(target).tolist():
                if length not in trees:
                    continue
                ranks, back, members, tree = trees[length]
                of = np.nonzero(target == length)[0]
                query, value = tree.report(*(np.searchsorted(x, y[of]) for x, y in ((ranks, first), (ranks, last), (back, r_first), (back, r_last))))
                i, j, p = own[of[query]], by_back[back[value]], place[of[query]]
                if more:
                    before = letters[np.maximum(offset[i] + p - 1, 0)]
                    ok = (p == 0) | (letters[offset[j] + p] != before)
                else:
                    ok = i != j
                left.append(i[ok])
                right.append(j[ok])
                if more:
                    left.append(j[ok])
                    right.append(i[ok])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """(word, n): the words of ``shortest`` letters at least that occur ``least`` times in all texts."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    lowered = docs.select(name.alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size, at = F.length("run"), F.pmod(F.col("h"), F.length("run")).cast("int")
    without = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % one_in == 0, without).otherwise(F.col("run"))
    words = lowered.withColumn("h", h).withColumn("at", at).select(word.alias("word"), size.alias("size"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dealt(words: DataFrame, head: Column, name: str, limit: int = LIMIT) -> DataFrame:
    """``words`` with ``name``: the fewest letters, from ``START`` on, that at most ``limit`` words share as their ``head``.

    A word shorter than that gets its length + 1.  ``head`` gives a word's letters to be shared, its first or its last ones,
    as a function of column ``name``.  At most one in ``limit`` of the words' number are common heads: a small broadcast."""
    words = words.withColumn(name, F.lit(START))
    for letters in itertools.count(START):
        reached = (F.col(name) == letters) & (F.length("word") >= letters)
        common = cut(words.where(reached).groupBy(head.alias("common")).count().where(F.col("count") > limit).select("common"), "heads")
        if not common.limit(1).count():
            forget(common)
            return words
        deeper = words.join(F.broadcast(common), reached & (head == F.col("common")), "left")
        words = cut(deeper.withColumn(name, F.when(F.col("common").isNotNull(), letters + 1).otherwise(F.col(name))).drop("common"), "dealt")


NEAR = "word string, n_near long, form_n long, form string"


def met_in_blocks(words: DataFrame) -> DataFrame:
    """For words (word, n, d, e) dealt by d first and by e last letters, what near words tell each, one row a block or less."""

    def told(rows: list[tuple[str, int, int, int, bool]]) -> pa.RecordBatch | None:
        words = [r[0].encode("latin-1") for r in rows]
        n, d, e = (np.array(x, np.int64) for x in list(zip(*rows))[1:4])
        size = np.array([len(w) for w in words], np.int64)
        if rows[0][4]:
            low, high, longer = d, size - 1, size
        else:
            low, high, longer = np.zeros(len(rows), np.int64), np.minimum(d - 1, size - 1 - e), np.minimum(d - 1, size - e)
        i, j = near_pairs(words, low, high, longer)
        if not len(i):
            return None
        # each word's near words, the most frequent first and then in order
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        place = np.empty(len(words), np.int64)
        place[by_word] = np.arange(len(words))
        best = np.lexsort((place[j], -n[j], i))
        i, j = i[best], j[best]
        head = np.nonzero(np.r_[True, i[1:] != i[:-1]])[0]
        count = np.diff(np.r_[head, len(i)])
        names = [rows[k][0] for k in i[head].tolist()], [rows[k][0] for k in j[head].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(count), pa.array(n[j[head]]), pa.array(names[1])], ["word", "n_near", "form_n", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, int, bool]] = []
        size, last = 0, None
        for batch in batches:
            for by_prefix, head, *row in zip(*(batch.column(c).to_pylist() for c in ("by_prefix", "head", "word", "n", "d", "e"))):
                if (by_prefix, head) != last and rows and (size >= CHUNK or by_prefix != rows[0][4]):
                    if (out := told(rows)) is not None:
                        yield out
                    rows, size = [], 0
                last = (by_prefix, head)
                rows.append((*row, by_prefix))
                size += len(row[0])
        if rows and (out := told(rows)) is not None:
            yield out

    first = words.where("d <= length(word)").select(F.lit(True).alias("by_prefix"), F.expr("left(word, d)").alias("head"), "word", "n", "d", "e")
    final = words.where("e <= length(word)").select(F.lit(False).alias("by_prefix"), F.expr("right(word, e)").alias("head"), "word", "n", "d", "e")
    blocks = first.union(final).repartitionByRange("by_prefix", "head").sortWithinPartitions("by_prefix", "head")
    return blocks.mapInArrow(run, NEAR)


def met_by_rest(words: DataFrame) -> DataFrame:
    """The same for the places between common first and common last letters: words meet by all letters but one.

    A word stands under its letters without that at p, and under its whole self for one that is put in before p."""
    places = words.where("d + e > length(word)").select("word", "n", F.explode(F.expr("sequence(length(word) - e, d)")).alias("p"), "d", "e")
    parts = F.expr("substring(word, 1, p)"), F.expr("substring(word, p + 2)"), F.expr("substring(word, p + 1)")
    inside = places.where("p between greatest(length(word) - e, 0) and least(d - 1, length(word) - 1)")
    without = inside.select("word", "n", "p", parts[0].alias("a"), parts[1].alias("b"), F.expr("substring(word, p + 1, 1)").alias("letter"))
    between = places.where("p between greatest(length(word) - e + 1, 0) and least(d - 1, length(word))").select("word", "n", "p", parts[0].alias("a"), parts[2].alias("b"))
    mine, theirs = without.alias("x"), without.alias("y")
    on = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b"))
    replaced = mine.join(theirs, on & (F.col("x.word") != F.col("y.word"))).select(F.col("x.word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
    # the first place where the letter can be put in
    put_in = between.alias("x").join(theirs, on & ((F.col("x.p") == 0) | (F.expr("right(x.a, 1)") != F.col("y.letter"))))
    told = replaced.union(put_in.select(F.col("x.word"), F.col("y.word"), F.col("y.n"))).union(put_in.select(F.col("y.word"), F.col("x.word"), F.col("x.n")))
    return told.select("word", F.lit(1).cast("long").alias("n_near"), F.col("near_n").alias("form_n"), F.col("near").alias("form"))


def roots(forms: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(word, root): the last of the forms that lead on from each word of ``forms`` (word, form), by pointer jumping."""
    up = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(up)
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        up = new
    raise RuntimeError("forms don't end")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 10, limit: int = LIMIT, **kinds: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the ``vocabulary`` of all texts.

    Words are near if they differ by one inserted, deleted or replaced code point; a word's form is its near word of the
    largest n (ties: the smallest in code-point order) if that is ``factor`` times its own n or more, and root the last form
    that follows from it.  Null and empty texts have no words; a null id is written as nothing before the colon that a run's
    checksum is taken of, so a run is the same in all rows of an id; repeated rows count each.  Words of any length are taken
    whole, and an empty table gives no rows.  Other columns are ignored."""
    words = cut(vocabulary(docs, id_col, text_col, **kinds), "words")
    held = dealt(words, F.expr("left(word, d)"), "d", limit)
    held = cut(dealt(held, F.expr("right(word, e)"), "e", limit), "words")
    told = met_in_blocks(held).union(met_by_rest(held))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))  # strings are compared by code points
    near = told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    of_form = lambda c: F.when(-F.col("best.minus") >= factor * F.col("n"), c)
    columns = [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), of_form(F.col("best.form")).alias("form"), of_form(-F.col("best.minus")).alias("form_n")]
    forms = cut(words.join(near, "word", "left").select("word", "n", *columns), "forms")
    forget(words, held)
    found = forms.join(roots(forms.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all words of ``documents``, see ``spelling_variants``."""
    return spelling_variants(table(spark, sf_dir, "documents"))
