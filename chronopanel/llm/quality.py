"""Operator 9, quality classifier by co-training.

Two views of a document: its text (shape of the writing, words that favour or speak against the target) and its page
metadata (language, source, length and how they go together).  Each view has a logistic classifier; over some rounds,
each labels the pool documents that it is surest about, and the other trains on those labels too.  How many it passes on
and what they weigh comes from its precision on labelled rows kept apart: a view that is right no more often than the
class is common passes on nothing, one that is always right passes labels of full weight.  The views are calibrated and
combined on those rows, and the combination scores every document.  The same procedure is run for two targets, low
quality and toxicity; a document is kept if neither is likely.  Fitting uses a bounded sample of labelled rows and a
bounded pool of unlabelled ones (``sample_rows``, ``pool_rows``) on the driver; scoring reads all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounds of what is fitted on: labelled rows and unlabelled rows.
SAMPLE_ROWS, POOL_ROWS = 8000, 4000
ROUNDS = 3
#: Shares of the pool that a view may pass on for a class, and the precision from which the largest such share is taken.
SHARES, PRECISION = (0.02, 0.05, 0.1, 0.2), 0.9
_WORD = re.compile(r"[^\W_]+")
_ASCII = np.zeros((6, 256), bool)
_ASCII[0, 65:91] = _ASCII[1, 48:58] = True
_ASCII[2, [10, 13]] = _ASCII[3, [9, 32]] = True
_ASCII[4, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ASCII[5, 97:123] = True


def shape(text: str) -> tuple[np.ndarray, list[str]]:
    """Dense features of the whole text and its lower-case words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = (_ASCII @ counts) / max(1, len(raw))
    tokens = text.split()
    n = max(1, len(tokens))
    words = _WORD.findall(text.lower())
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    lines = text.split("\n")
    return np.array([
        *shares, np.sqrt(shares[0]), np.sqrt(shares[4]), len(set(tokens)) / n, repeats, np.sqrt(repeats), len(raw) / n / 10, counts[124] / n,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(tokens)) / 10, (len(set(tokens)) / n) * np.log1p(len(tokens)) / 10,
    ]), words


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in dict.fromkeys(words)), np.int64)


#: Columns of the metadata view: language, source, length class, language with length class, size.
META = 16 + 64 + 16 + 64 + 4


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META)
    size = np.log1p(max(0, n_chars or 0)) / 10
    step = 0 if n_chars is None else 1 + min(14, int(14 * min(1.0, size)))
    out[zlib.crc32((lang or "?").encode()) % 16] = 1
    out[16 + zlib.crc32((source or "?").encode()) % 64] = 1
    out[80 + step] = 1
    out[96 + zlib.crc32(f"{lang or '?'}/{step}".encode()) % 64] = 1
    out[160:] = size, size**2, size**3, n_chars is None
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic regression on weighted rows, the intercept last and unpenalised, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


#: Figures of the text view from words: the three strongest for and against the target, and the mean.
TOLD = 7


@dataclass
class Head:
    """One target: word weights, scaling of the text view, and the views' and the combination's weights."""

    words: tuple[np.ndarray, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    content: np.ndarray
    meta: np.ndarray
    mix: np.ndarray

    def text_view(self, dense: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        known, odds = self.words
        found = np.sort(odds[np.searchsorted(known, np.intersect1d(hashes, known, assume_unique=True))])
        told = np.zeros(TOLD)
        most, least = np.maximum(found[-3:], 0), np.minimum(found[:3], 0)
        told[3 - len(most) : 3], told[3 : 3 + len(least)] = most, least
        told[6] = found.mean() if len(found) else 0.0
        return (np.concatenate([dense, told]) - self.mean) / self.scale

    def score(self, views: np.ndarray, metas: np.ndarray) -> np.ndarray:
        return sigmoid(logit(np.column_stack([logit(views, self.content), logit(metas, self.meta)]), self.mix))


@dataclass
class Model:
    low: Head | None = None
    toxic: Head | None = None
    report: dict = field(default_factory=dict)


def word_weights(rows: list[dict], y: np.ndarray, weight: np.ndarray, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the log odds of the target given the word, against its share, where they tell something.

    Words in fewer than ``least`` rows say nothing, and three rows' worth of the share is added to each, so rare words
    say little; the table holds at most a fifth of the words of the sample."""
    hashes, each = np.concatenate([r["hashes"] for r in rows]), [len(r["hashes"]) for r in rows]
    words, at = np.unique(hashes, return_inverse=True)
    seen = np.bincount(at, minlength=len(words))
    hits = np.bincount(at, weights=np.repeat(weight, each), minlength=len(words))
    positive = np.bincount(at, weights=np.repeat(y * weight, each), minlength=len(words))
    share = min(max(np.average(y, weights=weight), 1e-3), 1 - 1e-3)
    rate = (positive + 3 * share) / (hits + 3)
    odds = np.log((rate + 1e-9) / (1 - rate + 1e-9)) - np.log(share / (1 - share))
    told = (seen >= least) & (np.abs(odds) > 0.5)
    return words[told], odds[told].astype(np.float32)


def passed_on(sure: np.ndarray, right: np.ndarray, weight: np.ndarray, pool: np.ndarray, common: float) -> tuple[np.ndarray, float]:
    """(rows of the pool, weight of their labels) that a view passes on for a class.

    sure, right, weight: how sure the view is of the class on rows kept apart, whether they are of it, their weights; pool:
    how sure it is there; common: the class's share.  The largest of SHARES that is precise enough is taken, else the most
    precise one; the weight is the part of the doubt that the view takes away."""
    best, precision = 0.0, 0.0
    for share in SHARES:
        told = sure >= np.quantile(sure, 1 - share)
        p = float(np.average(right[told], weights=weight[told]))
        if p >= max(precision, PRECISION) or p > precision and precision < PRECISION:
            best, precision = share, p
    worth = max(0.0, (precision - common) / (1 - common)) if common < 1 else 0.0
    if not worth or not len(pool):
        return np.zeros(0, np.int64), 0.0
    return np.nonzero(pool >= np.quantile(pool, 1 - best))[0], worth


def co_train(rows: list[dict], y: np.ndarray, pool: list[dict], rounds: int = ROUNDS) -> tuple[Head, dict]:
    """A head from labelled rows and an unlabelled pool.

    Rows are dealt into four parts: views are fitted on two, thresholds and the combination are taken from the third, and
    the accuracy told in the report from the fourth, which nothing else sees.  A row's words are weighed on other parts.
    Where a part lacks a class, all rows serve for everything and the report says so."""
    part = np.array([zlib.crc32(b"%d" % r["doc_id"]) % 4 for r in rows])
    weight = np.array([r["weight"] for r in rows], float)
    weight /= weight.mean()
    fit, dev, test = part <= 1, part == 2, part == 3
    split = all(0 < y[s].sum() < s.sum() for s in (fit, dev, test))
    if not split:
        fit = dev = test = np.ones(len(rows), bool)
    head = Head((np.zeros(0, np.int64), np.zeros(0, np.float32)), np.zeros(1), np.ones(1), np.zeros(1), np.zeros(1), np.array([1.0, 0.0, 0.0]))

    def raw(rs: list[dict], words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        head.words = words
        return np.array([head.text_view(r["dense"], r["hashes"]) for r in rs])

    plain = np.zeros((len(rows), len(rows[0]["dense"]) + TOLD))
    for k in np.unique(part):
        own, away = part == k, (part != k) & ~test if split else part != k
        if not away.any():
            away = own
        plain[own] = raw([r for r, o in zip(rows, own) if o], word_weights([r for r, o in zip(rows, away) if o], y[away], weight[away]))
    known = ~test if split else fit
    everything = word_weights([r for r, o in zip(rows, known) if o], y[known], weight[known])
    pooled = raw(pool, everything) if pool else plain[:0]
    head.words = everything
    head.mean, head.scale = plain[fit].mean(0), plain[fit].std(0) + 1e-6
    texts, metas = (plain - head.mean) / head.scale, np.array([r["meta"] for r in rows])
    sets = {"content": (texts, (pooled - head.mean) / head.scale), "meta": (metas, np.array([r["meta"] for r in pool]) if pool else metas[:0])}
    extra: dict[str, dict[int, tuple[int, float]]] = {"content": {}, "meta": {}}
    share = float(np.average(y[fit], weights=weight[fit]))
    given = {view: {"positive": 0, "negative": 0, "weight": 0.0} for view in sets}

    def trained(view: str) -> np.ndarray:
        (x, more), own = sets[view], extra[view]
        labels, weights = ([v[k] for v in own.values()] for k in (0, 1))
        return fit_logistic(np.concatenate([x[fit], more[list(own)]]), np.concatenate([y[fit], labels]), np.concatenate([weight[fit], weights]))

    def accuracy(weights: dict[str, np.ndarray]) -> float:
        head.content, head.meta = weights["content"], weights["meta"]
        both = np.column_stack([logit(texts[dev], head.content), logit(metas[dev], head.meta)])
        head.mix = fit_logistic(both, y[dev].astype(float), weight[dev])
        return float(np.average((head.score(texts[test], metas[test]) >= 0.5) == y[test], weights=weight[test]))

    weights = {view: trained(view) for view in sets}
    alone = accuracy(weights)
    for _ in range(rounds):
        for view, other in (("content", "meta"), ("meta", "content")):
            x, more = sets[view]
            seen, guess = logit(x[dev], weights[view]), logit(more, weights[view])
            for target, sign, common in ((1, 1, share), (0, -1, 1 - share)):
                which, worth = passed_on(sign * seen, y[dev] == target, weight[dev], sign * guess, common)
                for k in which.tolist():
                    if k not in extra[other]:
                        extra[other][k] = (target, worth)
                        given[other]["positive" if target else "negative"] += 1
                        given[other]["weight"] += worth
            weights[other] = trained(other)
    told = accuracy(weights)
    return head, {"labelled": len(rows), "tested": int(test.sum()) if split else 0, "accuracy": told, "accuracy_without_exchange": alone, "passed_to": given}


def _columns(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    def has(name: str, kind: str) -> Column:
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), has("lang", "string"), has("source", "string"), has("n_chars", "long")]


def shares_of(classes: list[tuple[tuple, int]], rows: int) -> dict[tuple, int]:
    """How many rows of each class to take, at most ``rows`` in all: small classes whole, the others alike."""
    left, out = rows, {}
    ordered = sorted(classes, key=lambda c: (c[1], str(c[0])))
    for k, (name, n) in enumerate(ordered):
        out[name] = min(n, left // (len(ordered) - k))
        left -= out[name]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Labels: doc_id, quality (1 good), toxic (1 toxic); several rows of a document count as its worst, null ids as none.

    The sample holds rare classes whole and is weighted back to the shares of all labels; the pool has no labelled
    document in it.  Both are the first in an order by hash, so a fit doesn't change with the run.  Of rows with one id
    the smallest text is taken.  A target without labelled documents of both kinds has no head and rejects nothing."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.where(F.col(id_col).isNotNull()).select(*_columns(docs, id_col, text_col))
    ids = rows.select("doc_id").distinct()
    known = known.join(ids, "doc_id")
    classes = [((r["quality"], r["toxic"]), r["count"]) for r in known.groupBy("quality", "toxic").count().collect()]  # a few classes
    if not classes:
        return Model()
    order = F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")
    chosen = None
    for (quality, toxic), n in shares_of(classes, sample_rows).items():
        total = dict(classes)[quality, toxic]
        part = known.where(F.col("quality").eqNullSafe(F.lit(quality)) & F.col("toxic").eqNullSafe(F.lit(toxic))).orderBy(*order).limit(n).withColumn("weight", F.lit(total / max(1, n)))
        chosen = part if chosen is None else chosen.union(part)
    pool = ids.join(labels.where("doc_id is not null").select("doc_id"), "doc_id", "left_anti").orderBy(*order).limit(pool_rows)
    pool = pool.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), F.lit(0.0).alias("weight"))
    picked = chosen.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), "weight").union(pool)
    shown = rows.join(F.broadcast(picked), "doc_id")  # at most sample_rows + pool_rows rows of 24 bytes
    body = F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    shown = shown.groupBy("doc_id", "quality", "toxic", "weight").agg(F.min(body).alias("row")).select("doc_id", "quality", "toxic", "weight", "row.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dense, words = shape(row["text"] or "")
                yield pa.RecordBatch.from_pylist([{
                    "doc_id": row["doc_id"], "quality": row["quality"], "toxic": row["toxic"], "weight": row["weight"], "dense": dense.tolist(),
                    "hashes": word_hashes(words).tolist(), "meta": metadata(row["lang"], row["source"], row["n_chars"]).tolist(),
                }], KIND)

    got = shown.mapInArrow(features, "doc_id long, quality int, toxic int, weight double, dense array<double>, hashes array<bigint>, meta array<double>")
    sample = [r.asDict() | {"dense": np.array(r["dense"]), "hashes": np.array(r["hashes"], np.int64), "meta": np.array(r["meta"])} for r in got.toLocalIterator()]
    sample.sort(key=lambda r: r["doc_id"])
    unlabelled = [r for r in sample if not r["weight"]]
    model = Model()
    for name, target in (("low", lambda r: None if r["quality"] is None else int(r["quality"] == 0)), ("toxic", lambda r: r["toxic"])):
        labelled = [r for r in sample if r["weight"] and target(r) is not None]
        y = np.array([target(r) for r in labelled], np.int64)
        if 0 < y.sum() < len(y):
            head, model.report[name] = co_train(labelled, y, unlabelled, rounds)
            setattr(model, name, head)
    return model


KIND = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("weight", pa.float64()), ("dense", pa.list_(pa.float64())), ("hashes", pa.list_(pa.int64())), ("meta", pa.list_(pa.float64()))])


def score(docs: DataFrame, model: Model, low_at: float = 0.5, toxic_at: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, low_score, toxic_score, keep), one row per input row; scores are null where the model has no such head.

    Null and empty texts are scored as such, texts of any length whole; missing metadata is a value of its own, missing
    metadata columns too; repeated rows are scored alike, rows without an id like others; an empty table gives no rows."""
    judged = judge(docs.select(*_columns(docs, id_col, text_col)), model, low_at, toxic_at)
    return judged.select("doc_id", "low_score", "toxic_score", "keep")


def kept_documents(docs: DataFrame, model: Model, low_at: float = 0.5, toxic_at: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns, each of which goes to the workers once."""
    kinds = dict(docs.dtypes)
    told = {"text": (text_col, "string"), "lang": ("lang", "string"), "source": ("source", "string"), "n_chars": ("n_chars", "bigint")}
    inside = {name: docs.columns.index(c) for name, (c, kind) in told.items() if kinds.get(c) == kind}
    further = [c for c, name in zip(_columns(docs, id_col, text_col)[1:], told) if name not in inside]
    whole = docs.select(F.struct(*docs.columns).alias("row"), *further)
    return judge(whole, model, low_at, toxic_at, inside).where("keep").select("row.*")


def judge(rows: DataFrame, model: Model, low_at: float, toxic_at: float, inside: dict[str, int] | None = None) -> DataFrame:
    """``rows`` (row or doc_id; text, lang, source, n_chars) with scores.  ``inside``: places of those that ``row`` holds."""
    held = inside or {}
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c in ("row", "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [sent.value.low, sent.value.toxic]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts, *about = (part.column("row").field(held[c]) if c in held else part.column(c) for c in ("text", "lang", "source", "n_chars"))
                views: list[list[np.ndarray]] = [[], []]
                metas = np.array([metadata(*x) for x in zip(*(c.to_pylist() for c in about))]).reshape(-1, META)
                for text in texts:
                    dense, words = shape(text.as_py() or "")
                    hashes = word_hashes(words)
                    for view, head in zip(views, heads):
                        if head is not None:
                            view.append(head.text_view(dense, hashes))
                p = [np.full(len(metas), np.nan) if h is None else h.score(np.array(v), metas) for h, v in zip(heads, views)]
                keep = ~((p[0] >= low_at) | (p[1] >= toxic_at))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *[pa.array(x, pa.float64(), from_pandas=True) for x in p], pa.array(keep)], [*names, "low_score", "toxic_score", "keep"])

    schema = rows.select(*names, F.lit(0.0).alias("low_score"), F.lit(0.0).alias("toxic_score"), F.lit(True).alias("keep")).schema
    for f in schema.fields:
        f.nullable = True
    return rows.mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of all documents by a model fitted on the labels: see there for nulls, repeats, empty texts and columns."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
