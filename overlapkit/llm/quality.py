"""Quality classifier by co-training two views of a document.

* content view: the text itself - hashed-gram log-odds, shares of letters, capitals, digits, symbols,
  distinct and repeated words, and how its lines are laid out;
* metadata view: the record without its text - length as recorded, language and source.

Each round fits a logistic model per view on that view's training set, scores the pool of all unlabelled
documents, and hands its most confident documents, with the labels it gave them, to the *other*
view. After ``rounds`` rounds each view is calibrated (Platt) on labelled rows that no round has
seen, and a logistic combination of the two calibrated log-odds, fitted on the same rows, gives the
score of every document.

The fit reads about ``max_labelled`` labelled rows (a share by the hash of the id) and sums all unlabelled
ones, in one aggregation, into at most ``cells`` cells of like documents. Scoring reads every whole text
once.

Cases: null and empty texts have zero counts and a score like any other text; null source or lang is
a value of its own; duplicate label rows count once by their minimum; without labels of both kinds
every score is the share of good labels (1.0 with none), so nothing is rejected for want of labels;
repeated rows are scored alike; an empty table gives no rows. Extra columns pass through, but for one
that has the score column's name, which the score replaces.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?")
SLOTS = 8  # hashed indicators of source and of lang
LENGTHS = 26  # indicators of lengths by powers of two, the last but one for longer ones, the last for none


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))] @ self.weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.intercept, -12, 12)


def fit_logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, l2: float = 1.0, steps: int = 30) -> Logistic:
    """Ridge logistic regression by damped Newton steps; both classes weigh the same. ``rows``: what each row stands for."""
    rows = np.ones(len(y)) if rows is None else rows
    mean = np.average(x, axis=0, weights=rows)
    model = Logistic(mean, np.sqrt(np.average((x - mean) ** 2, axis=0, weights=rows)) + 1e-6, np.zeros(x.shape[1] + 1))
    z = np.c_[np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(x))]
    of = lambda which: rows.sum() / max(rows[which].sum(), 1e-9)
    weight = rows * np.where(y > 0, of(y > 0), of(y <= 0)) / 2
    ridge = np.diag(np.r_[np.full(x.shape[1], l2), 1e-6])
    for _ in range(steps):
        p = S.sigmoid(z @ model.weights)
        grad = z.T @ (weight * (p - y)) + ridge @ model.weights
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-6 * np.eye(z.shape[1]), grad)
        model.weights -= step / max(1.0, np.abs(step).max())
    return model


@dataclass
class QualityModel:
    bits: int
    base: float = 1.0
    odds: np.ndarray | None = None
    content: Logistic | None = None
    metadata: Logistic | None = None
    mix: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    handed: list = field(default_factory=list)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.content is None:
            return np.full(len(content), self.base)
        both = np.c_[self.content.log_odds(content), self.metadata.log_odds(metadata), np.ones(len(content))]
        return S.sigmoid(both @ self.mix)


def content_features(texts: list[bytes], odds: np.ndarray, bits: int) -> np.ndarray:
    """One row a text: gram log-odds, shares of character and word kinds, and the layout of its lines."""
    mean = S.pooled(odds, texts, bits)
    rows = np.zeros((len(texts), 15))
    for k, t in enumerate(texts):
        n = max(len(t), 1)
        words = t.split()
        w = max(len(words), 1)
        letters = sum(map(t.count, (b"e", b"a", b"n", b"i", b"t", b"r")))
        caps = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = len(t) - len(t.translate(None, SYMBOLS))
        digits = len(t) - len(t.translate(None, b"0123456789"))
        repeated = sum(map(operator.eq, words, words[1:]))
        lines = t.split(b"\n")
        long = [x for x in lines if x.strip()]
        m = max(len(long), 1)
        spaces = t.count(b" ")
        rows[k] = (
            caps / n, symbols / n, digits / n, letters / n,
            len(set(words)) / w / (1 - 0.05 * min(np.log1p(w), 12)), repeated / w,
            np.sqrt(symbols / w), np.log1p(w),
            np.log1p(len(lines)), np.log1p(sum(map(len, long)) / m), len(set(long)) / m,
            len(t) / (spaces + len(lines)), sum(x.rstrip().endswith((b".", b"?", b"!")) for x in long) / m,
            (len(lines) - len(long)) / len(lines), spaces / (len(t) + 1),
        )
    return np.c_[mean, rows]


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One row a record: its length and which of several lengths, and hashed indicators of source and language."""
    rows = np.zeros((len(source), 1 + LENGTHS + 2 * SLOTS))
    for k, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        known = n is not None and n >= 0
        rows[k, 0] = np.log1p(n) if known else 0.0
        rows[k, 1 + (min(int(n).bit_length(), LENGTHS - 2) if known else LENGTHS - 1)] = 1
        rows[k, 1 + LENGTHS + zlib.crc32(repr(s).encode()) % SLOTS] = 1
        rows[k, 1 + LENGTHS + SLOTS + zlib.crc32(repr(g).encode()) % SLOTS] = 1
    return rows


def _views(batch: pa.RecordBatch, odds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    meta = metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    return content_features(S.utf8(batch.column("text")), odds, bits), meta


def _gram_odds(sample: DataFrame, bits: int) -> np.ndarray:
    """Smoothed log-odds of each gram's occurrences in good against bad texts of ``sample``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << bits))
        for batch in S.slices(batches, "text", 1_000_000):
            h, offsets = S.grams(S.utf8(batch.column("text")), bits)
            size = np.diff(offsets)
            share = np.repeat(1000 / np.maximum(size, 200), size)  # each document weighs much the same
            good = np.repeat(batch.column("y").to_numpy(zero_copy_only=False), size) > 0
            for k in (0, 1):
                own = good == bool(k)
                found[k] += np.bincount(h[own], weights=share[own], minlength=1 << bits)
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(found[1][at]), pa.array(found[0][at])], names=["gram", "good", "bad"]
        )

    rows = sample.mapInArrow(count, "gram int, good double, bad double").groupBy("gram")
    table = rows.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # at most 2**bits rows
    good, bad = np.zeros(1 << bits), np.zeros(1 << bits)
    good[table["gram"].to_numpy()] = table["good"].to_numpy()
    bad[table["gram"].to_numpy()] = table["bad"].to_numpy()
    if not good.sum() or not bad.sum():
        return np.zeros(1 << bits, dtype=np.float32)
    prior = 50.0
    odds = np.log((good + prior * good.sum() / (good.sum() + bad.sum())) / max(good.sum(), 1))
    odds -= np.log((bad + prior * bad.sum() / (good.sum() + bad.sum())) / max(bad.sum(), 1))
    return np.round(odds, 6).astype(np.float32)


def sure_above(score: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The lowest score such that of the labelled rows from it on, three or more, ``precision`` are right; else infinity."""
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero((good >= precision) & (np.arange(len(order)) >= 2))
    return float(score[order[enough[-1]]]) if len(enough) else np.inf


def co_train(
    content: np.ndarray, metadata: np.ndarray, y: np.ndarray, rounds: int, share: float, precision: float = 0.98, rows: np.ndarray | None = None, test: tuple | None = None
) -> tuple[Logistic, Logistic, list]:
    """Two logistic models and what was handed over; ``y`` is 1, 0 or -1 (unlabelled), ``rows`` what each row stands for.

    A round hands over up to ``share`` of the pool's most confident good and bad documents each way, in
    the proportion of the labels, and of these only those with a score that is right for ``precision``
    of the rows of ``test`` (content, metadata, y), which no round trains on; a document keeps the
    first label that it was given in a view. The list has (round, teacher, good, bad) in rows.
    """
    views, rows = [content, metadata], np.ones(len(y)) if rows is None else rows
    given = [y.astype(float).copy(), y.astype(float).copy()]
    known, handed = y >= 0, []
    fresh, truth = (test[:2], test[2]) if test else ([x[known] for x in views], y[known])
    good = rows[y == 1].sum() / max(rows[known].sum(), 1e-9)
    fit = lambda k: fit_logistic(views[k][given[k] >= 0], given[k][given[k] >= 0], rows[given[k] >= 0])
    n = share * rows[~known].sum()
    for number in range(rounds):
        models = [fit(0), fit(1)]
        for teacher, pupil in ((0, 1), (1, 0)):
            free = np.flatnonzero(given[pupil] < 0)
            if not len(free):
                continue
            score, on_test = models[teacher].raw(views[teacher][free]), models[teacher].raw(fresh[teacher])
            count = []
            for label, sign, part in ((1, 1.0, good), (0, -1.0, 1 - good)):
                order = np.argsort(-sign * score, kind="stable")
                first = order[np.cumsum(rows[free[order]]) - rows[free[order]] < n * part]  # the one that fills the share is in
                sure = first[sign * score[first] >= max(1, sure_above(sign * on_test, truth == label, precision))]
                given[pupil][free[sure]] = label
                count.append(float(rows[free[sure]].sum()))
            handed.append((number, ("content", "metadata")[teacher], *count))
    return fit(0), fit(1), handed


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    bits: int = 18,
    rounds: int = 4,
    share: float = 0.1,
    max_labelled: int = 8_000,
    cells: int = 4_096,
) -> QualityModel:
    """Fit on ``docs(id, text, lang, source, n_chars)`` and ``labels(id, quality)``.

    Three of four labelled rows (by a hash of the id) train; on the fourth the hand-over's precision is
    measured and the views are calibrated. The pool is every unlabelled document: their features are
    summed in ``cells`` cells around those of a sample, and a cell's mean is handed over with the weight
    of its documents (together they weigh as much as the labelled rows).
    """
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y"))
        .where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    )
    total, good = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0))).first()
    model = QualityModel(bits, good / total if total else 1.0)
    if good in (0, total):
        return model
    base = docs.select(F.col(id_col).alias("id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    known = S.bounded_sample(marks, max_labelled, "id").withColumn("y", (F.col("y") > 0).cast("int"))
    known = known.withColumn("y", F.when(F.abs(F.xxhash64("id", F.lit("fold"))) % 4 == 0, F.col("y") + 2).otherwise(F.col("y")))
    pool = base.where("id is not null")  # texts stay where they are: ids, and later features, are joined with the labelled ids
    drawn = S.bounded_sample(pool.select("id").join(marks.select("id").hint("merge"), "id", "left_anti").distinct(), cells, "id").withColumn("y", F.lit(-1))
    ids = S.materialize(known.unionByName(drawn))
    sample = S.materialize(base.join(F.broadcast(ids), "id"))  # ids: two bounded samples
    model.odds = _gram_odds(sample.where("y in (0, 1)"), bits)
    held_odds = docs.sparkSession.sparkContext.broadcast(model.odds)  # 2**bits floats

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, "text"):
            c, m = _views(batch, held_odds.value, bits)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(c)), pa.array(list(m))], names=["y", "c", "m"])

    found = sample.mapInArrow(describe, "y int, c array<double>, m array<double>").toArrow()  # a few numbers a sampled row
    S.discard(ids)
    S.discard(sample)
    y, c, m = found["y"].to_numpy(), np.array(found["c"].to_pylist()), np.array(found["m"].to_pylist())
    order = np.lexsort((*m.T, *c.T, y))  # the fit does not depend on the order in which tasks end
    y, c, m = y[order], c[order], m[order]
    held, train = y >= 2, (y == 0) | (y == 1)
    if len(set(y[train])) < 2 or len(set(y[held])) < 2:
        return model
    rows = np.ones(train.sum())
    if rounds and (y < 0).any():
        width, centres = c.shape[1], np.unique(np.c_[c, m][y < 0], axis=0)
        n, mean = S.cell_sums(pool, lambda batch: np.hstack(_views(batch, held_odds.value, bits)), ["text", "lang", "source", "n_chars"], centres, centres.std(axis=0) + 1e-6, without=marks.select("id"))
        c, m = np.r_[c, mean[:, :width]], np.r_[m, mean[:, width:]]
        y, held, train = np.r_[y, np.full(len(n), -1)], np.r_[held, np.zeros(len(n), bool)], np.r_[train, np.zeros(len(n), bool)]
        used = np.flatnonzero(train | (np.arange(len(y)) >= len(y) - len(n)))
        rows = np.r_[rows, n / n.sum() * train.sum()]
    else:
        used = np.flatnonzero(train)
    target = y[held] - 2
    model.content, model.metadata, model.handed = co_train(c[used], m[used], y[used], rounds, share, rows=rows, test=(c[held], m[held], target))
    for view, x in ((model.content, c[held]), (model.metadata, m[held])):
        view.slope, view.intercept = S.platt(view.raw(x), target)
    both = np.c_[model.content.log_odds(c[held]), model.metadata.log_odds(m[held]), np.ones(held.sum())]
    start, free = np.array([1.0, 0.0, 0.0]), np.ones(3, dtype=bool)
    while True:  # ridge towards the content view alone, so that a useless view drops out; no view counts against itself
        mix = np.where(free, start, 0.0)
        for _ in range(50):
            p = S.sigmoid(both @ mix)
            hess = (both * (p * (1 - p))[:, None]).T @ both + np.eye(3)
            mix[free] -= np.linalg.solve(hess[np.ix_(free, free)], (both.T @ (p - target) + (mix - start))[free])
        if (mix[:2] >= 0).all():
            break
        free[:2] &= mix[:2] >= 0
    model.mix = mix
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of good quality. Whole texts, one pass, no shuffle."""
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != score_col]
    shared = spark.sparkContext.broadcast(model)  # 2**bits floats, whatever the input
    schema = S.schema_of(docs, keep, **{score_col: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        odds = m.odds if m.odds is not None else np.zeros(1 << m.bits, dtype=np.float32)
        for batch in S.slices(batches, "text"):
            score = m.score(*_views(batch, odds, m.bits))
            yield S.with_columns(batch, keep, **{score_col: pa.array(score, pa.float64())})

    return docs.mapInArrow(run, schema)
