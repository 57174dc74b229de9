"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other training text is *unlabelled*, not clean.
Learning goes in two steps, both corrected by the class prior ``pi``:

1. Gram evidence. For each hashed byte gram, ``r = pi * P(gram | toxic) / P(gram | unlabelled)``
   is the share of toxic documents among those that have the gram. Its lower bound (a standard
   error off the toxic count) is kept, so grams seen once or twice count for little. A confirmed
   document that takes part in the fit is described by the evidence of the others alone.
   P(gram | unlabelled) is counted over all texts that may be learnt from, a Spark aggregation over
   the grams that some confirmed texts share.
2. Risk estimator. Each document becomes a few numbers (its strongest gram, how many and how dense
   the grams above several levels of ``r`` are), and a numpy logistic model minimises
   ``pi R_p(+) + max(0, R_u(-) - pi R_p(-))`` over positives and unlabelled; where the second part
   falls below zero, the step goes against it, as the non-negative estimator prescribes.

The logistic loss makes the model's output log-odds; its intercept is then moved until the mean
score of all texts is ``pi``. No label 0 is used anywhere but in counting ``pi``. The fit takes about
``max_positive`` confirmed rows (a share by the hash of the id); the unlabelled side is every text that may
be learnt from, summed in one aggregation into at most ``cells`` cells of like features. Scoring reads
every whole text. Only the text is an input of the score.

Cases: null or empty text scores as a text without evidence. No positives or no labels: every
score is the prior (0 where that is unknown). Duplicate label rows count once by their maximum;
null labels count as unlabelled. Repeated documents are scored alike; an empty table gives no rows.
Extra columns pass through, but for one that has the score column's name, which the score replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

LEVELS = (0.2, 0.35, 0.5, 0.7)


@dataclass
class ToxicityModel:
    bits: int
    prior: float
    evidence: np.ndarray | None = None
    evidence_of_others: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    intercept: float = 0.0

    def features(self, texts: list[bytes], own: np.ndarray | None = None) -> np.ndarray:
        """``own``: which of the texts are confirmed ones that the evidence was counted on."""
        h, offsets = S.grams(texts, self.bits)
        v, starts, n = self.evidence[h], offsets[:-1], np.diff(offsets)
        if own is not None and own.any():
            v = np.where(np.repeat(own, n), self.evidence_of_others[h], v)
        out = [np.maximum.reduceat(v, starts)]
        for level in LEVELS:
            c = np.add.reduceat((v > level).astype(np.float32), starts)
            out += [np.log1p(c), np.log1p(1000 * c / n)]
        return np.stack(out, axis=1).astype(np.float64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        return S.sigmoid(self.raw(self.features(texts)) + self.intercept)


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, weight: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model under the non-negative positive-unlabelled risk (Adam); ``weight``: rows that an unlabelled one stands for."""
    w, m, s = (np.zeros(pos.shape[1]) for _ in range(3))
    share = np.full(len(unl), 1 / len(unl)) if weight is None else weight / weight.sum()
    for k in range(1, steps + 1):
        gp, gu = pos @ w, unl @ w
        zp, zu = S.sigmoid(gp), S.sigmoid(gu)
        negative = np.logaddexp(0, gu) @ share - prior * np.logaddexp(0, gp).mean()
        from_neg = unl.T @ (zu * share) - prior * pos.T @ zp / len(pos)
        grad = prior * pos.T @ (zp - 1) / len(pos) + from_neg if negative >= 0 else -from_neg
        grad = grad + l2 * w
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return w


def _frequencies(texts: DataFrame, bits: int, only: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(documents with each gram, documents) of ``texts(text)``; with ``only``, a flag a gram, for these alone."""
    wanted = texts.sparkSession.sparkContext.broadcast(only)  # 2**bits flags, whatever the input

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, flags = np.zeros(1 << bits, dtype=np.int64), 0, wanted.value
        for batch in S.slices(batches, "text", 1_000_000):
            h, offsets = S.grams(S.utf8(batch.column("text")), bits)
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets))
            if flags is not None:
                keep = flags[h]
                h, doc = h[keep], doc[keep]
            pairs = np.unique(doc << bits | h)
            found += np.bincount(pairs & ((1 << bits) - 1), minlength=1 << bits)
            texts += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([texts], pa.int64())], names=["gram", "n"])
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(found[part])], names=["gram", "n"])

    rows = texts.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most 2**bits rows and one more, whatever the input
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    out = np.zeros(1 << bits)
    out[gram[gram >= 0]] = n[gram >= 0]
    return out, int(n[gram < 0].sum())


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = 20,
    max_positive: int = 4_000,
    cells: int = 4_096,
    prior: float | None = None,
) -> ToxicityModel:
    """Fit on ``docs(id, text)`` and ``labels(id, toxic)``; pass only the rows that may be learnt from.

    ``prior`` is the share of toxic documents; by default that of all given labels. The confirmed texts
    are a sample of ``max_positive``; the unlabelled side is all texts: their features are summed in
    ``cells`` cells around those of a sample of texts, and the risk runs over the cells' means, each with
    the weight of its texts.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    total, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if prior is None:
        prior = toxic / total if total else 0.0
    model = ToxicityModel(bits, float(prior))
    if not toxic or toxic == total:
        return model
    confirmed = S.bounded_sample(marks.where("toxic > 0"), max_positive, "id").select("id", F.lit(1).alias("own"))
    drawn = S.bounded_sample(text.select("id").distinct(), cells, "id").select("id", F.lit(1).alias("drawn"))
    ids = S.materialize(confirmed.join(drawn, "id", "full_outer"))
    sample = S.materialize(text.join(F.broadcast(ids), "id").groupBy("id", "own", "drawn").agg(F.min("text").alias("text")))  # ids: two bounded samples
    p, n_pos = _frequencies(sample.where("own = 1"), bits)
    n_drawn = sample.where("drawn = 1").count()
    if not n_pos or not n_drawn:
        return model
    u, n_unl = _frequencies(text, bits, p >= 2)  # the evidence of a gram of one confirmed text is nothing

    def share(p: np.ndarray, u: np.ndarray, n_pos: int) -> np.ndarray:
        lower = np.maximum(p - np.sqrt(p), 0) / max(n_pos, 1)
        return np.where(p >= 2, np.clip(prior * lower / ((u + 1) / n_unl), 0, 1), 0).astype(np.float32)

    model.evidence = share(p, u, n_pos)
    model.evidence_of_others = share(np.maximum(p - 1, 0), np.maximum(u - 1, 0), n_pos - 1)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats twice, whatever the input

    def features(batch: pa.RecordBatch) -> np.ndarray:
        return held.value.features(S.utf8(batch.column("text")), batch.column("own").fill_null(0).to_numpy() > 0)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("drawn"), pa.array(list(features(batch)))], names=["own", "drawn", "x"])

    found = sample.select("text", "own", "drawn").mapInArrow(describe, "own int, drawn int, x array<double>").toArrow()  # a few numbers a sampled row
    x = np.array(found["x"].to_pylist())
    own, drawn = (found[c].fill_null(0).to_numpy() > 0 for c in ("own", "drawn"))
    order = np.lexsort((*x.T, drawn, own))  # the fit does not depend on the order in which tasks end
    x, own, drawn = x[order], own[order], drawn[order]
    every = text.join(F.broadcast(ids.where("own = 1").select("id", "own")), "id", "left")  # ``max_positive`` or so
    weight, unl = S.cell_sums(every, features, ["text", "own"], np.unique(x[drawn], axis=0), x[drawn].std(axis=0) + 1e-6)
    model.evidence_of_others = None  # of no use in scoring
    held.unpersist()
    S.discard(ids)
    S.discard(sample)
    model.mean = np.average(unl, axis=0, weights=weight)
    model.scale = np.sqrt(np.average((unl - model.mean) ** 2, axis=0, weights=weight)) + 1e-6
    scaled = lambda x: np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    model.weights = nnpu(scaled(x[own]), scaled(unl), prior, weight)
    raw, low, high = model.raw(unl), -30.0, 30.0
    for _ in range(60):  # the mean score rises with the intercept
        mid = (low + high) / 2
        low, high = (mid, high) if np.average(S.sigmoid(raw + mid), weights=weight) < prior else (low, mid)
    model.intercept = low
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability that a text is toxic. Whole texts, one pass, no shuffle."""
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != score_col]
    shared = spark.sparkContext.broadcast(model)  # 2**bits floats, whatever the input
    schema = S.schema_of(docs, keep, **{score_col: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, text_col):
            score = shared.value.score(S.utf8(batch.column(text_col)))
            yield S.with_columns(batch, keep, **{score_col: pa.array(score, pa.float64())})

    return docs.mapInArrow(run, schema)
