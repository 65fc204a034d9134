"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is compressed in blocks
under both; (bad size - good size) / (bad size + good size) is its normalised difference. A logistic curve over the
difference of the whole text, of its extreme blocks and the plain compression rates turns it into a score, fitted on
labelled texts that the dictionaries haven't seen.

Defined results: null and empty texts get the score of an empty block, the share of good labels. With labels of one
kind only, or none, every text gets that share (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Shipped, map_texts, stored

#: Labelled texts a kind that the model is fitted on, at most, and characters of them in total.
FIT_ROWS, FIT_BYTES = 1500, 12_000_000
#: Bytes of a block, of a dictionary, and the compression level.
BLOCK, DICTIONARY, LEVEL = 1024, 64_000, 3


def blocks_of(text: str | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """Trained on blocks; where there are too few of them to train on, their bytes themselves."""
    parts = [b for t in texts for b in blocks_of(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


class Measure:
    """Compressed sizes under two dictionaries, as features."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self.prepared(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def prepared(self, data: bytes) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=LEVEL)
        return made

    def features(self, text: str | None) -> list[float]:
        parts = blocks_of(text)
        if not parts:
            return [0.0] * 6
        good, bad = (np.array([len(c.compress(p)) for p in parts], float) for c in self.pair)
        size = np.array([len(p) for p in parts], float)
        each = (bad - good) / (bad + good)
        # a short last block says little: it counts by its size
        weight = np.minimum(1, size / (BLOCK / 4))
        return [(bad.sum() - good.sum()) / (bad.sum() + good.sum()), (each * weight).min(), (each * weight).max(), good.sum() / size.sum(), bad.sum() / size.sum(), np.log(size.sum())]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Newton steps, halved until the loss falls; the last weight is the constant, which the ridge leaves out."""
    x = np.c_[x, np.ones(len(x))]
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * keep @ (w * w)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def bent(x: np.ndarray) -> np.ndarray:
    """Squares beside the features, so that the curve may fall at both ends."""
    return np.c_[x, x**2]


class Model:
    def __init__(self, texts: list[str], labels: list[int], share: float | None = None):
        """share: of good labels among all, where the sample has another one; the curve's constant is shifted by it."""
        order = {k: [t for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)}
        own = float(np.mean(labels)) if labels else 0.5
        self.share = own if share is None else share
        self.both = min(map(len, order.values())) >= 4
        if not self.both:
            return
        rows = []
        for fold in (0, 1):
            # the curve is fitted on texts that their dictionaries haven't seen
            measure = Measure(*(dictionary(order[k][fold::2]) for k in (1, 0)))
            rows += [(measure.features(t), k) for k in (0, 1) for t in order[k][1 - fold :: 2] if t]
        self.good, self.bad = (dictionary(order[k]) for k in (1, 0))
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.weights = logistic(bent((x - self.mean) / self.scale), y)
        odds = lambda p: np.log(p / (1 - p))
        self.weights[-1] += odds(np.clip(self.share, 1e-3, 1 - 1e-3)) - odds(y.mean())

    def scorer(self):
        if not self.both:
            return lambda texts: np.full(len(texts), self.share)
        measure = Measure(self.good, self.bad)

        def score(texts):
            x = np.array([measure.features(t) for t in texts]).reshape(len(texts), -1)
            z = np.c_[bent((x - self.mean) / self.scale), np.ones(len(x))] @ self.weights
            return np.where([bool(t) for t in texts], 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.share)

        return score


def longest(lengths: list[tuple[int, int]], total: int) -> int:
    """The length that texts are shortened to, so that they have `total` characters at most; `lengths` are (length, texts)."""
    left, texts = total, sum(n for _, n in lengths)
    for length, n in sorted(lengths):
        if length * texts > left:
            return max(1, left // texts)
        left -= length * n
        texts -= n
    return max((length for length, _ in lengths), default=1)


def shortened(text: Column, limit: int, parts: int = 16) -> Column:
    """Texts of over `limit` characters as passages at even distances, from their first to their last characters, one a line."""
    parts = max(1, min(parts, limit // 64))
    n = max(1, limit // parts - 1)
    if parts == 1:
        return F.substring(text, 1, limit)
    places = [F.floor((F.length(text) - n) * F.lit(i) / (parts - 1)).cast("int") + 1 for i in range(parts)]
    return F.when(F.length(text) > limit, F.concat_ws("\n", *[F.substring(text, at, F.lit(n)) for at in places])).otherwise(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, fit_rows: int, text: str = "text", fit_bytes: int = FIT_BYTES) -> tuple[list[str], list[int], float | None]:
    """Texts, their labels and the share of label 1 among all learnable rows; of at most `fit_rows` learnable documents of each label, those with the smallest hash of their id.

    Ids are ranked without their texts, and texts are fetched for the chosen ids only. Contradictory labels of one
    document both count; null labels don't. If the chosen texts have over `fit_bytes` characters together, the longest
    are shortened to one length, so that all of them stay in the sample and the short ones stay whole.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).filter(learn)
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = parts[0].union(parts[1]).distinct()
    rows = stored(docs.select("doc_id", F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id"))
    limit = longest([(r["length"], r["count"]) for r in rows.groupBy(F.length("text").alias("length")).count().collect()], fit_bytes)
    taken = [(r.text, r.label) for r in rows.select(shortened(F.col("text"), limit).alias("text"), "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "label").toLocalIterator()]
    share = known.agg(F.avg("label")).first()[0]
    return [t for t, _ in taken], [y for _, y in taken], share


def score(docs: DataFrame, labels: DataFrame, keep: list[str], learn: Column, text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """`kept` (struct of the `keep` columns) and score of every row; learns from rows of `labels` where `learn` holds."""
    model = Shipped(docs.sparkSession, Model(*labelled_sample(docs, labels, label, learn, fit_rows, text, fit_bytes)))

    def make():
        scorer = model.value.scorer()
        return lambda texts: (pa.array(scorer(texts), pa.float64()),)

    return map_texts(docs, text, keep, make, "score double")
