"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word is read twice: as a word (hashed embedding and the log-odds of its bucket) and as characters (mean embedding of
its hashed 3- to 5-grams, mean and largest of their log-odds). The network reads overlapping windows; the score of a
text is the chance of its most toxic window, over all windows of the whole text. Labels belong to texts, so training
follows the window that scores highest. Log-odds are cross-fitted: a text never meets those it was counted in.

Defined results: null, empty and wordless texts are one empty window. With labels of one kind only, or none, every
text gets the share of label 1 (0 without labels).
"""

from __future__ import annotations

import gc
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from storyloom.llm.common import Shipped, map_texts
from storyloom.llm.quality import FIT_BYTES, labelled_sample

#: Labelled texts a kind that the model is fitted on, at most.
FIT_ROWS = 700
#: Words of a window and words from one window to the next.
WINDOW, STRIDE = 16, 8
#: Buckets of words and of character n-grams, width of an embedding, units of the network in each direction.
WORDS, GRAMS, WIDE, UNITS = 1 << 14, 1 << 16, 4, 8
#: Buckets of words for their log-odds: so many that the words of the fit sample seldom share one.
ODDS = 1 << 20
#: Steps of training, windows a step, and rounds in which the windows are chosen anew.
STEPS, BATCH, CHOICES = 600, 128, 5
#: Folds of the labelled texts for the log-odds.
FOLDS = 5
#: Windows that are scored at a time.
TOGETHER = 4096
#: Words that a task remembers; the memory is emptied when full, results don't depend on it.
REMEMBERED = 400_000
EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&+-_=/\\~^`@"


def bare(word: str) -> str:
    return word.lower().strip(EDGE)


class Parts:
    """Buckets of words and of their character n-grams, for many words at once."""

    def __init__(self, words: list[str]):
        framed = [f"<{w}>" for w in words]
        codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in framed], np.int64)
        self.starts = np.zeros(len(words), np.int64)
        np.cumsum(size[:-1], out=self.starts[1:])
        self.of = np.repeat(np.arange(len(words)), size)
        self.grams, self.fits, h = [], [], codes
        for n in range(2, 6):
            h = self.longer(h, codes, n)
            if n > 2:
                ends = np.minimum(np.arange(len(codes)) + n - 1, len(codes) - 1)
                self.grams.append(((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GRAMS)
                self.fits.append((self.of[ends] == self.of) & (np.arange(len(codes)) + n <= len(codes)))
        whole = np.add.reduceat(codes * (np.uint64(31) ** (np.arange(len(codes)) - self.starts[self.of]).astype(np.uint64)), self.starts) if len(words) else np.zeros(0, np.uint64)
        self.hash = ((whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        self.word = self.hash % WORDS
        self.count = np.maximum(1, sum(np.add.reduceat(f.astype(np.int64), self.starts) for f in self.fits)) if len(words) else np.zeros(0)

    def longer(self, h: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        nxt = np.zeros_like(codes)
        nxt[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        return h * np.uint64(0x100000001B3) + nxt

    def inputs(self, p: dict, odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """One row a word: log-odds of the word, largest and mean of its n-grams, both embeddings."""
        of_word, of_gram = odds
        top = np.max([np.where(f, of_gram[g], -9.0) for g, f in zip(self.grams, self.fits)], 0)
        mean = sum(of_gram[g] * f for g, f in zip(self.grams, self.fits))
        emb = sum(p["gram"][g] * f[:, None] for g, f in zip(self.grams, self.fits))
        top = np.maximum(np.maximum.reduceat(top, self.starts), -4.0)
        mean, emb = (np.add.reduceat(x, self.starts, axis=0) for x in (mean, emb))
        return np.c_[of_word[self.hash % len(of_word)], top, mean / self.count, p["word"][self.word], emb / self.count[:, None]].astype(np.float32)


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows of word numbers; 0 fills up the last one."""
    n = max(0, -(-(len(ids) - WINDOW) // STRIDE)) + 1
    filled = np.zeros(STRIDE * (n - 1) + WINDOW, np.int32)
    filled[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::STRIDE]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def passed(gates: np.ndarray, u: np.ndarray, order) -> tuple[np.ndarray, list]:
    """One direction: gates[b, t, 3 units] are the inputs' part; returns states[b, t, units] and what training needs."""
    b, t, _ = gates.shape
    h, out, kept = np.zeros((b, UNITS), np.float32), np.empty((b, t, UNITS), np.float32), []
    for k in order:
        g = gates[:, k]
        zr = sigmoid(g[:, : 2 * UNITS] + h @ u[:, : 2 * UNITS])
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        rh = r * h
        n = np.tanh(g[:, 2 * UNITS :] + rh @ u[:, 2 * UNITS :])
        kept.append((k, h, z, r, rh, n))
        h = h + z * (n - h)
        out[:, k] = h
    return out, kept


def back(grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u, from those of the states."""
    dg, du, dh = np.zeros((*grad.shape[:2], 3 * UNITS), np.float32), np.zeros_like(u), np.zeros_like(grad[:, 0])
    for k, h, z, r, rh, n in reversed(kept):
        dh = dh + grad[:, k]
        dn = dh * z * (1 - n * n)
        drh = dn @ u[:, 2 * UNITS :].T
        dz, dr = dh * (n - h) * z * (1 - z), drh * h * r * (1 - r)
        dg[:, k] = np.c_[dz, dr, dn]
        du[:, : 2 * UNITS] += h.T @ dg[:, k, : 2 * UNITS]
        du[:, 2 * UNITS :] += rh.T @ dn
        dh = dh * (1 - z) + drh * r + dg[:, k, : 2 * UNITS] @ u[:, : 2 * UNITS].T
    return dg, du


class Network:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "word": draw(WORDS, WIDE, by=0.01), "gram": draw(GRAMS, WIDE, by=0.01), "in": draw(3 + 2 * WIDE, 6 * UNITS), "bias": draw(6 * UNITS, by=0.01),
            "ahead": draw(UNITS, 3 * UNITS), "behind": draw(UNITS, 3 * UNITS), "look": draw(2 * UNITS), "out": draw(2 * UNITS), "const": draw(1),
        }
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def logits(self, table: np.ndarray, at: np.ndarray, for_training: bool = False):
        """table: the inputs' part of all gates, one row a word, row 0 for filling; at[b, t]: words of windows."""
        gates, p = table[at], self.p
        t = range(at.shape[1])
        ahead, kept_a = passed(gates[:, :, : 3 * UNITS], p["ahead"], t)
        behind, kept_b = passed(gates[:, :, 3 * UNITS :], p["behind"], reversed(t))
        states = np.concatenate([ahead, behind], 2)
        look = np.where(at > 0, states @ p["look"], -1e9)
        look = np.exp(look - look.max(1, keepdims=True))
        share = look / look.sum(1, keepdims=True)
        pooled = np.einsum("bt,btu->bu", share, states)
        out = pooled @ p["out"] + p["const"]
        return (out, (states, share, pooled, kept_a, kept_b)) if for_training else out

    def table(self, inputs: np.ndarray) -> np.ndarray:
        return np.r_[np.zeros((1, 6 * UNITS), np.float32), inputs @ self.p["in"] + self.p["bias"]]

    def step(self, parts: Parts, inputs: np.ndarray, at: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step of Adam on windows; `parts` and `inputs` belong to words 1, 2, ... of `at`."""
        p = self.p
        out, (states, share, pooled, kept_a, kept_b) = self.logits(self.table(inputs), at, True)
        d = ((sigmoid(out) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "const": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["out"]
        dshare = np.einsum("bu,btu->bt", dpool, states)
        dlook = share * (dshare - (share * dshare).sum(1, keepdims=True))
        g["look"] = np.einsum("bt,btu->u", dlook, states)
        dstates = share[:, :, None] * dpool[:, None] + dlook[:, :, None] * p["look"]
        da, g["ahead"] = back(dstates[:, :, :UNITS], kept_a, p["ahead"])
        db, g["behind"] = back(dstates[:, :, UNITS:], kept_b, p["behind"])
        dgates = np.concatenate([da, db], 2).reshape(-1, 6 * UNITS)
        dtable = np.zeros((len(inputs) + 1, 6 * UNITS), np.float32)
        np.add.at(dtable, at.reshape(-1), dgates)
        dtable = dtable[1:]
        g["in"], g["bias"] = inputs.T @ dtable, dtable.sum(0)
        dx = dtable @ p["in"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], parts.word, dx[:, 3 : 3 + WIDE])
        each = (dx[:, 3 + WIDE :] / parts.count[:, None])[parts.of]
        for grams, fits in zip(parts.grams, parts.fits):
            np.add.at(g["gram"], grams[fits], each[fits])
        self.steps += 1
        for k, grad in g.items():
            m, v = self.m[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            own = rate * (0.03 if k in ("word", "gram") else 1)  # embeddings learn slowly, so that few texts aren't learnt by heart
            p[k] *= np.float32(1 - 0.1 * own)
            p[k] -= (own * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-6)).astype(np.float32)


class Words:
    """Words of texts as numbers from 1 on; new ones get their parts in one go."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.listed: list[str] = []

    def ids(self, runs: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, runs), np.int32, len(runs))

    def add(self, runs: set[str]) -> list[str]:
        """Numbers for runs of characters; runs that differ by case or punctuation share the word but not the number."""
        new = [r for r in runs if r not in self.number]
        self.number |= {r: len(self.number) + 1 + i for i, r in enumerate(new)}
        return [bare(r) for r in new]


def log_odds(parts: Parts, sets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of buckets, by the number of toxic and other texts that have them."""
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    order = np.argsort(parts.of, kind="stable")
    first = np.searchsorted(parts.of[order], np.arange(len(parts.starts) + 1))
    hits = [np.zeros((2, ODDS)), np.zeros((2, GRAMS))]
    for ids, y in zip(sets, labels):
        words = np.unique(ids) - 1
        hits[0][y, np.unique(parts.hash[words] % ODDS)] += 1
        spots = np.concatenate([np.arange(first[w], first[w + 1]) for w in words]) if len(words) else np.zeros(0, np.int64)
        grams = np.concatenate([g[spots][f[spots]] for g, f in zip(parts.grams, parts.fits)]) if len(spots) else np.zeros(0, np.int64)
        hits[1][y, np.unique(grams)] += 1
    prior, weight = np.log(share / (1 - share)), 4.0
    return tuple(np.clip(np.log((h[1] + weight * share) / (h[0] + weight * (1 - share))) - prior, -4, 6).astype(np.float32) for h in hits)


class Model:
    def __init__(self, texts: list[str], labels: list[int], share: float | None):
        y = np.array(labels, np.int64)
        self.share = float(share or 0.0)
        self.both = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.both:
            return
        split, known = [t.split() for t in texts], Words()
        parts = Parts(known.add(set(chain.from_iterable(split))) or [""])
        sets = [known.ids(s) for s in split]
        fold = np.arange(len(y)) % FOLDS
        others = [log_odds(parts, [s for s, f in zip(sets, fold) if f != k], y[fold != k]) for k in range(FOLDS)]
        views = [windows(s) for s in sets]
        doc = np.repeat(np.arange(len(y)), [len(v) for v in views])
        at = np.concatenate(views)
        self.net, rng = Network(), np.random.default_rng(3)
        for choice in range(CHOICES):
            # the likeliest window of each text; before any training by its largest log-odds
            scores = np.empty(len(at), np.float32)
            for k in range(FOLDS):
                # texts of fold k meet the log-odds of the other folds
                inputs = parts.inputs(self.net.p, others[k])
                table = np.r_[np.full(1, -9, np.float32), inputs[:, :2].max(1)] if choice == 0 else self.net.table(inputs)
                own = np.flatnonzero(fold[doc] == k)
                for i in range(0, len(own), TOGETHER):
                    part = own[i : i + TOGETHER]
                    scores[part] = table[at[part]].max(1) if choice == 0 else self.net.logits(table, at[part])
            best = np.lexsort((-scores, doc))
            top = best[np.r_[True, doc[best][1:] != doc[best][:-1]]]
            clean = np.flatnonzero(y[doc] == 0)
            for step in range(STEPS // CHOICES):
                k = step % FOLDS
                mine = top[fold[doc[top]] == k]
                pick = [rng.choice(mine[y[doc[mine]] == v], BATCH // 2) for v in (0, 1) if (y[doc[mine]] == v).any()]
                other = clean[fold[doc[clean]] == k]
                pick += [rng.choice(other, BATCH // 4)] if len(other) else []
                if not pick:
                    continue
                rows = np.concatenate(pick)
                used, spot = np.unique(at[rows], return_inverse=True)
                shift = 0 if used[0] == 0 else 1
                words = used[used > 0] - 1
                some = parts_of(parts, words, known)
                self.net.step(some, some.inputs(self.net.p, others[k]), (spot.reshape(-1, WINDOW) + shift).astype(np.int32), y[doc[rows]].astype(np.float32), 0.01)
        self.odds = log_odds(parts, sets, y)
        self.net.m = {}
        mean = y.mean()
        self.shift = np.log(self.share / (1 - self.share)) - np.log(mean / (1 - mean)) if 0 < self.share < 1 else 0.0

    def scorer(self):
        if not self.both:
            return lambda texts: np.full(len(texts), self.share)
        return Scorer(self).score


def parts_of(parts: Parts, words: np.ndarray, known: Words) -> Parts:
    """The parts of some of the words."""
    if not known.listed:
        known.listed = [bare(r) for r in known.number]
    return Parts([known.listed[w] for w in words] or [""])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.net = model, model.net
        self.empty()

    def empty(self) -> None:
        self.known, self.table = Words(), np.zeros((1, 6 * UNITS), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        runs = set(chain.from_iterable(split))
        if len(self.known.number) + len(runs) > REMEMBERED:
            self.empty()
        new = self.known.add(runs)
        for i in range(0, len(new), 50_000):
            part = Parts(new[i : i + 50_000])
            self.table = np.r_[self.table, self.net.table(part.inputs(self.net.p, self.model.odds))[1:]]
        views = [windows(self.known.ids(s)) for s in split]
        at = np.concatenate(views)
        logits = np.concatenate([self.net.logits(self.table, at[i : i + TOGETHER]) for i in range(0, len(at), TOGETHER)])
        starts = np.zeros(len(views), np.int64)
        np.cumsum([len(v) for v in views[:-1]], out=starts[1:])
        return sigmoid(np.maximum.reduceat(logits, starts).astype(float) + self.model.shift)


def score(docs: DataFrame, labels: DataFrame, keep: list[str], learn: Column, text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """`kept` (struct of the `keep` columns) and score of every row; learns from rows of `labels` where `learn` holds."""
    model = Shipped(docs.sparkSession, Model(*labelled_sample(docs, labels, label, learn, fit_rows, text, fit_bytes)))

    def make():
        gc.disable()  # large dicts of strings and numbers; the next task collects what is left in cycles
        scorer = model.value.scorer()
        return lambda texts: (pa.array(scorer(texts), pa.float64()),)

    return map_texts(docs, text, keep, make, "score double")
