"""Set, vector and string similarity plus tolerant JSON readers."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import text as tx

SCORE_DIGITS = 4


def half_even(value: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.bround(value, digits)


def jaccard(left: Column, right: Column) -> Column:
    """|intersection| / |union| of the non-empty items; two empty sides give 0."""
    a = F.filter(left, lambda x: x != "")
    b = F.filter(right, lambda x: x != "")
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """L2-normalised vector; a zero vector is an error, as its direction is undefined."""
    length = norm(vector)
    return F.when(
        length == 0, F.raise_error(F.lit("zero-length vector")).cast("array<double>")
    ).otherwise(F.transform(vector, lambda x: x.cast("double") / length))


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (norm(left) * norm(right))


#: From so many characters on difflib leaves out the frequent characters of the second text; texts above the most are left to it.
FREQUENT_FROM, MOST_CHARS = 200, 384
#: Rectangles of one shape are compared together, as many as fill so many cells.
SHAPES, CELLS = np.array([1, 2, 4, 8, 16, 32, 64, 96, 128, 192, 256, MOST_CHARS]), 200_000


def _longest_common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest common run of each column, the first in a and then in b."""
    kind = np.uint8 if min(len(a), len(b)) < 256 else np.uint16
    run = np.zeros((len(b) + 1, b.shape[1]), kind)
    longest, i, j = np.zeros(b.shape[1], kind), np.zeros(b.shape[1], np.int32), np.zeros(b.shape[1], np.int32)
    for at, row in enumerate(a):
        run[1:] = (run[:-1] + kind(1)) * (b == row)
        found = run.max(axis=0)
        better = np.flatnonzero(found > longest)
        if len(better):
            longest[better], i[better] = found[better], at + 1
            j[better] = run[:, better].argmax(axis=0)
    return i - longest, j - longest, longest.astype(np.int32)


def ratios(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """SequenceMatcher(None, a, b).ratio() of each pair.

    The matching splits a pair at its longest common run and goes on left and right of it. The rectangles of all pairs are
    searched together, those of one shape at once, the largest first, as what is left of one is smaller in both directions.
    """
    out = {(a, b): 1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in pairs if a == b or max(len(a), len(b)) > MOST_CHARS}
    asked = [pair for pair in pairs if pair not in out]
    if not asked:
        return out
    texts = {text: at for at, text in enumerate(dict.fromkeys(x for pair in asked for x in pair))}
    _, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    codes = np.append(codes + 2, 0).astype(np.uint8 if codes.max(initial=0) < 250 else np.uint32)  # 0 and 1 stand for no character
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    sought = codes.copy()
    for lo, hi in zip(starts, starts[1:]):
        if hi - lo >= FREQUENT_FROM:
            sought[lo:hi][(np.bincount(codes[lo:hi]) > (hi - lo) // 100 + 1)[codes[lo:hi]]] = 1
    place = np.array([[texts[a], texts[b]] for a, b in asked])
    matched = np.zeros(len(asked), np.int64)
    pools: dict[tuple[int, int], list[np.ndarray]] = {}

    def put(boxes):
        """boxes: pair, start in a, end in a, start in b, end in b."""
        n, m = boxes[:, 2] - boxes[:, 1], boxes[:, 4] - boxes[:, 3]
        boxes, n, m = (x[(n > 0) & (m > 0)] for x in (boxes, n, m))
        shape = np.searchsorted(SHAPES, n) * len(SHAPES) + np.searchsorted(SHAPES, m)
        order = np.argsort(shape, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1) if len(order) else []:
            pools.setdefault(divmod(int(shape[group[0]]), len(SHAPES)), []).append(boxes[group])

    put(np.stack([np.arange(len(asked)), starts[place[:, 0]], starts[place[:, 0] + 1], starts[place[:, 1]], starts[place[:, 1] + 1]], axis=1))
    while pools:
        boxes = np.concatenate(pools.pop(max(pools, key=sum)))
        high, wide = (int((boxes[:, k + 1] - boxes[:, k]).max()) for k in (1, 3))
        for part in np.array_split(boxes, max(1, len(boxes) * wide // CELLS)):
            p, alo, ahi, blo, bhi = part.T
            cut = lambda of, lo, hi, size, none: np.where((at := np.arange(size)[:, None] + lo) < hi, of[np.minimum(at, len(of) - 1)], of.dtype.type(none))
            i, j, k = _longest_common(cut(codes, alo, ahi, high, 0), cut(sought, blo, bhi, wide, 1))
            i, j = alo + i, blo + j
            if wide >= FREQUENT_FROM or (starts[place[p, 1] + 1] - starts[place[p, 1]] >= FREQUENT_FROM).any():
                # frequent characters don't begin a run, but go on with it
                while (more := (i > alo) & (j > blo) & (codes[i - 1] == codes[j - 1])).any():
                    i, j, k = i - more, j - more, k + more
                while (more := (i + k < ahi) & (j + k < bhi) & (codes[np.minimum(i + k, ahi)] == codes[np.minimum(j + k, bhi)])).any():
                    k = k + more
            hit = k > 0
            np.add.at(matched, p[hit], k[hit])
            put(np.concatenate([np.stack([p, alo, i, blo, j], axis=1)[hit], np.stack([p, i + k, ahi, j + k, bhi], axis=1)[hit]]))
    length = (starts[place + 1] - starts[place]).sum(axis=1)
    return out | {pair: 2.0 * int(m) / int(n) for pair, m, n in zip(asked, matched, length, strict=True)}


def title_similarity_udf(stopwords):
    """Blend of character ratio (0.35) and token-set ratio (0.65). Ratcliff-Obershelp matching
    has no Spark counterpart, so this runs on Arrow batches, and only on candidate pairs."""
    stop = frozenset(stopwords)

    @F.pandas_udf(T.DoubleType())
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        known = _Tokens(stop)
        asked = list(dict.fromkeys((a, b) for a, b in zip(left, right, strict=True) if a is not None and b is not None))
        texts: dict[tuple[str, str], float] = {}
        for a, b in asked:
            texts[known.low(a), known.low(b)] = 0.0
            texts.update(dict.fromkeys(known.sides(a, b), 0.0))
        texts = ratios(list(texts))
        seen = {}
        for a, b in asked:
            token = max((texts[s] for s in known.sides(a, b)), default=0.0)
            seen[a, b] = round(0.35 * texts[known.low(a), known.low(b)] + 0.65 * token, SCORE_DIGITS)
        return pd.Series([seen.get(pair) for pair in zip(left, right, strict=True)], dtype="float64")

    return similarity


def title_bound_udf(stopwords):
    """What title_similarity_udf can't exceed, from lengths and shared words alone."""
    stop = frozenset(stopwords)

    def bound(a: str, b: str) -> float:
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0

    @F.pandas_udf(T.DoubleType())
    def similarity_bound(left: pd.Series, right: pd.Series) -> pd.Series:
        known = _Tokens(stop)

        def most(a: str, b: str) -> float:
            token = max((bound(*s) for s in known.sides(a, b)), default=0.0)
            return min(1.0, 0.35 * bound(known.low(a), known.low(b)) + 0.65 * token + 10.0**-SCORE_DIGITS)

        return pd.Series([most(a, b) if a is not None and b is not None else None for a, b in zip(left, right, strict=True)], dtype="float64")

    return similarity_bound


class _Tokens:
    """Texts of one batch in lower case with their words, each taken once."""

    def __init__(self, stop: frozenset):
        import re

        self.word, self.stop, self.held = re.compile(r"\w+"), stop, {}

    def of(self, text: str) -> tuple[str, frozenset, str]:
        if text not in self.held:
            low = text.lower()
            words = frozenset(self.word.findall(low)) - self.stop
            self.held[text] = (low, words, " ".join(sorted(words)))
        return self.held[text]

    def low(self, text: str) -> str:
        return self.of(text)[0]

    def sides(self, a: str, b: str) -> list[tuple[str, str]]:
        """The texts that the token-set ratio compares; none without shared words."""
        (_, x, left), (_, y, right) = self.of(a), self.of(b)
        shared = " ".join(sorted(x & y))
        return [(left, right), (shared, left), (shared, right)] if shared else []


# --- JSON --------------------------------------------------------------------------------------
def json_list(text: Column) -> Column:
    """Elements as variants; anything that is not a JSON list gives an empty array."""
    value = F.try_parse_json(tx.blank_if_null(text))
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def json_strings(text: Column) -> Column:
    """Only the string elements of a JSON list."""
    strings = F.filter(json_list(text), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def json_object(text: Column) -> Column:
    value = F.try_parse_json(tx.blank_if_null(text))
    return F.coalesce(
        F.try_variant_get(value, "$", "map<string,variant>"),
        F.create_map().cast("map<string,variant>"),
    )


def json_block(answer: Column) -> Column:
    """The JSON object inside a model answer: code fence removed, first brace to last brace."""
    body = F.regexp_replace(tx.strip(answer), r"^```(?:json)?\s*|\s*```$", "")
    block = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.nullif(block, F.lit(""))
