"""Language identification by unigram pieces, summed over all segmentations.

Every language has probabilities for the pieces of one fixed public vocabulary. The probability of a word is the sum
over all ways to cut it into pieces, computed by the forward recursion over its characters; a text is the product of
its words. The probabilities are learnt by expectation maximisation over the same lattices (forward and backward).

Defined results: `und` with score 0 for null texts and texts without a letter. Runs longer than SPAN code points
are cut into parts of SPAN. Ties go to the language that sorts first. Without labelled rows every text is `und`.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.common import map_texts, stored

#: Labelled texts a language that the model is fitted on, at most.
FIT_ROWS = 400
#: Longest run of characters that is one word.
SPAN = 48
#: Probability of a character that no piece covers, and the least probability of any piece.
FLOOR = 1e-6
#: Multiplier of the hash of substrings.
MULTIPLIER = 0x100000001B3
#: Rounds of expectation maximisation.
ROUNDS = 4
#: Words that a task remembers; the memory is emptied when full, results don't depend on it.
REMEMBERED = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of ordinary text -> number; control, byte and unknown pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    # words hold the mark of a word start in front only
    return {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in pieces if "▁" not in p[1:]))}


def words_of(text: str | None) -> list[str]:
    """Lower-case runs, each behind the mark of a word start."""
    if not text:
        return []
    out = []
    for run in text.lower().split():
        if len(run) <= SPAN:
            out.append(run)
        else:
            out += [run[i : i + SPAN] for i in range(0, len(run), SPAN)]
    return out


class Pieces:
    """The vocabulary as hash tables over arrays, so that all substrings of many words are looked up at once."""

    SLOTS = 20

    def __init__(self, ids: dict[str, int]):
        self.size, self.longest = len(ids), max(map(len, ids))
        values = {self.hash(p): i for p, i in ids.items()}
        if len(values) < len(ids):
            raise ValueError("two pieces share a hash")
        keys, numbers = np.array(list(values), np.uint64), np.array(list(values.values()), np.int32)
        self.tables = []
        while len(keys):
            # what meets in a slot goes on to a further table
            slots = self.slots(keys, len(self.tables))
            _, first = np.unique(slots, return_index=True)
            held, piece = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -1, np.int32)
            held[slots[first]], piece[slots[first]] = keys[first], numbers[first]
            self.tables.append((held, piece))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, numbers = keys[rest], numbers[rest]

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * MULTIPLIER + ord(c) + 1) % (1 << 64)
        return h

    def slots(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, -1 without one."""
        out = np.full(len(keys), -1, np.int32)
        for level, (held, piece) in enumerate(self.tables):
            slots = self.slots(keys, level)
            same = (held[slots] == keys) & (piece[slots] >= 0)
            out[same] = piece[slots[same]]
        return out


class Lattice:
    """The edges (from, to, piece) of many words, sorted by the position where they end."""

    def __init__(self, words: list[str], pieces: Pieces):
        marked = ["▁" + w for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.lengths = np.array([len(w) for w in marked], np.int32)
        of = np.repeat(np.arange(len(words), dtype=np.int32), self.lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        left = self.lengths[of] - place  # characters from here to the end of the word
        word, start, end, piece = [], [], [], []
        here, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, min(pieces.longest, int(self.lengths.max(initial=0))) + 1):
            stay = left[here] >= n
            here, h = here[stay], h[stay] * np.uint64(MULTIPLIER) + codes[here[stay] + n - 1]
            found = pieces.numbers(h)
            if n == 1:
                found[found < 0] = pieces.size
            hit = found >= 0
            word.append(of[here[hit]])
            start.append(place[here[hit]])
            end.append(place[here[hit]] + n)
            piece.append(found[hit])
        word, start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (word, start, end, piece))
        order = np.argsort(end.astype(np.int16), kind="stable")
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]
        self.width = int(self.lengths.max(initial=0)) + 1
        self.cuts = np.searchsorted(self.end, np.arange(self.width + 1))

    def forward(self, chances: np.ndarray) -> np.ndarray:
        """alpha[word, position]: probability of the prefix, over all its segmentations."""
        alpha = np.zeros((len(self.lengths), self.width))
        alpha[:, 0] = 1
        for p in range(1, self.width):
            part = slice(self.cuts[p], self.cuts[p + 1])
            w = self.word[part]
            alpha[:, p] = np.bincount(w, alpha[w, self.start[part]] * chances[self.piece[part]], len(self.lengths))
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.lengths)), self.lengths]

    def expected(self, chances: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, all segmentations weighed by their probability."""
        alpha = self.forward(chances)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        # edges by end from the last position down: beta of the end is complete when its edges are used
        for p in range(self.width - 1, 0, -1):
            part = slice(self.cuts[p], self.cuts[p + 1])
            np.add.at(beta, (self.word[part], self.start[part]), beta[self.word[part], p] * chances[self.piece[part]])
        share = alpha[self.word, self.start] * chances[self.piece] * beta[self.word, self.end]
        return np.bincount(self.piece, share * (times / self.total(alpha))[self.word], len(chances))


def fit(counts: dict[str, Counter], ids: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (languages x pieces and the unknown one)."""
    langs, pieces = sorted(counts), Pieces(ids)
    chances = np.zeros((len(langs), len(ids) + 1))
    for k, lang in enumerate(langs):
        words = list(counts[lang])
        times = np.array([counts[lang][w] for w in words], float)
        lattice = Lattice(words, pieces)
        p = np.full(len(ids) + 1, 1 / len(ids))
        for _ in range(rounds if words else 0):
            uses = lattice.expected(p, times)
            p = np.maximum(uses / uses.sum(), FLOOR)
            p[-1] = FLOOR
        chances[k] = p
    return langs, chances


class Scorer:
    def __init__(self, langs: list[str], chances: np.ndarray, ids: dict[str, int]):
        self.langs, self.chances, self.pieces = langs, chances, Pieces(ids)
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, len(langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) if self.langs else [] for t in texts]
        distinct = set(chain.from_iterable(split))
        new = [w for w in distinct if w not in self.row]
        if len(self.row) + len(new) > REMEMBERED:
            self.row, new = {}, list(distinct)
            self.logs = self.logs[:0]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            lattice = Lattice(part, self.pieces)
            logs = np.stack([np.log(lattice.total(lattice.forward(c))) for c in self.chances], 1)
            self.row |= {w: len(self.row) + i for i, w in enumerate(part)}
            self.logs = np.concatenate([self.logs, logs])
        named, scores = [], np.zeros(len(texts))
        for i, (text, words) in enumerate(zip(texts, split, strict=True)):
            if not self.langs or not any(map(str.isalpha, text or "")):
                named.append("und")
                continue
            total = self.logs[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0)
            chance = np.exp(total - total.max())
            named.append(self.langs[int(chance.argmax())])
            scores[i] = 1 / chance.sum()
        return named, scores


def train(docs: DataFrame, labelled: Column, path: str, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS):
    """Fit on at most `fit_rows` different labelled texts a language, drawn by their hash; copies of a text count once."""
    rows = docs.filter(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    keys = stored(hashed.select("lang", "h").distinct())
    sizes = {r.lang: r["count"] for r in keys.groupBy("lang").count().collect()}
    # a share of each language by hash, so that no task ranks a whole language
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2 * fit_rows / n))) for k, n in sorted(sizes.items())], F.lit(0.0)) if sizes else F.lit(0.0)
    mixed = keys.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    chosen = mixed.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("at") <= fit_rows).select("lang", "h")
    # copies are merged within the tasks that read them, so a hot text reaches the shuffle once a task
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    ids, counts = vocabulary(path), {}
    for r in sample.select("lang", "text").toLocalIterator():
        counts.setdefault(r.lang, Counter()).update(words_of(r.text))
    return (*fit(counts, ids), ids)


def identify(docs: DataFrame, keep: list[str], labelled: Column, text: str = "text", lang: str = "lang", path: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """`kept` (struct of the `keep` columns), lang_pred, score for every row; learns from the rows where `labelled` holds."""
    model = docs.sparkSession.sparkContext.broadcast(train(source if source is not None else docs, labelled, path or default_path(), text, lang))

    def make():
        scorer = Scorer(*model.value)

        def work(texts):
            named, scores = scorer.score(texts)
            return pa.array(named, pa.string()), pa.array(scores, pa.float64())

        return work

    return map_texts(docs, text, keep, make, "lang_pred string, score double")
