"""Log-bilinear language model with noise-contrastive estimation, over word classes.

P(word | context) = P(class | the classes of the words before) * P(word | class). The frequentest words are classes of
their own, all others are dealt to groups of like spelling, so unknown words have a class too. P(word | class) is the
smoothed share of the word's count, with one unknown word in each class. The class is predicted log-bilinearly, and
products of all contexts with all targets, normalised, give a table of log-probabilities.

Counts cover the whole corpus: tasks number the words of a block of text, word counts are summed over all blocks and
come back to each block as counts and classes of its own words; no task needs the corpus' vocabulary. The groups of
spelling are formed over all training words, each round by partial sums of the tasks. Parameters are estimated on the
driver from the counts of class triples, of which there are at most CLASSES^3 at any corpus size: each epoch passes over
all of them with their counts, and noise counts by its expectation, so nothing is drawn.

Defined results: null texts are empty, and an empty text is one end token. Without training texts every word is unknown.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import Shipped, pieces, stored

#: Classes: frequent words, groups of spelling, the end; the last number stands for what is before a text.
OWN, GROUPS = 95, 31
CLASSES = OWN + GROUPS + 2
END, BEFORE = CLASSES - 2, CLASSES - 1
#: Buckets of the character pairs and triples of words, and rounds that form the groups from them.
SPELLING, GROUPING = 1024, 12
#: Length up to which words of one length are looked at together.
PLACES = 48
#: Words of context, length of a representation, noise words for each of the corpus, passes over all triples and their parts.
CONTEXT, LENGTH, NOISE, EPOCHS, PARTS = 2, 24, 10, 50, 24
#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000


class Numbers(dict):
    """word -> number in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def blocks(docs: DataFrame, keep: list[str], held_out: Column, text: str) -> DataFrame:
    """Rows of two kinds in shared files: texts as word numbers of their block, and the words of the block with their
    number, spelling and count in training texts."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("kept", source.schema["kept"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("ids", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("word", T.BinaryType()), T.StructField("times", T.LongType()),
    ])

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        block, numbers, times, size = 0, Numbers(), np.zeros(0, np.int64), 0

        def vocabulary(kept_type):
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, first + block)), pa.nulls(n, kept_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
                 pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.binary()), pa.array(times)], names=schema.names)

        for batch in batches:
            for piece in pieces(batch):
                held = np.array(piece.column("held_out").to_pylist(), bool)
                split = [words_of(t) for t in piece.column("text").to_pylist()]
                ids = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in split]
                grown = np.zeros(len(numbers), np.int64)
                grown[: len(times)] = times
                train = [x for x, h in zip(ids, held) if not h]
                times = grown + (np.bincount(np.concatenate(train), minlength=len(grown)) if train else 0)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, first + block)), piece.column("kept"), piece.column("held_out"), pa.array([packed(x) for x in ids], pa.binary()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=schema.names)
                size += sum(map(len, split)) * 6
                if size > BLOCK_BYTES:
                    yield vocabulary(piece.column("kept").type)
                    block, numbers, times, size = block + 1, Numbers(), np.zeros(0, np.int64), 0
                kept_type = piece.column("kept").type
        if numbers:
            yield vocabulary(kept_type)

    return stored(source.mapInArrow(run, schema))


class Speller:
    """Character pairs and triples of words, hashed; their directions make the groups."""

    def __init__(self, words: list[bytes]):
        framed = [b"<" + w + b">" for w in words]
        codes = np.frombuffer(b"".join(framed), np.uint8).astype(np.int64)
        self.size = np.array([len(f) for f in framed], np.int64)
        self.starts = np.r_[0, np.cumsum(self.size)[:-1]] if len(words) else np.zeros(0, np.int64)
        left = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(codes))  # characters from here to the end of the word
        self.spots = []
        h = codes
        for n in (2, 3):
            h = h * 257
            h[: len(h) - n + 1] += codes[n - 1 :]
            # what reaches into the next word, or past the last one, counts in the last bucket, which weighs nothing
            self.spots.append(np.where(left >= n, (h * 0x9E3779B1 >> 7) % (SPELLING - 1), SPELLING - 1))

    def squares(self) -> np.ndarray:
        """Squared lengths of the words' counts of pairs and triples."""
        of = np.repeat(np.arange(len(self.starts)), self.size)
        code, times = np.unique(np.concatenate([of * SPELLING + s for s in self.spots]), return_counts=True)
        times[code % SPELLING == SPELLING - 1] = 0
        return np.bincount(code // SPELLING, times.astype(float) ** 2, len(self.starts)).astype(np.int64)

    def sums(self, near: np.ndarray, weight: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
        """Weighted sums of the words' directions (length 1) in each group. squares: squares(), if known."""
        norm = np.sqrt(self.squares() if squares is None else squares)
        row = np.repeat(near * SPELLING, self.size)
        each = np.repeat(weight / np.maximum(1e-9, norm), self.size)
        total = sum(np.bincount(row + s, each, GROUPS * SPELLING) for s in self.spots).reshape(GROUPS, SPELLING)
        total[:, SPELLING - 1] = 0
        return total

    def nearest(self, centres: np.ndarray) -> np.ndarray:
        """The centre of largest cosine; the length of the word doesn't matter for that."""
        by_spot = np.ascontiguousarray(centres.T)
        out = np.zeros(len(self.starts), np.int64)
        # words of one length are summed place by place, all at once; each long word by itself
        for size in np.unique(self.size[self.size <= PLACES]).tolist():
            at = np.flatnonzero(self.size == size)
            score = np.zeros((len(at), len(centres)))
            for place in range(size - 1):  # the last place begins no pair
                for n, spots in zip((2, 3), self.spots):
                    if place <= size - n:
                        score += by_spot[spots[self.starts[at] + place]]
            out[at] = score.argmax(1)
        for i in np.flatnonzero(self.size > PLACES).tolist():
            inside = slice(self.starts[i], self.starts[i] + self.size[i])
            out[i] = sum(np.bincount(s[inside], minlength=SPELLING) @ by_spot for s in self.spots).argmax()
        return out


def directions(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums at length 1; what nothing was summed for stays."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norm > 0, sums / np.maximum(norm, 1e-9), before)


def grouped(counts: DataFrame, own: list[bytes]) -> np.ndarray:
    """Centres of the groups of spelling, from all words with a count that aren't classes of their own.

    They start from GROUPS words that the hash deals from all, with chances by the root of their counts. In each round the
    tasks sum the directions of all words by their nearest centre.
    """
    spark = counts.sparkSession
    known = spark.createDataFrame([(w,) for w in own], "word binary")

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(Speller(batch.column("word").to_pylist()).squares())], names=["word", "c", "squares"])

    others = counts.filter("c > 0").join(F.broadcast(known), "word", "left_anti").select("word", "c")  # OWN rows at most
    rest = stored(others.mapInArrow(measured, "word binary, c long, squares long"))
    chance = (F.pmod(F.xxhash64("word", F.lit(5)), F.lit(1 << 30)) + 1) / float(1 << 30)
    first = [bytes(r.word) for r in rest.orderBy(-F.log(chance) / F.sqrt("c"), "word").limit(GROUPS).collect()]
    centres = np.zeros((GROUPS, SPELLING))
    if not first:
        return centres
    speller = Speller(first)
    centres[: len(first)] = directions(speller.sums(np.arange(len(first)), np.ones(len(first))), centres)[: len(first)]
    for _ in range(GROUPING):
        shared = Shipped(spark, centres)

        def partial(batches):
            centres, total = shared.value, np.zeros((GROUPS, SPELLING))
            for batch in batches:
                words = batch.column("word").to_pylist()
                if words:
                    speller = Speller(words)
                    total += speller.sums(speller.nearest(centres), np.sqrt(batch.column("c").to_numpy()), batch.column("squares").to_numpy())
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total.ravel()[cell])], names=["cell", "value"])

        found = rest.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        sums = np.zeros(GROUPS * SPELLING)
        sums[found.column("cell").to_numpy()] = found.column("value").to_numpy()
        after = directions(sums.reshape(GROUPS, SPELLING), centres)
        still = np.allclose(after, centres, atol=1e-9)
        centres = after
        if still:
            break
    return centres


class Classes:
    def __init__(self, own: list[bytes], centres: np.ndarray):
        """own: the frequentest words, which are their own classes; all others belong to the nearest centre."""
        self.own, self.centres = {w: i for i, w in enumerate(own)}, centres

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int32)
        group = OWN + Speller(words).nearest(self.centres)
        return np.array([self.own.get(w, g) for w, g in zip(words, group.tolist())], np.int32)


class LogBilinear:
    """prediction = sum over context places of (representation of the class there) @ (matrix of the place);
    the score of a target is prediction . target + bias."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) * 0.1
        self.p = {"seen": draw(CLASSES, LENGTH), "place": draw(CONTEXT, LENGTH, LENGTH) + np.eye(LENGTH) / CONTEXT, "target": draw(CLASSES, LENGTH), "bias": np.zeros(CLASSES)}

    def predict(self, context: np.ndarray) -> np.ndarray:
        return sum(self.p["seen"][context[:, i]] @ self.p["place"][i] for i in range(CONTEXT))

    def table(self) -> np.ndarray:
        """log10 P(target | context) for all contexts (code of the context) and targets."""
        codes = np.arange(CLASSES**CONTEXT)
        context = np.stack([codes // CLASSES ** (CONTEXT - 1 - i) % CLASSES for i in range(CONTEXT)], 1)
        out = np.empty((len(codes), CLASSES), np.float32)
        for i in range(0, len(codes), 4096):
            score = self.predict(context[i : i + 4096]) @ self.p["target"].T + self.p["bias"]
            score[:, BEFORE] = -np.inf
            score -= score.max(1, keepdims=True)
            out[i : i + 4096] = (score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)
        return out

    def fit(self, codes: np.ndarray, times: np.ndarray, seed: int = 12) -> None:
        """Noise-contrastive estimation: tell targets of the corpus from NOISE words each of their overall shares.

        codes: all (context, target) triples, times: their counts. Contexts are dealt to PARTS parts, and a step takes all
        triples of a part with their counts and the expectation over all noise words, so an epoch passes over the whole table.
        """
        if not len(codes):
            return
        p = self.p
        share = np.bincount(codes % CLASSES, times, CLASSES) + 1e-3 * times.sum() / CLASSES
        share[BEFORE] = 0
        share /= share.sum()
        log_noise = np.log(NOISE * np.maximum(share, 1e-12))
        p["bias"] = np.log(np.maximum(share, 1e-12))
        past, row = np.unique(codes // CLASSES, return_inverse=True)
        context = np.stack([past // CLASSES ** (CONTEXT - 1 - i) % CLASSES for i in range(CONTEXT)], 1)
        part = np.random.default_rng(seed).permutation(len(past)) % PARTS
        cells = []
        for i in range(min(PARTS, len(past))):
            at = np.flatnonzero(part == i)
            inside = np.flatnonzero(part[row] == i)
            cells.append((context[at], np.searchsorted(at, row[inside]), codes[inside] % CLASSES, times[inside]))
        scale = len(cells) / times.sum()
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        steps = EPOCHS * len(cells)
        for step in range(1, steps + 1):
            context, at, target, n = cells[step % len(cells)]
            guess = self.predict(context)
            chance = 1 / (1 + np.exp(-np.clip(guess @ p["target"].T + p["bias"] - log_noise, -30, 30)))
            d = chance * (np.bincount(at, n, len(context))[:, None] * (NOISE * share))
            d[at, target] -= n * (1 - chance[at, target])
            d *= scale
            g = {"bias": d.sum(0), "target": d.T @ guess, "seen": np.zeros_like(p["seen"]), "place": np.zeros_like(p["place"])}
            dguess = d @ p["target"]
            for i in range(CONTEXT):
                g["place"][i] = p["seen"][context[:, i]].T @ dguess
                np.add.at(g["seen"], context[:, i], dguess @ p["place"][i].T)
            rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def contexts(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code of the CONTEXT classes before each token; texts lie one behind the other."""
    place = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = np.zeros(len(seq), np.int64)
    for i in range(CONTEXT, 0, -1):
        before = np.r_[np.full(min(i, len(seq)), BEFORE), seq[:-i]][: len(seq)] if len(seq) else seq
        code = code * CLASSES + np.where(place >= i, before, BEFORE)
    return code


def score(docs: DataFrame, held_out: Column, keep: list[str], text: str = "text") -> DataFrame:
    """kept, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows not held out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = blocks(docs, keep, held_out, text)
    texts, words = rows.filter("ids IS NOT NULL"), rows.filter("number IS NOT NULL")
    counts = stored(words.groupBy("word").agg(F.sum("times").alias("c")))
    ends = texts.filter("NOT held_out").count()
    total = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (total.n or 0) + ends, total.v + (ends > 0)
    own = [bytes(r.word) for r in counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(OWN).collect()]
    classes = Shipped(docs.sparkSession, Classes(own, grouped(counts, own)))

    def classify(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(classes.value.of(batch.column("word").to_pylist()), pa.int32())], names=["word", "c", "class"])

    classed = stored(counts.mapInArrow(classify, "word binary, c long, class int"))
    mass = np.full(CLASSES, 0.1)
    for r in classed.filter("c > 0").groupBy("class").agg(F.sum(F.col("c") + F.lit(0.1)).alias("m")).collect():
        mass[r["class"]] += r.m
    mass[END] += ends
    of_block = words.select("block", "number", "word").join(classed, "word").select(F.col("block").alias("of"), "number", "c", "class")

    kept_type = texts.schema["kept"]
    summed = T.StructType([kept_type, *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, base_score double, within double, seq binary").fields])
    log_all = np.log10(n + 0.1 * (v + 1))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts and classes of a block's texts, from those of its words."""
        size = right.num_rows
        c, kind = np.zeros(size, np.int64), np.zeros(size, np.int64)
        number = right.column("number").to_numpy()
        c[number], kind[number] = right.column("c").to_numpy(), right.column("class").to_numpy()
        logs, inside = np.log10(c + 0.1) - log_all, np.log10(c + 0.1) - np.log10(mass[kind])
        end = np.log10(ends + 0.1)
        out = [[], [], [], [], []]
        for data in left.column("ids").to_pylist():
            ids = unpacked(data, np.int32)
            out[0].append(len(ids) + 1)
            out[1].append(int((c[ids] > 0).sum()) + (ends > 0))
            out[2].append(float(logs[ids].sum() + end - log_all))
            out[3].append(float(inside[ids].sum()))
            out[4].append(packed(np.r_[kind[ids], END].astype(np.uint8)))
        arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary())]
        return pa.Table.from_arrays([left.column("kept"), left.column("held_out"), *arrays], names=summed.names)

    known = stored(texts.select("block", "kept", "held_out", "ids").groupBy("block").cogroup(of_block.groupBy("of")).applyInArrow(look_up, summed))

    def triples(batches):
        for batch in batches:
            seqs = [unpacked(s, np.uint8).astype(np.int64) for s in batch.column("seq").to_pylist()]
            if seqs:
                seq = np.concatenate(seqs)
                code, times = np.unique(contexts(seq, np.array([len(s) for s in seqs])) * CLASSES + seq, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], names=["code", "times"])

    seen = known.filter("NOT held_out").select("seq").mapInArrow(triples, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).orderBy("code").toArrow()
    model = LogBilinear()
    model.fit(seen.column("code").to_numpy(), seen.column("times").to_numpy().astype(float))
    parameters = Shipped(docs.sparkSession, model)

    def log_chances(batches):
        table = parameters.value.table()
        for batch in batches:
            seqs = [unpacked(s, np.uint8).astype(np.int64) for s in batch.column("seq").to_pylist()]
            sums = []
            for s in seqs:
                sums.append(float(table[contexts(s, np.array([len(s)])), s].sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in summed.names[:-1]], pa.array(sums, pa.float64())], names=[*summed.names[:-1], "classes"])

    scored = known.mapInArrow(log_chances, T.StructType([*summed.fields[:-1], T.StructField("classes", T.DoubleType())]))
    return scored.select("kept", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", (F.col("within") + F.col("classes") + float(np.log10((ends + 0.1) / mass[END]))).alias("score"))
