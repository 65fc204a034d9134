"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a piece of text are put in trie order (sorted, so that the path from the root is a stack).
Going depth first, every trie node holds one state: the last token of the encoding of its prefix. A token `t` ends
the encoding of prefix p exactly if the pair (last token of p without t, t) stays apart under the merges, and there
is exactly one such token, so the state of a node follows from the states on its path. A prefix that many words
share is encoded once.

Defined results: null and empty texts give no ids and an empty decoded text; repeated rows are encoded alike; ids
that the vocabulary lacks fail on decoding.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Shipped, map_texts

#: Encoded words that a task remembers; the memory is emptied when full, results don't depend on it.
REMEMBERED = 250_000
#: The last symbol of a word is another symbol than the same character inside it.
LAST = 0x1000
#: Last symbols of a prefix by which the lengths of its possible last tokens are looked up.
TAIL = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, str]:
    """Byte -> printable character: itself if printable, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Vocabulary:
    """What a tokenizer file says, in the form that the traversal needs; small and fixed, so it's broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        kinds = [p["type"] for p in told["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or told["decoder"] is not None:
            raise ValueError(f"{path} is not a word-end BPE of the supported shape")
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.ids = {self.symbols(t): i for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks, made = {}, {}
        for rank, (a, b) in enumerate(merges):
            pair = (self.ids[self.symbols(a)], self.ids[self.symbols(b)])
            self.ranks[pair] = rank
            made.setdefault(self.ids[self.symbols(a + b)], (*pair, rank))
        self.made = made
        # white space is what Unicode calls so; the file's \s means that
        self.split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", "\\p{White_Space}")

    def symbols(self, token: str) -> str:
        """A token as symbols: the word end becomes part of the last symbol."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(LAST + ord(body[-1]))
        return token


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bytes = {b: ord(c) for b, c in byte_symbols().items()}
        self.words = regex.compile(vocabulary.split)
        self.marks = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.apart: dict[tuple[int, int], bool] = {}
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.of_chunk: dict[str, tuple[int, ...]] = {}
        self.odd, self.spaces = regex.compile("[\x1c-\x1f]"), regex.compile(r"\p{White_Space}+")
        # tokens that the merges really make of their own text
        made = vocabulary.made
        self.ids = {s: t for s, t in vocabulary.ids.items() if len(s) == 1 or (t in made and self.stays_apart(*made[t][:2], made[t][2]))}
        self.size = {t: len(s) for s, t in self.ids.items()}
        # last symbols of a prefix (TAIL of them, or all) -> the lengths of tokens that can end it, longest first
        ends = defaultdict(set)
        for s in self.ids:
            ends[s[-TAIL:]].add(len(s))
        shorter = lambda tail: {n for n in range(1, len(tail)) if tail[-n:] in self.ids}
        self.lengths = {tail: tuple(sorted(n | shorter(tail), reverse=True)) for tail, n in ends.items()}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that stand at its left (0) or right (1) edge while it's merged: (part, rank of the merge that ends it)."""
        memory = self.right if side else self.left
        if token not in memory:
            parts, ends = [], float("inf")
            while True:
                parts.append((token, ends))
                if token not in self.v.made:
                    break
                *two, ends = self.v.made[token]
                token = two[side]
            memory[parts[0][0]] = parts
            return parts
        return memory[token]

    def stays_apart(self, a: int, b: int, own: float = float("inf")) -> bool:
        """No merge of rank below `own` crosses the border between tokens a and b. Equal ranks go left to right."""
        for x, x_ends in self.edge(a, 1):
            for y, y_ends in self.edge(b, 0):
                rank = self.v.ranks.get((x, y))
                if rank is not None and rank < own and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def learn(self, words: set[str]) -> None:
        """Encode words in one depth-first walk over their trie; `last[d]` is the state at depth d of the path."""
        ids, size, lengths, apart, known = self.ids, self.size, self.lengths, self.apart, self.known
        before, last = "", [0]
        for path, word in sorted([(self.spell(w), w) for w in words]):
            shared = 0
            for x, y in zip(before, path):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                for length in lengths.get(path[end - TAIL : end] if end > TAIL else path[:end], (3, 2, 1)):
                    token = ids.get(path[end - length : end]) if length <= end else None
                    if token is None:
                        continue
                    if length == end:
                        break
                    pair = (last[end - length], token)
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) > REMEMBERED:
                            apart.clear()
                        ok = apart[pair] = self.stays_apart(*pair)
                    if ok:
                        break
                last.append(token)
            tokens, at = [], len(path)
            while at:
                token = last[at]
                tokens.append(token)
                at -= size[token]
            known[word] = tuple(tokens[::-1])
            before = path

    def spell(self, word: str) -> str:
        shown = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.bytes)
        return shown[:-1] + chr(LAST + ord(shown[-1]))

    def chunks(self, text: str | None) -> list[str]:
        """Parts that the pre-tokenizer never joins: runs without white space, special tokens as they stand."""
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return self.runs(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.runs(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.runs(text[at:])

    def runs(self, text: str) -> list[str]:
        # str.split() also splits at U+001C..U+001F, which aren't white space for the file
        return text.split() if not self.odd.search(text) else self.spaces.split(text)

    def plain(self, chunk: str) -> list[str]:
        """Normalised words of a run. Lower case goes letter by letter, so a last sigma is like any other."""
        return self.words.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts."""
        if len(self.known) + len(self.of_chunk) > 2 * REMEMBERED:
            self.known.clear()
            self.of_chunk.clear()
        of_chunk, special = self.of_chunk, self.v.special
        split = [self.chunks(t) for t in texts]
        new = {c: self.plain(c) for c in set(chain.from_iterable(split)) - of_chunk.keys() if c not in special}
        self.learn(set(chain.from_iterable(new.values())) - self.known.keys())
        of_chunk |= {c: (i,) for c, i in special.items()}
        # a run that is one word shares its tuple
        known = self.known
        of_chunk |= {c: known[words[0]] if len(words) == 1 else tuple(chain.from_iterable([known[w] for w in words])) for c, words in new.items()}
        return [np.fromiter(chain.from_iterable([of_chunk[c] for c in chunks]), np.int32) for chunks in split]

    def decode(self, ids) -> str:
        """Token texts joined by one space, as a tokenizer without a decoder does."""
        names = self.v.names
        return " ".join([names[i] for i in ids])


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """`kept` (struct of the `keep` columns), `ids` array<int>, `decoded` string for every row."""
    vocabulary = Shipped(docs.sparkSession, Vocabulary(path or default_path()))

    def make():
        gc.disable()  # large dicts of strings and numbers; the next task collects what is left in cycles
        encoder = Encoder(vocabulary.value)

        def work(texts):
            encoded = encoder.encode(texts)
            starts = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum([len(x) for x in encoded], out=starts[1:])
            flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            return ids, pa.array([encoder.decode(x.tolist()) for x in encoded], pa.string())

        return work

    return map_texts(docs, text, keep, make, "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(docs, ["doc_id"], path=path).select(
        "kept.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
