"""Benchmark decontamination: Wu-Manber multi-pattern search over whole texts.

Benchmark items become windows of words, windows become byte strings framed by blanks. Windows of like length share
one table: the shift of a block of bytes says how far the search may jump, the block that ends a window's shortest
common length has shift 0 and a bucket of windows, and those are compared directly.

Defined results: null or wordless documents have no words and no hits; null or wordless items have no window;
repeated items count once; items without an id hit words but aren't listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import map_texts

#: Bytes of benchmark text that one scan holds in its tables; more text is dealt over several scans.
TABLE_BYTES = 32_000_000
#: Bytes of a block.
BLOCK = 8
#: A-Z become a-z, other ASCII without letter or digit becomes a blank, bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if text else []


def framed(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class Table:
    """Shifts and buckets of windows whose lengths lie within a factor of two."""

    def __init__(self, windows: list[bytes]):
        self.least = least = min(map(len, windows))
        self.block = block = min(BLOCK, least)
        self.jump = least - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for w in windows:
            for end in range(block, least + 1):
                part = w[end - block : end]
                self.shift[part] = min(self.shift.get(part, self.jump), least - end)
            self.bucket[w[least - block : least]].append(w)

    def search(self, text: bytes):
        """(start, window) of every occurrence."""
        shift, bucket, least, block, jump = self.shift.get, self.bucket, self.least, self.block, self.jump
        at, n = least, len(text)
        while at <= n:
            part = text[at - block : at]
            step = shift(part, jump)
            if step:
                at += step
                continue
            for w in bucket[part]:
                if text.startswith(w, at - least):
                    yield at - least, w
            at += 1


class Searcher:
    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.owners: dict[bytes, set[str | None]] = defaultdict(set)
        for name, text in items:
            words = [w for w in words_of(text) if w]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                self.owners[framed(words[i : i + width])].add(name)
        classes = defaultdict(list)
        for w in self.owners:
            classes[len(w).bit_length()].append(w)
        self.tables = [Table(ws) for _, ws in sorted(classes.items())]

    def find(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """Number of words, disjoint spans of hit words (first, past the last), ids of the items that occur."""
        words = [w for w in words_of(text) if w]
        if not words:
            return 0, [], []
        line = framed(words)
        hits = [hit for table in self.tables for hit in table.search(line)]
        if not hits:
            return len(words), [], []
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        spans: list[dict] = []
        for start, past in sorted((int(np.searchsorted(blanks, at)), int(np.searchsorted(blanks, at + len(w) - 1))) for at, w in hits):
            if spans and start <= spans[-1]["past"]:
                spans[-1]["past"] = max(spans[-1]["past"], past)
            else:
                spans.append({"first": start, "past": past})
        names = set().union(*(self.owners[w] for w in {w for _, w in hits})) - {None}
        return len(words), spans, sorted(names)


def item_groups(benchmark: DataFrame, table_bytes: int) -> list[list[tuple]]:
    """The items in groups of bounded size, fetched one group at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // table_bytes))
    for g in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g).collect()
        yield [(r.item_id, r.text) for r in rows]


def hit_words(spans: Column) -> Column:
    """Words covered by spans that may overlap."""
    start = F.struct(F.lit(0).alias("past"), F.lit(0).alias("n"))

    def add(state, span):
        past = F.greatest(state["past"], span["past"])
        return F.struct(past.alias("past"), (state["n"] + F.greatest(F.lit(0), span["past"] - F.greatest(state["past"], span["first"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["n"]).cast("long")


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", width: int = 13, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """`kept` (struct of the `keep` columns), n_words, spans, items, n_hit, contaminated for every row."""
    sc = docs.sparkSession.sparkContext
    fields = "n_words long, spans array<struct<first:int, past:int>>, items array<string>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    # columns are numbered, so that no name clashes; the text travels once, whether it is kept or not
    given = [*keep, *([] if text in keep else [text])]
    names = [f"given_{i}" for i in range(len(given))]
    source = out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)])
    read = names[given.index(text)]
    for items in item_groups(benchmark, table_bytes):
        shared = sc.broadcast(items)

        def make(shared=shared):
            searcher = Searcher(shared.value, width)

            def work(texts):
                rows = [searcher.find(t) for t in texts]
                return pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.list_(pa.string()))

            return work

        mapped = map_texts(out, read, out.columns, make, fields)
        own = [F.col(f"kept.{n}") for n in names]
        if out is source:
            out = mapped.select(*own, "n_words", "spans", "items")
        else:
            out = mapped.select(*own, "n_words", F.concat("kept.spans", "spans").alias("spans"), F.array_sort(F.array_union("kept.items", "items")).alias("items"))
    kept = F.struct(*[F.col(n).alias(c) for c, n in zip(keep, names)]).alias("kept")
    found = out.select(kept, "n_words", "spans", "items")
    hit = hit_words(F.col("spans"))
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return find(docs, benchmark, ["doc_id"]).select(
        "kept.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), b1 AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS line
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM b1)
), spots AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS line
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM b1) WHERE len(w) >= k)
), hits AS (SELECT doc_id, s.k, i, item_id FROM spots s JOIN windows v ON s.k = v.k AND s.line = v.line
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
