"""Ranked lexical search by pipelined term partitioning.

Documents are dealt to blocks of bounded size and turned to postings (block, term, places, counts) in one scan. Terms
belong to successive owner stages, the rarest first. A bundle is a group of items before one block of documents: it
carries sparse integer accumulators (item, place, score) and is cogrouped with the postings of the terms that the stage
owns, whose contributions are added. After each stage the 50th best partial score of every item over all blocks is a
floor under its final results: accumulators that the terms still to come can't lift to it are left, and new ones are
only begun while these terms could. This loses no result, as all bounds are integers that no score exceeds.

The scan keeps words whose hash is set in a bitmap of the items' terms (2 MB at any size); words that only share a
hash with a term fall out in the join with the terms.

Defined results: null or wordless documents aren't counted and never listed; rows of a repeated doc_id are ranked each,
a null doc_id comes last among equal scores; rows of one item_id (null too) are one item with the terms of all;
items without a term or a match give no row; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from storyloom.llm.common import pieces, stored

#: Documents of a block and items of a group: a bundle has at most their product of accumulators.
BLOCK_DOCS = 2_048
GROUP_ITEMS = 256
#: A term whose documents are at most N / 64 is owned by the first stage, at most N / 4 by the second, others by the last.
BANDS = (64, 4)
#: Bits of the filter of terms.
FILTER_BITS = 1 << 24
#: Words whose place in the filter a task remembers.
REMEMBERED = 500_000
#: A-Z become a-z; ASCII characters that are no letter or digit become a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    folded = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    return items.select(F.col(item).alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """One byte for 8 hash values of terms: at most FILTER_BITS / 32768 rows of 4 KB reach the driver."""
    spot = (F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1).alias("spot")
    rows = terms.select(spot).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


class Block:
    """Postings of some documents."""

    def __init__(self, wanted):
        self.wanted = wanted
        self.ids: list[pa.Array] = []
        self.terms: list[int] = []
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        self.ids.append(ids)
        for text in texts:
            at = len(self.terms)
            words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
            self.terms.append(len(words))
            for word, n in Counter(words).items():
                if self.wanted(word):
                    places, counts = self.postings.setdefault(word, ([], []))
                    places.append(at)
                    counts.append(n)

    def rows(self, number: int, schema: pa.Schema):
        """The row of the documents (term null), then one row a term; documents are in the order of their ids."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        head = [[number], [None], [None], [np.asarray(self.terms, np.int64)[order]], [ids.take(pa.array(order))]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(head, schema)], schema=schema)
        words = sorted(self.postings)
        for i in range(0, len(words), 1_000):
            part = words[i : i + 1_000]
            columns = [
                [number] * len(part), [w.decode("utf-8", "replace") for w in part], [place[self.postings[w][0]] for w in part],
                [np.asarray(self.postings[w][1], np.int64) for w in part], [None] * len(part),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


def _remembering(bits: np.ndarray):
    known: dict[bytes, bool] = {}

    def wanted(word: bytes) -> bool:
        found = known.get(word)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            spot = zlib.crc32(word) % FILTER_BITS
            found = known[word] = bool(bits[spot >> 3] >> (spot & 7) & 1)
        return found

    return wanted


def postings(docs: DataFrame, bits: np.ndarray, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(block, term, docs, counts, ids) in shared files: a row with term null for the documents of a block, one for each of its terms."""
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    fields = T.StructType([*T._parse_datatype_string("block long, term string, docs array<int>, counts array<long>").fields, T.StructField("ids", T.ArrayType(source.schema["id"].dataType))])
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        wanted, number, block, schema = _remembering(shared.value), TaskContext.get().partitionId() << 32, None, None
        for batch in batches:
            for piece in pieces(batch):
                for start in range(0, piece.num_rows, block_docs):
                    part = piece.slice(start, block_docs)
                    if block and len(block.terms) + part.num_rows > block_docs:
                        yield from block.rows(number, schema)
                        number, block = number + 1, None
                    if block is None:
                        block = Block(wanted)
                        kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(part.column("id").type)]
                        schema = pa.schema(list(zip(("block", "term", "docs", "counts", "ids"), kinds)))
                    block.add(part.column("id"), part.column("text").to_pylist())
        if block:
            yield from block.rows(number, schema)

    return stored(source.mapInArrow(run, fields))


def contribution(count, m):
    """Part of a term that stands `count` times in a document of measure m, before its weight."""
    return 1_000_000_000 * count // (1_000 * count + 20 * m)


def _columns(group: pa.Table, name: str) -> np.ndarray:
    """All entries of a list column, row after row."""
    return group.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _added(bundle: pa.Table, owned: pa.Table) -> np.ndarray:
    """Dense accumulators (item, place) of one bundle after the terms of a stage."""
    m = _columns(bundle, "m")
    begin, low = _columns(bundle, "open").astype(bool), _columns(bundle, "low")
    acc = np.zeros((len(low), len(m)), np.int64)
    acc[_columns(bundle, "items"), _columns(bundle, "places")] = _columns(bundle, "scores")
    closed = (acc == 0) & ~begin[:, None]
    for weight, items, docs, counts in zip(*(owned.column(c).to_pylist() for c in ("w", "owned", "docs", "counts"))):
        docs, counts = np.asarray(docs), np.asarray(counts, np.int64)
        acc[np.ix_(items, docs)] += weight * contribution(counts, m[docs])
    acc[closed] = 0
    acc[acc < low[:, None]] = 0
    return acc


def _best(acc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) of the k largest scores above 0 of every item, equal scores by place."""
    items, places = np.nonzero(acc)
    order = np.lexsort((places, -acc[items, places], items))
    items, places = items[order], places[order]
    rank = np.arange(len(items)) - np.searchsorted(items, items)
    return items[rank < k], places[rank < k]


def _stage(k: int):
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(("grp", "block", "m", "items", "places", "scores", "top_items", "top_scores"), kinds)))

    def run(bundle: pa.Table, owned: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return schema.empty_table()
        acc = _added(bundle, owned)
        items, places = np.nonzero(acc)
        best = _best(acc, k)
        values = [_columns(bundle, "m"), items.astype(np.int32), places.astype(np.int32), acc[items, places], best[0].astype(np.int32), acc[best]]
        keys = [bundle.column(c).to_pylist() for c in ("grp", "block")]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip([*keys, *[[v] for v in values]], schema)], schema=schema)

    return run


def _selection(k: int):
    def run(bundle: pa.Table, owned: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            bundle = bundle.slice(0, 0)
            ids = bundle.column("ids").combine_chunks().flatten()
            return pa.Table.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int32()), ids, pa.array([], pa.int64())], names=["grp", "item", "doc_id", "score"])
        acc = _added(bundle, owned)
        items, places = _best(acc, k)
        ids = bundle.column("ids").combine_chunks().flatten().take(pa.array(places))
        grp = np.full(len(items), bundle.column("grp")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(grp), pa.array(items.astype(np.int32)), ids, pa.array(acc[items, places])], names=["grp", "item", "doc_id", "score"])

    return run


def _weight(n: int) -> Column:
    return F.floor(1000 * F.log((F.lit(2 * n + 2)).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, group_items: int = GROUP_ITEMS, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    asked = stored(item_terms(items, text=text))
    known = asked.select("item_id").distinct()
    n_groups = max(1, -(-known.count() // group_items))
    inside = Window.partitionBy("grp").orderBy("item_id")
    numbers = stored(known.withColumn("grp", F.pmod(F.xxhash64("item_id"), F.lit(n_groups)).cast("int")).withColumn("item", F.row_number().over(inside) - 1))
    found = postings(docs, term_filter(asked.select("term").distinct()), key, text, block_docs)
    blocks, lists = found.where("term IS NULL"), found.where("term IS NOT NULL")
    n, total = blocks.agg(
        F.coalesce(F.sum(F.size(F.filter("counts", lambda c: c > 0))), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)), F.lit(0))).first()

    band = F.when(F.lit(False), 0)
    for stage, share in enumerate(bands):
        band = band.when(F.col("df") * share <= n, stage)
    counted = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("counts")).alias("most"))
    weighed = counted.select("term", _weight(n).alias("w"), band.otherwise(len(bands)).alias("stage"), "most")
    same = asked["item_id"].eqNullSafe(numbers["item_id"])
    terms = stored(asked.join(numbers, same).select("grp", "item", "term").join(weighed, "term"))
    owners = stored(terms.groupBy("grp", "term", "w", "stage").agg(F.collect_list("item").alias("items")))  # at most the items of a group

    # what the terms from a stage on can add at most: m is 50 or more
    bound = F.col("w") * F.expr("(1000000000 * most) div (1000 * most + 1000)")
    rest = [F.sum(F.when(F.col("stage") >= s, bound).otherwise(0)).alias(f"rest{s}") for s in range(len(bands) + 2)]
    rests = stored(numbers.select("grp", "item").join(terms.groupBy("grp", "item").agg(*rest), ["grp", "item"], "left").na.fill(0).withColumn("floor", F.lit(0).cast("long")))
    measure = F.transform("counts", lambda c: F.lit(50) + F.call_function("div", 50 * c * F.lit(n).cast("long"), F.lit(max(1, total)).cast("long")))
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("items", "int"), ("places", "int"), ("scores", "bigint"))]
    bundles = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"), "block", measure.alias("m"), *empty)

    for stage in range(len(bands) + 1):
        last = stage == len(bands)
        entry = F.struct("item", (F.col(f"rest{stage}") >= F.col("floor")).alias("open"), (F.col("floor") - F.col(f"rest{stage + 1}")).alias("low"))
        limits = rests.groupBy("grp").agg(F.array_sort(F.collect_list(entry)).alias("l")).select("grp", F.col("l.open").alias("open"), F.col("l.low").alias("low"))
        left = bundles.join(limits, "grp")
        owner = owners.where(F.col("stage") == stage).select("term", F.col("grp").alias("to"), "w", F.col("items").alias("owned"))
        owned = lists.select(F.col("block").alias("of"), "term", "docs", "counts").join(owner, "term").drop("term").groupBy("to", "of")
        if last:
            left = left.join(blocks.select(F.col("block").alias("of"), "ids"), F.col("block") == F.col("of")).drop("of")
            kind = T.StructType([*T._parse_datatype_string("grp int, item int").fields, T.StructField("doc_id", docs.schema[key].dataType), T.StructField("score", T.LongType())])
            best = left.groupBy("grp", "block").cogroup(owned).applyInArrow(_selection(k), kind)
        else:
            fields = "grp int, block long, m array<long>, items array<int>, places array<int>, scores array<long>, top_items array<int>, top_scores array<long>"
            bundles = stored(left.groupBy("grp", "block").cogroup(owned).applyInArrow(_stage(k), fields))
            tops = bundles.select("grp", F.explode(F.arrays_zip("top_items", "top_scores")).alias("t")).select("grp", F.col("t.top_items").alias("item"), F.col("t.top_scores").alias("score"))
            kth = F.row_number().over(Window.partitionBy("grp", "item").orderBy(F.desc("score")))
            floors = tops.withColumn("r", kth).where(F.col("r") <= k).where(F.col("r") == k).select("grp", "item", F.col("score").alias("reached"))
            rests = stored(rests.join(floors, ["grp", "item"], "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", F.lit(0)))).drop("reached"))
            bundles = bundles.drop("top_items", "top_scores")
    order = Window.partitionBy("grp", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbers, ["grp", "item"]).select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents
), s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), p AS (
  SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, 50 + (50 * len(w) * n) // l AS m, unnest(w) AS term FROM d, s WHERE len(w) > 0) GROUP BY doc_id, m, term
), t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN t USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0
) WHERE rank <= 50
"""
