"""Prefix trie of conversations over vertical bitmaps.

Conversations in the order of their ids are dealt to shards of bounded size. A shard indexes (position, turn) to the
bitset of its conversations that have this turn there. A depth-first walk intersects the bitset of a node with the
postings of the next position: each intersection is a child, its bits are the members, and the bits without a next turn
end at the node. Nodes of several shards are the same if their paths are, which a 128-bit digest of the path tells.
Shards are ranges of ids, so lists of ends are put together in shard order and streamed through SHA-256. For sums over
subtrees each node counts in the shard of its smallest member, which knows all nodes above it.

Defined results: turns are in the order of (turn, role, text), null first; null role or text becomes empty; rows that
repeat are turns of their own; rows without conv_id belong to no conversation and are left out; an empty table has no
node, not even the root. The turns of one conversation (16 bytes each and a count of words) are never split.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.common import CRC_TABLE, crc_sql, stored

#: Conversations and turns that a shard holds at most; a longer conversation is a shard of its own.
SHARD_CONVERSATIONS = 4_096
SHARD_TURNS = 65_536
ROOT = bytes(16)

TRIE = pa.schema([
    ("shard", pa.int64()), ("at", pa.int32()), ("up", pa.int32()), ("node", pa.binary()), ("depth", pa.int64()), ("low", pa.int64()),
    ("members", pa.int64()), ("ended", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
])
TRIE_FIELDS = "shard long, at int, up int, node binary, depth long, low long, members long, ended long, words long, ends string"


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that stand for (role, text)."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): the turns of every conversation, numbered from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), role.alias("role"), text.alias("text"))
    tied = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", (F.row_number().over(tied) - 1).alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The first h turns of conversation c - c % every, then c's own turns after its first h; h = crc32(c) % most.

    A conversation without a turn has one row with pos null.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("giver"), head.alias("h"), "n")
    giver = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("giver"), F.struct("pos", "key", "words").alias("t"))
    given = giver.groupBy("giver").agg(F.array_sort(F.collect_list("t")).alias("first"))  # below `most` turns
    begun = ids.join(given, "giver", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast(given.schema["first"].dataType)), F.lit(1), F.col("h")))
    n_given, left = F.size("first"), F.greatest(F.lit(0), F.col("n") - F.col("h"))
    heads = begun.where(n_given > 0).select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.pos", "t.key", "t.words")
    # a giver with fewer than h turns lets the conversation's own turns move up
    short = begun.where(n_given < F.col("h")).select("conv_id", (F.col("h") - n_given).alias("less"))
    own = turns.where(F.col("pos") >= head).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "key", "words")
    none = begun.where((n_given == 0) & (left == 0)).select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("words"))
    return heads.unionByName(own).unionByName(none)


class Shard:
    """Bitmaps of some conversations and the walk over them."""

    def __init__(self):
        self.ids: list[int] = []
        self.paths: list[list[bytes]] = []
        self.words: dict[bytes, int] = {}
        self.turns = 0

    def add(self, conv: int, path: list[tuple[bytes, int]]) -> None:
        self.ids.append(conv)
        self.paths.append([key for key, _ in path])
        self.words.update(path)
        self.turns += len(path)

    def full(self, more: int) -> bool:
        return bool(self.ids) and (len(self.ids) >= SHARD_CONVERSATIONS or self.turns + more > SHARD_TURNS)

    def postings(self) -> tuple[list[dict[bytes, int]], list[int]]:
        """For each position the bitset of every turn; for each depth the bitset of the conversations that end there."""
        longest = max(map(len, self.paths))
        turns: list[dict[bytes, int]] = [defaultdict(int) for _ in range(longest)]
        ends = [0] * (longest + 1)
        for i, path in enumerate(self.paths):
            bit = 1 << i
            for pos, key in enumerate(path):
                turns[pos][key] |= bit
            ends[len(path)] |= bit
        return turns, ends

    def walk(self) -> Iterator[tuple]:
        """(at, up, node, depth, low, members, ended, words, ends) of all nodes, depth first; the root comes first."""
        turns, ends = self.postings()
        at, waiting = 0, [(-1, ROOT, 0, (1 << len(self.ids)) - 1, 0)]
        while waiting:
            up, node, depth, bits, words = waiting.pop()
            done = bits & ends[depth]
            yield at, up, node, depth, self.ids[_lowest(bits)], bits.bit_count(), done.bit_count(), words, ",".join(str(self.ids[i]) for i in _bits(done)) or None
            rest = bits & ~done
            while rest:
                key = self.paths[_lowest(rest)][depth]
                child = bits & turns[depth][key]
                rest &= ~child
                waiting.append((at, hashlib.sha256(node + key).digest()[:16], depth + 1, child, self.words[key]))
            at += 1


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bits(bits: int) -> Iterator[int]:
    while bits:
        yield _lowest(bits)
        bits &= bits - 1


def _conversations(batches) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """Rows in the order of conv_id and pos, put together to conversations."""
    conv, path = None, []
    for batch in batches:
        for c, key, words in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "words"))):
            if c != conv:
                if conv is not None:
                    yield conv, path
                conv, path = c, []
            if key is not None:
                path.append((key, words))
    if conv is not None:
        yield conv, path


def _rows(rows: Iterator[tuple], shard: int, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append((shard, *row))
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TRIE)], schema=TRIE)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TRIE)], schema=TRIE)


def local_tries(paths: DataFrame) -> DataFrame:
    """The nodes of every shard. Shards are ranges of conv_id: their numbers are in the order of their ids."""

    def run(batches):
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for conv, path in _conversations(batches):
            if shard.full(len(path)):
                yield from _rows(shard.walk(), number)
                number, shard = number + 1, Shard()
            shard.add(conv, path)
        if shard.ids:
            yield from _rows(shard.walk(), number)

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, TRIE_FIELDS)


def end_digests(tries: DataFrame) -> DataFrame:
    """(node, ends_sha256): the ids that end at a node in ascending order, one list a shard, streamed through the digest."""

    def run(batches):
        node, digest = None, None
        for batch in batches:
            names, hexes = [], []
            for n, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if n != node:
                    if node is not None:
                        names.append(node)
                        hexes.append(digest.hexdigest())
                    node, digest = n, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hexes, pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    lists = tries.where("ended > 0").select("node", "shard", "ends")
    return lists.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string")


def _subtrees(group: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard; a node counts where the shard owns it."""
    group = group.sort_by("at")
    up, own, n, conv = (group.column(c).to_pylist() for c in ("up", "own", "n_convs", "conv_id"))
    leaf = pc.equal(group.column("n_convs"), group.column("n_ended")).to_pylist()
    words = group.column("words").to_pylist()
    size = len(up)
    leaves = [int(own[i] and leaf[i]) for i in range(size)]
    saved = [(n[i] - 1) * words[i] if own[i] else 0 for i in range(size)]
    children = [0] * size
    for i in range(size - 1, 0, -1):  # a node comes after the one above it
        above = up[i]
        leaves[above] += leaves[i]
        saved[above] += saved[i]
        children[above] += own[i]
    over = [None if u < 0 else conv[u] for u in up]
    out = [pa.array(x, pa.int64()) for x in (over, children, leaves, saved)]
    return pa.Table.from_arrays([*(group.column(c) for c in ("node", "conv_id", "depth", "n_convs")), *out], names=["node", "conv_id", "depth", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"])


def nodes(paths: DataFrame) -> DataFrame:
    """One row a node of the trie over (conv_id, pos, key, words); pos null is a conversation without a turn."""
    tries = stored(local_tries(paths))
    merged = tries.groupBy("node").agg(F.min("low").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("ended").alias("n_ended"), F.min("shard").alias("owner"))
    known = tries.drop("low", "members", "ended", "ends").join(merged, "node").withColumn("own", F.col("shard") == F.col("owner"))
    fields = "node binary, conv_id long, depth long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    parts = known.groupBy("shard").applyInArrow(_subtrees, fields)
    same = [F.first(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    summed = parts.groupBy("node").agg(*same, *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return summed.join(end_digests(tries), "node", "left")


def rebuilt_nodes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, with digests of the lists of ends."""
    found = nodes(rebuilt(stored(turns_of(conversations))))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


SQL = rf"""
WITH {CRC_TABLE}, t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(g.own, [])[1:h], c.own[h + 1:]) AS path
  FROM (SELECT *, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM k, crc_table) c LEFT JOIN k g ON g.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, len(path) AS n, d, CASE WHEN d = 0 THEN NULL ELSE sha256(CAST(path[1:d - 1] AS VARCHAR)) END AS up, sha256(CAST(path[1:d] AS VARCHAR)) AS node,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT *, unnest(generate_series(0, len(path))) AS d FROM r)
), node AS (
  SELECT d, node, any_value(up) AS up, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id, bool_and(n = d) AS leaf,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY d, node
), sums AS (
  SELECT a.d, a.node, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (u.leaf) AS n_leaves, count(*) FILTER (u.d = a.d + 1) AS n_children
  FROM node u JOIN p a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.d, a.node
)
SELECT v.conv_id, v.d AS depth, above.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM node v JOIN sums s ON s.d = v.d AND s.node = v.node LEFT JOIN node above ON above.d = v.d - 1 AND above.node = v.up
"""
