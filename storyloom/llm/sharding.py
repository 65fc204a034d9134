"""Sharding by balanced label propagation, under the law `rows`: the shards' counts differ by one at most.

Documents of one group are linked through the group's hub. Groups of a large part of a shard are placed first, the
largest first, each where it fits most closely. A group is cut only if it exceeds a whole shard, into parts of a shard
and a rest, or where no shard has room left for all of it: as much as fits goes to the emptiest shard, the rest is placed
like a group of its own. All other documents are dealt to the room left, and rounds bring the groups together. In each
round a hub moves to the shard where most of its documents are, or on to one with room if that one is sought by too many,
and documents want to follow it. A quota for each ordered pair of shards says how many may go: what goes from i to j is
matched by what comes from j to i, first documents that want to, then documents without links, so the counts never
change. They end when no document wants to move or may. A group that is together then stays where it is. Those that are
still apart are laid end to end in the order of their hashes and the shards take stretches of that line, as long as the
room that the others leave; a group that stands across an end, one an end at most, is placed like the large ones.
Documents without links fill the room that is left.

Defined results: null texts have size 8 and crc32 0 and aren't linked; repeated rows are rows of their own;
fewer documents than shards leave shards empty.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.common import numbered, stored

#: Groups of at least this share of a shard are placed before the rounds; there are at most 1 / LARGE of them a shard.
LARGE = 0.125
#: Rounds at most; each leaves all counts as they are, so stopping is safe at any round and what is apart then is laid whole.
ROUNDS = 12


def quotas(wants: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(linked, free) moves for each ordered pair of shards, in balance: as many leave a shard as come.

    wants[i, j]: linked documents of shard i that want to be in j; free[i]: documents of i without links.
    """
    linked = np.minimum(wants, wants.T)
    fill, left = np.zeros_like(wants), free.copy()
    rest = wants - linked
    for i in range(len(wants)):
        for j in np.argsort(-rest[i], kind="stable"):
            n = min(rest[i, j], left[j])
            linked[i, j] += n
            fill[j, i] += n
            left[j] -= n
    return linked, fill


def goal_of(most: DataFrame, shards: int, room: np.ndarray, turn: int) -> Column:
    """The shard to which a hub goes: where most of its documents are, unless more would come there than it can hold.

    Hubs that are together stay. Of the others a share by hash, as large as the room left, gets the shard they want;
    the rest goes to shards with room to spare, in proportion to it.
    """
    whole, open_ = np.zeros(shards), np.zeros(shards)
    for r in most.groupBy("shard", "whole").agg(F.sum("size").alias("n")).collect():
        (whole if r["whole"] else open_)[r["shard"]] = r["n"]
    left = np.maximum(0, room - whole)
    keep = np.where(open_ > left, left / np.maximum(open_, 1), 1.0)
    spare = left - np.minimum(left, open_)
    if not spare.sum():
        return F.col("shard")
    draw = lambda salt: F.pmod(F.xxhash64("hub", F.lit(turn), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    upto = np.cumsum(spare) / spare.sum()
    other = F.coalesce(*[F.when(draw(2) < float(u), F.lit(j)) for j, u in enumerate(upto)], F.lit(int(np.flatnonzero(spare)[-1])))
    stays = F.col("whole") | (draw(1) < F.element_at(F.array(*[F.lit(float(k)) for k in keep]), F.col("shard") + 1))
    return F.when(stays, F.col("shard")).otherwise(other)


def packed(sizes: list[tuple], capacity: list[int]) -> tuple[list[tuple], list[int]]:
    """(group, low, high, shard) of groups (size, group), and what is left of the capacities; the numbers from low to high - 1 of a group go together."""
    left = list(capacity)
    # what no shard can hold is cut by the smallest capacity, so that shards with one row more stay for groups that need it
    waiting, full = [], max(1, min(capacity))
    for size, group in sizes:
        cuts = [*range(0, size, full), size] if size > max(capacity) else [0, size]
        waiting += [(low - high, group, low) for low, high in zip(cuts, cuts[1:])]
    heapq.heapify(waiting)
    parts = []
    while waiting:
        size, group, low = heapq.heappop(waiting)
        size = -size
        fitting = [k for k, room in enumerate(left) if room >= size]
        to = min(fitting, key=lambda k: (left[k], k)) if fitting else max(range(len(left)), key=lambda k: (left[k], -k))
        n = min(size, left[to])
        left[to] -= n
        parts.append((group, low, low + n, to))
        if n < size:
            heapq.heappush(waiting, (n - size, group, low + n))
    return parts, left


def laid(hubs: DataFrame, rows_per_chunk: int = 100_000) -> DataFrame:
    """`begin` of every hub (group, size) when all are laid end to end in the order of their hashes; by chunks, so no task holds all."""
    n_chunks = max(1, -(-hubs.count() // rows_per_chunk))
    marked = hubs.withColumn("_h", F.xxhash64("group")).withColumn("_chunk", F.pmod(F.shiftright("_h", 20), F.lit(n_chunks)))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    starts = marked.groupBy("_chunk").agg(F.sum("size").alias("_n")).select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_chunk").orderBy("_h", "group").rowsBetween(Window.unboundedPreceding, -1)
    ranked = marked.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "_chunk")
    return ranked.select("group", "size", (F.col("_first") + F.col("_at")).alias("begin"))


def stretches(left: list[int], linked: int) -> list[int]:
    """Ends of the stretches of the line of hubs, `linked` documents long, in proportion to the room left."""
    total, out = sum(left), []
    for room in np.cumsum(left):
        out.append(int(room) * linked // max(1, total))
    return out


def matrix(counts, shards: int) -> np.ndarray:
    out = np.zeros((shards, shards), np.int64)
    for r in counts:
        out[r["shard"], r["goal"]] = r["n"]
    return out


def propagated(state: DataFrame, shards: int, room: np.ndarray, rounds: int, n: int) -> DataFrame:
    """`row`, `hub`, `shard` after the rounds, in which hubs take the shard of most of their documents and documents follow."""
    spark = state.sparkSession
    for turn in range(rounds):
        # ties go to the shard that the hub's hash names first, so that groups spread
        tie = F.pmod(F.xxhash64("hub", "shard"), F.lit(1_000_003))
        found = state.filter("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", tie, "shard")).alias("top"), F.sum("n").alias("size"))
        most = stored(found.select("hub", "top.shard", "size", (F.col("top.n") == F.col("size")).alias("whole")), n)
        goals = stored(state.join(most.select("hub", goal_of(most, shards, room, turn).alias("goal")), "hub", "left").select("row", "hub", "shard", F.coalesce("goal", "shard").alias("goal")), n)
        wants = matrix(goals.filter("shard <> goal").groupBy("shard", "goal").agg(F.count("*").alias("n")).collect(), shards)
        free = np.zeros(shards, np.int64)
        for r in goals.filter("hub IS NULL").groupBy("shard").count().collect():
            free[r["shard"]] = r["count"]
        moves, fill = quotas(wants, free)
        if not moves.sum():
            break
        # movers of a pair are numbered; those below its quota go. Free rows of a shard take its fillings in turn.
        pairs = [(i, j) for i in range(shards) for j in range(shards)]
        quota = spark.createDataFrame([(i, j, int(moves[i, j])) for i, j in pairs], "shard int, goal int, quota long")
        past = np.cumsum(fill, axis=1)
        slots = spark.createDataFrame([(i, int(past[i, j] - fill[i, j]), int(past[i, j]), j) for i, j in pairs if fill[i, j]], "shard int, low long, high long, goal int")
        movers = numbered(goals.filter("shard <> goal"), ["shard", "goal"], "row", "at").join(F.broadcast(quota), ["shard", "goal"])
        going = movers.filter("at < quota").select("row", "goal")
        fillers = numbered(goals.filter("hub IS NULL"), ["shard"], "row", "at").join(F.broadcast(slots), "shard").filter("at >= low AND at < high")
        moved = going.union(fillers.select("row", slots["goal"]))
        state = stored(goals.select("row", "hub", "shard").join(moved.withColumnRenamed("goal", "to"), "row", "left").select("row", "hub", F.coalesce("to", "shard").alias("shard")), n)
    return state


def dealt(rows: DataFrame, left: list[int]) -> DataFrame:
    """Rows with the `shard` whose room their number falls in."""
    place = F.coalesce(*[F.when(F.col("at") < int(upto), F.lit(k)) for k, upto in enumerate(np.cumsum(left))])
    return numbered(rows, [], "row", "at").withColumn("shard", place.cast("int")).drop("at")


def assign(docs: DataFrame, shards: int, group: str, rounds: int = ROUNDS) -> DataFrame:
    """`row`, `shard` for rows (`row` unique, `group` null or the key of linked rows)."""
    rows = docs.select("row", F.col(group).alias("group"))
    n = rows.count()
    room = max(1, n // shards)  # of a shard
    spark = docs.sparkSession
    groups = stored(rows.filter("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("size")).filter("size > 1"), n)
    large = [(r["size"], r["group"]) for r in groups.filter(F.col("size") >= max(2, -(-room // round(1 / LARGE)))).collect()]
    parts, left = packed(large, [n // shards + (k < n % shards) for k in range(shards)])
    places = spark.createDataFrame(parts, f"group {rows.schema['group'].dataType.simpleString()}, low long, high long, shard int")
    of_large = numbered(rows.join(F.broadcast(places.select("group").distinct()), "group", "left_semi"), ["group"], "row", "at")
    placed = of_large.join(F.broadcast(places), "group").filter("at >= low AND at < high").select("row", "shard")
    small = groups.join(F.broadcast(places.select("group").distinct()), "group", "left_anti")
    # all others start where there is room, and the rounds bring groups together
    others = rows.join(F.broadcast(places.select("group").distinct()), "group", "left_anti").join(small.select("group", F.xxhash64("group").alias("hub")), "group", "left")
    start = stored(dealt(others.select("row", "hub", "group"), left), n)
    state = propagated(start.select("row", "hub", "shard"), shards, np.array(left), rounds, n)
    linked = start.filter("hub IS NOT NULL").select("row", "group").join(state.select("row", "shard"), "row")
    settled = stored(linked.groupBy("group").agg(F.min("shard").alias("shard"), F.max("shard").alias("last"), F.count("*").alias("size")), n)
    together = settled.filter("shard = last")
    for r in together.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        left[r["shard"]] -= r["n"]
    # what the rounds left cut is laid in the room that the whole groups leave
    split = settled.filter("shard <> last").select("group", "size")
    ends = stretches(left, split.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    shard_of = lambda at: F.coalesce(*[F.when(at < e, F.lit(k)) for k, e in enumerate(ends)], F.lit(shards - 1))
    line = stored(laid(split).withColumn("shard", shard_of(F.col("begin"))).withColumn("over", shard_of(F.col("begin") + F.col("size") - 1) != F.col("shard")), n)
    for r in line.filter("NOT over").groupBy("shard").agg(F.sum("size").alias("n")).collect():
        left[r["shard"]] -= r["n"]
    across, left = packed([(r["size"], r["group"]) for r in line.filter("over").collect()], left)  # one an end at most
    spots = spark.createDataFrame(across, places.schema)
    of_across = numbered(rows.join(F.broadcast(spots.select("group").distinct()), "group", "left_semi"), ["group"], "row", "at")
    placed = placed.union(of_across.join(F.broadcast(spots), "group").filter("at >= low AND at < high").select("row", "shard"))
    whole = together.select("group", "shard").union(line.filter("NOT over").select("group", "shard"))
    placed = placed.union(rows.join(whole, "group").select("row", "shard"))
    # documents without links are numbered and dealt to the room left
    return placed.union(dealt(start.filter("hub IS NULL").select("row"), left).select("row", "shard"))


def shard(docs: DataFrame, shards: int = 24, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key of every row; equal texts are linked."""
    known = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(known) + 8).cast("long").alias("size"),
        F.crc32(known.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.sha2(F.col(text).cast("binary"), 256)).alias("group_key"),
    ))
    placed = rows.join(assign(rows, shards, "group_key"), "row")
    return numbered(placed, ["shard"], "row", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_key")
