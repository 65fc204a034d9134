"""MinHash near-dedup with odd sketches.

1. Every text becomes a set of word shingles (hashes of 64 bits), BANDS x ROWS MinHash samples, one key a band, and an
   odd sketch: each sample toggles one bit, so the bits in which two sketches differ tell how many samples differ.
2. Texts of one set are one class, and only its first row goes on.
3. Each band key becomes a star: its rows are paired with its smallest row, never with each other. Pairs whose
   sketches differ too much are dropped, the rest is confirmed on the full shingle sets.
4. Links join to components. Keys whose rows still lie in several components are searched to the end: rows outside
   the largest component meet all blocks of the key's rows, and pairs of different components whose sketches agree
   are compared inside these meetings. So no link between rows that share a key is lost, and no group is paired out.

At similarity 0.8 two sets share no key with probability below 1e-6, and a sketch rejects them below 1e-6.

Defined results: null, empty and wordless texts have no shingle and no link; a text of fewer words than a
shingle is one shingle; rows without doc_id take part, and a component's name is the smallest id it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import map_texts, stored
from storyloom.operators.graph import connected_components

BANDS, ROWS = 48, 6
#: Bits of an odd sketch, and the most in which linked sets may differ. 0.2 of 288 samples differing make about 103
#: bits, with a deviation of 11.5.
SKETCH_BITS, FAR = 1024, 170
#: Shingles that are hashed at a time, to stay in the processor's cache.
CACHED = 65_536
#: Rows of a band key that form a block of the search to the end.
BLOCK = 256
#: Ids of rows in question that are broadcast to find their texts, at most.
FEW = 1_000_000


class WordHashes(dict):
    """word -> 64 bits, computed when first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text. A-Z are lower-cased, ASCII white space ends words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = mixed(acc + h[k : k + n])
    return np.unique(acc)


class Sampler:
    """MinHash samples of many sets at once: 32-bit multiply-add hashes of the shingles, smallest value of each."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.times = rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(sets), BANDS * ROWS), np.uint32)
        at = 0
        while at < len(sets):
            past, size = at, 0
            while past < len(sets) and (past == at or size + len(sets[past]) <= CACHED):
                size += len(sets[past])
                past += 1
            part = sets[at:past]
            x = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
            starts = np.zeros(len(part), np.int64)
            np.cumsum([len(s) for s in part[:-1]], out=starts[1:])
            for k in range(BANDS * ROWS):
                out[at:past, k] = np.minimum.reduceat(x * self.times[k] + self.plus[k], starts)
            at = past
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One 64-bit key a band."""
        bands = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
        for r in range(ROWS):
            key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + bands[:, :, r])
        return key.view(np.int64)

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmaps of the samples, as 64-bit words."""
        n = len(samples)
        bits = np.zeros((n, SKETCH_BITS), np.uint8)
        rows = np.arange(n)
        for k in range(samples.shape[1]):
            spot = mixed(samples[:, k].astype(np.uint64) + np.uint64((k + 1) << 32)) % np.uint64(SKETCH_BITS)
            bits[rows, spot.astype(np.int64)] ^= 1
        return np.packbits(bits, axis=1).view(np.int64).reshape(n, SKETCH_BITS // 64)


def lists(values: np.ndarray) -> pa.Array:
    """A 2-d array of int64 as lists."""
    starts = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.ascontiguousarray(values).reshape(-1)))


def signatures(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """row, doc_id, n_shingles, set_key, bands, sketch of every row, in shared files."""

    def make():
        hashes, sampler = WordHashes(), Sampler()

        def work(texts):
            sets = [shingles(t, width, hashes) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            place = {i: j for j, i in enumerate(some)}
            take = pa.array([place.get(i) for i in range(len(sets))], pa.int64())
            samples = sampler.samples([sets[i] for i in some])
            if some:
                bands, sketch = lists(sampler.keys(samples)).take(take), lists(sampler.sketches(samples)).take(take)
            else:
                bands = sketch = pa.nulls(len(sets), pa.list_(pa.int64()))
            name = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            return pa.array([len(s) for s in sets], pa.int64()), pa.array(name, pa.string()), bands, sketch

        return work

    fields = "n_shingles long, set_key string, bands array<long>, sketch array<long>"
    mapped = map_texts(docs, text, ["doc_id"], make, fields)
    return stored(mapped.select(F.monotonically_increasing_id().alias("row"), "kept.doc_id", "n_shingles", "set_key", "bands", "sketch"))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def shingle_sets(wanted: DataFrame, rows: DataFrame, docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """(row, items) of the wanted rows, made from their texts anew and kept in shared files."""
    named = stored(wanted.join(rows.select("row", "doc_id", "set_key"), "row"))

    def make():
        hashes = WordHashes()

        def work(texts):
            sets = [shingles(t, width, hashes) for t in texts]
            starts = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=starts[1:])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            return pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))

        return work

    ids = named.select(F.col("doc_id").alias("_id")).distinct()
    if named.count() <= FEW:
        ids = F.broadcast(ids)  # at most FEW numbers; beyond that the texts are shuffled to them
    texts = docs.select("doc_id", F.col(text).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = map_texts(texts, "text", ["doc_id"], make, "set_key string, items array<long>")
    sets = made.select(F.col("kept.doc_id").alias("_id"), "set_key", "items").join(named, ["set_key"]).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    return stored(sets.select("row", "items").dropDuplicates(["row"]))


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, width: int, percent: int, text: str = "text") -> DataFrame:
    """The pairs (a, b) of rows whose full shingle sets are similar enough; sets are made for the rows in question only."""
    sets = shingle_sets(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), rows, docs, width, text)
    left = pairs.join(sets.select(F.col("row").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("row").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stored(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(row, root) of the rows that have links; root is the smallest row of the component."""
    return connected_components(links, "a", "b").select(F.col("id").alias("row"), F.col("component").alias("root"))


def links(rows: DataFrame, docs: DataFrame, width: int, percent: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a, b) links between first rows of classes that connect every component, and (row, first) of all rows with words."""
    some = rows.filter("n_shingles > 0")
    firsts = some.groupBy("set_key").agg(F.min("row").alias("first"))
    member = some.select("row", "set_key").join(firsts, "set_key").select("row", "first")
    unique = stored(some.join(member.filter("row = first").select("row"), "row", "left_semi"))
    sketch = unique.select("row", "sketch")
    bands = unique.select("row", F.explode("bands").alias("key"))
    stars = bands.groupBy("key").agg(F.min("row").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(bands.join(stars, "key"))

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketch.select(F.col("row").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("row").alias("b"), F.col("sketch").alias("y")), "b")
        return pairs.select("a", "b", differing(F.col("x"), F.col("y")).alias("bits")).filter(F.col("bits") <= FAR)

    near = stored(alike(shared.filter("row <> centre").select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()))
    # the likeliest star of each row first; the others only where they would still join two components
    best = near.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    found = confirmed(best, rows, docs, width, percent, text)
    root = components(found)
    ra, rb = root.select(F.col("row").alias("a"), F.col("root").alias("ra")), root.select(F.col("row").alias("b"), F.col("root").alias("rb"))
    across = near.join(ra, "a", "left").join(rb, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    others = stored(across.select("a", "b").join(best, ["a", "b"], "left_anti"))
    if not others.isEmpty():
        found = found.union(confirmed(others, rows, docs, width, percent, text))
        root = components(found)
    meetings = stored(met(shared, root, unique.select("row", "sketch", "bands")))
    pairing = stored(meetings.groupBy("key", "block", "other").applyInArrow(likely, meetings.schema))
    if pairing.isEmpty():
        return found, member
    sets = shingle_sets(pairing.select("row").distinct(), rows, docs, width, text)
    schema = "a long, b long"
    late = pairing.join(sets, "row").groupBy("key", "block", "other").applyInArrow(lambda group: linked(group, percent), schema)
    return found.union(stored(late)), member


def met(shared: DataFrame, root: DataFrame, about: DataFrame) -> DataFrame:
    """The rows of keys that hold several components, dealt so that every pair of different components meets.

    All rows of a key stand in blocks as `home`; those outside its largest component come as probes to every block,
    in blocks of their own, so a meeting has at most about two blocks of rows however large the key is.
    """
    inside = shared.filter("n > 2").join(root, "row", "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    parts = inside.groupBy("key", "root").agg(F.count("*").alias("n"))
    several = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = several.select("key", F.col("top.root").alias("largest"), blocks(F.col("n")).alias("homes"), blocks(F.col("n") - F.col("top.n")).alias("probes"))
    dealt = inside.join(sized, "key").withColumn("h", F.xxhash64("row", "key")).join(about, "row")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["row", "root", "sketch", "bands"]
    home = dealt.select("key", F.pmod("h", "homes").cast("int").alias("block"), up_to("probes").alias("other"), F.lit(False).alias("probe"), *own)
    probe = dealt.filter("root <> largest").select("key", up_to("homes").alias("block"), F.pmod("h", "probes").cast("int").alias("other"), F.lit(True).alias("probe"), *own)
    return home.union(probe)


def table_of(group: pa.Table, name: str) -> np.ndarray:
    """A column of lists of equal length as a 2-d array."""
    return group.column(name).combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)


def alive(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the home rows and probes of a meeting, whether a pair is still in question, and its differing bits.

    In question: of different components, sketches alike, and this key is the first that the two share, so that
    each pair is looked at once.
    """
    probe, root, key = group.column("probe").to_numpy(zero_copy_only=False), group.column("root").to_numpy(), group.column("key")[0].as_py()
    sketch, bands = table_of(group, "sketch").view(np.uint64), table_of(group, "bands")
    home, guest = np.flatnonzero(~probe), np.flatnonzero(probe)
    bits = np.zeros((len(home), len(guest)), np.int64)
    for k in range(sketch.shape[1]):
        bits += np.bitwise_count(sketch[home, k][:, None] ^ sketch[guest, k])
    ok = (bits <= FAR) & (root[home][:, None] != root[guest])
    for k in range(bands.shape[1]):
        if (bands[home, k] == key).any():
            break
        ok &= bands[home, k][:, None] != bands[guest, k]
    return home, guest, ok, bits


def likely(group: pa.Table) -> pa.Table:
    """The rows of a meeting that have a pair in question."""
    home, guest, ok, _ = alive(group)
    return group.take(pa.array(np.sort(np.r_[home[ok.any(1)], guest[ok.any(0)]])))


def linked(group: pa.Table, percent: int) -> pa.Table:
    """Links between the components of a meeting, confirmed on full sets; likeliest first, none within a component."""
    home, guest, ok, bits = alive(group)
    root, row = group.column("root").to_numpy(), group.column("row").to_numpy()
    starts, flat = (group.column("items").combine_chunks().offsets.to_numpy(), group.column("items").combine_chunks().values.to_numpy())
    up = {int(r): int(r) for r in root}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    i, j = np.nonzero(ok)
    out = []
    for k in np.argsort(bits[i, j], kind="stable"):
        a, b = int(home[i[k]]), int(guest[j[k]])
        x, y = top(int(root[a])), top(int(root[b]))
        if x == y:
            continue
        one, two = flat[starts[a] : starts[a + 1]], flat[starts[b] : starts[b + 1]]
        common = len(np.intersect1d(one, two, assume_unique=True))
        if 100 * common >= percent * (len(one) + len(two) - common):
            up[max(x, y)] = min(x, y)
            out.append((int(row[a]), int(row[b])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def groups(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. Links: 100 * common >= percent * union of shingle sets."""
    rows = signatures(docs, width, text)
    joined, member = links(rows, docs, width, percent, text)
    root = components(joined)
    label = stored(member.join(root.withColumnRenamed("row", "first"), "first", "left").select("row", F.coalesce("root", "first").alias("root")))
    named = rows.select("row", "doc_id", "n_shingles").join(label, "row", "left")
    ids = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(ids, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one doc_id of each component. Rows of one doc_id stay or go together; rows without one stay."""
    decided = groups(docs, width, percent, text)
    kept = decided.filter("kept").select("doc_id")
    gone = decided.filter("NOT kept").select(F.col("doc_id")).join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias("_gone"))
    whole = docs.select(F.struct("*").alias("kept"))  # columns of any name travel inside
    return whole.join(gone, F.col("kept.doc_id") == F.col("_gone"), "left_anti").select("kept.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), two AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
