"""Exact n-gram Jaccard self-join in a metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

The space is sets of hashed 5-word shingles under the Jaccard distance; two documents link at distance 0.2 or less.

Regions. Text is sparse: nearly all documents are at distance 1 from any document taken as a pivot. The outer pivots are
therefore the singletons {s}: a set x is at distance 1 - 1/|x| from {s} if it holds s, at 1 otherwise, so its nearest
pivots are its own shingles. Ties are broken by one global order, rare first. A set belongs to its first pivot's region;
what lies within the window of distance 0.2 around any set must share one of its first |x| - ceil(0.8 |x|) + 1
pivots, so boundary documents are replicated to exactly these regions. Rare first comes from a sketch of fixed size of
all documents' shingles; any order would do for exactness, this one keeps frequent passages from making regions.

Recursion. A region's documents are split by document pivots. A pivot's near documents form one piece, each of them is
a pivot for what remains, pieces of all regions are joined into blocks, and a block is split once more in the same way
by exact distances: |d(x, p) - d(y, p)| > 0.2 rules a pair out by the triangle inequality, linked documents need
no further comparison with each other, so groups of copies cost one pass, not all pairs. In regions a bitmap of two to
four bits a shingle bounds distances from below: each bit that one set has and the other has not is a shingle that they do
not share, so no linked pair is ever ruled out. Blocks verify all that goes on with the whole sets.

Equal sets are one document of the join: they are grouped by a 128-bit sum first. Documents' texts are read three times
and shuffled only for blocks; links and sets never reach the driver.

Cases: null, empty and word-less texts have the empty set and link with nothing; fewer words than five are one shingle.
Null doc_ids link with nothing and have a null component. Rows repeated under one doc_id are equal sets. Columns other
than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, components, map_batches, partitions, read, small_batches, written

WIDTH = 5
#: Links are at 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the sketch, in bits and in slices for its sum.
SKETCH_BITS, SLICES = 18, 16
#: A-Z in lower case; bytes.split() then cuts at blanks and bytes 9 to 13: the contract's fixed classes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = _RNG.integers(0, 1 << 63, WIDTH + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            steps = np.full(max(n, 1 << 20), BASE)
            steps[0] = 1
            cls.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = inverse
            cls.down = np.cumprod(steps, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's words begin and end."""
    inside = np.concatenate([[False], ~SPACE[np.frombuffer(text, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def totals(values: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial of values: any stretch's hash is a difference of two, shifted down."""
    return np.concatenate([[np.uint64(0)], np.cumsum(values * Powers.to(len(values))[0], dtype=np.uint64)])


def running(text: bytes) -> np.ndarray:
    return totals(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1))


def word_hashes(text: bytes, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word of a text. sums: running(text), if it is known."""
    starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = running(text) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * Powers.to(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    w = word_hashes(text.translate(LOWER)) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    width = min(WIDTH, len(w))
    n = len(w) - width + 1
    h = np.full(n, STEPS[WIDTH] * np.uint64(width))
    for i in range(width):
        h += w[i : i + n] * STEPS[i]
    return np.unique(mix(h))


def links(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + m - common)


def bitmap(s: np.ndarray) -> bytes:
    """A set's shingles as bits, of the least power of two (64 or more) that is twice their number or more."""
    bits = np.zeros(max(64, 1 << (2 * len(s) - 1).bit_length()), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(p: np.ndarray, n, q: np.ndarray, m) -> np.ndarray:
    """No fewer than the shingles that sets of sizes n and m with bitmaps p and q (rows of 64-bit words) share: of different widths, the wider is folded."""
    while p.shape[-1] != q.shape[-1]:
        if p.shape[-1] > q.shape[-1]:
            p = p[..., : p.shape[-1] // 2] | p[..., p.shape[-1] // 2 :]
        else:
            q = q[..., : q.shape[-1] // 2] | q[..., q.shape[-1] // 2 :]
    only = lambda x, y: np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)
    return np.minimum(n - only(p, q), m - only(q, p))


class Region:
    """Members with their sizes and bitmaps, by the bitmaps' widths."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]) -> None:
        self.sizes, self.width = sizes, np.array([len(b) // 8 for b in bits])
        self.row, self.maps = np.zeros(len(bits), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.maps[w] = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w)

    def near(self, p: int, others: np.ndarray) -> np.ndarray:
        n, m = self.sizes[p], self.sizes[others]
        fit = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        own = self.maps[int(self.width[p])][self.row[p]]
        for w in np.unique(self.width[others[fit]]).tolist():
            at = np.flatnonzero(fit & (self.width[others] == w))
            fit[at] = links(most_common(own, n, self.maps[w][self.row[others[at]]], m[at]), n, m[at])
        return fit


def sketch(texts: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles in 2^SKETCH_BITS buckets; summed by slices on the executors."""
    small_batches(texts.sparkSession)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            found = [s for t in as_bytes(batch.column(0)) if len(s := shingles(t))]
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition(min(SLICES, partitions(texts.sparkSession)), "slice").mapInArrow(add, schema).collect()
    total = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for k, c in rows:
        total[k] += np.frombuffer(c, np.uint64)
    return total.reshape(-1)


def levels(counts: np.ndarray) -> np.ndarray:
    """How far each bucket stands out from the mean, in powers of two: 0 for nearly all."""
    return np.maximum(0, np.floor(np.log2((counts + 1) / (4 * counts.mean() + 16)))).astype(np.uint64) + (counts > 4 * counts.mean() + 16)


def order_of(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Pivots of a set in the global order: 6 bits of level, 58 of hash."""
    return np.sort((level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (s >> np.uint64(6)))


class Runs:
    """Sorted rows as they come: add gives those whose key (any row's first part) is complete, rest the last ones."""

    def __init__(self) -> None:
        self.held: list[tuple] = []  # pieces of one key

    def add(self, key: np.ndarray, rest: list[np.ndarray]):
        if not len(key):
            return None
        if self.held and key[-1] == self.held[0][0][0]:
            self.held.append((key, rest))
            return None
        last = int(np.argmax(key == key[-1]))
        pieces = [*self.held, (key[:last], [x[:last] for x in rest])]
        self.held = [(key[last:], [x[last:] for x in rest])]
        return self.joined(pieces)

    def rest(self):
        return self.joined(self.held)

    @staticmethod
    def joined(pieces: list[tuple]):
        if not sum(len(k) for k, _ in pieces):
            return None
        return np.concatenate([k for k, _ in pieces]), [np.concatenate(c) for c in zip(*[r for _, r in pieces], strict=True)]


def runs(batches, columns: list[int]):
    """Sorted Arrow batches as runs of rows with one key (column 0): (keys, other columns), complete runs only."""
    held = Runs()
    for batch in batches:
        found = held.add(batch.column(0).to_numpy(zero_copy_only=False), [batch.column(i).to_numpy(zero_copy_only=False) for i in columns])
        if found:
            yield found
    if found := held.rest():
        yield found


def bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.append(starts[1:], len(key))


def split(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of the pieces of n documents: near(pivot, others) tells which others go with the pivot.

    Every member of a piece is a pivot for what is in no piece yet; what a piece has taken is not compared again.
    """
    edges, left = [], np.arange(n)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            p = frontier.pop()
            hit = near(p, left)
            if hit.any():
                taken = left[hit]
                edges += [(p, x) for x in taken]
                frontier += taken.tolist()
                left = left[~hit]
    return edges


class Block:
    """Documents with whole sets, compared exactly; distances to the first pivot give the triangle-inequality windows."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.flat, self.ends = np.concatenate(sets), np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.first = self.distance(0, np.arange(len(sets)))

    def common(self, p: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.begins[p] : self.ends[p]]
        n = self.sizes[others]
        at = np.repeat(self.begins[others] - np.cumsum(n) + n, n) + np.arange(n.sum())
        theirs = self.flat[at]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        return np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)

    def distance(self, p: int, others: np.ndarray) -> np.ndarray:
        c = self.common(p, others)
        return 1 - c / (self.sizes[p] + self.sizes[others] - c)

    def near(self, p: int, others: np.ndarray) -> np.ndarray:
        n, m = self.sizes[p], self.sizes[others]
        window = (np.abs(self.first[others] - self.first[p]) <= 1 - PERCENT / 100 + 1e-9) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        at = np.flatnonzero(window)
        if len(at):
            window[at] = links(self.common(p, others[at]), n, m[at])
        return window


def prepared(documents: DataFrame) -> DataFrame:
    """A written table of all rows: doc_id, n, two sums that name the set, its bitmap, and the pivots of its regions."""
    level = documents.sparkSession.sparkContext.broadcast(levels(sketch(documents)))

    def make(batch):
        out = {"doc_id": batch.column("doc_id"), "n": [], "d1": [], "d2": [], "bits": [], "pivots": []}
        for text in as_bytes(batch.column("text")):
            s = shingles(text)
            n = len(s)
            out["n"].append(n)
            out["d1"].append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if n else None)
            out["d2"].append(int(mix(s * STEPS[0] + STEPS[1]).sum(dtype=np.uint64).astype(np.int64)) if n else None)
            out["bits"].append(bitmap(s) if n else None)
            out["pivots"].append(order_of(s, level.value)[: n - -(-PERCENT * n // 100) + 1].tobytes() if n else None)
        return out

    return written(map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bits binary, pivots binary"), "jaccard-sets")


def region_members(reps: DataFrame) -> DataFrame:
    """(list, id) of regions with two documents or more; regions with the same documents are one."""

    def spread(batch):
        pivots = [np.frombuffer(p, np.int64) for p in batch.column("pivots").to_pylist()]
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(p) for p in pivots])
        return {"pivot": np.concatenate(pivots), "id": ids}

    def gather(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for key, (ids,) in runs(batches, [1]):
            starts, ends = bounds(key)
            many = ends - starts > 1
            starts, ends = starts[many], ends[many]
            if not len(starts):
                continue
            n = ends - starts
            at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = ids[at]
            names = np.add.reduceat(mix(own.astype(np.uint64) * BASE), np.cumsum(n) - n, dtype=np.uint64).astype(np.int64)
            new = np.zeros(len(names), bool)
            for i, x in enumerate(names.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            if len(seen) > 1 << 20:
                seen.clear()
            keep = np.repeat(new, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)[keep]), pa.array(own[keep])], names=["list", "id"])

    p = partitions(reps.sparkSession)
    rows = map_batches(reps.select("doc_id", "pivots"), spread, "pivot bigint, id bigint")
    return rows.repartition(p, "pivot").sortWithinPartitions("pivot").mapInArrow(gather, "list bigint, id bigint").distinct()


def region_edges(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join the pieces of each region, by bitmaps and sizes."""

    def join(batches):
        import pyarrow as pa

        for key, (ids, sizes, bits) in runs(batches, [1, 2, 3]):
            starts, ends = bounds(key)
            out = []
            pairs = starts[ends - starts == 2]
            n, m = sizes[pairs], sizes[pairs + 1]
            pairs = pairs[100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)]
            shape = np.array([(len(bits[i]), len(bits[i + 1])) for i in pairs]).reshape(-1, 2)
            for a, b in np.unique(shape, axis=0).tolist():
                at = pairs[(shape == (a, b)).all(1)]
                rows = lambda i, width: np.frombuffer(b"".join(bits[i].tolist()), np.uint64).reshape(len(i), width // 8)
                good = at[links(most_common(rows(at, a), sizes[at], rows(at + 1, b), sizes[at + 1]), sizes[at], sizes[at + 1])]
                out.append(np.stack([ids[good], ids[good + 1]], 1))
            for a, b in zip(starts, ends, strict=True):
                if b - a > 2:
                    edges = split(b - a, Region(sizes[a:b], bits[a:b].tolist()).near)
                    if edges:
                        out.append(ids[a:b][np.array(edges)])
            if out:
                e = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    p = partitions(members.sparkSession)
    rows = members.join(reps.select(F.col("doc_id").alias("id"), "n", "bits"), "id").select("list", "id", "n", "bits")
    return rows.repartition(p, "list").sortWithinPartitions("list", "id").mapInArrow(join, "a bigint, b bigint")


def block_links(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Verified links (a, b), enough to connect all documents of a block that links connect."""

    def join(batches):
        import pyarrow as pa

        for key, (ids, texts) in runs(batches, [1, 2]):
            starts, ends = bounds(key)
            out = []
            for a, b in zip(starts, ends, strict=True):
                own, first = np.unique(ids[a:b], return_index=True)
                if len(own) > 1:
                    edges = split(len(own), Block([shingles(texts[a + i].encode()) for i in first]).near)
                    if edges:
                        out.append(own[np.array(edges)])
            if out:
                e = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    p = partitions(documents.sparkSession)
    # Merged at every size: whether the members are few enough to broadcast must not decide whether texts are shuffled.
    rows = documents.select("doc_id", "text").join(blocks.hint("merge"), F.col("doc_id") == F.col("id")).select(F.col("component").alias("block"), "id", "text")
    return rows.repartition(p, "block").sortWithinPartitions("block", "id").mapInArrow(join, "a bigint, b bigint")


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents (doc_id, text)."""
    small_batches(documents.sparkSession)
    rows = prepared(documents)
    names = written(rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard-names")
    own = names.select(F.col("rep").alias("doc_id"), "d1", "d2")
    reps = rows.join(own, ["doc_id", "d1", "d2"], "left_semi")
    blocks = components(region_edges(region_members(reps), reps), "jaccard-blocks")
    # components() gives the members but the smallest; that one is its own.
    blocks = blocks.unionByName(blocks.select(F.col("component").alias("id"), "component").distinct())
    found = components(block_links(documents, written(blocks, "jaccard-blocks")), "jaccard-links")
    found = names.join(found, F.col("rep") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    empty = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.where("n > 0 and doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    return full.join(found, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id").unionByName(empty)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
