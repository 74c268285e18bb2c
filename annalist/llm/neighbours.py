"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Training: coarse centroids (k-means) and, on residuals, one codebook a sub-space, from at most `SAMPLE` vectors taken by
a hash of vec_id (a documented bound). Index: every vector goes to its nearest centroid's list with the codes of its residual;
the lists are written in order, dealt by ranges of (list, vec_id), so that no list is one task's work.
Search: a query probes the lists with the largest inner product of query and centroid. Query vectors are broadcast in chunks
of at most CHUNK bytes; each task reads its part of the lists, scores all codes of a list by an asymmetric table (query
against each code word) for the queries that probe it, reranks the best `rerank` of a segment of BLOCK vectors by the exact
product in double precision, and returns the best k that it has for a query; the best k of all tasks remain. So only the index
is shuffled, once, and k rows a query and task. Ties go to the smaller vec_id.
Check: the k-th score found bounds each query from below. A second scan of the index takes, for each query, the segments that can
hold a product as large (query with centroid, plus the query's length times the largest residual), and adds what they hold. So the
answer is exact on any rows: copies, vectors of unlike lengths, queries far from all others. Where no segment can be ruled out
the check is a product of all queries and vectors, in blocks.

How many lists are probed is measured on TRIALS vectors of the sample: as many as give `RECALL` of the true neighbours after
the codes and the reranking, against brute force.

Cases: vectors that are null, zero, or hold null or non-finite components, or are not as long as most, take no part,
neither as queries nor as candidates; null vec_ids neither. Rows repeated under one vec_id count once. Fewer candidates
than k: all of them. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import map_batches, partitions, read, written

K = 20
SAMPLE = 20_000
BLOCK, QUERIES, CHUNK = 4096, 512, 64 << 20
#: Products of the check that are computed at once.
PAIRS = 1 << 16
#: Parts of a vector that are quantised on their own, code words of each, and k-means rounds.
PARTS, WORDS, ROUNDS = 16, 256, 8
#: Share of true neighbours that the search must find, measured on TRIALS vectors of the sample; candidates that a segment reranks for a query.
RECALL, TRIALS, RERANK = 0.97, 200, 64


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vec of the rows that take part: floats as they are, all other numbers as doubles."""
    v = F.col(column).cast("array<float>" if df.schema[column].dataType.elementType.typeName() == "float" else "array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(good, F.lit(False)))
    top = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (top[0] if top else 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows, floats or doubles."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(part @ centres.T - half, 1) for part in np.array_split(x, max(1, len(x) // 4096))])


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centres; fewer where x has fewer different rows."""
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centres = different[rng.permutation(len(different))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(x.dtype)
    return centres


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, seed: int = 13) -> None:
        self.centres = k_means(sample, lists, seed)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.books = [k_means(np.ascontiguousarray(rest[:, c]), WORDS, seed + 1 + i) for i, c in enumerate(self.cuts)]

        self.probes = self.measured(sample, RECALL)

    def measured(self, sample: np.ndarray, recall: float) -> int:
        """Lists to probe, so that codes and reranking of them find this share of the K nearest within the sample of TRIALS of its vectors."""
        at = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        exact = sample[at] @ sample.T
        exact[np.arange(len(at)), at] = -np.inf
        near = np.argsort(-exact, 1)[:, : min(K, max(1, len(sample) - 1))]
        own, codes = self.encode(sample)
        place = np.take_along_axis(np.argsort(self.probe(sample[at], len(self.centres)), 1), own[near], 1)
        reranked = np.zeros(exact.shape, bool)
        for c in np.unique(own).tolist():
            members = np.flatnonzero(own == c)
            if len(members) <= RERANK:
                reranked[:, members] = True
            else:
                top = np.argpartition(-self.scores(sample[at], c, codes[members]), RERANK, 1)[:, :RERANK]
                np.put_along_axis(reranked, members[top], True, 1)
        need = np.where(np.take_along_axis(reranked, near, 1), place, len(self.centres))
        found = np.cumsum(np.bincount(need.reshape(-1), minlength=len(self.centres) + 1))[:-1] / need.size
        return int(min(np.searchsorted(found, recall), len(self.centres) - 1)) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([nearest(np.ascontiguousarray(rest[:, c]), b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def probe(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), 1, kind="stable")[:, :n]

    def scores(self, q: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric scores, queries by codes, of one list."""
        out = np.repeat((q @ self.centres[own])[:, None], len(codes), 1)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, c] @ b.T)[:, codes[:, i]]
        return out


def train(vectors: DataFrame, sample: int = SAMPLE, lists: int | None = None) -> tuple[Quantiser | None, int]:
    """A quantiser and the number of vectors. Lists: about the square root of their number, 4096 at most."""
    n = vectors.count()
    if not n:
        return None, 0
    share = int(min(1.0, sample / n) * (1 << 30))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).toArrow() if share < 1 << 30 else vectors.toArrow()
    rows = rows if rows.num_rows else vectors.limit(1).toArrow()
    order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
    x = matrix(rows.column("vec").combine_chunks())[order]
    return Quantiser(x, lists or int(np.clip(np.sqrt(n), 1, 4096))), n


def index(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """A written table (list, vec_id, code, vec, dims) in the order of lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def make(batch):
        x = matrix(batch.column("vec"))
        own, codes = shared.value.encode(x)
        return {"list": own, "vec_id": batch.column("vec_id"), "code": [c.tobytes() for c in codes], "vec": [v.tobytes() for v in x], "dims": [x.shape[1]] * len(x)}

    coded = map_batches(vectors, make, "list int, vec_id bigint, code binary, vec binary, dims int")
    return written(coded.repartitionByRange(partitions(vectors.sparkSession), "list", "vec_id").sortWithinPartitions("list", "vec_id"), "ivf")


class Best:
    """The best k of each query so far, by score, then by the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.ids, self.scores = k, np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = (scores >= self.scores[at, -1:]).any(1) & (scores > -np.inf).any(1)
        at, ids, scores = at[better], np.concatenate([self.ids[at[better]], ids[better]], 1), np.concatenate([self.scores[at[better]], scores[better]], 1)
        order = np.lexsort((ids, -scores), -1)[:, : self.k]
        self.ids[at], self.scores[at] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def segments(batches, last: tuple = (None, None)):
    """list, ids, codes and vectors of segments of at least BLOCK rows of a list, or all that a task has of it; by vec_id, each once."""
    held: list = []  # pieces of one list

    def joined():
        nonlocal last
        ids = np.concatenate([h[1] for h in held])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.concatenate([[(held[0][0], ids[0]) != last], ids[1:] != ids[:-1]])
        codes, vecs = [c for h in held for c in h[2]], [v for h in held for v in h[3]]
        kind = np.float64 if len(vecs[0]) == 8 * held[0][4] else np.float32
        out = held[0][0], ids[first], *(np.frombuffer(b"".join(x), k).reshape(len(ids), -1)[order][first] for x, k in ((codes, np.uint8), (vecs, kind)))
        last = held[0][0], ids[-1]
        held.clear()
        return out

    for batch in batches:
        own, vec_ids = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
        codes, vecs, dims = batch.column("code").to_pylist(), batch.column("vec").to_pylist(), batch.column("dims").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                if held and (held[0][0] != own[a] or sum(len(h[1]) for h in held) >= BLOCK):
                    yield joined()
                held.append((int(own[a]), vec_ids[a:b], codes[a:b], vecs[a:b], int(dims[a])))
    if held:
        yield joined()


def tops(batches, quantiser, sent, search, k: int):
    """One batch of the best k that `search` adds for each query of a task."""
    import pyarrow as pa

    q_ids, queries = sent.value[:2]
    best = Best(len(q_ids), k)
    search(quantiser.value, *sent.value, segments(batches), best)
    found = best.scores > -np.inf
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, found.sum(1))), pa.array(best.ids[found]), pa.array(best.scores[found])], names=["query_id", "vec_id", "score"])


FOUND = "query_id bigint, vec_id bigint, score double"


def scanned(packed: DataFrame, quantiser, ids: np.ndarray, q: np.ndarray, probes: int, k: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score: the best k that each task has for each of these queries in the lists that it probes."""
    sent = packed.sparkSession.sparkContext.broadcast((ids, q))

    def probing(model, q_ids, queries, parts, best):
        near = model.probe(queries, probes)
        by_list = np.argsort(near.reshape(-1), kind="stable")
        edges = np.searchsorted(near.reshape(-1)[by_list], np.arange(len(model.centres) + 1))
        for own, ids, codes, vecs in parts:
            vecs = vecs.astype(np.float64)
            for at in np.split(by_list[edges[own] : edges[own + 1]] // near.shape[1], range(QUERIES, edges[own + 1] - edges[own], QUERIES)):
                if len(at):
                    rough = model.scores(queries[at], own, codes)
                    rough[q_ids[at][:, None] == ids[None, :]] = -np.inf
                    top = np.argpartition(-rough, rerank, 1)[:, :rerank] if len(ids) > rerank else np.tile(np.arange(len(ids)), (len(at), 1))
                    exact = np.einsum("qd,qrd->qr", queries[at].astype(np.float64), vecs[top])
                    exact[np.take_along_axis(rough, top, 1) == -np.inf] = -np.inf
                    best.add(at, ids[top], exact)

    return packed.mapInArrow(lambda batches: tops(batches, quantiser, sent, probing, k), FOUND)


def checked(packed: DataFrame, quantiser, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each task for each query among all vectors whose score is not below its `least`."""
    sent = packed.sparkSession.sparkContext.broadcast((ids, q, least))

    def checking(model, q_ids, queries, least, parts, best):
        queries, long = queries.astype(np.float64), np.linalg.norm(queries.astype(np.float64), axis=1)
        for own, ids, _, vecs in parts:
            vecs, centre = vecs.astype(np.float64), model.centres[own].astype(np.float64)
            slack = 1e-11 * long * (np.linalg.norm(vecs, axis=1).max() + np.linalg.norm(centre))  # rounding of sums in different orders
            can = np.flatnonzero(queries @ centre + long * np.linalg.norm(vecs - centre, axis=1).max() >= least - slack)
            for at in np.split(can, range(QUERIES, len(can), QUERIES)):
                bound = (np.maximum(least[at], best.scores[at, -1]) - slack[at])[:, None]
                rough = queries[at] @ vecs.T
                rough[q_ids[at][:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:  # what k others of the segment exceed is out
                    bound = np.maximum(bound, np.partition(rough, -k, 1)[:, -k, None] - 2 * slack[at][:, None])
                row, col = np.nonzero((rough >= bound) & (rough > -np.inf))
                if not len(row):
                    continue
                exact = np.concatenate([np.einsum("pd,pd->p", queries[at[row[i : i + PAIRS]]], vecs[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)])
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col, exact, place = row[place < k], col[place < k], exact[place < k], place[place < k]
                wide_ids, wide = np.full((len(at), k), np.iinfo(np.int64).max), np.full((len(at), k), -np.inf)
                wide_ids[row, place], wide[row, place] = ids[col], exact
                best.add(at, wide_ids, wide)

    return packed.mapInArrow(lambda batches: tops(batches, quantiser, sent, checking, k), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """For each query row (vec_id, vec): query_id, rank, vec_id, score of the k nearest of vectors but itself."""
    spark = vectors.sparkSession
    quantiser, _ = train(vectors)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if quantiser is None:
        return spark.createDataFrame([], schema)
    packed, shared = index(vectors, quantiser), spark.sparkContext.broadcast(quantiser)
    dims, lists = quantiser.centres.shape[1], len(quantiser.centres)
    n_probe = min(lists, probes or quantiser.probes)
    size = max(1, CHUNK // (8 * dims + 16 * k + 32 * n_probe))  # what a query takes in a worker
    n = max(1, -(-queries.count() // size))
    asked = written(queries.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("part")), "queries") if n > 1 else queries
    found = None
    for i in range(n):
        own = (asked.where(F.col("part") == i) if n > 1 else asked).select("vec_id", "vec").toArrow()
        if own.num_rows:
            ids, q = own.column("vec_id").to_numpy(), matrix(own.column("vec").combine_chunks())
            near = written(scanned(packed, shared, ids, q, n_probe, k, rerank), "near")
            kth = ranked(near, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
            least = np.full(len(ids), -np.inf)
            at = np.argsort(ids, kind="stable")
            least[at[np.searchsorted(ids[at], kth.column("query_id").to_numpy())]] = kth.column("score").to_numpy()
            part = near.unionByName(checked(packed, shared, ids, q, least, k))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return ranked(found, k)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"]))
