"""Ranked lexical search with block-max pruning: forward-index blocks of neighbouring documents, scored by falling bounds.

Documents are cut into terms once. A block holds the documents of a range of the table (neighbours as the table is read,
so nothing is shuffled): for each, its length and the terms that any query asks for with how often it has them. The blocks
are a table in the shared folder, a small part of the texts. Its sums give N, L and the documents of each term.

The most that a term adds to a score within a block, times how often a query has it, bounds the scores of the block for
that query. The search runs in three passes over the blocks. The first keeps the few blocks of highest bound for each query,
the second scores these, and the k-th best score so found is a threshold that holds for all tasks. In the third each task
sorts its blocks by the query's bound and scores them from the top until the bound is below the threshold, which rises
with what the task finds. Blocks whose bound equals the threshold are scored too, as ties go by doc_id. So no document of
the ranking is missed, however little can be left out.

Queries travel to the tasks: up to `broadcast_bytes` of their text at once. Beyond, they are split into parts of whole
items, each with blocks and passes of its own. A task gives k rows a query at most; only thresholds and the statistics
of query terms come to the driver.

Cases: null texts, and texts without a term, count nowhere. Repeated documents, and different ones under one id, are ranked
one by one; null ids rank behind others of equal score. The distinct texts of one item_id, null included, are one query.
Items without a term, or of terms that no document has, get no rows. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, forget, read, small_batches, written

TOP = 20
#: Documents of a block, blocks that a task sorts at once, and blocks of highest bound that set a query's threshold.
BLOCK, CHUNK, SEEDS = 8, 256, 8
#: Bytes of query text that are sent to the tasks at once.
BROADCAST_BYTES = 8 << 20
#: The contract's classes as fixed values: A-Z is lower case, other ASCII than digits and letters separates terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCKS = "block bigint, n_docs bigint, n_terms bigint, docs array<bigint>, lengths array<bigint>, counts array<int>, terms array<int>, tfs array<bigint>"

BOUNDS = "q int, block bigint, bound bigint"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


class Queries:
    """Items as numbered terms: term i of the vocabulary, and for each item its terms and how often it has them, one after the other."""

    def __init__(self, items: dict[object, Counter]) -> None:
        self.items = [i for i, terms in items.items() if terms]
        self.vocabulary: dict[bytes, int] = {}
        own = [items[i] for i in self.items]
        self.terms = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for terms in own for t in terms], np.int64)
        self.often = np.array([n for terms in own for n in terms.values()], np.int64)
        self.ends = np.cumsum([len(terms) for terms in own]) if own else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if own else self.ends

    def of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[q], self.ends[q])
        return self.terms[at], self.often[at]


def parts(items: DataFrame, broadcast_bytes: int) -> Iterator[Queries]:
    """The queries, in parts of whole items of about broadcast_bytes of text each; one part is in memory at a time."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // broadcast_bytes))
    for part in range(n):
        found: dict[object, Counter] = {}
        for item, text in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part)).toLocalIterator():
            found.setdefault(item, Counter()).update(terms_of(text.encode()))
        yield Queries(found)


def indexed(docs: DataFrame, vocabulary, block: int = BLOCK) -> DataFrame:
    """Forward-index blocks of docs (doc_id, text) over a broadcast vocabulary. n_docs and n_terms count all of the range, docs those with a term of it."""
    small_batches(docs.sparkSession)
    arrow = _arrow(BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        get = vocabulary.value.get
        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        n_docs = n_terms = 0
        ids, lengths, counts, terms, tfs = [], [], [], [], []

        def row():
            nonlocal n_docs, n_terms, made
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((base + made, n_docs, n_terms, ids, lengths, counts, terms, tfs), arrow, strict=True)], schema=arrow)
            made, n_docs, n_terms = made + 1, 0, 0
            for held in (ids, lengths, counts, terms, tfs):
                held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                own = [(t, n) for w, n in Counter(words).items() if (t := get(w)) is not None]
                if own:
                    ids.append(doc)
                    lengths.append(len(words))
                    counts.append(len(own))
                    terms += [t for t, _ in own]
                    tfs += [n for _, n in own]
                    if len(ids) == block:
                        yield row()
        if n_docs:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


class Block:
    """A block's contributions by term: maxima for its bounds, and all of them as a matrix if it is scored."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int) -> None:
        self.ids = row["docs"]
        terms, tfs = np.array(row["terms"], np.int64), np.array(row["tfs"], np.int64)
        m = np.array([100 - 25 + 25 * length * n // total for length in row["lengths"]], np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), row["counts"])
        self.terms = terms
        self.adds = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m[self.doc]))
        self.matrix = None

    def bounds(self, queries: Queries, most: np.ndarray) -> np.ndarray:
        """By query. most is room for a number a term, all zero, and is left so."""
        np.maximum.at(most, self.terms, self.adds)
        out = np.add.reduceat(most[queries.terms] * queries.often, queries.starts)
        most[self.terms] = 0
        return out

    def scores(self, terms: np.ndarray, often: np.ndarray) -> np.ndarray:
        if self.matrix is None:
            self.known, at = np.unique(self.terms, return_inverse=True)
            self.matrix = np.zeros((len(self.known), len(self.ids)), np.int64)
            self.matrix[at, self.doc] = self.adds
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        here = self.known[at] == terms
        return often[here] @ self.matrix[at[here]]


class Best:
    """The k best (score, doc) of one query so far, and the score that a document has to reach."""

    def __init__(self, k: int, threshold: int) -> None:
        self.k, self.threshold, self.rows = k, max(1, threshold), []

    def add(self, scores: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(scores >= self.threshold).tolist()
        if at:
            self.rows = sorted(self.rows + [(-int(scores[i]), ids[i] is None, ids[i] or 0) for i in at])[: self.k]
            if len(self.rows) == self.k:
                self.threshold = max(self.threshold, -self.rows[-1][0])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the `top` best documents with a score above 0 for each of items (item_id, text)."""
    spark = docs.sparkSession
    kind = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id bigint, score bigint"
    found = None
    for queries in parts(items, broadcast_bytes):
        own = _part(docs, queries, top, block, kind)
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _part(docs: DataFrame, queries: Queries, top: int, block: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score), written: what the tasks find for some queries, `top` rows a task and query at most."""
    spark = docs.sparkSession
    if not queries.items:
        return spark.createDataFrame([], kind)
    sc = spark.sparkContext
    blocks = written(indexed(docs, sc.broadcast(queries.vocabulary), block), "lexical-blocks")
    n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.zeros(len(queries.vocabulary), np.int64)  # of terms that no document has
    for term, df in blocks.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    sent = sc.broadcast((queries, weights))
    bounds_of, found_of = _arrow(BOUNDS), _arrow(kind)
    narrow = blocks.select("block", "docs", "lengths", "counts", "terms", "tfs")

    def chunks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK).to_pylist()
                yield [(r["block"], Block(r, sent.value[1], n, total)) for r in rows if r["docs"]]

    def highest(batches):
        queries, weights = sent.value
        most, n = np.zeros(len(weights), np.int64), len(queries.items)
        names, bounds = np.zeros((0, n), np.int64), np.zeros((0, n), np.int64)
        for chunk in chunks(batches):
            if chunk:
                names = np.concatenate([names, np.repeat(np.array([[name] for name, _ in chunk], np.int64), n, 1)])
                bounds = np.concatenate([bounds, [held.bounds(queries, most) for _, held in chunk]])
                if len(bounds) > SEEDS:
                    few = np.argpartition(-bounds, SEEDS - 1, axis=0)[:SEEDS]
                    names, bounds = np.take_along_axis(names, few, 0), np.take_along_axis(bounds, few, 0)
        at, q = np.nonzero(bounds)
        yield _batch(list(zip(q.tolist(), names[at, q].tolist(), bounds[at, q].tolist(), strict=True)), bounds_of)

    seeds = Window.partitionBy("q").orderBy(F.col("bound").desc(), "block")
    first = narrow.mapInArrow(highest, BOUNDS).withColumn("place", F.row_number().over(seeds)).where(F.col("place") <= SEEDS).select("q", "block")
    first = written(first, "lexical-seeds")  # SEEDS rows a query

    def scored(thresholds):
        def run(batches):
            queries, weights = sent.value
            most = np.zeros(len(weights), np.int64)
            best = [Best(top, t) for t in thresholds]
            for chunk in chunks(batches):
                if not chunk:
                    continue
                bounds = np.array([held.bounds(queries, most) for _, held in chunk])
                order = np.argsort(-bounds, axis=0, kind="stable")
                for q, mine in enumerate(best):
                    terms, often = queries.of(q)
                    for b in order[:, q].tolist():
                        if bounds[b, q] < mine.threshold:
                            break
                        mine.add(chunk[b][1].scores(terms, often), chunk[b][1].ids)
            yield _batch([(queries.items[q], None if none else doc, -score) for q, mine in enumerate(best) for score, none, doc in mine.rows], found_of)

        return run

    zero = [0] * len(queries.items)
    places = {item: q for q, item in enumerate(queries.items)}
    start = narrow.join(first.select("block").distinct(), "block", "left_semi").mapInArrow(scored(zero), kind)
    down = Window.partitionBy("item_id").orderBy(F.col("score").desc())
    kth = start.withColumn("place", F.row_number().over(down)).where(F.col("place") == top)
    thresholds = list(zero)
    for item, score in kth.select("item_id", "score").toLocalIterator():
        thresholds[places[item]] = score
    out = written(narrow.mapInArrow(scored(thresholds), kind), "lexical-found")
    forget(blocks)
    forget(first)
    return out


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
c AS (SELECT count(*) AS n_all, sum(len(ws))::BIGINT AS l_all FROM d WHERE len(ws) > 0),
q AS (
  SELECT item_id, term, count(*) AS often FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY item_id, term),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, n_all),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ws) * n_all) // l_all AS m FROM d, c WHERE len(ws) > 0),
s AS (
  SELECT item_id, r, m.doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r, m.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
