"""Retrieval: keyword overlap, vector products, rank fusion, and the protocol of pluggable retrievers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T


class Retriever(Protocol):
    """A system under evaluation: all questions at once, never one by one."""

    name: str

    def transform(self, corpus: DataFrame, questions: DataFrame) -> DataFrame: ...


#: Bytes of questions' text that are broadcast at once.
BROADCAST_BYTES = 16 << 20


def parts(questions: DataFrame, bound: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The questions whole if their texts are within the bound, else in as many parts by a hash of their ids as keep each within it."""
    size = questions.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // bound))
    return [questions] if n == 1 else [questions.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def bounded(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """rows, of which each question has at most one, with a broadcast hint if the questions' texts are within the bound."""
    return F.broadcast(rows) if len(parts(questions)) == 1 else rows


def keyword_topk(questions: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score, rank: the k documents that share most tokens with each question, ties to the smaller id; none that share nothing.

    The questions' tokens, size-checked, go to the tasks as postings (which questions hold a token), part by part. A task adds
    up a block of documents' postings as tables of documents by questions, of bounded size, and keeps the k best of each question:
    pairs are never rows, and what is shuffled are tops of tasks. Ids are taken to tell documents apart.
    """
    docs = documents.select("doc_id", T.token_set("text").alias("tokens"))
    found = None
    for part in parts(questions):
        asked = [(r[0], r[1]) for r in part.select("item_id", T.token_set("text")).where("text is not null").collect()]
        top = docs.mapInArrow(_most_shared(asked, k), "query_id bigint, id bigint, score bigint")
        found = top if found is None else found.unionByName(top)
    best = top_k(found, "query_id", [F.desc("score"), F.col("id")], k)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def _most_shared(asked: list[tuple], k: int):
    """A task's work: tokens shared by a block's documents with every question, of which the best are kept.

    What is sent to the tasks are arrays, a number for each token of a question; a worker makes no objects of them.
    """
    import numpy as np
    import pyarrow as pa

    places: dict[str, int] = {}
    names = pa.array([name for name, _ in asked], pa.int64())
    token = np.array([places.setdefault(t, len(places)) for _, tokens in asked for t in tokens], np.int32)
    item = np.repeat(np.arange(len(asked), dtype=np.int32), np.array([len(tokens) for _, tokens in asked], np.int64))
    order = np.lexsort((token, item // ASKED))  # by ranges of questions, each by token
    token, item = token[order], item[order]
    known, width = pa.array(list(places), pa.string()), ASKED
    begin = np.searchsorted(item // width, np.arange(-(-len(names) // width) + 1))
    del asked, places, order

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def postings():
            """Of a range of questions each: its first, how many, and by token how many of them hold it and which."""
            for i, first in enumerate(range(0, len(names), width)):
                own = slice(begin[i], begin[i + 1])
                yield first, min(width, len(names) - first), np.bincount(token[own], minlength=len(known)).astype(np.int32), item[own] - first

        def hits(block):
            """Row and token of all tokens of a block that any question has."""
            rows, found = [], []
            for low in range(0, block.num_rows, ROWS):
                tokens = block.column(1).slice(low, ROWS)
                at = pc.index_in(tokens.flatten().cast(pa.string()), known)
                row = np.repeat(np.arange(low, low + len(tokens), dtype=np.int32), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                rows.append(row[pc.is_valid(at).to_numpy(zero_copy_only=False)])
                found.append(at.drop_null().to_numpy(zero_copy_only=False).astype(np.int32))
            return np.concatenate(rows), np.concatenate(found)

        tops = Tops(len(names), k)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                block = batch.slice(low, BLOCK)
                ids, (rows, t) = block.column(0).to_numpy(zero_copy_only=False), hits(block)
                for first, many, sizes, flat in postings():
                    counts, begins, reps = np.zeros((block.num_rows, many), np.int32), np.cumsum(sizes, dtype=np.int64) - sizes, sizes[t]
                    ends = np.cumsum(reps, dtype=np.int64)
                    cuts = np.unique([0, *np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), len(t)])
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # rows are in order, so a piece is of a few of them
                        n, at, top = reps[a:b], rows[a], rows[b - 1] + 1
                        items = flat[np.repeat(begins[t[a:b]] - np.cumsum(n, dtype=np.int64) + n, n) + np.arange(n.sum())]
                        counts[at:top] += np.bincount(np.repeat((rows[a:b] - at).astype(np.int64) * many, n) + items, minlength=(top - at) * many).reshape(-1, many).astype(np.int32)
                    tops.add(counts.T, ids, counts.T > 0, first)
        rows = tops.rows()
        yield pa.RecordBatch.from_arrays([names.take(pa.array([q for q, _, _ in rows], pa.int64())), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([int(x) for _, _, x in rows], pa.int64())], names=["query_id", "id", "score"])

    return run


class Tops:
    """The k best (score, id) of each query, fed with blocks: scores by query and row; ties go to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.best = k, [[] for _ in range(queries)]

    def add(self, scores, ids, allowed, first: int = 0) -> None:
        """scores of the queries from the first on."""
        import numpy as np

        for q in range(len(scores)):
            held = self.best[first + q]
            row = np.where(allowed[q], scores[q], -np.inf)
            least = max(np.partition(row, len(row) - self.k)[len(row) - self.k] if len(row) > self.k else -np.inf, -held[-1][0] if len(held) == self.k else -np.inf)
            few = np.flatnonzero((row >= least) & (row > -np.inf))
            if len(few):
                self.best[first + q] = sorted(held + [(-row[j], int(ids[j])) for j in few])[: self.k]

    def rows(self) -> list[tuple]:
        return [(q, i, -s) for q, held in enumerate(self.best) for s, i in held]


def keyword_top1(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """The best document of each question; ties go to the smaller id."""
    return keyword_topk(questions, documents, 1).drop("rank")


def closest(rows: DataFrame, queries: DataFrame, k: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, id, rank: the k rows (id, value) whose number is closest to each query's (query_id, value), ties to the smaller id; nulls take no part.

    The queries go to the tasks, part by part; a task keeps k rows of each, so no pair is a row.
    """
    asked = queries.where("value is not null").select("query_id", "value")
    n = max(1, -(-16 * asked.count() // bound))
    found = None
    for part in range(n):
        sent = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == part)).collect()

        def run(batches, sent=sent):
            import numpy as np
            import pandas as pd

            values, tops = np.array([r[1] for r in sent], np.float64), Tops(len(sent), k)
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    block = batch.iloc[at : at + BLOCK]
                    gaps = -np.abs(values[:, None] - block["value"].to_numpy(np.float64)[None])
                    tops.add(gaps, block["id"].to_numpy(), np.ones_like(gaps, bool))
            yield pd.DataFrame([(sent[q][0], i, -s) for q, i, s in tops.rows()], columns=["query_id", "id", "gap"]).astype({"query_id": "int64", "id": "int64", "gap": "float64"})

        top = rows.where("value is not null").select("id", "value").mapInPandas(run, "query_id bigint, id bigint, gap double")
        found = top if found is None else found.unionByName(top)
    return top_k(found, "query_id", [F.col("gap"), F.col("id")], k).select("query_id", "id", "rank")


def top_k(scored: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows that meet the queries as one matrix.
BLOCK = 4096
#: Questions whose counts a block holds at once, rows whose tokens are looked up at once, pairs of token and question that are added up at once.
ASKED, ROWS, PAIRS = 1024, 256, 1 << 18


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6, bound: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, id, rank, score: the k rows of largest inner product with each query, by score to some digits and then by id; no row meets itself.

    rows: id, vector, and any of scope, valid_at, invalid_at; queries: query_id, vector, and any of scope, as_of. What both sides
    bring restricts: a query sees the rows of its scope, and those that were valid at its time (valid_at at the latest, invalid_at
    later or null). Rows of scopes that no query has are left out before anything else. Rows meet the queries of their scope in
    blocks, as matrices; a task keeps k rows a query, so what is shuffled are tops of tasks. Queries are sent to the tasks up
    to `bound` bytes at once, beyond that part by part. Rows and queries with a null vector or component take no part.
    """
    scoped, timed = "scope" in rows.columns and "scope" in queries.columns, "as_of" in queries.columns and "valid_at" in rows.columns
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    names = ["id", "vector", *(["scope"] if scoped else []), *(["valid_at", "invalid_at"] if timed else [])]
    own = rows if "invalid_at" in rows.columns or not timed else rows.withColumn("invalid_at", F.lit(None).cast(rows.schema["valid_at"].dataType))
    own = own.where(whole("vector")).select(*names)
    asked = queries.where(whole("vector")).select("query_id", "vector", *(["scope"] if scoped else []), *(["as_of"] if timed else []))
    if scoped:
        own = own.join(asked.select("scope").distinct(), "scope", "left_semi").select(*names)
    size = asked.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // bound))
    found = None
    for part in range(n):
        sent = asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == part)
        top = own.mapInPandas(_tops(sent.toPandas(), k, digits, scoped, timed), "query_id bigint, id bigint, score double")
        found = top if found is None else found.unionByName(top)
    return top_k(found, "query_id", [F.desc("score"), F.col("id")], k)


def _tops(asked, k: int, digits: int, scoped: bool, timed: bool):
    """A task's work: the k best rows for each query, block by block."""

    def run(batches):
        import numpy as np
        import pandas as pd

        groups = [g for _, g in asked.groupby("scope")] if scoped else [asked]
        ready = [(g["scope"].iloc[0] if scoped else None, g["query_id"].to_numpy(), np.array(g["vector"].tolist(), np.float64), pd.to_datetime(g["as_of"]).to_numpy() if timed else None) for g in groups if len(g)]
        tops = {scope: Tops(len(names), k) for scope, names, *_ in ready}
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                block = batch.iloc[at : at + BLOCK]
                for scope, names, vectors, times in ready:
                    own = block[block["scope"] == scope] if scoped else block
                    if not len(own):
                        continue
                    ids = own["id"].to_numpy()
                    scores = np.round(vectors @ np.array(own["vector"].tolist(), np.float64).T, digits)
                    bad = names[:, None] == ids[None]
                    if timed:
                        since, until = (pd.to_datetime(own[c]).to_numpy() for c in ("valid_at", "invalid_at"))
                        bad |= ~(since[None] <= times[:, None]) | (until[None] <= times[:, None])
                    tops[scope].add(scores, ids, ~bad)
        out = [(names.tolist()[q], i, s) for scope, names, *_ in ready for q, i, s in tops[scope].rows()]
        yield pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    return run


def fact_block(found: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, block: the facts found for each query as lines with their validity, best first. facts: id, fact, valid_at, invalid_at."""
    day = lambda c, other: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(other))
    line = F.concat(F.lit("- "), F.coalesce("fact", F.lit("")), F.lit(" ("), day("valid_at", "unknown"), F.lit(" to "), day("invalid_at", "present"), F.lit(")"))
    lines = found.join(facts, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def reciprocal_ranks(lists: DataFrame, k: int = 60) -> DataFrame:
    """Rank fusion: the sum over lists of 1 / (k + rank). lists: (query, id, rank)."""
    return lists.groupBy("query", "id").agg(F.sum(F.lit(1).cast("decimal(20,12)") / (F.lit(k) + F.col("rank")).cast("decimal(10,0)")).cast("double").alias("rrf"))


class KeywordRetriever:
    """Answers with the document that shares most tokens with the question."""

    name = "keyword"

    def transform(self, corpus: DataFrame, questions: DataFrame) -> DataFrame:
        best = keyword_top1(questions, corpus)
        return questions.select("item_id").join(best, "item_id", "left").join(corpus.select("doc_id", F.substring("text", 1, 600).alias("answer_text")), "doc_id", "left")


RETRIEVERS = {"keyword": KeywordRetriever}


def retriever(name: str) -> Retriever:
    if name not in RETRIEVERS:
        raise KeyError(f"no retriever {name!r}; there are {sorted(RETRIEVERS)}")
    return RETRIEVERS[name]()
