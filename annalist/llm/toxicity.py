"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with marks at its ends, and the whole word), hashed into buckets that
each have a vector; a segment of some words is the mean of its words' bags, and a linear softmax of that mean gives the
two classes. Segments overlap by half, so that no phrase of half a segment is cut by all of them. A document is as toxic as
its most toxic segment, so that one insult in thousands of words counts, and all segments of the whole text are looked at.
Vectors and softmax are learned together: each epoch scores all segments, takes every document's worst few, and descends on
their cross entropy. Unseen spellings share n-gram vectors.

Learning uses at most `per_label` labelled rows a label (a documented bound; rows are taken by a hash of doc_id). The length
of segments is chosen among `segments` by learning on three quarters of at most `trial` of these rows a label and scoring
the rest; rows held out of learning choose nothing.

Cases: null and empty texts have no segment and score as the softmax's bias alone, at most 0.4; no labels to learn from,
or one label only: every score is that label's share, as it is if no labelled text has a word. Labels that are null are left out; a null doc_id is not held out.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import map_batches, read, small_batches
from annalist.llm.language import remainder
from annalist.llm.sampling import labelled

#: Bound of the sample that is learned from, in rows a label.
PER_LABEL = 3000
#: Lengths of segments, in words, that learning chooses from, the one it has without a choice, and the rows a label that it tries them on.
SEGMENTS, SEGMENT, TRIAL = (2, 4, 8), 4, 1200
#: bags() makes 17 bits of a hash.
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 17, 16, 12, 0.5
#: Worst segments of a clean and of a toxic document that an epoch learns from: an insult lies in two that overlap.
WORST = {0: 2, 1: 2}
CACHE = 200_000
#: Words whose n-grams are cut at once in learning.
PART = 10_000
#: Bytes of words: ASCII letters in lower case, digits, and bytes beyond ASCII; the rest is a blank.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(WORD).split()


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and of the words themselves, and the number of the word that each belongs to, in order."""
    marked = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(marked)) - begins[owner]
    powers = np.cumprod(np.full(int(sizes.max()), 0x01000193, np.uint32), dtype=np.uint32)
    of, hashes = [np.arange(len(words))], [np.add.reduceat(marked * powers[place], begins, dtype=np.uint32) * np.uint32(0x85EBCA6B)]
    for n in (3, 4, 5):
        inside = np.flatnonzero(place + n <= sizes[owner])
        h = np.full(len(inside), n, np.uint32)
        for i in range(n):
            h = (h ^ marked[inside + i]) * np.uint32(0x01000193)
        of.append(owner[inside])
        hashes.append(h * np.uint32(0x9E3779B1))
    of, found = np.concatenate(of), (np.concatenate(hashes) >> np.uint32(15)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    return found[order], of[order]


def segment_starts(n: int, segment: int) -> np.ndarray:
    """Where the segments of n words begin: every half segment, none of them inside the last one."""
    return np.arange(0, max(1, n - segment // 2), max(1, segment // 2), dtype=np.int32)


def highest(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest value of each stretch."""
    edges = np.stack([begins, ends], 1).reshape(-1)
    return np.maximum.reduceat(np.append(values, -np.inf), edges)[::2]


class Model:
    """The buckets' logits and the softmax's bias; words' logits are cached."""

    def __init__(self, logits: np.ndarray, bias: float, empty: float, segment: int = SEGMENT) -> None:
        self.logits, self.bias, self.empty, self.segment, self.words = logits, bias, empty, segment, {}

    def __reduce__(self):
        return Model, (self.logits, self.bias, self.empty, self.segment)

    def scores(self, texts: list[str | None]) -> list[float]:
        cut = [words_of(t) for t in texts]
        new = set().union(*cut) - self.words.keys()
        if len(self.words) + len(new) > CACHE:
            self.words = {}
            new = set().union(*cut)
        new = list(new)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            found, of = bags(part)
            self.words.update(zip(part, (np.bincount(of, self.logits[found]) / np.bincount(of)).tolist(), strict=True))
        return [self.worst(ws) for ws in cut]

    def worst(self, ws: list[bytes]) -> float:
        if not ws:
            return self.empty
        sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.words.__getitem__, ws), np.float64, len(ws)))])
        starts = segment_starts(len(ws), self.segment)
        ends = np.minimum(starts + self.segment, len(ws))
        means = (sums[ends] - sums[starts]) / (ends - starts)
        return float(1 / (1 + np.exp(-np.clip(means.max() + self.bias, -30, 30))))

    @classmethod
    def chosen(cls, rows: list[tuple[str, int]], segments: tuple[int, ...] = SEGMENTS, trial: int = TRIAL) -> Model:
        """A model whose segments have the length, of those given, that scores best on a quarter of the rows."""
        by_label: dict[int, list] = {}
        for row in sorted(rows, key=lambda r: crc32((r[0] or "").encode())):
            by_label.setdefault(row[1], []).append(row)
        tried = [row for own in by_label.values() for row in own[:trial]]
        seen, rest = ([r for r in tried if (crc32((r[0] or "").encode()) % 4 == 0) == of] for of in (False, True))
        if len(segments) == 1 or len({y for _, y in seen}) < 2 or len({y for _, y in rest}) < 2:
            return cls.fit(rows, segment=segments[len(segments) // 2])
        truth = np.array([y for _, y in rest])

        def loss(segment: int) -> float:
            p = np.clip(cls.fit(seen, segment=segment).scores([t for t, _ in rest]), 1e-6, 1 - 1e-6)
            return sum(float(-np.log(np.where(truth == y, np.where(y, p, 1 - p), 1)).sum() / (truth == y).sum()) for y in (0, 1))

        return cls.fit(rows, segment=min(segments, key=lambda k: (loss(k), k)))

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], seed: int = 3, segment: int = SEGMENT) -> Model:
        share = sum(y for _, y in rows) / max(1, len(rows))
        if not 0 < share < 1:
            return cls(np.zeros(BUCKETS, np.float32), 30.0 if share else -30.0, float(share), segment)
        number: dict[bytes, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t, _ in rows]
        labels = np.array([y for d, (_, y) in zip(docs, rows, strict=True) if len(d)])
        docs = [d for d in docs if len(d)]
        if not docs:
            return cls(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))), min(0.4, share), segment)
        names = list(number)
        flat, sizes = [], []
        for i in range(0, len(names), PART):
            found, of = bags(names[i : i + PART])
            flat.append(found)
            sizes.append(np.bincount(of))
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        begins = np.cumsum(sizes) - sizes
        # All segments of all documents, one after another; bound: where each document's begin.
        starts = [segment_starts(len(d), segment) for d in docs]
        bound = np.cumsum([0] + [len(s) for s in starts])
        offset = np.cumsum([0] + [len(d) for d in docs]).astype(np.int32)
        words = np.concatenate(docs)
        seg = np.concatenate([s + o for s, o in zip(starts, offset, strict=False)])
        ends = np.minimum(seg + np.int32(segment), np.repeat(offset[1:], np.diff(bound)))
        # First guess of a document's worst segment: words by the log-odds of the documents that have them.
        counts = np.zeros((2, len(names)))
        for d, y in zip(docs, labels, strict=True):
            counts[y, np.unique(d)] += 1
        total = np.bincount(labels, minlength=2)
        guess = np.log((counts[1] + 0.5) / (total[1] + 1)) - np.log((counts[0] + 0.5) / (total[0] + 1))
        level = highest(guess[words], seg, ends)
        del docs, number, names, starts, counts, guess

        rng = np.random.default_rng(seed)
        vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)  # a bucket never met says nothing
        soft, bias = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
        grow = np.full(BUCKETS, 1e-6, np.float32)
        for epoch in range(EPOCHS):
            if epoch:
                logit = vectors @ (soft[:, 1] - soft[:, 0])
                sums = np.concatenate([[0.0], np.cumsum((np.add.reduceat(logit[flat], begins) / sizes)[words], dtype=np.float64)])
                level = (sums[ends] - sums[seg]) / (ends - seg)
            taken = np.concatenate([a + np.argsort(-level[a:b], kind="stable")[: WORST[y]] for a, b, y in zip(bound[:-1], bound[1:], labels.tolist(), strict=True)])
            for batch in np.array_split(rng.permutation(taken), max(1, len(taken) // 64)):
                spans = ends[batch] - seg[batch]
                ws = words[np.repeat(seg[batch] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())]
                n = sizes[ws]
                at = flat[np.repeat(begins[ws] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                by = np.repeat((1 / n / np.repeat(spans, spans)).astype(np.float32), n)
                each = np.add.reduceat(n, np.cumsum(spans) - spans)
                edges = np.cumsum(each) - each
                mean = np.add.reduceat(vectors[at] * by[:, None], edges)
                z = mean @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), labels[np.searchsorted(bound, batch, "right") - 1]] -= 1
                back = (p @ soft.T)[np.repeat(np.arange(len(batch)), each)] * by[:, None]
                np.add.at(grow, at, (back * back).sum(1))
                soft -= RATE / 8 * mean.T @ p / len(batch)
                bias -= RATE / 8 * p.mean(0)
                np.subtract.at(vectors, at, RATE * back / np.sqrt(grow[at])[:, None])
        b = float(bias[1] - bias[0])
        return cls(vectors @ (soft[:, 1] - soft[:, 0]), b, min(0.4, 1 / (1 + float(np.exp(-b)))), segment)


def fit(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    return Model.chosen(labelled(documents, labels, "toxic", per_label))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        return {"doc_id": batch.column("doc_id"), "score": shared.value.scores(batch.column("text").to_pylist())}

    return map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, score double")


def reject(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """documents whose score is below the threshold; columns and rows otherwise unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    small_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in shared.value.scores(batch.column(at).to_pylist())], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels.where(remainder(5) != 0)))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
