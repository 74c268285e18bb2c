"""Language identification by error-correcting output codes.

Every language has a codeword of signs. One binary classifier per bit, a logistic regression over hashed byte n-grams,
predicts that bit of a text's codeword; all bits are trained together. Decoding is loss-weighted: a language's distance
is the sum over bits of the logistic loss of (its sign x margin), each bit weighted by what its classifier got right in
training. The nearest codeword wins, its score is the softmax of the negated distances, and a text whose two nearest
codewords lie within `ambiguity` of each other is flagged.

Learning uses at most `per_language` rows of each language (a documented bound; rows are taken by a hash of doc_id), the
texts whole, and snippets of a few words of them, so that short texts are known too. Prediction reads the text only.

Cases: `und` with score 0 where the text is null or has no letter, or no language could be learned; one language only:
that language, score 1. Rows with null lang or doc_id are never learned from; a null doc_id counts as not held out.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import map_batches, read

#: Bound of the sample that is learned from, in rows a language.
PER_LANGUAGE = 500
#: Below this difference of mean loss a bit, the two nearest codewords are too close to tell.
AMBIGUITY = 0.15
EPOCHS = 3
#: Bytes of words: ASCII letters in lower case and bytes beyond ASCII; the rest is a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BUCKETS = 1 << 17
LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Places of a text's byte bigrams and hashed trigrams among BUCKETS."""
    b = np.frombuffer(b" " + text.lower().encode().translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    two = two[two != 0x2020]
    three = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])
    three = (three * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return np.concatenate([two, three + np.uint32(BUCKETS >> 1)])


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Occupied buckets and the square roots of their shares: a vector of length 1."""
    counts = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / counts[at].sum()).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of signs. Up to five languages: all ways to split them; more: the best of random codes by least distance."""
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1)) if n > 1 else np.array([0])
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.float32)
    rng, length = np.random.default_rng(seed), max(15, int(np.ceil(8 * np.log2(n))))
    best, least = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(length)], 1)
        apart = ((length - code @ code.T) / 2 + length * np.eye(n)).min()
        if apart > least:
            best, least = code, apart
    return best.astype(np.float32)


class Model:
    """Languages, their codewords, and the bits' classifiers."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], seed: int = 11) -> Model:
        languages = sorted({lang for _, lang in rows})
        n = len(languages)
        code = codewords(max(1, n))
        weights, bias, trust = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1], np.float32)
        if n > 1:
            rng, place = np.random.default_rng(seed), {x: i for i, x in enumerate(languages)}
            data = []
            for text, lang in rows:
                ws = text.split()
                starts = rng.integers(0, max(1, len(ws) - 3), 2)
                for part in (text, *(" ".join(ws[s : s + k]) for s, k in zip(starts, rng.integers(2, 12, 2), strict=True))):
                    if LETTER.search(part):
                        data.append((vector(part), code[place[lang]]))
            size, right, seen = np.full((BUCKETS, 1), 1e-6, np.float32), np.zeros_like(trust), 0
            for epoch in range(EPOCHS):
                for i in rng.permutation(len(data)):
                    (at, x), signs = data[i]
                    margin = x @ weights[at] + bias
                    if epoch == EPOCHS - 1:
                        right, seen = right + (margin * signs > 0), seen + 1
                    slope = -signs / (1 + np.exp(np.clip(signs * margin, -30, 30)))
                    size[at] += (x * x)[:, None]
                    weights[at] -= 2.0 * (x[:, None] / np.sqrt(size[at])) * slope
                    bias -= 0.02 * slope
            trust = np.maximum(right / max(1, seen) - 0.5, 0.01)
            trust /= trust.sum()
        return cls(languages, code, weights, bias, trust)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether it is ambiguous."""
        if not self.languages or text is None or not LETTER.search(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        at, x = vector(text)
        margins = x @ self.weights[at] + self.bias
        loss = np.log1p(np.exp(-np.clip(self.code * margins, -30, 30))) @ self.trust
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]) * len(margins))
        return self.languages[order[0]], float(1 / p.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUITY)


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows (doc_id, text, lang) of train: at most about per_language of each lang, by a hash of doc_id."""
    known = train.where("lang is not null and text is not null and doc_id is not null")
    shares = {r[0]: min(1.0, per_language / r[1]) for r in known.groupBy("lang").count().collect()}
    if not shares:
        return Model.fit([])
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")
    return Model.fit(sorted((r[0], r[1]) for r in taken.collect()))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents' doc_id with lang_pred, score, ambiguous."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id")} | {k: [f[i] for f in found] for i, k in enumerate(("lang_pred", "score", "ambiguous"))}

    return map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def remainder(of: int):
    """crc32(doc_id as text) mod of, null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(4) != 2))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
