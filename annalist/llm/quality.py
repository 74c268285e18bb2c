"""Quality by positive-unlabelled learning: non-negative unbiased risk, trusted positives, unlabelled web text.

Trusted positives are rows labelled 1; unlabelled text is a sample of all documents. A first classifier tells positives
from unlabelled text; the class prior is the smallest ratio of the shares of both above a threshold of its score. A
network with one hidden layer then minimises the non-negative unbiased risk (Kiryo et al.) with the logistic loss:
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); where the second part is negative, only it is
ascended. All in numpy. Features are shares of byte classes of the whole text, their extremes over its lines, repeated
lines, and lengths.

Learning uses at most `bound` trusted positives and `bound` unlabelled texts (a documented bound, taken by hashes).

Cases: null and empty texts have all features 0 and score 0; without positives or text to learn from every score is 0.5.
A null doc_id is not held out; null labels are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, map_batches, read
from annalist.llm.language import remainder
from annalist.llm.sampling import labelled, unlabelled

#: Bound of either sample, in rows.
BOUND = 5000
HIDDEN, EPOCHS, RATE = 16, 60, 0.01
#: Byte classes: upper case, lower case, digits, blanks, full stops and commas, other sentence marks, bars and brackets, other marks, beyond ASCII, the rest.
CLASSES = np.full(256, 9, np.uint8)
for _i, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b".,", b"!?;:", b"|<>[]{}()/\\=_", b"#$%&*@^~+", bytes(range(128, 256)))):
    CLASSES[list(_bytes)] = _i
KINDS = 10
FEATURES = 3 * KINDS + 5


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes in the text, their least and largest over lines of 20 bytes or more, repeated lines, lengths."""
    out = np.zeros(FEATURES)
    if not text or not text.strip():
        return out
    kinds = CLASSES[np.frombuffer(text, np.uint8)]
    counts = np.bincount(kinds, minlength=KINDS)
    out[:KINDS] = counts / len(text)
    lines = text.split(b"\n")
    if len(lines) > 1:
        sizes = np.array([len(x) for x in lines])
        ends = np.cumsum(sizes + 1)
        line = np.repeat(np.arange(len(lines)), sizes + 1)[: len(text)]
        table = np.bincount(line * KINDS + kinds, minlength=len(lines) * KINDS).reshape(-1, KINDS)
        table[:-1, 9] -= 1  # the line ends themselves
        long = sizes >= 20
        shares = (table[long] / sizes[long, None]) if long.any() else out[None, :KINDS]
        assert len(ends) == len(lines)
    else:
        shares = out[None, :KINDS]
    out[KINDS : 2 * KINDS], out[2 * KINDS : 3 * KINDS] = shares.min(0), shares.max(0)
    n_words = len(text.split())
    out[3 * KINDS :] = (1 - len(set(lines)) / len(lines), np.log1p(n_words) / 10, min(len(text) / max(1, n_words), 40) / 10, np.log1p(len(lines)) / 10, counts[0] / max(1, counts[0] + counts[1]))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """One hidden layer of tanh over standardised features, by Adam."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w], 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Of standardised rows."""
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """Descends by the risk's derivative for each row's margin."""
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - h * h)
        grads = [x.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ slope + 1e-4 * self.w[2], np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def prior_of(positive: np.ndarray, unlabelled_: np.ndarray) -> float:
    """The class prior: least ratio of unlabelled to positive shares above a threshold that a tenth of the positives pass."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.7, 35))
    ratios = [(unlabelled_ >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.98))


class Model:
    def __init__(self, net: Net | None, prior: float) -> None:
        self.net, self.prior = net, prior

    @classmethod
    def fit(cls, positives: list[str], texts: list[str], seed: int = 5) -> Model:
        if not positives or not texts:
            return cls(None, 0.5)
        p, u = (np.stack([features(t.encode()) for t in x]) for x in (positives, texts))
        both = np.concatenate([p, u])
        mean, scale = both.mean(0), both.std(0) + 1e-3
        rng = np.random.default_rng(seed)

        def train(slopes, seed, p=p, u=u, epochs=EPOCHS):
            net = Net(mean, scale, seed)
            sp, su = net.standard(p), net.standard(u)
            for _ in range(epochs):
                for ip, iu in zip(np.array_split(rng.permutation(len(p)), max(1, len(p) // 256)), np.array_split(rng.permutation(len(u)), max(1, len(p) // 256)), strict=True):
                    xp, xu = sp[ip], su[iu]
                    if len(xp) and len(xu):
                        net.step(np.concatenate([xp, xu]), np.concatenate(slopes(net.margin(xp), net.margin(xu))))
            return net

        def apart(a, b):
            return (sigmoid(a) - 1) / len(a), sigmoid(b) / len(b)

        # Either half is judged by a classifier that has seen the other: one that knows its own positives makes the prior too small.
        seen = [[], []]
        for k in (0, 1):
            net = train(apart, seed, p[k::2], u[k::2], EPOCHS // 3)
            for to, x in zip(seen, (p[1 - k :: 2], u[1 - k :: 2]), strict=True):
                to.append(net.margin(net.standard(x)))
        prior = prior_of(*(np.concatenate(x) for x in seen)) if len(p) > 1 and len(u) > 1 else 0.5

        def risk(a, b):
            """Derivatives of the non-negative risk; log losses of both signs have slopes sigmoid - 1 and sigmoid."""
            negative = np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean()
            if negative >= 0:
                return (prior * (sigmoid(a) - 1) - prior * sigmoid(a)) / len(a), sigmoid(b) / len(b)
            return prior * sigmoid(a) / len(a), -sigmoid(b) / len(b)

        return cls(train(risk, seed + 1), prior)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        x = np.stack([features(t) for t in texts])
        return np.where(x.any(1), sigmoid(self.net.margin(self.net.standard(x))), 0.0)


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Trusted positives are the labels' rows with quality 1; what else the labels say is not used."""
    trusted = [t for t, _ in labelled(documents, labels.where("quality = 1"), "quality", bound)]
    return Model.fit(trusted, unlabelled(documents, bound))


def score(documents: DataFrame, model: Model) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        return {"doc_id": batch.column("doc_id"), "score": shared.value.scores(as_bytes(batch.column("text")))}

    return map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels.where(remainder(4) != 2)))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
