"""Periodic runs of words, by bit-parallel lags over big integers.

A run is a stretch of consecutive words in which words q apart are identical, q being its smallest period, of at least
max(least, exponent * q) words, that no neighbouring word extends. The word ids of a text are written as bit planes, each
one big integer with a bit for each word. For a lag q every plane is XORed with itself shifted by q and the mismatches are
ORed: zero bits are words equal to the one q further on. Shift-doubling AND of the matches leaves the places at which a
zero stretch of the wanted length starts; its blocks are the runs. A lag that leaves nothing after its first planes, or
after the first doublings, ends there: almost all do. A stretch whose period is a multiple of a shorter run's over the same
words is that run and not another.

Texts of more than LONG words have too many lags for that. There a lag is tried first at every q-th word: a run of four
periods holds three neighbouring multiples of q at which words q apart are equal, so that a lag without any has no run
(n/q comparisons a lag, n log n in all), and places well inside a run whose period divides q show nothing new. Either
way all runs are found, in texts of any length.

Every text is looked at by itself: nothing is shuffled, and memory is that of one Arrow batch and one text's planes.

Cases: null or empty text, and text of white space only, has no words and no run; `collapse` leaves null texts null. Repeated
rows are looked at one by one. Words are compared byte for byte. Null ids pass through. Other columns pass through
`collapse` unchanged, whatever their names; `find` returns doc_id and its own columns. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annalist.llm.common import as_bytes, map_batches, read, small_batches

LEAST, EXPONENT = 6, 4
#: Words of a text from which on lags are tried at every q-th word first, and planes that are ORed before the first doublings.
LONG, FIRST = 2000, 4


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, in the order in which they first occur."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane b holds bit b of each id, the first word in the lowest bit."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(top)]


def stretches(matches: int, length: int) -> int:
    """A bit for each place at which at least `length` set bits of matches start."""
    have = 1
    while have < length and matches:
        step = min(have, length - have)
        matches &= matches >> step
        have += step
    return matches


def places(bits: int) -> np.ndarray:
    """The numbers of the set bits, ascending."""
    raw = bits.to_bytes(bits.bit_length() // 8 + 1, "little")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))


class Known:
    """Runs found so far: whether a place is well inside one whose period divides a lag."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []
        self.arrays = np.zeros((0, 3), np.int64)

    def add(self, rows: list[tuple[int, int, int]]) -> None:
        self.rows += rows
        self.arrays = np.array(sorted(self.rows), np.int64)

    def holds(self, at: np.ndarray, q: int) -> np.ndarray:
        """For each place: whether at to at + q lies in such a run. What has period q and that overlap has the shorter one."""
        of = self.arrays[q % self.arrays[:, 2] == 0] if len(self.arrays) else self.arrays
        if not len(of):
            return np.zeros(len(at), bool)
        reach = np.maximum.accumulate(of[:, 0] + of[:, 1])
        before = np.searchsorted(of[:, 0], at, "right") - 1
        return (before >= 0) & (reach[np.maximum(before, 0)] >= at + q)


def runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start and then period. exponent is at least 4."""
    n = len(words)
    if n < least:
        return []
    ids = word_ids(words)
    planes, known = bit_planes(ids), Known()
    every = (1 << n) - 1
    for q in range(1, n // exponent + 1):
        if n > LONG and not sampled(ids, q, known):
            continue
        want = max(least, exponent * q) - q
        inside = every >> q
        mismatch = 0
        for plane in planes[:FIRST]:
            mismatch |= plane ^ plane >> q
        found = stretches(inside & ~mismatch, want)
        if found and len(planes) > FIRST:
            for plane in planes[FIRST:]:
                mismatch |= plane ^ plane >> q
            found = stretches(inside & ~mismatch, want)
        if found:
            first, last = places(found & ~(found << 1)), places(found & ~(found >> 1))
            own = [(s, e - s + want + q, q) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
            same = {(s, m) for s, m, p in known.rows if q % p == 0}
            known.add([r for r in own if r[:2] not in same])
    return sorted(known.rows)


def sampled(ids: np.ndarray, q: int, known: Known) -> bool:
    """Whether three neighbouring multiples of q have words that equal those q further on, and no run found explains all of these."""
    every = ids[::q]
    match = every[:-1] == every[1:]
    at = np.flatnonzero(match[:-2] & match[1:-1] & match[2:]) * q
    return bool(len(at)) and not known.holds(at, q).all()


def repeated(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of n words: whether a run holds it after the run's first period."""
    out = np.zeros(n, bool)
    for start, length, period in found:
        out[start + period : start + length] = True
    return out


def find(df: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n_words and the runs of the text by start, then period."""

    def make(batch):
        texts = [(t or b"").split() for t in as_bytes(batch.column("text"))]
        found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs(ws, least, exponent)] for ws in texts]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(ws) for ws in texts], "runs": found}

    return map_batches(df.select("doc_id", "text"), make, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>")


def collapse(df: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """df with every run cut down to its first period; texts with a run have their kept words joined by one blank, others stay as they are."""
    small_batches(df.sparkSession)
    at = df.columns.index("text")

    def one(text: bytes | None) -> bytes | None:
        words = (text or b"").split()
        found = runs(words, least, exponent)
        return b" ".join(w for w, gone in zip(words, repeated(len(words), found), strict=True) if not gone) if found else text

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([one(t) for t in as_bytes(columns[at])], pa.large_binary()).cast(pa.large_string()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the period that the contract of op13 writes into every tenth document, by a checksum of its id; none without an id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text with the planted periods, and digests of the runs and of the text without what they repeat."""

    def make(batch):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows = [digest(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True)]
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    return map_batches(read(spark, sf_dir, "documents").select("doc_id", "text"), make, SCHEMA)


def digest(doc_id: int | None, text: bytes | None) -> tuple:
    words = planted(doc_id, (text or b"").split())
    found = runs(words)
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    said = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = b" ".join([w for w, gone in zip(words, repeated(len(words), found).tolist(), strict=True) if not gone])
    return doc_id, len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
