"""Benchmark decontamination: windows of normalised benchmark words, held as a broadcast hash set, found in whole documents.

Words are maximal runs of digits, ASCII letters (lower-cased) and bytes beyond ASCII. An item's windows are its runs of
`width` consecutive words; an item of fewer words, but not none, is one window of its own length. The set is keyed by a
hash of word numbers; each hit is verified against the window's words themselves, so no collision can mark a word.

The benchmark's size is checked before it is broadcast: up to `broadcast_bytes` of text it goes to every executor as
one set. Beyond, it is split into as many parts of whole items as keep each under that bound, and the documents are
scanned once for each part; what the parts find is joined by row. Either way documents are neither shuffled nor collected.

Cases: a document that is null or has no words has 0 words and no hit. Items that are null or have no words have no
windows. Items with equal windows are all reported. Repeated documents are each scanned. Columns other than doc_id and
text (item_id and text) pass through `decontaminate` unchanged and are otherwise ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, map_batches, read, small_batches, written

WIDTH = 10
#: Bytes of benchmark text that are broadcast as one set.
BROADCAST_BYTES = 32 << 20
#: What separates words is a blank, A-Z is lower case: the contract's classes, as fixed values.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Odd multiplier of the hash of word numbers.
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def fold(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width numbers."""
    n = len(ids) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * STEP + ids[i : i + n]
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of some items: word numbers from 1, and by window length a sorted array of hashes with their windows."""

    def __init__(self, items: list[tuple], width: int) -> None:
        self.numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ws = words_of(text)
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws]
            w = min(width, len(ids))
            for i in range(len(ids) - w + 1 if w else 0):
                found[w][tuple(ids[i : i + w])].add(item)
        self.by_width = {}
        for w, windows in sorted(found.items()):
            keys = list(windows)
            hashes = fold(np.array(keys, np.uint64).reshape(-1), w)[::w]
            by_hash: dict[int, list] = defaultdict(list)
            for h, k in zip(hashes.tolist(), keys, strict=True):
                by_hash[h].append((k, windows[k]))
            self.by_width[w] = (np.unique(hashes), dict(by_hash))

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set]:
        """Number of words, positions of hit words, items found."""
        ws = words_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))
        hit, items = None, set()
        for width, (hashes, windows) in self.by_width.items():
            if len(ids) < width:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(at):
                continue
            own = fold(ids, width)[at]
            at = at[hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own]
            for i in at.tolist():
                run = ids[i : i + width]
                for key, of in windows[int(fold(run, width)[0])]:
                    if tuple(run.tolist()) == key:
                        hit = np.zeros(len(ids), bool) if hit is None else hit
                        hit[i : i + width] = True
                        items |= of
        return len(ids), np.flatnonzero(hit) if hit is not None else np.zeros(0, np.int64), items


def item_sets(benchmark: DataFrame, width: int, broadcast_bytes: int) -> list:
    """Broadcast windows: one set if the benchmark is within the bound, else parts of whole items within it."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // broadcast_bytes))
    sets = []
    for part in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part)
        rows = [(str(r[0]), r[1].encode()) for r in own.distinct().toLocalIterator()]
        sets.append(spark.sparkContext.broadcast(Windows(rows, width)))
    return sets


def find(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hits (array<int>: positions of hit words), items (array<string>: sorted)."""
    sets = item_sets(benchmark, width, broadcast_bytes)

    def one(windows):
        def make(batch):
            out = {"doc_id": batch.column("doc_id"), "n_words": [], "hits": [], "items": []}
            for text in as_bytes(batch.column("text")):
                n, hits, items = windows.value.scan(text)
                out["n_words"].append(n)
                out["hits"].append(hits)
                out["items"].append(sorted(items))
            return out

        return make

    rows = documents.select("doc_id", "text")
    schema = "doc_id bigint, n_words bigint, hits array<bigint>, items array<string>"
    if len(sets) == 1:
        return map_batches(rows, one(sets[0]), schema)

    def more(windows):
        def make(batch):
            out = one(windows)(batch) | {"text": batch.column("text")}
            for name in ("hits", "items"):
                out[name] = [sorted({*old, *new}) for old, new in zip(batch.column(name).to_pylist(), out[name], strict=True)]
            return out

        return make

    rows = rows.selectExpr("*", "0L as n_words", "cast(array() as array<bigint>) as hits", "cast(array() as array<string>) as items")
    for windows in sets:  # one part in memory at a time
        rows = written(map_batches(rows, more(windows), schema + ", text string"), "decontamination")
        windows.unpersist()
    return rows.drop("text")


def decontaminate(documents: DataFrame, benchmark: DataFrame, how: str = "spans", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents without their contaminated rows (how="documents"), or without the hit words of their texts (how="spans").

    Removing spans cuts the bytes from the first to the last word of each run of hit words, and nothing else of the text.
    All other columns stay as they are. Of a benchmark in several parts one is in memory at a time, as in `find`: what each
    part hits in the text as it was is written with the rows, and the cuts are made at the end.
    """
    sets = item_sets(benchmark, width, broadcast_bytes)
    schema, at = documents.schema, documents.columns.index("text")
    small_batches(documents.sparkSession)
    rows = documents.select(F.struct("*").alias("row"), F.array().cast("array<bigint>").alias("hits"))

    def scan(windows):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                texts = as_bytes(batch.column(0).field(at))
                found = [sorted({*old, *windows.value.scan(text)[1].tolist()}) for text, old in zip(texts, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["row", "hits"])

        return run

    for windows in sets[:-1]:
        rows = written(rows.mapInArrow(scan(windows), rows.schema), "decontaminated")
        windows.unpersist()
    last = sets[-1]

    def run(batches):
        import pyarrow as pa

        for batch in scan(last)(batches):
            made, hits = batch.column(0).flatten(), batch.column(1).to_pylist()
            if how == "documents":
                yield pa.RecordBatch.from_arrays(made, names=schema.names).filter(pa.array([not h for h in hits], pa.bool_()))
            else:
                texts = [without(text, set(h)) if h else text for text, h in zip(as_bytes(made[at]), hits, strict=True)]
                made[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(made[at].type)
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return rows.mapInArrow(run, schema)


def without(text: bytes, hits: set[int]) -> bytes:
    """text less the bytes of each run of hit words."""
    import re

    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out, at = [], 0
    for i in sorted(hits):
        if i - 1 not in hits:
            out.append(text[at : places[i][0]])
        at = places[i][1]
    return b"".join([*out, text[at:]])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT d, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT d, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT d, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT d, i, n FROM m)) GROUP BY d),
t AS (SELECT d, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT d, item_id FROM m) GROUP BY d)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (d) LEFT JOIN t USING (d)
"""
