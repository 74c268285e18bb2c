"""Removal of repeated byte strings by a sparse suffix array: splitters, range-partitioned suffixes, multikey quicksort.

A string of LENGTH bytes that starts at two places anywhere is removed at both, judged on the input. Sorting every suffix of
a corpus would shuffle each byte hundreds of times; the suffixes sorted here start at anchors that no repeat can avoid:
of the hashes of all GRAM-byte strings, those that are least in some window of LENGTH - GRAM + 1 of them. Equal strings
of LENGTH bytes hold equal anchors at equal places, and a text has about one anchor in 150 bytes.

1. Anchors that occur once are left out: (hash, text, place) rows meet by hash. Of an anchor that a batch of rows holds more
   than twice two rows go to the meeting, the others are known to be repeated and are dealt by text, so a passage that a
   third of all documents share is no hot key.
2. The others' texts give each anchor's suffix (LENGTH bytes) and what stands before it. Suffixes go to partitions by ranges
   of their leading bytes, by splitters from a bounded sample. Equal contexts within a task are told there and shipped once;
   what is told goes as joined ranges without bytes, dealt by text.
3. A bucket holds all suffixes with its leading bytes, so those that share GRAM bytes never lie on two sides of a boundary.
   They are compared by two, by all pairs of a few, or sorted by multikey quicksort (eight bytes a key), forward and
   backward; common lengths of neighbours then tell those of all pairs or, of more than WIDE, for each split of LENGTH
   around the anchor which contexts share it.
   All comparisons are of the bytes themselves.
4. A text's runs are merged and cut out. Texts that occur more than once are removed whole, and count once in 1 to 3.

With `words`, passages of that many words are found too, in the same steps: the units are then a text's words (apart at
blanks and bytes 9 to 13), in contexts WIDTH bytes of each word's hash, whatever blanks stand between.

Cases: null text is empty; texts shorter than LENGTH keep all bytes. Repeated rows are copies of each other. Null doc_ids are
rows like any other. Columns other than doc_id and text are ignored by `mark`; `remove` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, map_batches, partitions, read, small_batches
from annalist.llm.jaccard import Powers, Runs, bounds, mix, running, runs, totals, word_bounds, word_hashes

LENGTH, GRAM = 400, 100
#: Suffixes of one gram that are compared pair by pair, or by a matrix of common lengths; texts and anchors, and contexts, that a task remembers.
PAIRS, WIDE, SEEN, CONTEXTS = 8, 2048, 1 << 18, 1 << 17
KEYS = ["k1", "k2"]
#: Bytes of a hashed word in contexts, and words whose hashes make a gram; the fewest words of what counts as a passage.
WIDTH, WORD_GRAM, PASSAGE = 6, 12, 51
#: Texts that splitters are sampled from, and the leading bytes that a splitter has.
SAMPLE, LEAD = 4000, 32


class Rule(NamedTuple):
    """What is a repeat: units of it, of a gram, and bytes of a unit in contexts (1: units are bytes, else words)."""

    length: int
    gram: int
    width: int

    def cells(self, text: bytes) -> bytes:
        """What is compared: width bytes for each unit."""
        return text if self.width == 1 else np.ascontiguousarray(word_hashes(text).view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes()


def rules(length: int | None, gram: int, words: int | None) -> list[Rule]:
    """Rules by kind, the lowest bit of places: bytes (0), words (1)."""
    return [Rule(length or 0, gram, 1), Rule(words or 0, min(WORD_GRAM, words or WORD_GRAM), WIDTH)]


def sliding(v: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or largest) of each w neighbours: of a block's rest and the next one's beginning."""
    op, fill = (np.minimum, np.uint64((1 << 64) - 1)) if least else (np.maximum, np.uint64(0))
    n = len(v) - w + 1
    rows = np.concatenate([v, np.full(-len(v) % w, fill)]).reshape(-1, w)
    ahead = op.accumulate(rows, 1).reshape(-1)
    behind = op.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(text: bytes, ruled: list[Rule]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of a text's anchors, by rule: of grams, differences of running sums, those least in a window of them."""
    out = []
    sums = running(text) if any(r.length and len(text) >= (r.length if r.width == 1 else 2 * r.length - 1) for r in ruled) else None
    for length, gram, width in ruled:
        run = sums if width == 1 or sums is None else totals(word_hashes(text, sums))
        if not length or run is None or len(run) <= length:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        v = mix((run[gram:] - run[:-gram]) * Powers.to(len(run))[1][: len(run) - gram])
        w = length - gram + 1
        edge = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, sliding(v, w, True), edge]), w, False) == v)
        out.append((v[at], at))
    return out


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows of equal width: sorted by one key of eight bytes at a time, and only what is still tied by the next."""
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.concatenate([[0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0])])
    for k in range(1, words.shape[1]):
        n = np.bincount(group)
        tied = np.flatnonzero(n[group] > 1)
        if not len(tied):
            break
        sub = np.lexsort((words[order[tied], k], group[tied]))
        order[tied] = order[tied[sub]]
        key = words[order, k]
        new = (group[1:] != group[:-1]) | (key[1:] != key[:-1]) & (n[group[1:]] > 1)
        group = np.concatenate([[0], np.cumsum(new)])
    return order


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of rows a and b."""
    differ = a != b
    return np.where(differ.any(-1), differ.argmax(-1), a.shape[-1])


def sorted_common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and the common length of each with the next."""
    order = multikey_order(rows)
    return order, common(rows[order[1:]], rows[order[:-1]])


def all_common(rows: np.ndarray) -> np.ndarray:
    """Common lengths of all pairs: in sorted order, the least of those of neighbours between them."""
    order, shared = sorted_common(rows)
    g = len(rows)
    upper = np.full((g, g), 1 << 14, np.int16)
    upper[:, 1:] = shared
    upper[np.tri(g, dtype=bool)] = 1 << 14
    np.minimum.accumulate(upper, 1, out=upper)
    out = np.empty((g, g), np.int16)
    out[np.ix_(order, order)] = np.minimum(upper, upper.T)
    return out


def spans(right: np.ndarray, left: np.ndarray, n: np.ndarray, m: np.ndarray, length: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of one gram (and reversed bytes before it, of n and m bytes): units of width bytes before and after the anchor that are repeated; 0, 0 if none."""
    g = len(right)
    if g <= WIDE:
        pairs = (lambda x: common(x[:, None], x[None])) if g <= PAIRS else all_common
        r, ls = (np.minimum(np.minimum(pairs(x), k[:, None]), k) // width for x, k in ((right, n), (left, m)))
        good = (r + ls >= length) & ~np.eye(g, dtype=bool)
        return np.where(good, ls, 0).max(1), np.where(good, r, 0).max(1)
    classes = [(order, shared // width) for order, shared in map(sorted_common, (right, left))]
    before, after = np.zeros(g, np.int64), np.zeros(g, np.int64)
    for back in range(left.shape[1] // width + 1):
        ids = []
        for (order, shared), depth in zip(classes, (length - back, back), strict=True):
            own = np.empty(g, np.int64)
            own[order] = np.concatenate([[0], np.cumsum(shared < depth)])
            ids.append(own)
        fits = np.flatnonzero((m // width >= back) & (n // width >= length - back))
        if len(fits) > 1:
            key = ids[0][fits] * g + ids[1][fits]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            again = np.zeros(len(fits), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            hit = fits[again]
            before[hit] = back
            after[hit] = np.maximum(after[hit], length - back)
    return before, after


def keyed(documents: DataFrame) -> DataFrame:
    """row (a struct of all columns of documents) and two 64-bit hashes of the text: equal where texts are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.struct("*").alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def suspects(rows: DataFrame, ruled: list[Rule]) -> DataFrame:
    """(k1, places) of texts with anchors that occur elsewhere too; a place is twice a unit's number, plus its rule's.

    Texts go by k1 alone here: two texts of one k1 would share their places, which costs comparisons and no result.
    """

    def find(batches):
        import pyarrow as pa

        seen: set = set()
        often = np.zeros(0, np.uint64)
        for batch in batches:
            keys, found = [], []
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if text and name not in seen:
                    seen.add(name)
                    for kind, (hashes, at) in enumerate(anchors(text, ruled)):
                        if len(at):
                            keys.append(name)
                            found.append((hashes, at * 2 + kind))
            if len(seen) > SEEN:
                seen.clear()
            if found:
                hashes, places = (np.concatenate(x) for x in zip(*found, strict=True))
                own = np.repeat(np.array(keys, np.int64), [len(h) for h, _ in found])
                order = np.argsort(hashes, kind="stable")
                starts, ends = bounds(hashes[order])
                told = np.zeros(len(hashes), bool)
                told[order] = np.arange(len(order)) >= np.repeat(starts + 2, ends - starts)  # beyond the first two of a batch
                if len(often):
                    told |= often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
                often = np.union1d(often if len(often) < SEEN else often[:0], hashes[order[starts[ends - starts > 1]]])
                meet = np.where(told, mix(own.view(np.uint64) + places.astype(np.uint64)), hashes)
                yield pa.RecordBatch.from_arrays([pa.array(meet.view(np.int64)), pa.array(own), pa.array(places * 2 + told)], names=columns)

    def repeated(batches):
        import pyarrow as pa

        for meet, (name, place) in runs(batches, [1, 2]):
            order = np.lexsort((place, name, meet))
            meet, name, place = meet[order], name[order], place[order]
            same = meet[1:] == meet[:-1]
            new = np.concatenate([[True], ~same | (name[1:] != name[:-1]) | (place[1:] != place[:-1])])  # copies that several tasks read
            meet, name, place = meet[new], name[new], place[new]
            starts, ends = bounds(meet)
            n = ends - starts
            good = np.repeat(n > 1, n) | (place & 1 == 1)
            yield pa.RecordBatch.from_arrays([pa.array(name[good]), pa.array(place[good] >> 1)], names=columns[1:])

    columns = ["meet", "k1", "place"]
    found = rows.select("k1", "row.text").mapInArrow(find, "meet bigint, k1 bigint, place bigint")
    met = found.repartition(partitions(rows.sparkSession), "meet").sortWithinPartitions("meet")
    return met.mapInArrow(repeated, "k1 bigint, place bigint").groupBy("k1").agg(F.collect_set("place").alias("places"))


def splitters(rows: DataFrame, ruled: list[Rule], sample: int = SAMPLE) -> list[bytes]:
    """Leading bytes that divide suffixes into ranges of about equal size: of the least anchor of about `sample` texts, taken by a hash."""
    n = rows.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))

    def lead(batch):
        found = []
        for text in as_bytes(batch.column(0)):
            for kind, (hashes, at) in enumerate(anchors(text, ruled)):
                if len(at):
                    _, gram, width = ruled[kind]
                    at = int(at[hashes.argmin()]) * width
                    found.append((bytes([kind]) + ruled[kind].cells(text)[at : at + gram * width])[:LEAD])
        return {"lead": found}

    texts = rows.where(F.pmod("k2", F.lit(1 << 30)) < share).select("row.text").where("text is not null")
    found = sorted(r[0] for r in map_batches(texts, lead, "lead binary").collect())
    p = partitions(rows.sparkSession)
    return [bytes(found[i * len(found) // p]) for i in range(1, p)] if found else []


def repeats(texts: DataFrame, ruled: list[Rule], cuts_at: list[bytes]) -> DataFrame:
    """(k1, k2, kind, begin, end) of repeated units around each suspected anchor of texts (k1, k2, row, places); cuts_at: splitters."""
    import pyarrow as pa

    at_text = texts.schema["row"].dataType.names.index("text")
    buckets = len(cuts_at) + 1
    names = ["bucket", "lead", "k1", "k2", "place", "end", "right", "left"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def contexts(batches):
        seen: dict = {}
        out: list[tuple] = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        def told(a, b, kind, begin, end):
            out.append(((a ^ begin) % buckets, None, a, b, begin * 2 + kind, end, None, None))

        for batch in batches:
            k1, k2, places = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for a, b, text, own in zip(k1, k2, as_bytes(batch.column(2).field(at_text)), places, strict=True):
                forms = {kind: ruled[kind].cells(text or b"") for kind in {p & 1 for p in own}}
                ready = [None, None]  # by kind: what is told here of this text, joined where it overlaps
                for p in sorted(own):
                    kind, unit = p & 1, p >> 1
                    length, gram, w = ruled[kind]
                    at, n, g, form = unit * w, length * w, gram * w, forms[kind]
                    right, left = form[at : at + n], form[max(0, at - n + g) : at]
                    if len(right) == n and len(left) == n - g:
                        begin, end = unit - length + gram, unit + length
                        first = seen.setdefault((kind, xxhash.xxh3_128_intdigest(left + right)), [(a, b, kind, begin, end), False])
                        if first[0] != (a, b, kind, begin, end):  # told here: a row without its bytes
                            run = ready[kind]
                            if run and begin <= run[1]:
                                run[1] = end
                            else:
                                if run:
                                    told(a, b, kind, *run)
                                ready[kind] = [begin, end]
                            if not first[1]:
                                told(*first[0])
                                first[1] = True
                            continue
                    lead = bytes([kind]) + right[:g]
                    out.append((bisect_right(cuts_at, lead[:LEAD]), lead, a, b, p, None, right, left))
                for kind, run in enumerate(ready):
                    if run:
                        told(a, b, kind, *run)
                if len(out) > 5000:
                    yield made()
                    out.clear()
                if len(seen) > CONTEXTS:
                    seen.clear()
        if out:
            yield made()

    def compare(batches):
        held = Runs()
        for batch in batches:
            told = batch.column(6).is_null()
            if told.true_count:
                some = batch.filter(told)
                place = some.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(3), pa.array(place & 1), pa.array(place >> 1), some.column(5)], names=found_names)
            rest = batch.filter(pc.invert(told))
            yield from judged(held.add(rest.column(1).to_numpy(zero_copy_only=False), [rest.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 6, 7)]))
        yield from judged(held.rest())

    def judged(complete):
        if not complete:
            return
        lead, (k1, k2, place, rights, lefts) = complete
        # one row for each place, whatever repeated rows and runs of a task gave
        order = np.lexsort((place, k2, k1, np.cumsum(np.concatenate([[True], lead[1:] != lead[:-1]]))))
        same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1]) & (place[order][1:] == place[order][:-1])
        at = order[np.concatenate([[True], ~same])]
        starts, ends = bounds(lead[at])
        many = ends - starts > 1
        for kind, rule in enumerate(ruled):
            own = np.flatnonzero(many & (place[at[starts]] & 1 == kind))
            for part in np.array_split(own, max(1, int((ends - starts)[own].sum()) // 20_000)):
                if len(part):
                    a, b, begin, end = compared(at, starts[part], ends[part], k1, k2, place >> 1, rights, lefts, rule)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, np.full(len(a), kind), begin, end)], names=found_names)

    found_names = ["k1", "k2", "kind", "begin", "end"]
    found = texts.select(*KEYS, "row", "places").mapInArrow(contexts, "bucket int, lead binary, k1 bigint, k2 bigint, place bigint, end bigint, right binary, left binary")
    ranged = found.repartitionById(buckets, "bucket").sortWithinPartitions("lead")
    return ranged.mapInArrow(compare, "k1 bigint, k2 bigint, kind bigint, begin bigint, end bigint")


def compared(at, starts, ends, k1, k2, place, rights, lefts, rule: Rule) -> tuple:
    """Repeated units around the anchors of some groups."""
    length, back = rule.length * rule.width, (rule.length - rule.gram) * rule.width
    rows = np.concatenate([at[a:b] for a, b in zip(starts, ends, strict=True)])
    n, m = (np.array([len(x[i]) for i in rows]) for x in (rights, lefts))
    right = np.frombuffer(b"".join([rights[i].ljust(length, b"\0") for i in rows]), np.uint8).reshape(len(rows), length)
    left = np.frombuffer(b"".join([lefts[i][::-1].ljust(back, b"\0") for i in rows]), np.uint8).reshape(len(rows), back) if back else np.zeros((len(rows), 0), np.uint8)
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    before, after = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    two = begins[sizes == 2]
    if len(two):
        r, ls = (np.minimum(common(x[two], x[two + 1]), np.minimum(k[two], k[two + 1])) // rule.width for x, k in ((right, n), (left, m)))
        good = r + ls >= rule.length
        for i in (two[good], two[good] + 1):
            before[i], after[i] = ls[good], r[good]
    for a, size in zip(begins[sizes > 2], sizes[sizes > 2], strict=True):
        i = slice(a, a + size)
        before[i], after[i] = spans(right[i], left[i], n[i], m[i], rule.length, rule.width)
    hit = np.flatnonzero(after)
    i = rows[hit]
    return k1[i], k2[i], place[i] - before[hit], place[i] + after[hit]


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching intervals."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def marked(documents: DataFrame, length: int | None, gram: int, words: int | None) -> DataFrame:
    """row (a struct of all columns of documents) and cuts, as mark gives them. Readers that take the whole row, as the steps
    here do, let one exchange of the texts serve both of its joins."""
    small_batches(documents.sparkSession)
    ruled = rules(length, gram, words)
    rows = keyed(documents)
    narrow = rows.select("row.doc_id", *KEYS, F.octet_length(F.coalesce("row.text", F.lit(""))).cast("bigint").alias("size")).groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"))
    named = narrow.join(suspects(rows, ruled), "k1").select(*KEYS, "rep", "places")
    own = F.when(F.col("row.doc_id").isNull(), F.col("rep").isNull()).otherwise(F.col("row.doc_id") == F.col("rep"))  # no join key: the exchange is by KEYS
    texts = rows.join(named, KEYS).where(F.coalesce(own, F.lit(False)))
    cuts = repeats(texts, ruled, splitters(rows, ruled)).groupBy(*KEYS).agg(F.collect_list(F.struct("kind", "begin", "end")).alias("cuts"))
    cut = lambda kind: F.array(F.struct(F.lit(kind).cast("bigint").alias("kind"), F.lit(0).cast("bigint").alias("begin"), F.col("size").alias("end")))
    none = F.slice(cut(0), 1, 0)
    whole = F.concat(F.when(F.col("size") >= (length or 0), cut(0)).otherwise(none) if length else none, F.when(F.col("size") >= 2 * words - 1, cut(1)).otherwise(none) if words else none)
    marks = narrow.where("copies > 1").select(*KEYS, whole.alias("whole")).where(F.size("whole") > 0).join(cuts, KEYS, "full").select(*KEYS, F.coalesce("whole", "cuts").alias("cuts"))
    return rows.join(marks, KEYS, "left").select("row", "cuts")


def mark(documents: DataFrame, length: int | None = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """row (a struct of all columns of documents), doc_id, text, and `cuts` (array<struct<kind, begin, end>>: unmerged ranges to remove,
    of bytes (kind 0; none if length is None) or, with words, of words (kind 1); null if none). Read them by `removed` and `passages`."""
    return marked(documents, length, gram, words).select("row", "row.doc_id", "row.text", "cuts")


def each(cuts) -> Iterator[list[dict] | None]:
    """The cuts of one row after the other: those of a whole batch as Python values could be more than a worker holds."""
    return (row.as_py() for row in cuts)


def removed(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges of repeated bytes."""
    return merged([(c["begin"], c["end"]) for c in cuts or () if not c["kind"]])


def passages(text: bytes, cuts: list[dict] | None, words: int) -> list[tuple[int, int, int]]:
    """Maximal repeated passages as (first byte, last byte's end, words)."""
    own = [(c["begin"], c["end"]) for c in cuts or () if c["kind"]]
    starts, ends = word_bounds(text) if own else ((), ())
    return [(int(starts[a]), int(ends[min(b, len(starts)) - 1]), min(b, len(starts)) - a) for a, b in merged(own)] if len(starts) >= words else []


def remove(documents: DataFrame, length: int | None = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """documents with the repeated bytes (and passages of that many words) cut from their texts; a character that is cut into goes whole. Other columns stay."""
    at = documents.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made, texts = batch.column(0).flatten(), []
            for text, c in zip(as_bytes(made[at]), each(batch.column(1)), strict=True):
                if c is not None and text is not None:
                    text = kept(text, merged(removed(c) + [(a, b) for a, b, _ in passages(text, c, words or 0)])).decode(errors="ignore").encode()
                texts.append(text)
            names = [f.name for f in batch.schema.field(0).type]
            made[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(made[at].type)
            yield pa.RecordBatch.from_arrays(made, names=names)

    return marked(documents, length, gram, words).mapInArrow(run, documents.schema)


def kept(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in cut:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, judged by LENGTH bytes, and n_passages, n_passage_words: passages of over 50 words that occur elsewhere too, however few bytes they have."""
    rows = marked(read(spark, sf_dir, "documents").select("doc_id", "text"), LENGTH, GRAM, PASSAGE)

    def make(batch):
        doc_id, texts = batch.column("row").flatten()
        out = {"doc_id": doc_id, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "n_passages": [], "n_passage_words": []}
        for text, cuts in zip(as_bytes(texts), each(batch.column("cuts")), strict=True):
            text = text or b""
            cut, found = removed(cuts), passages(text, cuts, PASSAGE)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(b - a for a, b in cut))
            out["n_spans"].append(len(cut))
            out["kept_sha256"].append(hashlib.sha256(kept(text, cut)).hexdigest())
            out["n_passages"].append(len(found))
            out["n_passage_words"].append(sum(n for _, _, n in found))
        return out

    return map_batches(rows, make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint")
