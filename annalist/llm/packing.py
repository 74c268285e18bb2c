"""Sum-of-squares online packing of tokenised documents into sequences of a fixed length.

Each document is its token ids and an end id. It is cut into pieces of at most `size` tokens: full pieces are sequences
by themselves, the rest is placed by the sum-of-squares rule (Csirik et al.): among the fill levels that have an open
window with room, and an empty window, take the one that leaves the smallest sum over levels of squared counts of
partially filled windows. A level array holds the counts; the rule needs only the differences of squares of two levels.

Windows stay open over a partition's whole run; at its end the open windows are closed by cutting: the emptiest are
cut freely into pieces that fill the fullest exactly, so that at most one window of a partition is not full. Rows keep
where each id lies; nothing is shuffled, and memory holds the pieces of open windows only, `max_open` windows at most
(then the same closing is applied and packing goes on).

Cases: null or empty text gives one piece with the end id alone. Repeated rows and null doc_ids are packed as they
come. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annalist.llm.common import read, small_batches

SIZE = 4096
END_ID = 2
#: Windows that a task keeps open, and entries of each generation of a worker's two caches of encoded words.
MAX_OPEN = 2048
CACHE = 300_000
#: The pattern by which this vocabulary's tokenizer cuts words, and how it normalises: fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS, PRETOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary has for each byte: itself if it is printable Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def known(path: str) -> bool:
    """Whether a vocabulary file's tokenizer normalises and cuts words as Words does."""
    with open(path, encoding="utf-8") as f:
        of = json.load(f)
    steps = [(of.get(part) or {}).get(name) or [{}] for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    normal, cut = steps
    plain = [x.get("type") for x in normal] == NORMALIZERS and normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " "
    split = [x.get("type") for x in cut] == PRETOKENIZERS and cut[0].get("pattern") == {"Regex": PIECES} and cut[0].get("invert") and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
    return bool(plain and split)


class Words(dict):
    """Ids (little-endian 32-bit) of words between blanks, in two generations of at most CACHE entries each.

    The normaliser lower-cases, composes and makes white space one blank, and no piece crosses a blank: so a text's ids are
    those of its words. Words up to Latin Extended-B are cut into pieces here and go to the merge model itself; all others,
    and any that may hold a special token, go through the whole tokenizer. So do whole texts where the vocabulary file names
    another normaliser or pattern.
    """

    #: A-Z in lower case, line ends as blanks.
    PLAIN = bytes(32 if i == 10 else i + 32 if 65 <= i <= 90 else i for i in range(256))

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.by_word = known(path)
        self.model, self.pieces, self.letters = self.whole.model, regex.compile(PIECES).findall, byte_letters()
        self.parts: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = ({}, {})

    def __call__(self, text: str | None) -> bytes:
        if not self.by_word:
            return np.array(self.whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, (text or "").encode().translate(self.PLAIN).split(b" ")))

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.older[0].get(raw)
        if ids is None:
            ids = self.encode(raw)
        if len(self) >= CACHE:
            self.older = (dict(self), self.older[1])
            self.clear()
        if len(raw) <= 64:
            self[raw] = ids
        return ids

    def encode(self, raw: bytes) -> bytes:
        word = raw.decode()
        if "<|" in word or not word.isprintable() or not raw.isascii() and max(word) > "\u024f":
            ids = self.whole.encode(raw.decode(), add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        word = "".join([c.lower() for c in word]) if not raw.isascii() else word
        return b"".join([self.parts.get(p) or self.part(p) for p in ([word] if word.isalpha() else self.pieces(word))])

    def part(self, piece: str) -> bytes:
        ids = self.older[1].get(piece)
        if ids is None:
            text = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(text)])
        if len(self.parts) >= CACHE:
            self.older = (self.older[0], self.parts)
            self.parts = {}
        if len(piece) <= 64:
            self.parts[piece] = ids
        return ids


class Packer:
    """Sum-of-squares placement of items (any length from 1 to size - 1) into windows of size."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # windows: lists of [length, item]
        self.n_open = 0

    def add(self, length: int, item) -> list | None:
        """The window that is full by this item, if one is."""
        c, size = self.count, self.size
        # Change of the sum of squares if the item goes to level h: -(2c[h] - 1) there, +(2c[h + length] + 1) above.
        top = size - length
        gain = 2 * c[length : size + 1] - 2 * c[: top + 1] + 2
        gain[0] = 2 * c[length] + 1  # a new window; there is no level 0 to leave
        gain[top] = 1 - 2 * c[top]  # a full window leaves the count
        gain[1:][c[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = int(len(gain) - 1 - gain[::-1].argmin())  # ties: the fullest
        if best:
            window = self.open[best].pop()
            c[best] -= 1
        else:
            window = []
            self.n_open += 1
        window.append((length, item))
        level = best + length
        if level == size:
            self.n_open -= 1
            return window
        self.open[level].append(window)
        c[level] += 1
        return None

    def close(self, cut) -> list[list]:
        """All open windows, none open afterwards: the emptiest are cut (by cut(item, length) -> two items) to fill the fullest."""
        left = [(level, w) for level in range(1, self.size) for w in self.open[level]]
        self.__init__(self.size)
        done, low = [], 0
        high = len(left) - 1
        while low < high:
            level, window = left[high]
            room = self.size - level
            while room and low < high:
                at, source = left[low]
                length, item = source.pop()
                if length > room:
                    first, rest = cut(item, room)
                    source.append((length - room, rest))
                    left[low] = (at - room, source)
                    window.append((room, first))
                    room = 0
                else:
                    window.append((length, item))
                    room -= length
                    left[low] = (at - length, source)
                    if not source:
                        low += 1
            if room:  # low met high
                left[high] = (self.size - room, window)
                break
            done.append(window)
            high -= 1
        return done + [w for _, w in left[low : high + 1] if w]


def pack(df: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of df (doc_id, text): where each lies in its document and in its sequence.

    with_ids adds the pieces' ids (array<int>), for a caller that writes the sequences themselves.
    """
    small_batches(df.sparkSession)
    path = tokenizer or vocabulary()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        from pyspark import TaskContext

        words = _words(path)
        packer = Packer(size)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        n = 0
        out: list[tuple] = []

        def cut(item, length):
            doc, start, data, total = item
            return (doc, start, data[: 4 * length], total), (doc, start + length, data[4 * length :], total)

        def emit(window) -> None:
            nonlocal n
            at = 0
            for length, (doc, start, data, total) in window:
                row = (doc, start, length, zlib.crc32(data), total, base + n, at)
                out.append((*row, np.frombuffer(data, "<u4").astype(np.int32)) if with_ids else row)
                at += length
            n += 1

        def rows():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for doc, text in zip(docs, texts, strict=True):
                data = words(text) + end
                total = len(data) // 4
                for start in range(0, total, size):
                    piece = data[4 * start : 4 * (start + size)]
                    item, length = (doc, start, piece, total), len(piece) // 4
                    window = [(length, item)] if length == size else packer.add(length, item)
                    if window:
                        emit(window)
                if packer.n_open >= MAX_OPEN:
                    for window in packer.close(cut):
                        emit(window)
            if out:
                yield rows()
        for window in packer.close(cut):
            emit(window)
        if out:
            yield rows()

    return df.select("doc_id", "text").mapInArrow(run, schema)


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    """One cache of words for a worker's life."""
    if path not in _WORDS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _WORDS[path] = Words(path)
    return _WORDS[path]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
