"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Executors tokenise whole texts and cut documents longer than a sequence. What the packing decides
depends on lengths alone, so the driver gets one count for each length, never a row for each
document, and runs best-fit decreasing over them: bins of equal remaining capacity are alike and are
kept as runs, and a segment tree over the capacities finds the tightest one that holds a length in
logarithmic time. Pieces of one length are numbered across the cluster by two-level sums, and each
looks up its run.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.llm.prefix_sums import with_sum_before
from corpusmill.plans.batches import bound_batches
from corpusmill.plans.durable import Scratch

LENGTH, END_ID = 2048, 0
#: Letters that stay one letter when composed.
_LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß"
_PLAIN = frozenset(_LOWER + "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NOT_LOWER = str.maketrans("", "", _LOWER)
#: Byte-level models name a byte by its Latin-1 sign; those without a visible one come from 256 on.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(_UNSEEN)}


class ChunkTokenizer:
    """Ids of whole UTF-8 texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern never crosses white space and its normaliser keeps what lies between,
    so a text's ids are those of its chunks. It also parts a plain letter from a comma or full stop
    and lower-cases, so a chunk may be had from another one; a word of plain small letters is one
    word of the model. Chunks are kept up to ``keep`` of them.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each task
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.model = self.tokenizer.model
        self.marks = {"": b"", **{x: self._encode(x) for x in ",."}}

    def _encode(self, chunk: str) -> bytes:
        if chunk.translate(_NOT_LOWER):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(_BYTE_NAMES))]
        return array("I", ids).tobytes()  # 4 bytes each, lowest first: asserted below

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        for chunk in new:
            stem, mark = chunk.decode("utf-8", "replace"), ""
            if len(stem) > 1 and stem[-1] in ",." and stem[-2] in _PLAIN:
                stem, mark = stem[:-1], stem[-1]
            if stem.isascii() and stem.isalpha():
                stem = stem.lower()
            key = stem.encode()
            if (own := known.get(key)) is None:
                own = known[key] = self._encode(stem)
            known[chunk] = own + self.marks[mark]

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for text in texts:
            if len(self.known) > self.keep:
                self.known.clear()
            chunks = text.split() if text else []  # bytes: at ASCII white space only
            new = set(chunks).difference(self.known)
            if new:
                self._learn(new)
            yield b"".join(map(self.known.__getitem__, chunks))


assert array("I", [1]).tobytes() == b"\1\0\0\0"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def _piece_batches(path: str, length: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[lo : lo + 4 * length]
                        rows.append((doc_id, piece, lo // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
                lists = [None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lists, pa.list_(pa.int32()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def tokenise(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the pieces of every document.

    A document is the ids of its whole text (null: none), then ``end_id``; one longer than ``length`` is
    cut into pieces of ``length``, of which the last may be shorter. ids is null unless ``keep_ids``.
    """
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return narrow.mapInArrow(_piece_batches(vocabulary, length, end_id, keep_ids), schema)


class CapacityTree:
    """Segment tree over capacities 0..size: which of them open bins have."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.some = bytearray(2 * self.width)

    def mark(self, capacity: int, some: bool) -> None:
        i = capacity + self.width
        self.some[i] = some
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity that is ``least`` or more."""
        i = least + self.width
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = LENGTH) -> np.ndarray:
    """Placements of ``counts`` {length: how many}: rows (length, first, how many, bin, in a bin, offset).

    Row r puts items first .. first + how many - 1 of its length into bins from ``bin`` on, ``in a bin``
    to each, the first at ``offset``. Lengths go in from the largest; each item goes to the open bin
    with the least room that still holds it, or opens a bin. Bins with equal room are filled in turn,
    which is what item-by-item best fit does. The number of rows depends on the lengths, not on the
    number of items.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining room -> (first bin, bins)
    tree, bins, out = CapacityTree(capacity), 0, []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not runs[room]:
                tree.mark(room, True)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, at, full * each, first, each, capacity - room))
                add(room - each * length, first, full)
                at, left = at + full * each, left - full * each
            rest = n - full
            if rest and left:  # fewer than one bin takes
                out.append((length, at, left, first + full, left, capacity - room))
                add(room - left * length, first + full, 1)
                at, left, full, rest = at + left, 0, full + 1, rest - 1
            add(room, first + full, rest)
    return np.array(out, dtype=np.int64).reshape(-1, 6)


def _place_batches(plan: np.ndarray):
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    rows = plan[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = rows[:, 0]
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            lo, hi = np.searchsorted(lengths, length), np.searchsorted(lengths, length, side="right")
            while np.any(hi - lo > 1):  # the last row of the length that starts at or before the number
                mid = (lo + hi) // 2
                below = (rows[mid, 1] <= number) & (hi - lo > 1)
                lo, hi = np.where(below, mid, lo), np.where(below | (hi - lo <= 1), hi, mid)
            own = rows[lo] if len(rows) else np.zeros((0, 6), np.int64)
            step = number - own[:, 1]
            names = [c for c in b.schema.names if c != "number"]
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            columns += [pa.array(own[:, 3] + step // own[:, 4]), pa.array(own[:, 5] + step % own[:, 4] * own[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = True, stretch: int = 8192) -> DataFrame:
    """Every piece of every row of ``docs`` with its place: sequence_id, and offset, gapless from 0.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where ``keep_ids``.
    Null and empty texts are one piece that holds ``end_id``. Rows that repeat a doc_id are packed as
    documents of their own. Other columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = tokenise(docs, vocabulary, length, end_id, keep_ids)
    # a number of its own for each row, written with it: pieces that are alike in all else spread over stretches too
    pieces = scratch.save((pieces if keep_ids else pieces.drop("ids")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``length`` rows at most
    plan = best_fit_decreasing(counts, length)
    # number the pieces of each length: by hash into stretches, then in and across stretches
    dealt = max(1, sum(counts.values()) // stretch)
    rows = pieces.withColumn("stretch", F.pmod(F.xxhash64("row"), F.lit(dealt)).cast("int"))
    sums = with_sum_before(rows.groupBy("length", "stretch").agg(F.count("*").alias("n")), ["length"], "stretch", F.col("n"), "before")
    inside = Window.partitionBy("length", "stretch").orderBy("row")
    numbered = (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(sums.select("length", "stretch", "before"), ["length", "stretch"])
        .withColumn("number", F.col("before") + F.col("at")).select(*pieces.drop("row").columns, "number")
    )
    schema = ", ".join(f"{n} {t}" for n, t in pieces.drop("row").dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(_place_batches(plan), schema)
