"""SimHash near-duplicates, searched by a Gray-order hierarchical index.

Fingerprints are computed in Arrow batches, 64 bit counters a document. Two fingerprints that
differ in at most three of 64 bits agree in at least one of four blocks of 16 bits, so each distinct
fingerprint stands in four orders, each time turned so that another block leads. An order is sorted by
Gray rank: those that agree in the leading block are neighbours there, and one cell of the order. Every
cell is searched by the index, whatever its size: runs of neighbours become nodes that hold the bits all
their members share (mask and pattern), nodes of nodes hold what those share, and a search adds up the
differences on the way down and leaves a whole group as soon as they exceed the limit.

A leading block that many distinct fingerprints share is parted into smaller cells: the differing bits lie
in the other 48 bits, of whose four parts one must be equal. Nothing is capped; what is still large after
that is searched by the index in memory of 8 bytes a fingerprint. A cell emits a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.components import connected_components
from corpusmill.plans.durable import Scratch

SEED = 42
#: Leading blocks of the orders, and parts of the other 48 bits, as (lowest bit, width).
BLOCK, PARTS = 16, ((0, 12), (12, 12), (24, 12), (36, 12))
#: Distinct fingerprints with one leading block beyond which they are parted into smaller cells.
CROWDED = 16_384
#: Rows that one index is built over, but for larger cells; places that a search holds at once.
CHUNK, FRONTIER = 32_768, 65_536


def simhash64(raw: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of the lower-cased words of UTF-8 text; 0 where there is no word."""
    words = raw.lower().split() if raw else []  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash64(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_hash"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash): one row for each row of ``docs``, fp the fingerprint as a signed long."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"),
        F.xxhash64("text").alias("text_hash"),
    )
    return narrow.mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long, text_hash long")


# ---- orders and cells


def _bits(x: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def _turned(x: Column, by: int) -> Column:
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _orders(distinct: DataFrame) -> DataFrame:
    """(lead, turned): four rows a fingerprint; lead is the number of the order and its leading block."""
    rows = []
    for k in range(64 // BLOCK):
        turned = _turned(F.col("fp"), BLOCK * k)
        rows.append(F.struct(F.lit(k << BLOCK).bitwiseOR(_bits(turned, 64 - BLOCK, BLOCK)).alias("lead"), turned.alias("turned")))
    return distinct.select(F.explode(F.array(*rows)).alias("r")).select(F.col("r.lead").cast("long").alias("lead"), "r.turned")


def _parted(ordered: DataFrame, crowded: int) -> DataFrame:
    """(lead, part, turned): a lead with more than ``crowded`` fingerprints is parted."""
    many = ordered.groupBy("lead").count().where(F.col("count") > crowded).select("lead", F.lit(True).alias("many"))
    parts = F.array(*[F.lit(i << 16).cast("long").bitwiseOR(_bits(F.col("turned"), *p)) for i, p in enumerate(PARTS)])
    own = F.when(F.col("many"), parts).otherwise(F.array(F.lit(-1).cast("long")))
    return ordered.join(many, "lead", "left").select("lead", F.explode(own).alias("part"), "turned")


def gray_rank(x: Column) -> Column:
    """Position of ``x`` in the Gray sequence, as a signed long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


# ---- the index


class GrayIndex:
    """Hierarchy of masked patterns over fingerprints that stand in cells, each cell sorted by Gray rank."""

    def __init__(self, fps: np.ndarray, cells: np.ndarray | None = None, fan: int = 16):
        self.fan = fan
        cells = np.zeros(len(fps), dtype=np.int64) if cells is None else cells
        mask, pattern, first, last = np.full(len(fps), ~np.uint64(0)), fps, cells, cells
        self.levels = [(mask, pattern, first, last)]
        while len(pattern) > fan:
            heads = np.arange(0, len(pattern), fan)
            lead = np.repeat(pattern[heads], np.diff(np.append(heads, len(pattern))))
            mask = np.bitwise_and.reduceat(mask, heads) & ~np.bitwise_or.reduceat(pattern ^ lead, heads)
            pattern, first = pattern[heads] & mask, first[heads]
            last = last[np.append(heads[1:], len(last)) - 1]
            self.levels.append((mask, pattern, first, last))

    def search(self, at: np.ndarray, limit: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position asked, later position of its cell) of fingerprints that differ in at most ``limit`` bits.

        The pairs come in pieces: a search never holds more than some times ``frontier`` places.
        """
        top, n_top = len(self.levels) - 1, len(self.levels[-1][1])
        step = max(1, frontier // max(1, n_top))
        for lo in range(0, len(at), step):
            own = at[lo : lo + step]
            q, node = np.repeat(own, n_top), np.tile(np.arange(n_top), len(own))
            todo = [(top, q, node, np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.uint64))]
            while todo:
                depth, q, node, differing, above = self._near(*todo.pop(), limit)
                if depth == 0 and len(q):
                    yield q, node
                elif depth:
                    for lo_ in range(0, len(q), frontier):
                        todo.append(self._below(depth, *(x[lo_ : lo_ + frontier] for x in (q, node, differing, above))))

    def _near(self, depth: int, q: np.ndarray, node: np.ndarray, differing: np.ndarray, above: np.ndarray, limit: int) -> tuple:
        """What is left of the places (query, node), with the differences added up and the bits they stand for."""
        fps, cells = self.levels[0][1:3]
        mask, pattern, first, last = self.levels[depth]
        # of the query's own cell, and not wholly before it
        may = (first[node] <= cells[q]) & (cells[q] <= last[node]) & ((node + 1) * self.fan**depth - 1 > q)
        q, node, differing, above = q[may], node[may], differing[may], above[may]
        differing = differing + np.bitwise_count((fps[q] ^ pattern[node]) & mask[node] & ~above)
        near = differing <= limit  # else the whole group is left
        q, node, differing = q[near], node[near], differing[near]
        return depth, q, node, differing, mask[node]

    def _below(self, depth: int, q: np.ndarray, node: np.ndarray, differing: np.ndarray, above: np.ndarray) -> tuple:
        """The places of all members of the nodes."""
        counts = np.minimum(self.fan, len(self.levels[depth - 1][1]) - node * self.fan)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return (depth - 1, np.repeat(q, counts), np.repeat(node * self.fan, counts) + step, np.repeat(differing, counts), np.repeat(above, counts))


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of linked positions; a class is labelled with its least position."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
    return labels


def cell_links(cells: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (linked, representative) within each run of equal ``cells`` numbers, found by one index."""
    labels = np.arange(len(fps))
    asks = np.flatnonzero(np.bincount(cells, minlength=1)[cells] > 1)  # alone in its cell: no pair
    for q, found in GrayIndex(fps, cells).search(asks, limit):
        labels = _join(labels, q, found)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return moved, labels[moved]


def _links(limit: int, chunk: int):
    """Rows (lead, part, turned) in the order of cells and Gray ranks -> links; a cell is never cut."""

    def linked(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        cells = np.cumsum(np.append(0, np.any(rows[1:, :2] != rows[:-1, :2], axis=1)))
        turned, by = np.ascontiguousarray(rows[:, 2]).view(np.uint64), (BLOCK * (rows[:, 0] >> BLOCK)).astype(np.uint64)
        fps = (turned >> by) | (turned << ((np.uint64(64) - by) & np.uint64(63)))
        ends = [pa.array(fps[i].view(np.int64)) for i in cell_links(cells, turned, limit)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy() for i in range(3)])
            if not len(rows):
                continue
            if sum(map(len, kept)) >= chunk:
                same = np.all(rows[:, :2] == kept[-1][-1, :2], axis=1)
                more = len(rows) if same.all() else int(np.argmin(same))  # rows of the last cell
                kept.append(rows[:more])
                if more < len(rows):
                    yield linked(kept)
                    kept = [rows[more:]]
            else:
                kept.append(rows)
        if kept:
            yield linked(kept)

    return run


def near_links(distinct: DataFrame, limit: int = 3, crowded: int = CROWDED, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join all fingerprints of (fp) within ``limit`` <= 3 bits, directly or by others."""
    if not 0 <= limit <= 3:
        raise ValueError("four blocks find at most three differing bits")
    ordered = _parted(_orders(distinct), crowded).withColumn("gray", gray_rank(F.col("turned")))
    dealt = ordered.repartition("lead", "part").sortWithinPartitions("lead", "part", "gray")
    return dealt.select("lead", "part", "turned").mapInArrow(_links(limit, chunk), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, text_hash, component_id, component_fp.

    component_id is the smallest doc_id among all rows that can be reached by links of fingerprints
    within ``limit`` bits, component_fp the fingerprint that stands for the component inside.
    Null and empty texts have fingerprint 0 and are linked like any other; rows that repeat a
    doc_id each get a row; a null doc_id is never a component_id unless its component has no other.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, shingle), "fingerprints")
    by_fp = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(by_fp.select("fp"), limit), scratch)
    placed = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component_fp")
    )
    least = placed.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    classes = scratch.save(placed.join(least, "component_fp").select("fp", "component_fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "text_hash", "component_id", "component_fp")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but one document of each near-duplicate component.

    The document with the smallest doc_id stays (nulls last; of rows with that doc_id the one with
    the smallest text hash), in one row even if the row repeats. Columns are those of ``docs``, whatever
    their names.
    """
    found = near_duplicates(docs, shingle, limit)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    stay = found.groupBy("component_fp").agg(F.min(rank).alias("r")).select("r.i", "r.h")
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own = own.withColumns({"own_id": doc_id.cast("long"), "own_hash": F.xxhash64(text)})
    kept = own.join(stay, F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_hash") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_hash"]).select(*names).toDF(*docs.columns)
