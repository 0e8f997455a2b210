"""Near-duplicates by the Jaccard similarity of five-word shingles, for stages without a contract of their own.

SimHash comes first: fingerprints of the distinct shingle sets are searched by the Gray-order index of ``simhash``,
and sets within its three bits are tested. Sets of similarity 0.8 differ in about ten of 64 bits, and a search that
wide meets unrelated texts; so MinHash says which sets may have further partners: those that share one of 32 keys
of five rows with any other set. Two sets of similarity 0.8 share none once in about 300,000 times (computed:
(1 - 0.8^5)^32). All those sets are joined exactly, whatever keys they share and however many share a key:
shingles stand in one order, rarest first, and two sets of the similarity have a shingle in common among the first
of both (prefix filter). Every link, of either search, is the exact similarity of two sets.

Pairs that share such a shingle are left out only if a bound rules the similarity out (by places of the shingle, or by
the parities of the sets' hashes, whose differing bits are differing shingles) or if their sets are in one component
already. Where a shingle has many sets, each is first tested with a few centres of it, so that groups of copies
become components; then all pairs that are left are tested. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.simhash import near_links
from corpusmill.operators.components import connected_components, with_value
from corpusmill.plans.batches import bound_batches
from corpusmill.plans.durable import Scratch

SEED = 42
SHINGLE, BANDS, ROWS = 5, 32, 5
#: Least similarity in per cent.
LEAST_PERCENT = 80
#: Longs that hold the parities of a set's hashes.
PARITY = 8
#: Pairs for each row of a prefix that are few enough to test them all at once; centres of a shingle in one round.
FEW, CENTRES = 8, 4

_rng = np.random.default_rng(SEED)
_HASHES = BANDS * ROWS
_FACTORS = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def shingle_set(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 text, its words lower-cased; a shorter text is one shingle."""
    words = raw.lower().split() if raw else []  # bytes: A-Z only, and ASCII white space only
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)] if words else []
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def fingerprint(s: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes of a shingle set; signed."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(s), 65536):
        ones += np.unpackbits(s[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def band_keys(s: np.ndarray) -> np.ndarray:
    """The keys of a shingle set, one a band."""
    least = np.full(_HASHES, ~np.uint64(0))
    for at in range(0, len(s), 512):
        h = s[at : at + 512, None] * _FACTORS + _OFFSETS
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(bands)], dtype=np.uint64)


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the hashes that fall on i: where two sets differ in d hashes, theirs differ in d bits at most."""
    at = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    odd = np.bincount((at % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x.as_py()) for x in b.column(1)]
        own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        keys = [band_keys(s).view(np.int64) if len(s) else np.empty(0, dtype=np.int64) for s in sets]
        counts, fps = pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(own), counts, fps, pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "node", "n", "fp", "keys"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x.as_py()) for x in b.column(1)]
        columns = [b.column(0), *(pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), parities))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "s", "odd"])


def _pick(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` as columns c0, c1 ... with the columns of ``chosen`` (i, h, ...) for its doc_id and text hash, one row each."""
    # the keys of the join are those of the last step too, so that texts are shuffled once
    keys = ["_id", "_null", "_hash"]

    def keyed(df: DataFrame, i, h) -> DataFrame:
        i = i.cast("long")
        return df.withColumns({"_id": F.coalesce(i, F.lit(0)), "_null": i.isNull(), "_hash": h})

    names = [f"c{k}" for k in range(len(docs.columns))]  # no name can clash inside
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own, other = keyed(docs.toDF(*names), doc_id, F.xxhash64(text)), keyed(chosen, F.col("i"), F.col("h")).drop("i", "h")
    return own.join(other, keys).dropDuplicates(keys).drop(*keys)


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    common = F.size(F.array_intersect("sa", "sb"))
    similar = 100 * common >= LEAST_PERCENT * (F.size("sa") + F.size("sb") - common)
    return pairs.join(b, "b").join(a, "a").where(similar).select("a", "b")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, node, n, at, odd): the rarest shingles of each set that others have too, at: how many of the set are rarer.

    As many as it takes: two sets of the similarity have one of them in common.
    """
    each = sets.select("node", F.explode("s").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # a shingle of one set comes before all others: its place is known without moving it
    ordered = with_value(each, counts, ["key"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("o"))
    n = F.size("s")
    placed = sets.join(ordered, "node").select("node", "odd", n.alias("n"), (n - F.size("o")).alias("single"), "o")
    length = F.col("n") - F.ceil(F.col("n") * LEAST_PERCENT / 100).cast("int") + 1
    placed = placed.withColumn("o", F.slice("o", 1, F.greatest(length - F.col("single"), F.lit(0))))
    return placed.select("node", "n", "odd", "single", F.posexplode("o").alias("j", "x")).select(
        F.col("x.key").alias("key"), "node", "n", (F.col("single") + F.col("j")).alias("at"), "odd"
    )


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of rows (key, node, n, at, odd, label) that share a key, are in two components and may have the similarity."""
    once = F.col("node") < F.col("node_") if left is right else F.lit(True)
    other = right.select("key", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "at", "odd", "label")))
    both = F.col("n") + F.col("n_")
    # of the first shingle in common: so many can be in common at most
    enough = (100 + LEAST_PERCENT) * F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_")) >= LEAST_PERCENT * both
    differing = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd_")[i])) for i in range(PARITY)), F.lit(0))
    near = (100 + LEAST_PERCENT) * differing <= (100 - LEAST_PERCENT) * both
    met = left.join(other, "key").where((F.col("label") != F.col("label_")) & once & enough & near)
    return met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def _centres(met: DataFrame, k: int) -> DataFrame:
    """Some rows of each key, by a hash of their node and the round."""
    own = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "at", "odd", "label")
    part = F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(CENTRES)).alias("part")
    return met.groupBy("key", part).agg(F.min(own).alias("m")).select("key", "m.node", "m.n", "m.at", "m.odd", "m.label")


def _within_bits(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked by the Gray-order index, each with one other of its class."""
    filled = distinct.where("n > 0")
    by_fp = scratch.save(filled.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = filled.join(by_fp, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    one, other = (by_fp.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}")) for x in ("a", "b"))
    near = near_links(by_fp.select("fp")).join(one, "a").join(other, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    pairs = equal.unionByName(near).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, least, root): each distinct set, its first document and its component."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("text_hash")
    )
    marked = scratch.save(
        narrow.mapInArrow(_signature_batches, "doc_id long, text_hash long, node long, n long, fp long, keys array<long>"), "marked"
    )
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    distinct = scratch.save(
        marked.groupBy("node").agg(F.min(rank).alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "keys"))), "distinct"
    )
    scratch.drop("marked")
    routed = distinct.select("node", F.explode("keys").alias("key"))
    busy = routed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    close = scratch.save(_within_bits(distinct, scratch), "close")
    nodes = with_value(routed, busy, ["key"]).select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    asked = distinct.join(nodes, "node").select("least.i", "least.h", "node")
    texts = _pick(docs.select("doc_id", "text"), asked).select("node", F.col("c1").cast("binary").alias("raw"))
    sets = scratch.save(texts.mapInArrow(_set_batches, "node long, s array<long>, odd array<long>"), "sets")

    met = scratch.save(_prefixes(sets).withColumn("label", F.col("node")), "met_0")
    links, before, k = None, None, 0
    while True:
        sizes = met.groupBy("key", "label").agg(F.count("*").alias("c"))
        sizes = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"))
        left, rows = sizes.agg(F.sum((F.col("c") * F.col("c") - F.col("same")) / 2), F.sum("c")).first()
        left, rows = left or 0, rows or 0
        if k and not left:
            break
        # centres as long as a round of them leaves half the pairs at most; then all that are left
        last = left <= FEW * rows or (before is not None and 2 * left > before)
        pairs = _pairs(met, met if last else _centres(met, k))
        pairs = pairs if k else pairs.unionByName(close).distinct()
        found = scratch.save(_tested(pairs, sets), f"links_{k}")
        links = links.unionByName(found) if k else found
        roots = connected_components(links, scratch, f"components_{k}")
        if last:
            break
        # keys whose sets are all in one component are done
        now = met.drop("label").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        open_keys = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        met = scratch.save(with_value(now, open_keys, ["key"]), f"met_{k + 1}")
        scratch.drop(f"met_{k}")
        before, k = left, k + 1
    placed = distinct.select("node", "least")
    return placed.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of each near-duplicate component.

    Texts are linked if the sets of their five-word shingles (words lower-cased, split at ASCII white space)
    have a Jaccard similarity of 0.8 or more; texts with equal sets, null and empty ones included, are copies.
    The document with the smallest doc_id stays (nulls last; of rows with that doc_id the one with the
    smallest text hash), in one row even if the row repeats. Columns are those of ``docs``.
    """
    placed = _components(docs, Scratch(docs.sparkSession, "near"))
    stay = placed.groupBy("root").agg(F.min("least").alias("r")).select("r.i", "r.h")
    return _pick(docs, stay).toDF(*docs.columns)
