"""Quality rules: counts of each text, and lines that too many documents of one host share.

Each text is read twice. First the hashes of its distinct normalised lines are taken, and distinct
documents are counted for each host and line with map-side combine. Lines above the limit are the
host's boilerplate: they are removed from the texts. A document that keeps too little is depleted and
rejected. The limit is a number of documents, so it means the same for a host of any size.

The removal needs each host's lines beside its texts. Up to ``SENT_LINES`` of them are sent to the workers;
beyond, lines are matched by hash, and each text is joined with those of its own lines that are boilerplate.
Both ways remove the same lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.durable import Scratch

#: A document fails with fewer words, or with a larger share of its words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate in a host if so many of its documents hold it.
MIN_LINE_DOCS = 5
#: A document is depleted if fewer than MIN_WORDS words, or a smaller share of its words, are left without boilerplate.
MIN_LEFT_SHARE = 0.3
#: Boilerplate lines (16 bytes and a host each) that are sent to every worker at most.
SENT_LINES = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeat_words(words: list[str], window: int = 3) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == len(words):
        return 0
    if len(ids) < 1 << 21:  # three ids fit 63 bits
        keys = seq[:n]
        for k in range(1, window):
            keys = keys * len(ids) + seq[k : n + k]
        _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[place] > 1
    else:
        tally = Counter(zip(*(seq[k : n + k].tolist() for k in range(window)), strict=True))
        again = np.fromiter((tally[x] > 1 for x in zip(*(seq[k : n + k].tolist() for k in range(window)), strict=True)), bool, n)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : n + k] |= again
    return int(covered.sum())


def _line_key(words: list[str]) -> int:
    digest = xxhash.xxh64_intdigest(" ".join(words).translate(_LOWER).encode("utf-8", "surrogatepass"))
    return digest - (1 << 63)


def line_keys(text: str) -> list[int]:
    """Hashes of the distinct normalised lines."""
    return list({_line_key(own): None for line in text.split("\n") if (own := _WORD.findall(line))})


def without_lines(text: str, keys: set[int]) -> str:
    """``text`` without the lines whose normalised form has a hash in ``keys``."""
    lines = text.split("\n")
    stay = [line for line in lines if not ((own := _WORD.findall(line)) and _line_key(own) in keys)]
    return text if len(stay) == len(lines) else "\n".join(stay)


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), n_dup, repeat_words(words)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = pa.array([line_keys(x.as_py() or "") for x in b.column(2)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lines], names=["doc", "host_key", "lines"])


def _clean_batches(sent=None):
    """Texts without boilerplate: the lines sent by host, or else those of the row's own column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            if sent is None:
                keys = [set(x) if x else () for x in b.column(3).to_pylist()]
            else:
                keys = [sent.value.get(h, ()) for h in b.column(3).to_pylist()]
            clean = [without_lines(t, k) if t and k else t for t, k in zip(texts, keys, strict=True)]
            got = [text_counts(t or "") for t in texts]
            left = [len(_WORD.findall(t)) if t else 0 for t in clean]
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
            columns += [pa.array(left, pa.int64()), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "host", *_COUNTS, "left_words", "text"])

    return run


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    min_line_docs: int = MIN_LINE_DOCS,
    min_left_share: float = MIN_LEFT_SHARE,
    min_left_words: int = MIN_WORDS,
    sent_lines: int = SENT_LINES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, the counts, base_failed, left_words, kept, text.

    Words are runs without ASCII white space, lines what \\n separates, both of the whole text; a
    normalised line is its words, A-Z lower-cased, joined by a space. A line is boilerplate of a host if
    at least ``min_line_docs`` distinct documents of the host hold it.
    The text is returned without the boilerplate lines of its host; its other lines stay as they are.
    left_words: words of that text; kept: not base_failed, and left_words at least ``min_left_words`` and
    ``min_left_share`` of n_words. The other counts are those of the whole text. Null and empty texts have no words and fail. Rows that repeat
    doc_id, host and text are one document and get equal rows. A null host is a host of its own.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    # one key for a document, free of nulls, so that repeated rows and null ids count
    text_hash = F.xxhash64("text")
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "host", F.col("host").isNull(), text_hash).alias("doc")
    host_key = F.when(F.col("host").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("host"))).alias("host_key")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text").select(
        "doc_id", "host", "text", host_key, key
    )
    lined = narrow.select("doc", "host_key", "text").mapInArrow(_line_batches, "doc long, host_key string, lines array<long>")
    # within a document lines are distinct, so rows that repeat are dropped here and lines are only counted below
    lines = scratch.save(lined.dropDuplicates(["doc"]), "lines").select("doc", "host_key", F.explode("lines").alias("line"))
    often = lines.groupBy("host_key", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_line_docs)
    boiler = scratch.save(often.select("host_key", "line"), "boiler")
    schema = f"doc_id long, host string, {', '.join(f'{c} long' for c in _COUNTS)}, left_words long, text string"
    few = boiler.limit(sent_lines + 1).collect()  # never more than the bound
    if len(few) <= sent_lines:
        by_host: dict[str, set[int]] = {}
        for r in few:
            by_host.setdefault(r["host_key"], set()).add(r["line"])
        sent = docs.sparkSession.sparkContext.broadcast(by_host)
        cleaned = narrow.select("doc_id", "host", "text", "host_key").mapInArrow(_clean_batches(sent), schema)
    else:
        own = lines.join(boiler, ["host_key", "line"]).groupBy("doc").agg(F.collect_list("line").alias("boiler"))
        cleaned = narrow.join(own, "doc", "left").select("doc_id", "host", "text", "boiler").mapInArrow(_clean_batches(), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = (F.col("left_words") >= min_left_words) & (F.col("left_words") >= min_left_share * F.col("n_words"))
    return cleaned.select(
        "doc_id", "host", *_COUNTS, failed.alias("base_failed"), "left_words", (~failed & left).alias("kept"), "text",
    )
