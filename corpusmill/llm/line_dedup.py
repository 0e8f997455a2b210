"""Line dedup by a suffix order over line ids, built by distributed prefix doubling.

Each document is the sequence of its lines that hold a word. A line that occurs once breaks every
repeated run, so only repeated lines get an id; ids, and the ranks of 2, 4, 8 ... lines, are assigned
in order of what they stand for: the distinct pairs (rank here, rank k lines on) are counted with
map-side combine, those that occur once are dropped with their suffixes, the rest are range-sorted
and numbered. Ranks of 2^p lines thus sort suffixes by their first 2^p lines.

Suffixes whose first n lines are equal are one interval of that order with a longest common prefix
of at least n lines; (rank of the first 2^p lines, rank of the last 2^p lines, n) names it. For each
line the shortest window of lines from it, and the shortest window up to it, that hold ``min_words``
words are looked up: the prefix that a suffix must share to be worth an interval. An interval's least
position is the first copy; every other position begins a later copy. Neighbouring windows of a document
whose first copies are neighbours too lie on one diagonal; together they are a maximal repeated run: the
two places agree from its first line to its last, and one of the next lines differs, or both copies end.

Only DataFrame functions are used. Per-key work is combined before a shuffle. The join that names a window's
interval has a shuffle of its own on both sides, so Spark can split it where one interval has most rows;
windows run within one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.operators.components import with_value
from corpusmill.plans.durable import Scratch

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = " \t\r\n\x0b\x0c"
DOC = ["doc_id", "text_hash"]


def _trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)))


def worded_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, words): lines with a word, pos counting only those from 0."""
    lines = F.filter(_trimmed_lines(F.col("text")), lambda x: x != "")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                    F.posexplode(lines).alias("pos", "line"))
        .select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
                F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))
    )


def _ranked(rows: DataFrame, keys: list[str], out: str, scratch: Scratch, name: str) -> DataFrame:
    """(keys, out) of the keys that occur more than once, out increasing with the keys."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return scratch.save(ordered.withColumn(out, F.monotonically_increasing_id()), name)


def suffix_ranks(docs: DataFrame, scratch: Scratch, max_lines: int) -> tuple[DataFrame, DataFrame]:
    """(lines, ranks): repeated lines (doc, pos, words) and ranks (doc, pos, level, rank) of their 2^level lines.

    Doubling ends when no suffix is tied, or when a level would be longer than ``max_lines``.
    """
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    all_lines = worded_lines(docs)
    ids = _ranked(all_lines, ["h1", "h2"], "rank", scratch, "rank_0")
    tied = scratch.save(all_lines.join(ids, ["h1", "h2"]).select(*DOC, "pos", "words", "rank"), "tied_0")
    scratch.drop("rank_0")
    lines, levels, level = tied, [tied.select(*DOC, "pos", F.lit(0).alias("level"), "rank")], 0
    while 2 << level <= max_lines:
        step = 1 << level
        on = F.first("rank").over(by_doc.rangeBetween(step, step))
        pairs = tied.select(*DOC, "pos", "rank", on.alias("after")).where("after is not null")
        level += 1
        named = _ranked(pairs, ["rank", "after"], "both", scratch, f"rank_{level}")
        joined = pairs.join(named, ["rank", "after"]).select(*DOC, "pos", F.col("both").alias("rank"))
        tied = scratch.save(joined, f"tied_{level}")
        scratch.drop(f"rank_{level}")
        if tied.isEmpty():
            break
        levels.append(tied.select(*DOC, "pos", F.lit(level).alias("level"), "rank"))
    return lines, reduce(DataFrame.unionByName, levels)


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, start, end): shortest runs of repeated lines with ``min_words`` words from, and up to, each line."""
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    islands = lines.dropDuplicates([*DOC, "pos"]).withColumn("island", F.col("pos") - F.row_number().over(by_doc))
    by_island = Window.partitionBy(*DOC, "island")
    summed = islands.withColumn("upto", F.sum("words").over(by_island.orderBy("pos"))).select(
        *DOC, "island", "pos", F.col("upto"), (F.col("upto") - F.col("words")).alias("before")
    )

    def events(mark: str, ask: Column) -> DataFrame:
        both = F.array(
            F.struct(F.col(mark).alias("at"), F.lit(0).alias("asks")), F.struct(ask.alias("at"), F.lit(1).alias("asks"))
        )
        return summed.select(*DOC, "island", "pos", F.explode(both).alias("e")).select(*DOC, "island", "pos", "e.*")

    marked = F.last(F.when(F.col("asks") == 0, F.col("pos")), ignorenulls=True)
    rows = (Window.unboundedPreceding, Window.currentRow)
    ends = marked.over(by_island.orderBy(F.desc("at"), "asks").rowsBetween(*rows))
    starts = marked.over(by_island.orderBy("at", "asks").rowsBetween(*rows))
    forward = events("upto", F.col("before") + min_words).select(*DOC, "asks", F.col("pos").alias("start"), ends.alias("end"))
    backward = events("before", F.col("upto") - min_words).select(*DOC, "asks", starts.alias("start"), F.col("pos").alias("end"))
    return forward.unionByName(backward).where("asks = 1 and start is not null and end is not null").drop("asks")


def later_copies(docs: DataFrame, min_words: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, start, end, first): windows of worded lines that repeat an earlier place.

    first: (null, id, hash, start) of the interval's first place, a struct that sorts like places do.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    lines, ranks = suffix_ranks(docs, scratch, min_words)  # each line has a word: no window is longer
    windows = _windows(lines, min_words).withColumn("n", F.col("end") - F.col("start") + 1)
    level = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    windows = windows.distinct().withColumn("level", level).withColumn(
        "second", F.col("end") - F.expr("shiftleft(1, level)") + 1
    )
    ranks = ranks.distinct()
    doc_key = [F.coalesce("doc_id", F.lit(-1)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), F.col("text_hash").alias("k_hash")]
    first = ranks.select(*doc_key, "level", F.col("pos").alias("start"), F.col("rank").alias("r1"))
    last = ranks.select(*doc_key, "level", F.col("pos").alias("second"), F.col("rank").alias("r2"))
    keys = ["k_id", "k_null", "k_hash", "level"]
    named = (
        windows.select(*windows.columns, *doc_key).join(first, [*keys, "start"]).join(last, [*keys, "second"])
        .select(*DOC, "start", "end", "level", "n", "r1", "r2")
    )
    named = scratch.save(named, "intervals")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"), F.col("start").alias("d"))
    interval = ["level", "n", "r1", "r2"]
    least = named.groupBy(*interval).agg(F.min(place).alias("first"))
    return with_value(named, least, interval).where(place != F.col("first")).select(*DOC, "start", "end", "first")


def maximal_runs(windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, first): the later copies of :func:`later_copies` as maximal runs.

    Windows of one document that meet or overlap and whose first copies lie as far apart as they do are one run.
    """
    first = ["first.a", "first.b", "first.c"]
    shift = F.col("start") - F.col("first.d")
    diagonal = Window.partitionBy(*DOC, *first, "shift").orderBy("start", "end")
    reach = F.max("end").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("shift", shift).withColumn("opens", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("opens").over(diagonal.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*DOC, *(F.col(c).alias(f"f_{c[-1]}") for c in first), "shift", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first")
    ).select(*DOC, "start", "end", "first")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``, and what was deleted.

    A run is a sequence of lines with a word, compared without white space at their ends, that hold
    ``min_words`` words or more; lines without a word neither count nor break a run. The first copy
    is the one with the smallest doc_id (nulls last), then text hash, then line. Copies may overlap
    within one document. Rows that repeat doc_id and text are one document: they get the same result.

    Added: lines_ (lines of the text), removed_ (numbers from 0 of the deleted lines, ascending).
    A null text stays null with 0 lines; an empty text has one line and loses none; a text all of
    whose lines go becomes empty. Other columns pass through, whatever their names; docs must not have
    lines_ or removed_.
    """
    gone = (
        maximal_runs(later_copies(docs, min_words)).select(*DOC, F.explode(F.sequence("start", "end")).alias("at"))
        .groupBy(*DOC).agg(F.collect_set("at").alias("gone"))
        .select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "gone")
    )
    names = [f"c{k}" for k in range(len(docs.columns))]  # no name can clash inside
    at = docs.columns.index("text")
    doc_id, text = F.col(names[docs.columns.index("doc_id")]).cast("long"), F.col(names[at])
    own = docs.toDF(*names).join(gone, doc_id.eqNullSafe(F.col("g_id")) & (F.xxhash64(text) == F.col("g_hash")), "left")
    split = F.split(text, "\n", -1)
    worded = F.filter(F.transform(_trimmed_lines(text), lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    lost = let(worded, lambda w: F.sort_array(F.transform("gone", lambda s: F.element_at(w, s.cast("int") + 1))))
    out = own.withColumns({
        "lines_": F.when(text.isNull(), 0).otherwise(F.size(split)),
        "removed_": F.coalesce(F.when(F.col("gone").isNotNull(), lost), F.array().cast("array<int>")),
    })
    stay = F.array_except(F.sequence(F.lit(0), F.col("lines_") - 1), F.col("removed_"))
    shorter = let(split, lambda all_: F.array_join(F.transform(stay, lambda i: F.element_at(all_, i + 1)), "\n"))
    out = out.withColumn(names[at], F.when(F.size("removed_") > 0, shorter).otherwise(text))
    return out.select(*names, "lines_", "removed_").toDF(*docs.columns, "lines_", "removed_")
