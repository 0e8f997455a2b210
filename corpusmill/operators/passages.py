"""Lines and passages of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens


def passages(docs: DataFrame, window: int = 4, stride: int = 2, least: int = 8) -> DataFrame:
    """(pid, doc_id, line_start, n_tokens, passage): windows of lines that hold a word.

    Windows start every ``stride`` lines while a full one, or the rest, follows; a window with fewer
    than ``least`` tokens is left out unless it is the first. The number in pid counts those left out.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.size(tokens(x)) > 0)
    rows = docs.select("doc_id", lines.alias("lines")).where(F.size("lines") > 0)
    last = F.greatest(F.lit(1), F.size("lines") - window + stride) - 1
    starts = rows.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), last, F.lit(stride))).alias("line_start"))
    cut = starts.withColumn("passage", F.array_join(F.slice("lines", F.col("line_start") + 1, window), "\n"))
    cut = cut.withColumn("n_tokens", F.size(tokens(F.col("passage")))).where((F.col("n_tokens") >= least) | (F.col("line_start") == 0))
    pid = F.concat_ws("#", F.col("doc_id").cast("string"), F.floor(F.col("line_start") / stride).cast("string"))
    return cut.select(pid.alias("pid"), "doc_id", "line_start", "n_tokens", "passage")


#: A line with one of these ends the text.
STOP_LINE = "(licensed under|all rights reserved|copyright)"


def clean_lines(docs: DataFrame, stop: str = STOP_LINE) -> DataFrame:
    """(doc_id, n_lines, cleaned): lines before the first stop line, without bracketed notes and empty lines."""
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(stop)), True)
    before = F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
    bare = F.transform(before, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]|\([^)]*\)", " "), r"\s+", " ")))
    kept = docs.select("doc_id", F.filter(bare, lambda x: x != "").alias("lines")).where(F.size("lines") > 0)
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("cleaned"))
