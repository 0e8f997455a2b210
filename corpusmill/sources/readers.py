"""Sources: tables of the common form from JSON lines, SQLite files, run files, surveys and lexicons."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The common form of a document; what else a source has goes to ``extra``.
DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "artist", "album", "genre", "text")])
RUN = "qid string, q0 string, doc_id string, rank int, score double, system string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: known keys as columns, the others in the map ``extra``; lines that are no objects are left out."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    known = DOCUMENT.fieldNames()
    extra = F.map_filter("m", lambda k, v: ~k.isin(*known) & v.isNotNull())
    return raw.select(*[F.col("m")[c].alias(c) for c in known], extra.alias("extra"))


def read_lines_like(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """Rows of (compressed) JSON lines whose raw line matches: most lines are never parsed."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def read_run(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """(system, qid, doc_id, rank, score) of a six-column run file; ``keep`` (qid) limits the queries."""
    run = spark.read.csv(path, sep=" ", schema=RUN).select("system", "qid", "doc_id", "rank", "score")
    return run.join(keep.select("qid"), "qid", "left_semi") if keep is not None else run


def read_sqlite(spark: SparkSession, paths: list[str], table: str, columns: list[str]) -> DataFrame:
    """Rows of a table of SQLite files, a task for each file; columns that a file lacks are null, as is a missing table's every row left out.

    The files must lie where all executors can open them. ``source_no`` is the place of the file.
    """

    def read(frames):
        import sqlite3
        from contextlib import closing

        for frame in frames:
            for place, path in zip(frame["place"], frame["path"], strict=True):
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    have = [r[1] for r in db.execute(f'pragma table_info("{table}")')]
                    if not have:
                        continue
                    listed = ", ".join(f'cast("{c}" as text)' if c in have else "null" for c in columns)
                    rows = db.execute(f'select {listed} from "{table}" order by rowid')
                    while part := rows.fetchmany(10_000):
                        out = pd.DataFrame(part, columns=columns)
                        out.insert(0, "source_no", place)
                        yield out

    schema = ", ".join(["source_no int", *(f"`{c}` string" for c in columns)])
    files = spark.createDataFrame(list(enumerate(paths)), "place int, path string").repartition(max(1, len(paths)))
    return files.mapInPandas(read, schema)


def first_by_url(rows: DataFrame, need: list[str] = ("url", "text")) -> DataFrame:
    """The first row of each address in order of source; rows without one of ``need`` are left out."""
    for c in need:
        rows = rows.where(F.col(c).isNotNull() & (F.trim(F.col(c)) != ""))
    order = Window.partitionBy("url").orderBy("source_no", *[c for c in rows.columns if c not in ("url", "source_no")])
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def read_survey(spark: SparkSession, path: str, prompt: str = r"\[(\w+)\]") -> DataFrame:
    """(row, prompt_id, answer): a wide table of answers made long; the id stands in a column's header. Empty answers are left out."""
    wide = spark.read.csv(path, header=True, multiLine=True, escape='"')
    import re

    named = [(c, m[1]) for c in wide.columns if (m := re.search(prompt, c))]
    pairs = F.array(*[F.struct(F.lit(p).alias("prompt_id"), F.trim(F.col(f"`{c}`")).alias("answer")) for c, p in named])
    rows = wide.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(pairs).alias("a")).select("row", "a.*")
    return rows.where("answer is not null and answer <> ''")


def read_lexicon(path: str) -> dict:
    """A small JSON lexicon on the driver, keys that begin with _ left out."""
    with open(path, encoding="utf-8") as f:
        return {k: v for k, v in json.load(f).items() if not k.startswith("_")}


def sitemap_urls(xml: DataFrame) -> DataFrame:
    """(url) of the <loc> entries of documents (xml)."""
    found = F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return xml.select(F.explode(found).alias("url")).distinct()


def comment_rows(trees: DataFrame, depth: int = 12) -> DataFrame:
    """(post, id, parent, author, body, score, level) of nested comment trees (post, tree), tree a JSON object with ``replies``.

    One level is taken apart at a time; levels below ``depth`` are not read.
    """
    one = "struct<id:string,author:string,body:string,score:long,replies:array<string>>"
    level = trees.select("post", F.lit(None).cast("string").alias("parent"), F.col("tree").alias("raw"))
    out = None
    for k in range(depth):
        parsed = level.select("post", "parent", F.from_json("raw", one).alias("c")).where("c is not null")
        rows = parsed.select("post", "c.id", "parent", "c.author", "c.body", "c.score", F.lit(k).alias("level"))
        out = rows if out is None else out.unionByName(rows)
        level = parsed.select("post", F.col("c.id").alias("parent"), F.explode("c.replies").alias("raw"))
    return out
