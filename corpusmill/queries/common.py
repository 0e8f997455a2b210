"""Shared pieces of the registered queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import Index, build_index
from corpusmill.plans.spread import spread


class Family:
    """Queries of one module with their SQL, filled by the ``query`` decorator."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.oracles[name or f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


_INDEXES: dict[tuple, Index] = {}


def document_index(spark: SparkSession, sf_dir: str, analyzer: str = "words", terms: Column | None = None) -> Index:
    """The index of ``documents`` under an analyzer: built by the first query of a session that asks, then read.

    It is known by the table's path, time and size, so a table that was written anew is indexed anew.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    key = (spark.sparkContext.applicationId, status.getPath().toString(), status.getModificationTime(), status.getLen(), analyzer)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(docs(spark, sf_dir), terms)
    return _INDEXES[key]


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_clean(x)}, ' '), lambda t: t <> '')"


def sql_plain(x: str) -> str:
    return f"list_filter(string_split(strip_accents({sql_clean(x)}), ' '), lambda t: t <> '')"


#: Index of documents and terms of the benchmark queries.
SQL_INDEX = f"""
words as (select doc_id, unnest({sql_tokens('text')}) as term from documents),
postings as (select doc_id, term, count(*) as tf from words group by 1, 2),
lengths as (select doc_id, len({sql_tokens('text')}) as dl from documents),
stats as (select count(*) as n_docs, avg(dl) as avgdl, sum(dl) as total from lengths),
terms as (select term, count(*) as df, sum(tf)::bigint as cf from postings group by 1),
query as (
  select qid, term, count(*) as qtf from (select item_id as qid, unnest({sql_tokens('text')}) as term from benchmark) group by 1, 2)
"""

SQL_BM25 = SQL_INDEX + """,
bm25 as (
  select qid, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) as score
  from query join postings using (term) join terms using (term) join lengths using (doc_id) cross join stats group by 1, 2)
"""


def sql_top(run: str, k: int, extra: str = "") -> str:
    return f"""select qid, doc_id, score, rank::int as rank from (
  select *, row_number() over (partition by qid order by score desc, doc_id) as rank from (
    select qid, doc_id, round(score, 6) as score{extra} from {run})) where rank <= {k}"""
