"""Sinks: run files, releases, sitemaps, resumable caches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(run: DataFrame, path: str, system: str, depth: int = 100) -> None:
    """Six columns, scores with six places, each query's rows together in order of rank."""
    rows = run.where(F.col("rank") <= depth).repartition("qid").sortWithinPartitions("qid", "rank")
    line = F.format_string(f"%s Q0 %s %d %.6f {system}", F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.col("rank"), F.col("score"))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_release(docs: DataFrame, path: str) -> None:
    """(doc_id, digest) as tab-separated files: SHA-256 of the plain words, so that texts can be checked and not read."""
    from corpusmill.functions.text import plain_tokens

    digest = F.sha2(F.array_join(plain_tokens(F.col("text")), " "), 256)
    docs.select("doc_id", digest.alias("digest")).write.mode("overwrite").csv(path, sep="\t")


def export_form(docs: DataFrame) -> DataFrame:
    """Rows with a whole-number id from their address and everything else as JSON, nulls left out."""
    from corpusmill.functions.text import id60

    rest = [c for c in docs.columns if c != "url"]
    return docs.select(id60(F.col("url")).alias("id"), "url", F.to_json(F.struct(*rest)).alias("payload"))


def sitemap(urls: DataFrame, per_file: int = 50_000) -> DataFrame:
    """(part, xml): sitemap files of at most ``per_file`` addresses on average, dealt by hash."""
    n = max(1, -(-urls.count() // per_file))
    entry = F.format_string("<url><loc>%s</loc></url>", F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")))
    parts = urls.select(F.pmod(F.xxhash64("url"), F.lit(n)).alias("part"), entry.alias("e"))
    body = F.array_join(F.sort_array(F.collect_list("e")), "\n")
    return parts.groupBy("part").agg(F.concat(F.lit("<urlset>\n"), body, F.lit("\n</urlset>")).alias("xml"))


def robots(disallow: list[str], sitemap_url: str | None = None) -> str:
    lines = ["User-agent: *", *(f"Disallow: {p}" for p in disallow)]
    return "\n".join(lines + ([f"Sitemap: {sitemap_url}"] if sitemap_url else [])) + "\n"


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: rows of ``wanted`` whose key is not done."""
    return wanted.join(done.select(key), key, "left_anti")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not in the table at ``path``; how many there were. A failed run can be run again."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001  only a missing table is a start
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new = rows.dropDuplicates([key])
    new = new.join(known, key, "left_anti") if known is not None else new
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def significance_table(metrics: DataFrame, tests: DataFrame) -> str:
    """A Markdown table of systems with marks where the adjusted p is below 0.05 (*) or 0.01 (**). Systems are few."""
    p = {r["name"]: r["p_holm"] for r in tests.collect()}
    rows = metrics.orderBy("system").collect()
    names = [c for c in metrics.columns if c != "system"]
    out = ["| system | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    for r in rows:
        mark = "**" if p.get(r["system"], 1) < 0.01 else "*" if p.get(r["system"], 1) < 0.05 else ""
        out.append(f"| {r['system']}{mark} | " + " | ".join(f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |")
    return "\n".join(out)
