"""URLs, pages and crawl rules as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes of resources that are no pages.
RESOURCES = r"\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|json|xml|pdf|zip|rar|mp3|mp4|wav|avi|mov|woff2?|ttf)$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))


def normalise_url(url: Column) -> Column:
    """https, host in lower case without www. and m., no query, fragment or trailing slash, one slash in a row; null if it is no web address."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    return F.when(F.lower(url).rlike(r"^https?://[^/?#]+"), F.concat(F.lit("https://"), host, path))


def resolve(base: Column, href: Column) -> Column:
    """An absolute address of a link; null for other schemes and bare fragments. Dot segments are left."""
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+(?:/[^?#]*/)?)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z]+:)", 1)
    return (
        F.when(href.rlike(r"^https?://"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href)).when(href.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)") | (href == ""), F.lit(None))
        .otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), href))
    )


def url_reason(url: Column, depth: Column, hosts: list[str], max_depth: int, page_pattern: str) -> Column:
    """Why an address is not taken, VALID if it is; the first rule that fails counts."""
    host = host_of(url)
    inside = F.lit(False)
    for h in hosts:
        inside |= (host == h) | host.endswith("." + h)
    path = F.lower(F.regexp_replace(F.regexp_extract(url, r"://[^/?#]+([^?#]*)", 1), ";.*$", ""))
    return (
        F.when(depth > max_depth, "MAX_DEPTH").when(~F.lower(url).rlike("^https?://"), "INVALID_PROTOCOL").when(~inside, "OUTSIDE_DOMAIN")
        .when(path.rlike(RESOURCES), "NON_HTML_RESOURCE").when(~path.rlike(page_pattern), "NOT_A_CONTENT_PAGE").otherwise("VALID")
    )


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, n_links, n_paragraphs, body): what a page shows, by pattern."""
    html = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<article>(.*?)</article>", 1), "<[^>]+>", " "), r"\s+", " "))
    title = F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1)
    h1 = F.regexp_extract("html", r"(?is)<h1>([^<]*)</h1>", 1)
    return pages.select(
        "page_id", "url", F.trim(F.when(F.trim(title) != "", title).otherwise(h1)).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"),
        F.regexp_count(html, F.lit("(?i)<p>")).cast("long").alias("n_paragraphs"), bare.alias("body"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, target): links of pages, resolved."""
    rows = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.withColumn("target", resolve(F.col("url"), F.col("href")))


def robots_flags(content: Column) -> tuple[Column, Column]:
    """(may index, may follow) of a robots directive such as "noindex, follow"; null allows both."""
    words = F.coalesce(F.regexp_extract_all(F.lower(content), F.lit("[a-z]+"), F.lit(0)), F.array().cast("array<string>"))
    none = F.array_contains(words, "none")
    return ~(F.array_contains(words, "noindex") | none), ~(F.array_contains(words, "nofollow") | none)


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed) under robots rules (host, pattern, allow): the longest pattern that matches decides, Allow wins ties.

    In a pattern * stands for anything and a final $ for the end. Hosts without a matching rule allow all.
    """
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\$"))
    own = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", F.regexp_replace(F.col("url"), r"^[A-Za-z]+://[^/]+", ""))
    met = own.join(rules.withColumn("regex", regex), "host").where(F.expr("path rlike regex"))
    best = met.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    return own.join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


def admitted(candidates: DataFrame, per_host: int, total: int) -> DataFrame:
    """(url, host, depth, place): hosts take turns, at most ``per_host`` addresses of each and ``total`` in all.

    ``candidates`` (url, depth) is first cut for each host, so the last order sees per_host rows a host.
    """
    own = candidates.withColumn("host", host_of(F.col("url")))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("depth", "url"))
    cut = own.withColumn("turn", turn).where(F.col("turn") <= per_host).orderBy("turn", "depth", "url").limit(total)
    return cut.withColumn("place", F.row_number().over(Window.orderBy("turn", "depth", "url"))).select("url", "host", "depth", "place")
