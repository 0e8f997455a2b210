"""Near-duplicates, clustering, graphs and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import dedup, graph, web
from corpusmill.queries.common import Family, docs, sql_plain, table

FAMILY = Family()
query = FAMILY.query

_SETS = f"""d as (select doc_id, {sql_plain('text')} as t from documents),
x as (select distinct doc_id, unnest(case when len(t) = 0 then [] when len(t) <= 5 then [array_to_string(t, ' ')]
  else list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(t[i:i + 4], ' ')) end) as s from d),
sizes as (select doc_id, count(*) as n from x group by 1)"""
_JACCARD = f"""{_SETS}, common as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
pairs as (select a, b, round(c / (p.n + q.n - c), 6) as jaccard from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b)"""


@query(f"with {_JACCARD} select a, b, jaccard from pairs where jaccard >= 0.8")
def near_dup_pairs(spark, sf_dir):
    """Pairs of distinct or equal texts with a Jaccard similarity of 0.8 over five-word shingles."""
    return dedup.similar_pairs(docs(spark, sf_dir), 0.8)


@query(f"""with recursive {_JACCARD}, e as (select a, b from pairs where jaccard >= 0.5 union select b, a from pairs where jaccard >= 0.5),
reach as (select doc_id as node, doc_id as label from documents union select e.b, r.label from reach r join e on e.a = r.node where r.label < e.b)
select node as doc_id, min(label) as cluster from reach group by 1""")
def near_dup_components(spark, sf_dir):
    return dedup.near_duplicate_clusters(docs(spark, sf_dir))


@query(f"""with {_SETS}, rare as (select s from x group by 1 having count(*) between 2 and 50),
r as (select doc_id, s from x semi join rare using (s)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from r a join r b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2)
select a, b, p.n from p join sizes m on m.doc_id = a join sizes o on o.doc_id = b where p.n >= 0.5 * least(m.n, o.n)""")
def containment_pairs(spark, sf_dir):
    return dedup.shared_shingles(docs(spark, sf_dir), 0.5)


@query(f"""with {_SETS}, g as (select doc_id, 's' || (doc_id % 7) as cluster from documents), y as (select x.*, cluster from x join g using (doc_id)),
o as (select distinct cluster, s from y), f as (select s from o group by 1 having count(*) between 2 and 20),
m as (select y.doc_id, o.cluster, count(*) as n from y semi join f using (s) join o on o.s = y.s and o.cluster <> y.cluster group by 1, 2)
select doc_id, cluster, m.n, round(m.n / z.n, 6) as share from m join sizes z using (doc_id) where round(m.n / z.n, 6) between 0.1 and 0.8 and m.n >= 15""")
def borrowed_parts(spark, sf_dir):
    d = docs(spark, sf_dir)
    groups = d.select("doc_id", F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")).alias("cluster"))
    return dedup.borrowed(d, groups)


@query("""with c as (select lower(string_split(p_name, ' ')[1]) as prefix, p_name as name, count(*) as n from part group by 1, 2),
t as (select *, sum(n) over (partition by prefix) as t from c) select prefix, name, n from t where n >= 0.2 * t and n >= 2""")
def alias_by_prefix(spark, sf_dir):
    return dedup.alias_by_prefix(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 0.2)


@query()
def kmeans_groups(spark, sf_dir):
    groups = dedup.kmeans_groups(table(spark, sf_dir, "embeddings"), 10)
    return groups.groupBy("group").agg(F.count("*").alias("n"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, e, sqrt(list_inner_product(e, e)) as l from v),
p as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id where round(list_inner_product(a.e, b.e) / (a.l * b.l), 6) >= 0.7),
c as (select a from p group by 1 having count(*) + 1 >= 4)
select vec_id, case when vec_id in (select a from c) then 'core' when vec_id in (select p.a from p join c on c.a = p.b) then 'border' else 'noise' end as role from v""")
def density_roles(spark, sf_dir):
    return dedup.density_roles(table(spark, sf_dir, "embeddings"), 0.3, 4).select("vec_id", "role")


# ---- graph: parts bought together with suppliers stand in for pages and links

_EDGES = "e as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem union select distinct 's' || l_suppkey, 'p' || (l_partkey + 1) from lineitem)"


def _edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    back = rows.select(s.alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") + 1).cast("string")).alias("dst"))
    return graph.simple_edges(rows.select(p.alias("src"), s.alias("dst")).unionByName(back))


@query(f"with {_EDGES}, t as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from t group by 1")
def link_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"""r{k} as materialized (select n.node, n.dangling, 0.15 / (select c from size) + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{k - 1} where dangling) / (select c from size)) as rank
  from n left join (select dst as node, sum(rank * w) as got from r{k - 1} join we on we.src = r{k - 1}.node group by 1) g using (node))""")
    return f"""with {_EDGES}, o as (select src, count(*) as n from e group by 1), we as materialized (select src, dst, 1.0::double / n as w from e join o using (src)),
n as materialized (select node, o.n is null as dangling from (select src as node from e union select dst from e) left join o on o.src = node), size as (select count(*)::double as c from n),
r0 as materialized (select node, dangling, 1.0::double / (select c from size) as rank from n), {', '.join(steps)}
select node, round(rank / (select sum(rank) from r{rounds}), 9) as rank from r{rounds}"""


@query(_pagerank_sql(10))
def pagerank10(spark, sf_dir):
    """Ten rounds, so that the same number of them can be written in SQL."""
    return graph.pagerank(_edges(spark, sf_dir), rounds=10, tolerance=None).select("node", F.round("rank", 9).alias("rank"))


@query()
def pagerank_converged(spark, sf_dir):
    """Rounds until the changes sum to less than a millionth; it fails if they don't within 200."""
    return graph.pagerank(_edges(spark, sf_dir), rounds=200, tolerance=1e-6)


def _hits_sql(rounds: int) -> str:
    steps = ["h0 as materialized (select src as node, 1.0::double as v from e union select dst, 1.0 from e)"]
    for k in range(1, rounds + 1):
        for new, old, frm, to in (("a", "h", "src", "dst"), ("h", "a", "dst", "src")):
            last = f"{old}{k - 1}" if new == "a" else f"{old}{k}"
            steps.append(f"x{new}{k} as materialized (select n.node, coalesce(sum(p.v), 0) as v from h0 n left join e on e.{to} = n.node left join {last} p on p.node = e.{frm} group by 1)")
            steps.append(f"{new}{k} as materialized (select node, v / (select sqrt(sum(v * v)) from x{new}{k}) as v from x{new}{k})")
    return f"with {_EDGES}, {', '.join(steps)} select node, round(h.v, 6) as hub, round(a.v, 6) as authority from h{rounds} h join a{rounds} a using (node)"


@query(_hits_sql(10))
def hits10(spark, sf_dir):
    return graph.hits(_edges(spark, sf_dir), rounds=10).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query(f"""with recursive {_EDGES}, b as (select 's1' as node, 0 as level union select e.dst, b.level + 1 from b join e on e.src = b.node where b.level < 4)
select node, min(level)::int as level from b group by 1""")
def bfs_levels(spark, sf_dir):
    return graph.bfs_levels(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 4)


@query()
def label_communities(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return graph.label_propagation(edges, 5).groupBy("label").agg(F.count("*").alias("n"))


# ---- pages

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1))"


@query(rf"""select page_id, case when regexp_matches(lower(url), '^https?://[^/?#]+') then 'https://' || regexp_replace({_HOST}, '^(?:www|m)\.', '') ||
  regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') end as canonical from pages""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.normalise_url(F.col("url")).alias("canonical"))


@query(rf"""with p as (select page_id, url, (page_id % 5)::int as depth, {_HOST} as host, lower(regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), ';.*$', '')) as path from pages)
select case when depth > 3 then 'MAX_DEPTH' when not regexp_matches(lower(url), '^https?://') then 'INVALID_PROTOCOL'
  when not (host = 'example.com' or ends_with(host, '.example.com') or host = 'example.org' or ends_with(host, '.example.org')) then 'OUTSIDE_DOMAIN'
  when regexp_matches(path, '{web.RESOURCES}') then 'NON_HTML_RESOURCE' when not regexp_matches(path, '^/(en|fr|de)/') then 'NOT_A_CONTENT_PAGE' else 'VALID' end as reason, count(*) as n
from p group by 1""")
def url_rule_reasons(spark, sf_dir):
    reason = web.url_reason(F.col("url"), F.col("page_id") % 5, ["example.com", "example.org"], 3, "^/(en|fr|de)/")
    return table(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(r"""with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)
select page_id, href, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href as target from l where starts_with(href, '/')""")
def html_links(spark, sf_dir):
    return web.page_links(table(spark, sf_dir, "pages")).where("startswith(href, '/')").select("page_id", "href", "target")


@query(r"""with h as (select page_id, html, regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g') as clean from pages)
select page_id, trim(case when trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) <> '' then regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) else regexp_extract(html, '(?is)<h1>([^<]*)</h1>', 1) end) as title,
  len(regexp_extract_all(html, '<a href=')) as n_links, len(regexp_extract_all(clean, '(?i)<p>')) as n_paragraphs,
  md5(trim(regexp_replace(regexp_replace(regexp_extract(clean, '(?is)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as body_md5 from h""")
def page_fields(spark, sf_dir):
    return web.page_fields(table(spark, sf_dir, "pages")).select("page_id", "title", "n_links", "n_paragraphs", F.md5("body").alias("body_md5"))


@query(f"""with p as (select url, {_HOST} as host, (page_id % 3)::int as depth from pages), t as (select *, row_number() over (partition by host order by depth, url) as turn from p)
select url, host, depth, (row_number() over (order by turn, depth, url))::int as place from t where turn <= 5 order by turn, depth, url limit 100""")
def crawl_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).cast("int").alias("depth"))
    return web.admitted(rows, 5, 100)


@query(f"""with p as (select url, {_HOST} as host, regexp_replace(url, '^[A-Za-z]+://[^/]+', '') as path from pages)
select url, case when ends_with(host, 'example.net') then (regexp_matches(path, '^/en/') and not regexp_matches(path, '^/en/.*ref=')) else true end as allowed from p""")
def robots_rules(spark, sf_dir):
    """All of a host is closed but one folder, in which addresses with a parameter are closed again."""
    pages = table(spark, sf_dir, "pages").select("url")
    hosts = pages.select(web.host_of(F.col("url")).alias("host")).where("endswith(host, 'example.net')").distinct()
    rules = hosts.crossJoin(spark.createDataFrame([("/", False), ("/en/", True), ("/en/*ref=", False)], "pattern string, allow boolean"))
    return web.allowed(pages, rules)


@query(r"""with f as (select page_id, (['index, follow', 'noindex', 'NOFOLLOW', 'none', null, 'noindex, nofollow'])[page_id % 6 + 1] as content from pages)
select page_id, content, not (regexp_matches(coalesce(lower(content), ''), '\b(noindex|none)\b')) as may_index, not (regexp_matches(coalesce(lower(content), ''), '\b(nofollow|none)\b')) as may_follow from f""")
def robots_directives(spark, sf_dir):
    """What the directives of pages allow."""
    said = F.array(*[F.lit(x).cast("string") for x in ("index, follow", "noindex", "NOFOLLOW", "none", None, "noindex, nofollow")])
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(said, (F.col("page_id") % 6 + 1).cast("int")).alias("content"))
    index, follow = web.robots_flags(F.col("content"))
    return rows.select("page_id", "content", index.alias("may_index"), follow.alias("may_follow"))
