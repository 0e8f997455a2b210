"""Text scalars, analyzers and text pipelines over ``documents`` and ``part``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.queries.common import Family, docs, sql_clean, sql_plain, sql_tokens, table

FAMILY = Family()
query = FAMILY.query


@query(f"select doc_id, {sql_clean('text')} as cleaned, len({sql_tokens('text')}) as n_tokens from documents")
def clean_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select doc_id, md5(strip_accents(lower(text))) as plain_md5, lower(text) <> strip_accents(lower(text)) as marked from documents")
def strip_marks(spark, sf_dir):
    low = F.lower(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_marks(low)).alias("plain_md5"), T.has_marks(low).alias("marked"))


_BIGRAMS = "list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || '_' || t[i + 1])"


@query(f"""with d as (select {sql_tokens('text')} as t from documents), g as (select unnest({_BIGRAMS}) as bigram from d)
select bigram, count(*) as n from g group by 1 order by n desc, bigram limit 100""")
def bigram_counts(spark, sf_dir):
    grams = docs(spark, sf_dir).select(F.explode(T.ngrams(T.tokens(F.col("text")), 2)).alias("bigram"))
    return grams.groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(100)


@query(f"""with d as (select {sql_tokens('text')} as t from documents),
g as (select unnest(list_concat(t, {_BIGRAMS})) as term from d)
select count(*) as n_terms, count(distinct term) as vocabulary, count(*) filter (contains(term, '_')) as n_bigrams from g""")
def unigrams_and_bigrams(spark, sf_dir):
    terms = docs(spark, sf_dir).select(F.explode(T.with_bigrams(T.tokens(F.col("text")))).alias("term"))
    return terms.agg(
        F.count("*").alias("n_terms"), F.count_distinct("term").alias("vocabulary"), F.count_if(F.col("term").contains("_")).alias("n_bigrams")
    )


@query(f"""with w as (select '#' || unnest({sql_tokens('text')}) || '#' as p from documents),
g as (select unnest(case when length(p) <= 3 then [p] else list_transform(generate_series(1, length(p) - 2), lambda i: p[i:i + 2]) end) as gram from w)
select gram, count(*) as n from g group by 1""")
def char_ngrams_padded(spark, sf_dir):
    grams = docs(spark, sf_dir).select(F.explode(T.char_ngrams_padded(T.tokens(F.col("text")), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""with j as (select doc_id, array_to_string({sql_tokens('text')}, '_') as p from documents),
g as (select doc_id, case when length(p) = 0 then [] when length(p) <= 5 then [p]
  else list_transform(generate_series(1, length(p) - 4), lambda i: p[i:i + 4]) end as grams from j)
select doc_id, len(grams) as n_grams, len(list_distinct(grams)) as n_distinct from g""")
def char_ngrams_across(spark, sf_dir):
    grams = T.char_ngrams_across(T.tokens(F.col("text")), 5)
    return docs(spark, sf_dir).select("doc_id", grams.alias("g")).select(
        "doc_id", F.size("g").cast("long").alias("n_grams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct")
    )


_SHINGLES = """case when len(t) = 0 then [] when len(t) <= 5 then [array_to_string(t, ' ')]
  else list_distinct(list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(t[i:i + 4], ' '))) end"""


@query(f"with d as (select doc_id, {sql_plain('text')} as t from documents) select doc_id, len({_SHINGLES}) as n_shingles from d")
def shingles5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.shingles(T.plain_tokens(F.col("text")))).cast("long").alias("n_shingles"))


@query(f"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: len({sql_tokens('x')}) > 0) as lines from documents),
s as (select doc_id, lines, unnest(generate_series(0, greatest(1, len(lines) - 2) - 1, 2)) as line_start from l where len(lines) > 0),
p as (select doc_id, line_start, array_to_string(lines[line_start + 1:line_start + 4], chr(10)) as passage from s),
k as (select *, len({sql_tokens('passage')}) as n_tokens from p)
select doc_id || '#' || (line_start // 2) as pid, doc_id, line_start::int as line_start, n_tokens::int as n_tokens, passage
from k where n_tokens >= 8 or line_start = 0""")
def passages_window(spark, sf_dir):
    """Windows of four lines, two lines on each; short ones are left out but for the first."""
    from corpusmill.operators.passages import passages

    return passages(docs(spark, sf_dir))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents),
stop as (select doc_id, min(no) as cut from l where regexp_matches(lower(line), '(licensed under|all rights reserved|copyright)') group by 1),
kept as (select doc_id, no, trim(regexp_replace(regexp_replace(line, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) as line
  from l left join stop using (doc_id) where cut is null or no < cut)
select doc_id, count(*) as n_lines, string_agg(line, chr(10) order by no) as cleaned from kept where line <> '' group by 1""")
def line_clean_cut(spark, sf_dir):
    """Bracketed notes go, lines from the first notice on are cut, empty lines are dropped."""
    from corpusmill.operators.passages import clean_lines

    return clean_lines(docs(spark, sf_dir))


@query(r"""with s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), 'https?://\S*/(?:user|u|profile)/\S+', '[profile]', 'g'),
  '(?:^|\s)(?:@|/?u/)[A-Za-z0-9_.-]{3,}', ' [user]', 'g'), '\+?[0-9][0-9 ().-]{7,}[0-9]', '[phone]', 'g') as scrubbed from documents)
select doc_id, md5(scrubbed) as scrubbed_md5, contains(scrubbed, '[email]') as had_email, contains(scrubbed, '[phone]') as had_phone from s""")
def pii_scrub(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", T.scrub(F.col("text")).alias("s"))
    return out.select("doc_id", F.md5("s").alias("scrubbed_md5"), F.col("s").contains("[email]").alias("had_email"), F.col("s").contains("[phone]").alias("had_phone"))


@query(f"""with w as (select unnest({sql_tokens('text')}) as term from documents), c as (select term, count(*) as f from w group by 1),
r as (select *, row_number() over (order by f desc, term) as rank from c)
select round(regr_slope(ln(f), ln(rank)), 4) as slope, round(regr_r2(ln(f), ln(rank)), 4) as r2, count(*) as n_types from r where f >= 5""")
def zipf_fit(spark, sf_dir):
    """Slope and fit of log frequency on log rank. Ranks of terms with one frequency are got from counts of frequencies."""
    from corpusmill.operators.corpus_stats import zipf_fit as fit

    return fit(docs(spark, sf_dir))


@query(f"""with w as (select unnest({sql_tokens('text')}) as term from documents), c as (select term, count(*) as f from w group by 1),
t as (select sum(f) as top from (select f from c order by f desc limit 10))
select sum(f)::bigint as n_tokens, count(*) as n_types, round(count(*) filter (f = 1) / count(*), 6) as hapax_share,
  round(any_value(top) / sum(f), 6) as top10_share from c cross join t""")
def token_stats(spark, sf_dir):
    counts = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("f"))
    top = counts.orderBy(F.desc("f")).limit(10).agg(F.sum("f").alias("top"))
    return counts.agg(
        F.sum("f").alias("n_tokens"), F.count("*").alias("n_types"), F.round(F.count_if(F.col("f") == 1) / F.count("*"), 6).alias("hapax_share")
    ).crossJoin(top).select("n_tokens", "n_types", "hapax_share", F.round(F.col("top") / F.col("n_tokens"), 6).alias("top10_share"))


_STOP = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "et", "der", "die", "und", "el", "los")
_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP)


@query(f"""with w as (select unnest({sql_tokens('text')}) as t from documents),
v as (select t, strip_accents(t) as p, t in ({_STOP_SQL}) as stop from w),
s as (
  select 'baseline' as strategy, count(distinct t) as vocabulary, count(*) as n_tokens from v
  union all select 'no_stop_words', count(distinct t), count(*) from v where not stop
  union all select 'no_marks', count(distinct p), count(*) from v
  union all select 'no_stop_words_no_marks', count(distinct p), count(*) from v where not stop)
select strategy, vocabulary, n_tokens, round(100.0 * (1 - n_tokens / max(n_tokens) over ()), 4) as token_reduction from s""")
def vocab_strategies(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("t"))
    # one aggregation of types serves all four strategies
    types = words.groupBy("t").agg(F.count("*").alias("n")).withColumn("p", T.strip_marks(F.col("t"))).withColumn("stop", F.col("t").isin(*_STOP))
    kinds = F.explode(F.array(
        F.struct(F.lit("baseline").alias("strategy"), F.col("t").alias("v"), F.lit(True).alias("use")),
        F.struct(F.lit("no_stop_words").alias("strategy"), F.col("t").alias("v"), (~F.col("stop")).alias("use")),
        F.struct(F.lit("no_marks").alias("strategy"), F.col("p").alias("v"), F.lit(True).alias("use")),
        F.struct(F.lit("no_stop_words_no_marks").alias("strategy"), F.col("p").alias("v"), (~F.col("stop")).alias("use")),
    ))
    out = types.select("n", kinds.alias("k")).where("k.use").groupBy("k.strategy").agg(F.count_distinct("k.v").alias("vocabulary"), F.sum("n").alias("n_tokens"))
    return out.withColumn("token_reduction", F.round(100.0 * (1 - F.col("n_tokens") / F.max("n_tokens").over(Window.partitionBy())), 4))


@query(f"""with w as (select unnest({sql_tokens('text')}) as t from documents), c as (select t, strip_accents(t) as p, count(*) as n from w group by 1, 2),
g as (select p, count(*) as forms, max(n) as best, sum(n) as n from c group by 1)
select forms, count(*) as n_plain, sum(n)::bigint as n_tokens, round(sum(best) / sum(n), 6) as most_frequent_accuracy from g group by 1""")
def stripped_ambiguity(spark, sf_dir):
    """How many marked forms a plain word has, and how often the most frequent one is right."""
    counts = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    forms = counts.groupBy(T.strip_marks(F.col("t")).alias("p")).agg(F.count("*").alias("forms"), F.max("n").alias("best"), F.sum("n").alias("n"))
    return forms.groupBy("forms").agg(
        F.count("*").alias("n_plain"), F.sum("n").alias("n_tokens"), F.round(F.sum("best") / F.sum("n"), 6).alias("most_frequent_accuracy")
    )


@query(f"""with d as (select lang, len({sql_tokens('text')}) as n from documents)
select lang, count(*) as n_docs, round(avg(n), 4) as mean, round(quantile_cont(n, 0.1), 4) as p10, round(quantile_cont(n, 0.5), 4) as median,
  round(quantile_cont(n, 0.9), 4) as p90 from d group by 1""")
def length_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.size(T.tokens(F.col("text"))).alias("n"))
    p = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 4).alias("mean"), p.alias("p")).select(
        "lang", "n_docs", "mean", F.round(F.col("p")[0], 4).alias("p10"), F.round(F.col("p")[1], 4).alias("median"), F.round(F.col("p")[2], 4).alias("p90")
    )


@query(f"""with f as (select lang, ({sql_tokens('text')})[1] as word from documents), c as (select lang, word, count(*) as n from f where word is not null group by 1, 2),
r as (select *, sum(n) over (partition by lang) as total, row_number() over (partition by lang order by n desc, word) as k from c)
select lang, word, n, round(n / total, 6) as share from r where k = 1""")
def first_words(spark, sf_dir):
    first = table(spark, sf_dir, "documents").select("lang", F.try_element_at(T.tokens(F.col("text")), F.lit(1)).alias("word")).where("word is not null")
    counts = first.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.min_by(F.struct("word", "n"), F.struct(-F.col("n"), "word")).alias("b"), F.sum("n").alias("t")).select(
        "lang", "b.word", "b.n", F.round(F.col("b.n") / F.col("t"), 6).alias("share")
    )


@query(r"""with t as (select unnest(regexp_extract_all(text, '[^\s]+')) as w from documents)
select count(*) filter (regexp_matches(w, '^[0-9]+$')) as numbers, count(*) filter (contains(w, '-')) as hyphens,
  count(*) filter (contains(w, '''')) as apostrophes, count(*) as n from t""")
def token_shapes(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[^\s]+"), F.lit(0))).alias("w"))
    w = F.col("w")
    return words.agg(
        F.count_if(w.rlike("^[0-9]+$")).alias("numbers"), F.count_if(w.contains("-")).alias("hyphens"),
        F.count_if(w.contains("'")).alias("apostrophes"), F.count("*").alias("n"),
    )


@query(f"""with d as (select doc_id, {sql_tokens('text')} as t from documents),
r as (select doc_id, len(t) as n, case when len(t) = 0 then 0 else len(list_filter(t, lambda w: w <> strip_accents(w))) / len(t) end as marked,
  len(list_distinct(t)) as types from d),
k as (select case when n < 40 then 'short' when marked < 0.02 then 'few_marks' when types < 0.5 * n then 'repetitive' else 'kept' end as reason from r)
select reason, count(*) as n_docs from k group by 1""")
def filter_reasons(spark, sf_dir):
    """A cascade of filters: the first reason that holds counts."""
    words = docs(spark, sf_dir).select(T.tokens(F.col("text")).alias("t"))
    marked = F.size(F.filter("t", T.has_marks)) / F.greatest(F.size("t"), F.lit(1))
    reason = (
        F.when(F.size("t") < 40, "short").when(marked < 0.02, "few_marks")
        .when(F.size(F.array_distinct("t")) < 0.5 * F.size("t"), "repetitive").otherwise("kept")
    )
    return words.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n_docs"))


@query("""select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60], '-+$', '', 'g'), ''), 'item') as slug,
  left(md5(p_name), 2) || left(sha1(p_name), 10) as item_key, ('0x' || left(sha1(p_name), 15))::bigint as id60,
  left(sha256('salt:' || p_name), 12) as anonymous from part""")
def keys_and_slugs(spark, sf_dir):
    p = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.slug(p).alias("slug"), F.concat(F.substring(F.md5(p), 1, 2), F.substring(F.sha1(p), 1, 10)).alias("item_key"),
        T.id60(p).alias("id60"), F.substring(F.sha2(F.concat(F.lit("salt:"), p), 256), 1, 12).alias("anonymous"),
    )


@query("""with u as (select doc_id, ('0x' || left(md5('split:' || doc_id), 8))::bigint / 4294967295.0 as u from documents)
select doc_id, case when u < 0.7 then 'train' when u < 0.8 then 'dev' else 'test' end as split from u""")
def md5_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.split_of(F.col("doc_id").cast("string")).alias("split"))


@query(f"""with b as (select p_partkey, p_name, regexp_replace(lower(regexp_replace(p_name, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')),
  '\\b(remix|cover|version|ver|live|acoustic|karaoke|beat)\\b', ' ', 'g') as bare from part)
select p_partkey, strip_accents({sql_clean('bare')}) as title_key, levenshtein(p_name, strip_accents({sql_clean('bare')})) as distance from b""")
def title_keys(spark, sf_dir):
    key = T.norm_title(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("title_key"), F.levenshtein("p_name", key).cast("long").alias("distance"))


@query(r"""with q as (select doc_id, unnest(regexp_extract_all(text, '"([^"]+)"', 1)) as fragment from documents)
select doc_id, fragment from q where len(regexp_extract_all(fragment, '\S+')) >= 2""")
def quoted_fragments(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit('"([^"]+)"'), F.lit(1))).alias("fragment"))
    return rows.where(F.regexp_count("fragment", F.lit(r"\S+")) >= 2)


@query(f"""with w as (select distinct unnest({sql_tokens('text')}) as word from documents), t as (select *, regexp_extract(word, '([àèìòùáéíóúýñãõ])', 1) as c from w)
select word, case when c in ('à', 'è', 'ì', 'ò', 'ù') then 'huyen' when c in ('á', 'é', 'í', 'ó', 'ú', 'ý') then 'sac' when c <> '' then 'nga' end as tone,
  translate(word, 'àèìòùáéíóúýñãõ', 'aeiouaeiouynao') as no_tone, strip_accents(word) as plain, translate(word, 'áéíóúý', 'àèìòùỳ') as swapped from t""")
def vietnamese_tones(spark, sf_dir):
    """Tone functions over all words."""
    rows = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    w = F.col("word")
    return rows.select("word", T.tone_of(w).alias("tone"), T.strip_tones(w).alias("no_tone"), T.strip_marks(w).alias("plain"), T.swap_tone(w, "sac", "huyen").alias("swapped"))
