"""Properties of operators on small inputs."""

from __future__ import annotations

import json
import random
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import arrow
from corpusmill.functions import text as T
from corpusmill.operators import dedup, evaluation, fusion, generation, graph, language, logs, relational, retrieval, understanding, web
from corpusmill.operators.components import connected_components
from corpusmill.operators.vectors import best_of_group, nearest
from corpusmill.plans.durable import Scratch
from corpusmill.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


# ---- text


def test_analyzers(spark):
    words = F.array(*[F.lit(w) for w in ("má", "x", "đường")])
    row = spark.range(1).select(
        T.with_bigrams(words).alias("b"), T.char_ngrams_padded(words, 3).alias("c"), T.char_ngrams_across(words, 5).alias("a"),
        T.shingles(words, 5).alias("s"), T.shingles(words, 2).alias("s2"), T.strip_marks(F.lit("má đường Ñ ü")).alias("p"), T.strip_tones(F.lit("má đường")).alias("t"),
    ).first()
    assert row["b"] == ["má", "x", "đường", "má_x", "x_đường"]
    assert row["c"][:4] == ["#má", "má#", "#x#", "#đư"]
    assert row["a"][0] == "má_x_" and len(row["a"]) == len("má_x_đường") - 4
    assert row["s"] == ["má x đường"] and row["s2"] == ["má x", "x đường"]
    assert row["p"] == "ma duong N u" and row["t"] == "ma đương"


def test_clean_handles_null_and_signs(spark):
    assert one(spark, T.clean(F.col("a")), a="  Hello,_World!  Été-1 ") == "hello world été 1"
    row = spark.sql("select cast(null as string) a").select(T.clean(F.col("a")).alias("c"), T.tokens(F.col("a")).alias("t"), T.shingles(T.tokens(F.col("a"))).alias("s")).first()
    assert row["c"] is None and row["t"] == [] and row["s"] == []


def test_titles_and_scrub(spark):
    assert one(spark, T.norm_title(F.col("a")), a="Été (Live 1999) Remix [x]") == "ete"
    assert one(spark, T.title_parts(F.col("a")), a="One x Two & Three") == ["one", "two", "three"]
    out = one(spark, T.scrub(F.col("a")), a="write to a.b@example.com or @someone, call +84 123 456 789")
    assert "[email]" in out and "[user]" in out and "[phone]" in out


def test_split_is_stable_and_in_proportion(spark):
    got = spark.range(3000).select(T.split_of(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    counts = {r["s"]: r["count"] / 3000 for r in got}
    assert abs(counts["train"] - 0.7) < 0.04 and abs(counts["dev"] - 0.1) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_is_a_symmetric_bounded_distance(a, b):
    d = arrow.osa_distance(a, b)
    assert d == arrow.osa_distance(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert (d == 0) == (a == b)


def test_small_functions():
    assert arrow.osa_distance("ab", "ba") == 1
    assert arrow.longest_common_run("a b c d".split(), "x b c y".split()) == 2
    assert arrow.luhn_score("a x b y y y y y a".split(), {"a", "b"}) == pytest.approx(4 / 3)
    assert arrow.vbyte(5) == b"\x85" and arrow.vbyte(130) == bytes([1, 0x82]) and arrow.gamma(5) == "00101"
    assert arrow.deletes("abc") == ["ab", "abc", "ac", "bc"]
    for w in ("đường", "người", "má", "trăng"):
        assert arrow.from_telex(arrow.to_telex(w)) == w
    assert arrow.from_telex("bn") is None
    marked = {("hoa", "\u0301"): "hóa", ("hoang", "\u0301"): "hoáng", ("quy", "\u0309"): "quỷ", ("gia", "\u0300"): "già", ("gi", "\u0300"): "gì", ("nguoi", "\u0300"): "nguòi", ("người"[:2] + "ươi", "\u0300"): "người", ("khuya", "\u0301"): "khúya", ("bn", "\u0301"): "bn", ("duong", "\u0301"): "duóng"}
    for (word, mark), want in marked.items():
        assert arrow.place_tone(word, mark) in (want, {"khúya": "khuýa"}.get(want, want))
    assert understanding.find_times("on 2024-01-02 or 3 days")[0][2:] == ("DATE", "2024-01-02")
    assert understanding.longest_matches("a b c a".split(), frozenset({"a", "a b"}), 2) == [(0, 2), (3, 1)]
    assert understanding.parse("find the song")[0] == "(S (V find) (NP (DET the) (N song)))" and understanding.parse("") is None
    assert understanding.slots("Find songs about rain by anna") == {"intent": "find", "about": "rain", "by": "anna"}


# ---- retrieval


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(1, "sun over the hill"), (2, "rain in the night rain"), (3, "a marked été day"), (4, "")], "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_bm25_ranks_the_exact_text_first_and_only_positive(spark, tiny):
    index = retrieval.build_index(tiny)
    got = retrieval.top_k(retrieval.bm25(index, retrieval.query_terms(asked(spark, "rain night", "unknown words", ""))), 10).collect()
    assert [r["doc_id"] for r in got] == [2] and all(r["score"] > 0 for r in got)
    assert index.stats.first()["n_docs"] == 4


def test_stripped_index_finds_marked_text(spark, tiny):
    plain = T.plain_tokens(F.col("text"))
    run = retrieval.bm25(retrieval.build_index(tiny, plain), retrieval.query_terms(asked(spark, "ete"), plain)).collect()
    assert [r["doc_id"] for r in run] == [3]


def test_score_mixture_is_linear(spark, tiny):
    index = retrieval.build_index(tiny)
    a, b = (retrieval.query_terms(asked(spark, t)) for t in ("rain", "night the"))
    mixed = a.withColumn("qtf", F.col("qtf") * 0.7).unionByName(b.withColumn("qtf", F.col("qtf") * 0.3)).groupBy("qid", "term").agg(F.sum("qtf").alias("qtf"))
    score = lambda q: {r["doc_id"]: r["score"] for r in retrieval.bm25(index, q).collect()}
    sa, sb, sm = score(a), score(b), score(mixed)
    assert all(sm[d] == pytest.approx(0.7 * sa.get(d, 0) + 0.3 * sb.get(d, 0)) for d in sm)


def test_query_likelihood_scores_every_document(spark, tiny):
    got = retrieval.query_likelihood(retrieval.build_index(tiny), retrieval.query_terms(asked(spark, "rain"))).collect()
    assert len(got) == 4 and max(got, key=lambda r: r["score"])["doc_id"] == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_documents_are_found_where_they_lie(spark, tiny, monkeypatch):
    from corpusmill.operators import scoring

    monkeypatch.setattr(scoring, "ROWS", 2)  # queries in several blocks
    index, query = retrieval.build_index(tiny), retrieval.query_terms(asked(spark, "rain night", "the hill", "day the the"))
    rows = lambda df: sorted((r["qid"], r["doc_id"], round(r["score"], 5), r["rank"]) for r in df.collect())
    for k in (1, 2, 9):
        got = retrieval.bm25_top(index, query, k)
        assert rows(got) == rows(retrieval.top_k(retrieval.bm25(index, query), k))
        assert "[qid" in plan_of(got) and "doc_id" not in "".join(x for x in plan_of(got).splitlines() if "Exchange" in x)  # no row a query and document is shuffled
        assert rows(retrieval.query_likelihood_top(index, query, k)) == rows(retrieval.top_k(retrieval.query_likelihood(index, query), k))


def test_index_counts_words_of_a_text_without_a_shuffle(spark, tiny):
    index = retrieval.build_index(tiny)
    assert sorted((r["term"], r["tf"]) for r in index.postings.where("doc_id = 2").collect()) == [("in", 1), ("night", 1), ("rain", 2), ("the", 1)]
    assert {r["doc_id"]: r["dl"] for r in index.docs.collect()} == {1: 4, 2: 5, 3: 4, 4: 0}
    assert "Exchange" not in plan_of(index.postings) and "Exchange" not in plan_of(retrieval.boolean(index, ["the"], [["sun"]]))


def test_phrases_are_compared_in_their_text(spark, monkeypatch):
    from corpusmill.operators import scoring

    monkeypatch.setattr(scoring, "ROWS", 3)
    texts = spark.createDataFrame([(1, "a b a b a"), (2, "b a"), (3, None), (4, "a a a b")], "doc_id long, text string")
    got = retrieval.phrase_matches(texts, asked(spark, "a b a", "a a", "b", "", "a c"))
    assert sorted((r["qid"], r["doc_id"], r["n"]) for r in got.collect()) == [(0, 1, 2), (1, 4, 2), (2, 1, 2), (2, 2, 1), (2, 4, 1)]
    assert "Exchange" not in plan_of(got)  # texts stay where they are


def test_boolean_and_phrase(spark, tiny):
    index = retrieval.build_index(tiny)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(retrieval.boolean(index, ["the"])) == [1, 2] and ids(retrieval.boolean(index, ["the"], must_not=["rain"])) == [1]
    assert ids(retrieval.boolean(index, [], [["sun", "day"]])) == [1, 3] and ids(retrieval.boolean(index, [], must_not=["sun"])) == []
    hits = retrieval.phrase_matches(tiny, asked(spark, "in the night", "night the")).collect()
    assert [(r["qid"], r["doc_id"], r["n"]) for r in hits] == [(0, 2, 1)]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(40)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = nearest(df, df.where("vec_id < 5"), 3).collect()
    for q in range(5):
        s = np.round(u @ u[q], 6)
        want = sorted((i for i in range(40) if i != q), key=lambda i: (-s[i], i))[:3]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    groups = best_of_group(df, "label", df.where("vec_id = 0"), 3).collect()
    assert len(groups) == 3 and all(r["score"] <= 1 for r in groups)


# ---- fusion and evaluation


def runs_of(spark, rows):
    return spark.createDataFrame(rows, "system string, qid int, doc_id int, rank int, score double")


def test_fusion_rules(spark):
    runs = runs_of(spark, [("a", 1, 10, 1, 3.0), ("a", 1, 11, 2, 1.0), ("b", 1, 11, 1, 5.0), ("b", 1, 12, 2, 5.0)])
    rrf = {r["doc_id"]: r["score"] for r in fusion.rrf(runs, {"a": 1.0, "b": 1.0}).collect()}
    assert rrf[11] == pytest.approx(1 / 62 + 1 / 61) and rrf[10] == pytest.approx(1 / 61)
    assert {r["doc_id"] for r in fusion.rrf(runs, {"a": 1.0, "b": 0.0}).collect()} == {10, 11}
    comb = {r["doc_id"]: r["score"] for r in fusion.comb_sum(runs, {"a": 1.0, "b": 1.0}).collect()}
    assert comb == {10: 1.0, 11: 0.0, 12: 0.0}


def test_cluster_rank_counts_groups_once(spark):
    runs = runs_of(spark, [("a", 1, 1, 1, 3.0), ("a", 1, 2, 2, 2.0), ("a", 1, 3, 3, 1.0)])
    targets = spark.createDataFrame([(1, 3), (2, 9)], "qid int, doc_id int")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "doc_id int, cluster int")
    got = {r["qid"]: r["rank"] for r in evaluation.target_ranks(runs, targets, groups).collect()}
    assert got == {1: 2, 2: None}
    m = evaluation.known_item_metrics(evaluation.target_ranks(runs, targets, groups), ["system"]).first()
    assert m["mrr10"] == 0.25 and m["s1"] == 0 and m["s10"] == 0.5


def test_holm_and_randomisation(spark):
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    assert {r["name"]: round(r["p_holm"], 6) for r in evaluation.holm(p).collect()} == {"x": 0.03, "y": 0.06, "z": 0.06}
    zero = spark.createDataFrame([(i, 0.0) for i in range(20)], "key int, d double")
    assert evaluation.sign_flip_test(zero, 100).first()["p"] == 1.0
    far = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(30)], "key int, d double")
    assert evaluation.sign_flip_test(far, 200).first()["p"] < 0.02
    ci = evaluation.bootstrap_interval(far.withColumnRenamed("d", "v"), 200).first()
    assert ci["low"] < ci["mean"] < ci["high"]


def test_interleaving_keeps_both_lists(spark):
    runs = runs_of(spark, [(s, q, d, d % 7 + 1, 1.0) for s, lo in (("a", 0), ("b", 3)) for q in (1, 2) for d in range(lo, lo + 7)])
    got = fusion.interleave(runs, "a", "b").collect()
    assert all(len({r["doc_id"] for r in got if r["qid"] == q}) == len([r for r in got if r["qid"] == q]) for q in (1, 2))
    assert got == fusion.interleave(runs, "a", "b").collect()


def test_rankers_learn_the_informative_list(spark):
    rnd = random.Random(1)
    rows = []
    for q in range(40):
        good = rnd.randrange(8)
        for d in range(8):
            rows.append((q, d, float(d == good) + rnd.random() * 0.3, rnd.random(), int(d == good)))
    table = spark.createDataFrame(rows, "qid int, doc_id int, f1 double, f2 double, label int")
    for kind in ("pointwise", "pairwise", "trees"):
        model = fusion.fit_ranker(table.where("qid < 30"), "label", ["f1", "f2"], kind)
        top = fusion.rank_with(model, table.where("qid >= 30"), ["f1", "f2"], 1).join(table, ["qid", "doc_id"]).agg(F.avg("label")).first()[0]
        assert top >= 0.7, kind


# ---- dedup and graphs


def test_clusters_join_copies_and_near_copies(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(999)}" for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base + ["more", "words"])), (3, " ".join(f"v{i}" for i in range(100))), (4, " ".join(base)), (5, ""), (6, "")]
    got = dict(map(tuple, dedup.near_duplicate_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def test_all_similar_texts_are_found(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(60):  # pairs of a similarity just above a half, which bands miss now and then
        words = [f"g{g}w{k}" for k in range(44)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:30] + [f"h{g}x{k}" for k in range(9)]))]
    rows += [(900, rows[0][1]), (901, ""), (902, "")]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in rows}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    want = {p: j for p, j in want.items() if j >= 0.5}
    got = {(r["a"], r["b"]): r["jaccard"] for r in dedup.similar_pairs(table, 0.5).collect()}
    assert got == want and len(got) >= 61


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    got = dict(map(tuple, out.collect()))
    assert {got[i] for i in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100} and len(got) == 71
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_pagerank_sums_to_one_and_follows_links(spark):
    edges = graph.simple_edges(spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a"), ("a", "a"), ("a", "b"), ("d", "b")], "src string, dst string"))
    got = dict(map(tuple, graph.pagerank(edges).collect()))
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == "b"
    levels = dict(map(tuple, graph.bfs_levels(edges, spark.createDataFrame([("c",)], "node string"), 5).collect()))
    assert levels == {"c": 0, "b": 1, "a": 2}


def test_pagerank_that_has_not_settled_is_no_result(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    with pytest.raises(RuntimeError, match="settle"):
        graph.pagerank(edges, rounds=2, tolerance=1e-9)
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges, tolerance=0.1).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and min(ranks, key=ranks.get) == "d"


def test_headings_keep_entities_other_than_the_ampersand(spark):
    from corpusmill.operators.records import page_records

    pages = spark.createDataFrame([(1, "<h1>a &amp; b = &quot;c&quot;</h1>")], "page_id long, html string")
    assert page_records(pages).first()["title"] == "a & b = &quot;c&quot;"


def test_label_propagation_splits_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 2.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 1.0)]
    got = dict(map(tuple, graph.label_propagation(spark.createDataFrame(pairs, "src string, dst string, weight double")).collect()))
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and got["a1"] != got["b1"]


# ---- web, logs, tables


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.org/x/y", "z", "https://a.org/x/z"), ("https://a.org/x/y", "/z", "https://a.org/z"), ("https://a.org", "z", "https://a.org/z"),
        ("http://a.org/x", "//b.org/q", "http://b.org/q"), ("http://a.org/x", "#top", None), ("http://a.org/x", "mailto:x@y.z", None), ("http://a.org/x", "https://c.org/", "https://c.org/"),
    ],
)
def test_resolve(spark, base, href, want):
    assert one(spark, web.resolve(F.col("b"), F.col("h")), b=base, h=href) == want


def test_robots_longest_match_and_allow_on_ties(spark):
    rules = spark.createDataFrame([("a.org", "/", False), ("a.org", "/p", True), ("a.org", "/p/x$", False), ("a.org", "/t", False), ("a.org", "/t", True), ("a.org", "/*.pdf", False)], "host string, pattern string, allow boolean")
    urls = spark.createDataFrame([(f"https://{u}",) for u in ("a.org/p/1", "a.org/p/x", "a.org/p/xy", "a.org/q", "a.org/t", "a.org/a.pdf", "b.org/q")], "url string")
    got = {r["url"][8:]: r["allowed"] for r in web.allowed(urls, rules).collect()}
    assert got == {"a.org/p/1": True, "a.org/p/x": False, "a.org/p/xy": True, "a.org/q": False, "a.org/t": True, "a.org/a.pdf": False, "b.org/q": True}


def test_upsert_merge_and_match(spark):
    rows = spark.createDataFrame([("u", 3, "old", 1), ("u", 5, "new", 2), ("v", 1, None, 1)], "url string, depth int, title string, seq int")
    got = {r["url"]: (r["depth"], r["title"]) for r in relational.upsert(rows, "url", "seq", least=["depth"]).collect()}
    assert got == {"u": (3, "new"), "v": (1, None)}
    a = spark.createDataFrame([("k1", 2), ("k1", 1), (None, 3)], "k string, id int")
    b = spark.createDataFrame([("k1", 0), ("k2", 9)], "k string, id int")
    merged = [(r["k"], r["id"], r["new_id"]) for r in relational.merge_in_order([a, b], "k", "id").orderBy("new_id").collect()]
    assert merged == [("k1", 1, 1), ("k2", 9, 2)]


def test_typing_is_dropped(spark):
    log = spark.createDataFrame([("s", 0, "so"), ("s", 3, "song"), ("s", 20, "songs"), ("t", 1, "so")], "session string, t int, query string")
    log = log.withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r["query"] for r in logs.drop_typing(log).collect()) == ["so", "song", "songs"]


# ---- language, generation


def test_kneser_ney_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c\na b b"), (2, "c a b")], "doc_id int, text string")
    model = language.kneser_ney(docs)
    vocabulary = [r["w"] for r in model["c1"].collect()]
    for u, v in (("a", "b"), ("<s>", "<s>"), ("zz", "a")):
        grams = spark.createDataFrame([(u, v, w) for w in vocabulary], "u string, v string, w string")
        total = language.trigram_probabilities(model, grams).agg(F.sum("p")).first()[0]
        assert 0.9 < total <= 1.0 + 1e-9


def test_restoration_takes_the_most_frequent_form(spark):
    docs = spark.createDataFrame([(1, "été été ete où")], "doc_id int, text string")
    texts = spark.createDataFrame([(9, "ete ou xyz")], "doc_id int, plain string")
    assert language.restore_marks(texts, docs).first()["restored"] == "été où xyz"


def test_noise_is_seeded_and_counted():
    text = "one two three four five six seven eight nine"
    for rate in (0.0, 0.3, 1.0):
        out = generation.add_noise(text, rate, "k")
        assert out == generation.add_noise(text, rate, "k") and len(out.split(" ")) == 9
        assert sum(a != b for a, b in zip(out.split(" "), text.split(" "), strict=True)) <= round(rate * 9)


def test_answer_choice(spark):
    rows = [("p", "1", None, "x", "a", "try this", 5), ("p", "2", None, "y", "a", "or this", 1), ("p", "3", "2", "a", "a", "thank you, that's it", 1), ("q", "4", None, "x", "b", "maybe", 2)]
    got = generation.best_answers(spark.createDataFrame(rows, "post string, id string, parent string, author string, asker string, body string, score int"))
    assert dict(map(tuple, got.collect())) == {"p": "2", "q": "4"}


# ---- sources and sinks


def test_json_sqlite_and_run_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"url": "u", "text": "t", "views": 3}) + "\nnot json\n")
    row = readers.read_documents(spark, str(tmp_path / "a.jsonl")).first()
    assert row["url"] == "u" and row["extra"] == {"views": "3"} and row["artist"] is None
    for k, extra in ((0, ""), (1, ", artist text")):
        db = sqlite3.connect(tmp_path / f"{k}.db")
        db.execute(f"create table songs (url text, text text{extra})")
        db.execute("insert into songs (url, text) values ('u', ?), ('n', null)", (f"text {k}",))
        db.commit()
        db.close()
    rows = readers.read_sqlite(spark, [str(tmp_path / f"{k}.db") for k in (0, 1)], "songs", ["url", "text", "artist"])
    assert rows.count() == 4 and [r["text"] for r in readers.first_by_url(rows).collect()] == ["text 0"]
    run = spark.createDataFrame([("q1", "d2", 1, 2.5), ("q1", "d1", 2, 1.25)], "qid string, doc_id string, rank int, score double")
    writers.write_run(run, str(tmp_path / "run"), "sys")
    back = readers.read_run(spark, str(tmp_path / "run"))
    assert sorted(map(tuple, back.collect())) == [("sys", "q1", "d1", 2, 1.25), ("sys", "q1", "d2", 1, 2.5)]


def test_append_new_is_resumable(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    assert writers.append_new(rows, str(tmp_path / "t"), "k") == 2
    assert writers.append_new(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), str(tmp_path / "t"), "k") == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_comment_trees_flatten(spark):
    leaf = {"id": "2", "author": "b", "body": "y", "score": 1, "replies": []}
    tree = json.dumps({"id": "1", "author": "a", "body": "x", "score": 2, "replies": [leaf]})
    got = readers.comment_rows(spark.createDataFrame([("p", tree)], "post string, tree string"), 4).orderBy("id").collect()
    assert [(r["id"], r["parent"], r["level"]) for r in got] == [("1", None, 0), ("2", "1", 1)]


def test_answers_are_accepted_by_title_and_name(spark):
    from corpusmill.operators import resolution

    catalogue = spark.createDataFrame([(1, "the long road home", "anna"), (2, "rain", "bo"), (3, "rain", "cy")], "cluster int, title string, artist string")
    answers = spark.createDataFrame([(1, "It is The Long Road Home by Anna"), (2, "maybe rain"), (3, "the long road home"), (4, "no idea")], "id int, text string")
    got = {r["id"]: (r["cluster"], r["decision"]) for r in resolution.resolve_answers(answers, catalogue).collect()}
    assert got == {1: (1, "accept"), 2: (2, "review"), 3: (1, "review")}


def test_bleu_counts_runs_in_their_row(spark):
    from corpusmill.operators import resolution

    pairs = spark.createDataFrame([(1, ["a", "a", "b", "a", "a"], ["a", "a", "b", "c", "a"]), (2, [], ["x"])], "id int, said array<string>, truth array<string>")
    got = resolution.bleu(pairs)
    row = got.first()
    assert [row[f"p{n}"] for n in (1, 2, 3, 4)] == [0.8, 0.5, 0.333333, 0.0] and row["bleu"] == 0
    assert "hashpartitioning" not in plan_of(got)


def test_latent_vectors_are_those_of_the_products(spark):
    from corpusmill.operators.resolution import _products

    rows = spark.createDataFrame([([1.0, 2.0],), ([0.5, -1.0],), ([3.0, 0.0],)], "x array<double>").repartition(3)
    assert _products(rows, 2).tolist() == [[10.25, 1.5], [1.5, 5.0]]


def test_bleu_is_one_for_equal_texts(spark):
    from corpusmill.operators import resolution

    words = "a b c d e f".split()
    assert resolution.bleu(spark.createDataFrame([(1, words, words)], "id int, said array<string>, truth array<string>")).first()["bleu"] == 1.0
    assert resolution.bleu(spark.createDataFrame([(1, words, ["x"] * 6)], "id int, said array<string>, truth array<string>")).first()["bleu"] == 0.0
