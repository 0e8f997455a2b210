"""Query understanding: spelling, time expressions, names, grammar chunks, slots."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import delete_keys, osa
from corpusmill.functions.text import strip_marks, tokens


# types as objects, not as text: workers import this module without a session
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
_TREE = T.StructType([T.StructField("tree", T.StringType()), T.StructField("logp", T.DoubleType())])
_SLOTS = T.StructType([T.StructField(c, T.StringType()) for c in ("intent", "about", "by")])


def spelling_candidates(words: DataFrame, vocabulary: DataFrame, k: int = 12) -> DataFrame:
    """(word, candidate, cost, n, place): known words near a word, by cost and then frequency.

    ``vocabulary`` is (form, n). Words meet on keys with one letter deleted, from both sides, and on the
    form without marks. Costs: the word itself 0, the same letters with other marks 0.5, else 3 for each edit.
    """
    keys = lambda t, c: t.select("*", F.explode(delete_keys(strip_marks(F.col(c)))).alias("key"))
    met = keys(words.select("word").distinct(), "word").join(keys(vocabulary, "form"), "key").select("word", "form", "n").distinct()
    plain_w, plain_f = strip_marks(F.col("word")), strip_marks(F.col("form"))
    scored = met.withColumn("d", osa(plain_w, plain_f)).where("d <= 2")
    cost = F.when(F.col("word") == F.col("form"), 0.0).when(F.col("d") == 0, 0.5).otherwise(3.0 * F.col("d"))
    place = F.row_number().over(Window.partitionBy("word").orderBy("cost", F.desc("n"), "form"))
    out = scored.withColumn("cost", cost).withColumn("place", place).where(F.col("place") <= k)
    return out.select("word", F.col("form").alias("candidate"), "cost", "n", "place")


def best_readings(candidates: DataFrame, pairs: DataFrame, texts: DataFrame, best: int = 1, width: int = 10) -> DataFrame:
    """(qid, place, reading, score): the ``best`` cheapest readings of (qid, words) by candidate costs and bigram counts.

    ``candidates`` as above, ``pairs`` (u, w, c). Candidates of a text's words and the counts of the pairs they
    can form are gathered for each text, which bounds them by its length; a beam decodes each text.
    """
    words = texts.select("qid", F.posexplode("words").alias("pos", "word"))
    own = words.join(candidates, "word", "left").select(
        "qid", "pos", F.coalesce("candidate", "word").alias("form"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("n", F.lit(0)).alias("n")
    )
    after = own.select("qid", (F.col("pos") - 1).alias("pos"), F.col("form").alias("w"))
    bigrams = own.select("qid", "pos", F.col("form").alias("u")).join(after, ["qid", "pos"]).join(pairs, ["u", "w"]).groupBy("qid").agg(
        F.collect_set(F.struct("u", "w", "c")).alias("pairs")
    )
    options = own.groupBy("qid").agg(F.collect_set(F.struct("pos", "form", "cost", "n")).alias("options"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for qid, options_, pairs_ in zip(frame["qid"], frame["options"], frame["pairs"], strict=True):
                counts = {(p["u"], p["w"]): p["c"] for p in (pairs_ if pairs_ is not None else [])}
                places: dict[int, list] = {}
                for o in options_:
                    places.setdefault(o["pos"], []).append((o["form"], o["cost"], o["n"]))
                beam = [(0.0, ())]
                for pos in sorted(places):
                    grown = []
                    for score, path in beam:
                        for form, cost, n in sorted(places[pos]):
                            seen = counts.get((path[-1], form), 0) if path else 0
                            grown.append((score - cost + 0.2 * math.log1p(n) + math.log1p(seen), (*path, form)))
                    beam = sorted(grown, key=lambda x: (-x[0], x[1]))[:width]
                rows += [(qid, k, " ".join(path), round(score, 6)) for k, (score, path) in enumerate(beam[:best], 1)]
            yield pd.DataFrame(rows, columns=["qid", "place", "reading", "score"])

    kind = dict(texts.dtypes)["qid"]
    return options.join(bigrams, "qid", "left").mapInPandas(decode, f"qid {kind}, place int, reading string, score double")


def marked_forms(vocabulary: DataFrame, k: int = 8) -> DataFrame:
    """(word, candidate, cost, n): the k most frequent marked forms of each plain word of (form, n); feeds ``best_readings``."""
    plain = vocabulary.withColumn("word", strip_marks(F.col("form")))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "form"))
    return plain.withColumn("p", place).where(F.col("p") <= k).select("word", F.col("form").alias("candidate"), F.lit(0.0).alias("cost"), "n")


#: Patterns of time expressions, the first that holds a place wins: (kind, pattern, value).
TIME_PATTERNS = (
    ("DATE", r"\b(\d{4})-(\d{2})-(\d{2})\b", "{0}-{1}-{2}"), ("DATE", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", "{2}-{1:0>2}-{0:0>2}"),
    ("DATE", r"\b(1[5-9]\d\d|20\d\d)\b", "{0}"), ("DURATION", r"\b(\d+) years?\b", "P{0}Y"), ("DURATION", r"\b(\d+) months?\b", "P{0}M"),
    ("DURATION", r"\b(\d+) days?\b", "P{0}D"), ("TIME", r"\b(\d{1,2}):(\d{2})\b", "T{0:0>2}:{1}"), ("TIME", r"\b(tonight|night)\b", "TNI"), ("TIME", r"\b(morning)\b", "TMO"),
    ("DATE", r"\b(christmas)\b", "XXXX-12-25"), ("DATE", r"\b(today)\b", "PRESENT_REF"), ("DATE", r"\b(yesterday)\b", "PAST_REF"), ("DATE", r"\b(tomorrow)\b", "FUTURE_REF"),
)


def find_times(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of time expressions that don't overlap, by pattern priority and then place."""
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, value in TIME_PATTERNS:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if all(m.end() <= a or m.start() >= b for a, b, _, _ in taken):
                taken.append((m.start(), m.end(), kind, value.format(*m.groups())))
    return sorted(taken)


@F.pandas_udf(T.ArrayType(_SPAN))
def time_expressions(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("start", "end", "kind", "value"), x, strict=True)) for x in find_times(t or "")])


def longest_matches(words: list[str], phrases: frozenset, most: int) -> list[tuple[int, int]]:
    """(start, length) of phrases found from left to right, the longest at each place, without overlap."""
    out, i = [], 0
    while i < len(words):
        for n in range(min(most, len(words) - i), 0, -1):
            if " ".join(words[i : i + n]) in phrases:
                out.append((i, n))
                i += n
                break
        else:
            i += 1
    return out


def gazetteer_matches(docs: DataFrame, names: DataFrame, most_words: int = 4) -> DataFrame:
    """(doc_id, at, name, kind): names of (name, kind) in texts, longest first, names inside longer ones left out.

    N-grams of the texts meet the names in a join; a match inside a longer one is found by its span.
    """
    cut = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    grams = cut.select("doc_id", F.col("t"), F.explode(F.sequence(F.lit(1), F.lit(most_words))).alias("n")).where("size(t) >= n")
    grams = grams.select("doc_id", "n", F.posexplode(F.expr("transform(sequence(1, size(t) - n + 1), i -> array_join(slice(t, i, n), ' '))")).alias("at", "name"))
    met = grams.join(names, "name").select("doc_id", "at", (F.col("at") + F.col("n")).alias("stop"), "name", "kind")
    longer = met.select("doc_id", F.col("at").alias("a"), F.col("stop").alias("b")).select("doc_id", "a", "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("at"))
    inside = met.join(longer, ["doc_id", "at"]).where("stop <= b and (at > a or stop < b)").select("doc_id", "at", "stop").distinct()
    return met.join(inside, ["doc_id", "at", "stop"], "left_anti").select("doc_id", "at", "name", "kind")


#: A small grammar of request phrases in binary form, and the words of its classes.
RULES = (("S", "V", "NP", -0.2), ("S", "NP", "VP", -0.7), ("NP", "DET", "N", -0.4), ("NP", "NP", "PP", -1.2), ("NP", "ADJ", "N", -0.9), ("VP", "V", "NP", -0.3), ("PP", "P", "NP", -0.1))
CLASSES = {"find": "V", "play": "V", "show": "V", "the": "DET", "a": "DET", "song": "N", "songs": "N", "singer": "N", "love": "N", "sad": "ADJ", "old": "ADJ", "about": "P", "by": "P", "of": "P", "rain": "N"}


@lru_cache(maxsize=10_000)
def parse(text: str) -> tuple[str, float] | None:
    """The best bracketed parse of a sentence and its log probability (CKY); unknown words are nouns, a noun can be a phrase."""
    words = text.lower().split()
    if not words or len(words) > 40:
        return None
    n = len(words)
    chart: dict[tuple[int, int], dict[str, tuple[float, str]]] = {}
    for i, w in enumerate(words):
        c = CLASSES.get(w, "N")
        chart[i, i + 1] = {c: (0.0 if w in CLASSES else -2.0, f"({c} {w})")}
        if c == "N":
            score, tree = chart[i, i + 1]["N"]
            chart[i, i + 1]["NP"] = (score - 1.0, f"(NP {tree})")
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = chart[i, i + size] = {}
            for k in range(i + 1, i + size):
                for parent, left, right, p in RULES:
                    a, b = chart[i, k].get(left), chart[k, i + size].get(right)
                    if a and b and (parent not in cell or a[0] + b[0] + p > cell[parent][0]):
                        cell[parent] = (a[0] + b[0] + p, f"({parent} {a[1]} {b[1]})")
    best = chart[0, n].get("S") or chart[0, n].get("NP")
    return (best[1], round(best[0], 6)) if best else None


@F.pandas_udf(_TREE)
def parse_tree(text: pd.Series) -> pd.DataFrame:
    got = [parse(t) if t else None for t in text]
    return pd.DataFrame({"tree": [g[0] if g else None for g in got], "logp": [g[1] if g else None for g in got]})


def slots(text: str) -> dict[str, str | None]:
    """Intent and slots of a request by rules: what is asked for, its subject and its maker."""
    low = text.lower()
    intent = "find" if re.match(r"(find|show|which|what)\b", low) else "play" if re.match(r"play\b", low) else "other"
    about, by = re.search(r"\babout ([\w ]+?)(?: by\b|[?.!]|$)", low), re.search(r"\bby ([\w ]+?)(?: about\b|[?.!]|$)", low)
    return {"intent": intent, "about": about[1] if about else None, "by": by[1] if by else None}


@F.pandas_udf(_SLOTS)
def request_slots(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([slots(t or "") for t in text], columns=["intent", "about", "by"])


def hypernym_paths(pairs: DataFrame, depth: int = 8) -> DataFrame:
    """(node, ancestor, steps) of (node, parent) pairs, up to ``depth`` steps; the fewest steps of each pair."""
    level = pairs.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    out = level
    up = pairs.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for k in range(2, depth + 1):
        level = level.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(k).alias("steps"))
        out = out.unionByName(level)
    return out.groupBy("node", "ancestor").agg(F.min("steps").alias("steps"))


def lesk(contexts: DataFrame, senses: DataFrame) -> DataFrame:
    """(id, word, sense, overlap): the sense whose gloss shares most words with the context, ties to the first sense.

    ``contexts`` (id, word, text), ``senses`` (word, sense, gloss).
    """
    a = contexts.select("id", "word", F.array_distinct(tokens(F.col("text"))).alias("c"))
    b = senses.select("word", "sense", F.array_distinct(tokens(F.col("gloss"))).alias("g"))
    met = a.join(b, "word").withColumn("overlap", F.size(F.array_intersect("c", "g")))
    return met.groupBy("id", "word").agg(F.min_by(F.struct("sense", "overlap"), F.struct(-F.col("overlap"), "sense")).alias("b")).select("id", "word", "b.sense", "b.overlap")
