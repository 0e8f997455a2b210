"""Noise channels for queries, and what real variants show of them. Choices are seeded by a key, so reruns agree."""

from __future__ import annotations

import difflib
import hashlib
import random
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import to_telex
from corpusmill.functions.text import has_marks, plain_tokens, split_of, tokens, unit_hash

# Shares of the kinds of change.
WEIGHTS = {"initial": 0.3, "final": 0.15, "tone": 0.25, "typo": 0.3}
#: Onsets and endings that one region's speakers write for another's, in groups; rows of keys side by side.
ONSET_GROUPS, ENDING_GROUPS = (("s", "x"), ("ch", "tr"), ("l", "n"), ("d", "gi", "r", "v"), ("c", "k"), ("ng", "ngh")), (("n", "ng", "nh"), ("t", "c", "ch"))
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_HOOK, _TILDE = "̉", "̃"


def _near_keys(letter: str) -> str:
    """Keys beside, above and below a letter's."""
    for r, row in enumerate(KEY_ROWS):
        if (c := row.find(letter)) >= 0:
            around = [row[c - 1 : c], row[c + 1 : c + 2]]
            around += [KEY_ROWS[k][max(0, c - 1) : c + 1] for k in (r - 1, r + 1) if 0 <= k < len(KEY_ROWS)]
            return "".join(around)
    return ""


def _swapped(word: str, groups: tuple, at_start: bool) -> list[str]:
    """The word with its longest part of a group put for each other part of it."""
    fits = [(len(p), p, g) for g in groups for p in g if (word.startswith(p) if at_start else word.endswith(p)) and len(word) > len(p)]
    if not fits:
        return []
    n, part, group = max(fits)
    return [o + word[n:] if at_start else word[:-n] + o for o in group if o != part]


def changes(word: str) -> dict[str, list[str]]:
    """Every changed form of a word by each kind of change; kinds without one are left out."""
    parts = unicodedata.normalize("NFD", word)
    tone = parts.translate({ord(_HOOK): _TILDE, ord(_TILDE): _HOOK})
    typed = [word[:i] + k + word[i + 1 :] for i, c in enumerate(word) for k in _near_keys(c)]
    typed += [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
    forms = {
        "initial": _swapped(word, ONSET_GROUPS, True), "final": _swapped(word, ENDING_GROUPS, False),
        "tone": [unicodedata.normalize("NFC", tone)], "typo": typed,
    }
    return {k: own for k, v in forms.items() if (own := sorted({x for x in v if x != word}))}


def corrupted(text: str, rate: float, key: str, weights: dict[str, float] | None = None) -> tuple[str, dict[str, int]]:
    """The text with round(rate * words) of its words changed, one at least where rate > 0, and what was done.

    Words are tried in a seeded order, and those that no kind can change are passed over, so the number is met
    wherever enough words can be changed.
    """
    weights = weights or WEIGHTS
    words, rnd = text.split(), random.Random(int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big"))
    left = max(round(rate * len(words)), 1 if rate > 0 and words else 0)
    done: dict[str, int] = {}
    for i in rnd.sample(range(len(words)), len(words)):
        if not left:
            break
        forms = {k: v for k, v in changes(words[i]).items() if weights.get(k, 0) > 0}
        if forms:
            kind = rnd.choices(list(forms), [weights[k] for k in forms])[0]
            words[i] = rnd.choice(forms[kind])
            done[kind], left = done.get(kind, 0) + 1, left - 1
    return " ".join(words), done


def noisy_queries(queries: DataFrame, rate: float, seed: str = "1") -> DataFrame:
    """(qid, text, ops): queries through the channel; ops counts the changes of each kind."""

    @F.pandas_udf("text string, ops map<string, int>")
    def run(text: pd.Series, key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([corrupted(t or "", rate, k) for t, k in zip(text, key, strict=True)], columns=["text", "ops"])

    key = F.concat_ws(":", F.lit(seed), F.col("qid").cast("string"))
    return queries.select("qid", run(F.array_join(tokens(F.col("text")), " "), key).alias("r")).select("qid", "r.*")


def change_counts(noisy: DataFrame) -> DataFrame:
    """(op, n, share) over all queries."""
    each = noisy.select(F.explode("ops").alias("op", "n")).groupBy("op").agg(F.sum("n").alias("n"))
    return each.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a kind


def telex_residue(queries: DataFrame, most: int = 2, seed: str = "1") -> DataFrame:
    """(qid, text, typed): plain queries in which one or two of the words that had marks stand as they were typed."""

    @F.pandas_udf("text string, typed int")
    def run(words: pd.Series, plain: pd.Series, key: pd.Series) -> pd.DataFrame:
        out = []
        for w, p, k in zip(words, plain, key, strict=True):
            rnd = random.Random(int.from_bytes(hashlib.md5(k.encode()).digest()[:8], "big"))
            own, marked = list(p), [i for i, (a, b) in enumerate(zip(w, p, strict=True)) if a != b]
            chosen = rnd.sample(marked, min(len(marked), rnd.randint(1, most)))
            for i in chosen:
                own[i] = to_telex(w[i])
            out.append((" ".join(own), len(chosen)))
        return pd.DataFrame(out, columns=["text", "typed"])

    key = F.concat_ws(":", F.lit(seed), F.col("qid").cast("string"))
    plain = F.transform(tokens(F.col("text")), lambda w: F.array_join(plain_tokens(w), ""))
    return queries.select("qid", run(tokens(F.col("text")), plain, key).alias("r")).select("qid", "r.*")


def word_substitutions(pairs: DataFrame) -> DataFrame:
    """(id, old, new, kind): words that two versions (id, a, b) of a text have in each other's place, one for one."""

    def aligned(frames):
        for f in frames:
            out = []
            for i, a, b in zip(f["id"], f["a"], f["b"], strict=True):
                x, y = list(a), list(b)
                for tag, lo, hi, lo2, hi2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    if tag == "replace" and hi - lo == hi2 - lo2:
                        out += [(i, u, v) for u, v in zip(x[lo:hi], y[lo2:hi2], strict=True)]
            yield pd.DataFrame(out, columns=["id", "old", "new"])

    rows = pairs.select("id", tokens(F.col("a")).alias("a"), tokens(F.col("b")).alias("b")).mapInPandas(aligned, f"id {dict(pairs.dtypes)['id']}, old string, new string")
    return rows.withColumn("kind", substitution_kind(F.col("old"), F.col("new")))


def substitution_kind(old: Column, new: Column) -> Column:
    """marks: only marks differ; onset or ending: only letters before or after the others; edit: one letter; else other."""
    a, b = F.array_join(plain_tokens(old), ""), F.array_join(plain_tokens(new), "")
    vowels = r"[^aeiouy]"
    onset = lambda x: F.regexp_extract(x, rf"^({vowels}*)(.*)$", 2)
    ending = lambda x: F.regexp_extract(x, rf"^(.*?)({vowels}*)$", 1)
    return (
        F.when(a == b, "marks").when((onset(a) == onset(b)) & (onset(a) != ""), "onset").when((ending(a) == ending(b)) & (ending(a) != ""), "ending")
        .when(F.levenshtein(a, b) <= 1, "edit").otherwise("other")
    )


def observed_channel(queries: DataFrame, substitutions: DataFrame, rate: float, seed: str = "1") -> DataFrame:
    """(qid, text, changed): words replaced as often as ``rate`` asks by what versions have for them, in the observed shares.

    ``substitutions`` is (old, new); words that no version replaced stay.
    """
    counts = substitutions.groupBy("old", "new").agg(F.count("*").alias("n"))
    order = Window.partitionBy("old").orderBy("new")
    total = F.sum("n").over(Window.partitionBy("old"))
    ranges = counts.select("old", "new", (F.sum("n").over(order) - F.col("n")).alias("lo"), F.sum("n").over(order).alias("hi"), total.alias("total"))
    words = queries.select("qid", F.posexplode(tokens(F.col("text"))).alias("at", "w"))
    place = F.concat_ws(":", F.col("qid").cast("string"), F.col("at").cast("string"))
    drawn = words.withColumn("u", unit_hash(place, seed + "u")).withColumn("hit", unit_hash(place, seed + "hit") < rate)
    asked = drawn.where("hit").join(ranges, F.col("w") == F.col("old")).where((F.col("u") * F.col("total") >= F.col("lo")) & ((F.col("u") * F.col("total") < F.col("hi")) | (F.col("hi") == F.col("total"))))
    one = asked.groupBy("qid", "at").agg(F.min("new").alias("new"))
    done = words.join(one, ["qid", "at"], "left")
    listed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("new", "w").alias("w"))))
    return done.groupBy("qid").agg(F.array_join(F.transform(listed, lambda s: s["w"]), " ").alias("text"), F.count("new").alias("changed"))


def mark_use(posts: DataFrame, low: float = 0.05, high: float = 0.3) -> DataFrame:
    """(id, share, class): none, partly or fully, by the share of a post's words with marks; empty: no word."""
    w = tokens(F.col("text"))
    share = F.when(F.size(w) > 0, F.size(F.filter(w, has_marks)) / F.size(w))
    rows = posts.select("id", F.round(share, 6).alias("share"))
    return rows.withColumn("class", F.when(F.col("share").isNull(), "empty").when(F.col("share") < low, "none").when(F.col("share") < high, "partly").otherwise("fully"))


def one_per_group(fragments: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, text, split): fragments with the split of their group, one a group, the one with the least hash."""
    own = fragments.join(groups, "doc_id")
    order = Window.partitionBy("cluster").orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")), "doc_id")
    return own.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "text", split_of(F.col("cluster").cast("string")).alias("split"))


def sampled_items(items: DataFrame, n: int, template: str, salt: str = "sample") -> DataFrame:
    """(id, place, prompt): the first ``n`` items in the order of hashes, so that a larger sample holds a smaller one."""
    key = F.md5(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")))
    first = items.withColumn("key", key).orderBy("key", "id").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("key", "id"))).select("id", "place", F.format_string(template, "text").alias("prompt"))  # n rows


def reattached(queries: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, doc_id, outcome) after a rebuild: kept where the document still has its text, moved to the least document
    that has it now, dropped where none does. ``old`` and ``new`` are (doc_id, hash)."""
    was = queries.join(old, "doc_id", "left")
    same = new.select("doc_id", F.col("hash").alias("now"))
    moved = new.groupBy("hash").agg(F.min("doc_id").alias("other"))
    both = was.join(same, "doc_id", "left").join(moved, "hash", "left")
    outcome = F.when(F.col("hash") == F.col("now"), "kept").when(F.col("other").isNotNull(), "moved").otherwise("dropped")
    target = F.when(F.col("hash") == F.col("now"), F.col("doc_id")).otherwise(F.col("other"))
    return both.select("qid", target.alias("doc_id"), outcome.alias("outcome"))


def version_similarity(pairs: DataFrame) -> DataFrame:
    """(id, similarity): Jaccard similarity of the plain word sets of two versions (id, a, b)."""
    a, b = F.array_distinct(plain_tokens(F.col("a"))), F.array_distinct(plain_tokens(F.col("b")))
    union = F.size(F.array_union(a, b))
    return pairs.select("id", F.round(F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0), 6).alias("similarity"))
