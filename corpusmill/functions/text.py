"""Text scalars and analyzers as Column expressions.

All of them stay inside the engine. Marks are removed with a table built by rule from the Unicode
database (composed letters, both cases), so no Python runs per row.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tone marks of Vietnamese in decomposed text: grave, acute, hook, tilde, dot below.
TONES = {"huyen": "̀", "sac": "́", "hoi": "̉", "nga": "̃", "nang": "̣"}


def _composed_letters() -> list[str]:
    blocks = (range(0xC0, 0x250), range(0x1E00, 0x1F00))
    return [chr(c) for block in blocks for c in block if unicodedata.category(chr(c)).startswith("L")]


def _without(letter: str, marks: set[str] | None) -> str:
    kept = [c for c in unicodedata.normalize("NFD", letter) if not (unicodedata.category(c) == "Mn" if marks is None else c in marks)]
    return unicodedata.normalize("NFC", "".join(kept))


def _table(marks: set[str] | None) -> tuple[str, str]:
    pairs = [(c, _without(c, marks)) for c in _composed_letters()]
    if marks is None:
        pairs += [("đ", "d"), ("Đ", "D")]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKS, _NO_TONES = _table(None), _table(set(TONES.values()))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def clean(x: Column) -> Column:
    """Lower case, every sign that is no letter, digit or space to a space, spaces collapsed; null stays null."""
    plain = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def strip_marks(x: Column) -> Column:
    """Composed letters without their marks, đ as d."""
    return F.translate(x, *_MARKS)


def strip_tones(x: Column) -> Column:
    """Letters keep their shape marks and lose the five tone marks."""
    return F.translate(x, *_NO_TONES)


def has_marks(x: Column) -> Column:
    return x != strip_marks(x)


def tone_of(x: Column) -> Column:
    """Name of the first tone mark in a word, null if there is none."""
    shaped = {n: "".join(c for c in _composed_letters() if m in unicodedata.normalize("NFD", c)) for n, m in TONES.items()}
    every = "".join(shaped.values())
    first = F.regexp_extract(x, f"([{every}])", 1)
    out = F.lit(None).cast("string")
    for name, letters in shaped.items():
        out = F.when((first != "") & F.lit(letters).contains(first), F.lit(name)).otherwise(out)
    return out


def swap_tone(x: Column, old: str, new: str) -> Column:
    """The word with one tone mark put for another."""
    pairs = []
    for c in _composed_letters():
        parts = unicodedata.normalize("NFD", c)
        if TONES[old] in parts:
            other = unicodedata.normalize("NFC", parts.replace(TONES[old], TONES[new]))
            if len(other) == 1:
                pairs.append((c, other))
    return F.translate(x, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def tokens(x: Column) -> Column:
    """Words of the cleaned text, in order; empty for null."""
    return F.coalesce(F.filter(F.split(clean(x), " "), lambda t: t != ""), F.array().cast("array<string>"))


def plain_tokens(x: Column) -> Column:
    return F.coalesce(F.filter(F.split(strip_marks(clean(x)), " "), lambda t: t != ""), F.array().cast("array<string>"))


def _runs(words: Column, n: int, sep: str) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), sep))


def ngrams(words: Column, n: int, sep: str = "_") -> Column:
    """Runs of ``n`` words; none if there are fewer."""
    return let(words, lambda w: _runs(w, n, sep))


def with_bigrams(words: Column) -> Column:
    return let(words, lambda w: F.concat(w, _runs(w, 2, "_")))


def _substrings(x: Column, n: int) -> Column:
    """All substrings of ``n`` letters; the whole of a shorter one."""
    return F.when(F.length(x) <= n, F.array(x)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, n))
    )


def char_ngrams_padded(words: Column, n: int) -> Column:
    """Character n-grams inside each word between # signs; a word too short for one gives itself."""
    padded = F.transform(words, lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    return F.flatten(F.transform(padded, lambda p: _substrings(p, n)))


def char_ngrams_across(words: Column, n: int) -> Column:
    """Character n-grams of the words joined by _; a text too short for one gives itself, none gives none."""
    letters = F.filter(F.split(F.array_join(words, "_"), ""), lambda c: c != "")
    return let(
        letters,  # an array has constant-time access, a string has not
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) <= n, F.array(F.array_join(w, ""))).otherwise(_runs(w, n, "")),
    )


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of ``k`` words; the whole sequence if it is no longer; none for no word."""
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) <= k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(_runs(w, k, " "))),
    )


def norm_title(x: Column) -> Column:
    """A title without bracketed parts and version words, cleaned, without marks."""
    bare = F.regexp_replace(x, r"\([^)]*\)|\[[^\]]*\]", " ")
    bare = F.regexp_replace(F.lower(bare), r"\b(remix|cover|version|ver|live|acoustic|karaoke|beat)\b", " ")
    return strip_marks(clean(bare))


def title_parts(x: Column) -> Column:
    """Normalised parts of a title that names several, empty parts left out."""
    parts = F.split(x, r"\s+[xX]\s+|\s+vs\.?\s+|\s*[+&/,|]\s*|\s+-\s+")
    return F.filter(F.transform(parts, norm_title), lambda p: p != "")


def counted(words: Column) -> Column:
    """(term, tf) of each distinct word of an array, in order."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment in cleaned texts."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def scrub(x: Column) -> Column:
    """E-mail addresses, links to user pages, user mentions and telephone numbers replaced by their kind."""
    out = F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"https?://\S*/(?:user|u|profile)/\S+", "[profile]")
    out = F.regexp_replace(out, r"(?:^|\s)(?:@|/?u/)[A-Za-z0-9_.-]{3,}", " [user]")
    return F.regexp_replace(out, r"\+?[0-9][0-9 ().-]{7,}[0-9]", "[phone]")


def slug(x: Column, size: int = 60) -> Column:
    """Letters and digits of the plain text joined by hyphens, cut, never empty."""
    s = F.regexp_replace(strip_marks(F.lower(x)), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, size), r"-+$", "")
    return F.when(s == "", F.lit("item")).otherwise(F.coalesce(s, F.lit("item")))


def unit_hash(key: Column, salt: str) -> Column:
    """A number in 0..1 from the first 32 bits of md5 of salt:key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key)), 1, 8), 16, 10).cast("double") / 4294967295.0


def split_of(key: Column, salt: str = "split") -> Column:
    """train, dev or test in shares of 70, 10 and 20 percent, the same for a key at all times."""
    u = unit_hash(key, salt)
    return F.when(u < 0.7, "train").when(u < 0.8, "dev").otherwise("test")


def id60(x: Column) -> Column:
    """A positive 60-bit number from sha1."""
    return F.conv(F.substring(F.sha1(x), 1, 15), 16, 10).cast("long")


def share_of(words: Column, pattern: str) -> Column:
    """Share of words that match; 0 for none."""
    hits = F.size(F.filter(words, lambda w: w.rlike(pattern)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))
