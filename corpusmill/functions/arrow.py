"""Scalar functions that need sequential logic, as Arrow-batched pandas UDFs.

The plain Python functions stand beside them and can be used on the driver and in tests.
"""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment)."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words that both hold."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
        best, row = max(best, max(new)), new
    return best


def matching_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def deletes(word: str, most: int = 1) -> list[str]:
    """The word and all words left when up to ``most`` letters go, sorted."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return sorted(out)


def luhn_score(words: list[str], asked: set[str], gap: int = 4) -> float:
    """Best count^2 / span over groups of asked words at most ``gap`` apart."""
    best, start, last, n = 0.0, None, None, 0
    for i, w in enumerate(words):
        if w not in asked:
            continue
        if last is None or i - last > gap:
            start, n = i, 0
        n, last = n + 1, i
        best = max(best, n * n / (last - start + 1))
    return best


def vbyte(number: int) -> bytes:
    """Seven bits a byte, highest first, the high bit on the last byte."""
    out = [number & 0x7F | 0x80]
    while number := number >> 7:
        out.insert(0, number & 0x7F)
    return bytes(out)


def gamma(number: int) -> str:
    """Elias gamma code of a number from 1."""
    bits = f"{number:b}"
    return "0" * (len(bits) - 1) + bits


# The letters and tone marks of the Telex way of typing.
_SHAPES = {"aa": "â", "ee": "ê", "oo": "ô", "dd": "đ", "aw": "ă", "ow": "ơ", "uw": "ư"}
_TONE_KEYS = {"f": "\u0300", "s": "\u0301", "r": "\u0309", "x": "\u0303", "j": "\u0323"}


def to_telex(word: str) -> str:
    """A marked word as it is typed: shape keys in place, the tone key last."""
    tone, out = "", []
    shapes = {v: k for k, v in _SHAPES.items()}
    keys = {v: k for k, v in _TONE_KEYS.items()}
    for letter in unicodedata.normalize("NFC", word):
        parts = unicodedata.normalize("NFD", letter)
        tone = next((keys[c] for c in parts if c in keys), tone)
        bare = unicodedata.normalize("NFC", "".join(c for c in parts if c not in keys))
        out.append(shapes.get(bare, bare))
    return "".join(out) + tone


#: A syllable as onset (u of qu and i of gi belong to it before a vowel), nucleus and coda.
_SYLLABLE = re.compile(r"(qu(?=[aăâeêioôơy])|gi(?=[aăâeêoôơuư])|[^aăâeêioôơuưy]*)([aăâeêioôơuưy]+)(.*)", re.DOTALL)


def place_tone(word: str, mark: str) -> str:
    """A toneless syllable with its tone mark, by the orthography: a vowel with a shape mark carries it (the second of
    ươ), else the last vowel before a coda, and without one the first of two, the middle of three.

    A word that is no syllable, having no vowel, stays as it is.
    """
    parts = _SYLLABLE.fullmatch(word)
    if parts is None:
        return word
    onset, nucleus, coda = parts.groups()
    shaped = max(map(nucleus.rfind, "ăâêôơư"))
    seat = shaped if shaped >= 0 else len(nucleus) - (1 if coda or len(nucleus) == 1 else 2)
    return unicodedata.normalize("NFC", onset + nucleus[: seat + 1] + mark + nucleus[seat + 1 :] + coda)


def from_telex(word: str) -> str | None:
    """The marked word that was typed, or null if it holds no Telex key."""
    tone = _TONE_KEYS.get(word[-1:], "") if len(word) > 1 else ""
    body = word[:-1] if tone else word
    shaped = re.sub("|".join(_SHAPES), lambda m: _SHAPES[m[0]], body)
    if shaped == body and not tone:
        return None
    return place_tone(shaped, tone) if tone else shaped


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else longest_common_run(list(x), list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else matching_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def delete_keys(word: pd.Series) -> pd.Series:
    return word.map(lambda w: [] if w is None else deletes(w))


@F.pandas_udf(T.DoubleType())
def luhn(words: pd.Series, asked: pd.Series) -> pd.Series:
    return pd.Series([0.0 if w is None or a is None else luhn_score(list(w), set(a)) for w, a in zip(words, asked, strict=True)])


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: "" if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else html.unescape(s))


@F.pandas_udf(T.StringType())
def telex(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else to_telex(s))


@F.pandas_udf(T.StringType())
def untelex(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else from_telex(s))


ALL = {f.func.__name__: f for f in (osa, common_run, ratio, delete_keys, luhn, nfc, unescape, telex, untelex)}


def register(spark) -> None:
    """Make the functions known to SQL under their names."""
    for name, f in ALL.items():
        spark.udf.register(name, f)
