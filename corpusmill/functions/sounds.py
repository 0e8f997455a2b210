"""Syllables by how they sound, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.names import split_onset
from corpusmill.functions.text import let, strip_tones, swap_tone, tokens, with_bigrams

# Onsets and endings that are one sound in Northern or Southern speech, or two spellings of one.
ONSET_SOUNDS = {"x": "s", "ch": "tr", "n": "l", "gi": "d", "r": "d", "v": "d", "k": "c", "q": "c", "qu": "cu", "gh": "g", "ngh": "ng"}
ENDING_SOUNDS = {"ng": "n", "nh": "n", "ch": "t", "c": "t"}
#: The letter y with each tone, and i with the same ones.
_Y, _I = "yýỳỷỹỵ", "iíìỉĩị"


def sound_key(x: Column) -> Column:
    """A key that syllables share if they sound alike: onsets and endings merged, the tone ngã as hỏi, y as i.

    The i of "gi" is the vowel where no other follows ("gì", "gin"). Null stays null.
    """
    sounds = F.create_map(*[F.lit(s) for pair in ONSET_SOUNDS.items() for s in pair])
    vowel = r"^[aăâeêioôơuưy]"

    def keyed(s: Column) -> Column:
        onset, rest = s["onset"], s["rest"]
        bare = strip_tones(rest)
        hidden = (onset == "g") & bare.startswith("i") | (onset == "gi") & ~bare.rlike(vowel)
        tail = F.when((onset == "gi") & ~bare.rlike(vowel), F.concat(F.lit("i"), rest)).otherwise(rest)
        head = F.when(hidden, "d").otherwise(F.coalesce(sounds[onset], onset))
        merged = tail
        for old, new in ENDING_SOUNDS.items():
            if old != "c":
                merged = F.regexp_replace(merged, f"(?<=.){old}$", "~" + new)  # what was merged is not merged again
        merged = F.regexp_replace(F.regexp_replace(merged, "(?<=[^~])c$", "t"), "~", "")
        return F.translate(F.concat(head, merged), _Y, _I)

    return let(split_onset(swap_tone(x, "nga", "hoi")), keyed)


def sound_terms(text: Column) -> Column:
    """Sound keys of a text's words, and their pairs."""
    return with_bigrams(F.transform(tokens(text), sound_key))
