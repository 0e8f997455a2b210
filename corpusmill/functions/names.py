"""Names, titles, times and answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let, plain_tokens, strip_marks

# Words that mark a title as several pieces in one.
COMPILATION = ("mashup", "mashub", "mash up", "medley", "liên khúc", "lien khuc", "lk")
# What stands in a name field where no name is known.
NO_NAME = ("nhạc ngoại", "nhac ngoai", r"nhạc \S+ lời việt", "nhiều tác giả", "sưu tầm", "suu tam", "đang cập nhật", "n/?a", "không rõ", "unknown", "various artists?")
# What stands between names.
BETWEEN = r"\s*[,;/&]\s*|\s+(?:ft\.?|feat\.?|x|và)\s+"
# Cyrillic and Greek letters that look like Latin ones, and hooked letters used as ornament.
LOOKALIKES = ("авеікмнорстухјѕοναρτ", "abeikmhopctyxjsovapt")
ORNAMENTS = ("ƝɲƁɓƊɗƐɛÐð", "NnBbDdEeĐđ")
# The initial consonants of Vietnamese syllables, longest first.
ONSETS = ("ngh", "ng", "nh", "ch", "tr", "th", "ph", "kh", "gh", "gi", "qu", *"bcdđghklmnpqrstvx")

_EDGE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def is_compilation(title: Column) -> Column:
    """Whether a title names a mix of several pieces; false for null."""
    return F.coalesce(F.lower(title).rlike(_EDGE[0] + "(?:" + "|".join(COMPILATION) + ")" + _EDGE[1]), F.lit(False))


def known_name(x: Column) -> Column:
    """The name, or an empty string where it only says that none is known, or is null."""
    return F.when(F.lower(F.trim(x)).rlike("^(?:" + "|".join(NO_NAME) + ")$"), "").otherwise(F.coalesce(x, F.lit("")))


def split_names(x: Column) -> Column:
    """The names in a field, in order; empty for null."""
    parts = F.filter(F.transform(F.split(x, "(?i)" + BETWEEN), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def credits(author: Column, performers: Column) -> Column:
    """Authors and performers in one string; a name is listed once, whatever its case."""
    names = F.concat(split_names(known_name(author)), split_names(performers))
    seen = F.aggregate(
        names, F.array().cast("array<string>"),
        lambda a, n: F.when(F.exists(a, lambda o: F.lower(o) == F.lower(n)), a).otherwise(F.array_append(a, n)),
    )
    return F.array_join(seen, ", ")


def base_title(x: Column) -> Column:
    """A title without bracketed parts and without what follows a spaced dash, plain and in small letters."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(F.regexp_replace(x, r"\([^)]*\)|\[[^\]]*\]|\s+[-–—]\s.*$", " "))), r"\s+", " "))


def without_filler(x: Column, fillers: tuple[str, ...]) -> Column:
    """A text without any of ``fillers`` at its start, however many stand there."""
    return F.regexp_replace(x, r"(?i)^(?:(?:" + "|".join(sorted(fillers, key=len, reverse=True)) + r")[\s,:]+)+", "")


def holds_name(text: Column, name: Column) -> Column:
    """Whether the plain words of a text hold two neighbouring words of a name, or its only word if that has four letters."""
    padded = F.concat(F.lit(" "), F.array_join(plain_tokens(text), " "), F.lit(" "))
    pad = lambda *w: F.concat(F.lit(" "), F.concat_ws(" ", *w), F.lit(" "))
    pairs = lambda w: F.exists(F.sequence(F.lit(1), F.size(w) - 1), lambda i: padded.contains(pad(F.element_at(w, i), F.element_at(w, i + 1))))
    return let(plain_tokens(name), lambda w: F.when(F.size(w) == 0, False).when(F.size(w) == 1, (F.length(w[0]) >= 4) & padded.contains(pad(w[0]))).otherwise(pairs(w)))


def cut(x: Column, most: int) -> Column:
    """The text in one line, cut after the last whole word that leaves room for an ellipsis."""
    line = F.trim(F.regexp_replace(x, r"\s+", " "))
    head = F.regexp_replace(F.substring(line, 1, most), r"\s+\S*$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(head, F.lit("…")))


def page_title(title: Column, by: Column, site: str, most: int = 60) -> Column:
    """Title, name and site; without the site, then without the name, where that is too long."""
    full, short = F.concat_ws(" - ", title, F.nullif(by, F.lit("")), F.lit(site)), F.concat_ws(" - ", title, F.nullif(by, F.lit("")))
    return F.when(F.length(full) <= most, full).when(F.length(short) <= most, short).otherwise(cut(title, most))


def utc_time(x: Column) -> Column:
    """Epoch seconds, or ISO time with an offset (none: UTC), as ISO time in UTC; null if it is neither."""
    iso = F.regexp_replace(F.trim(x), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    at = F.when(F.trim(x).rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(F.trim(x).cast("double"))).otherwise(
        F.try_to_timestamp(F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z"))))
    )
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def wait_seconds(x: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks to wait, a number or an HTTP date; null if it is neither."""
    date = F.regexp_replace(F.regexp_replace(F.trim(x), "^[A-Za-z]{3}, ", ""), " GMT$", "")
    until = F.try_to_timestamp(date, F.lit("dd MMM yyyy HH:mm:ss"))
    number = F.when(F.trim(x).rlike(r"^\d+$"), F.trim(x).cast("long"))
    return F.coalesce(number, F.greatest(F.lit(0), F.unix_timestamp(until) - F.unix_timestamp(now)))


def described(x: Column) -> Column:
    """(title, names, year) of a description such as "title · name · Song · 2019"; fields are null where they are missing."""
    parts = F.transform(F.split(x, r"\s*·\s*"), lambda p: F.trim(p))
    kind = F.array_position(F.transform(parts, lambda p: F.lower(p)), "song").cast("int")
    year = F.nullif(F.regexp_extract(F.element_at(parts, -1), r"^(\d{4})$", 1), F.lit(""))
    names = F.when(kind > 2, F.slice(parts, 2, F.greatest(kind - 2, F.lit(0))))
    return F.struct(F.when(kind > 0, parts[0]).alias("title"), F.array_join(names, ", ").alias("names"), year.cast("int").alias("year"))


def first_answer(x: Column) -> Column:
    """The first line with text of a model's answer, without a leading label, quotes and list marks."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    bare = F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^(?:[-*•]\s*|\d+[.)]\s*)|^(?i:answer|query)\s*:\s*", "")
    return F.regexp_replace(bare, r"^[\"'“”]+|[\"'“”]+$", "")


def guesses(x: Column, most: int = 5) -> Column:
    """Titles of a numbered list, each line's text before " - " or " by ", ``most`` at most."""
    lines = F.filter(F.split(x, "\n"), lambda s: s.rlike(r"^\s*\d+[.)]\s*\S"))
    titles = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), r"^\d+[.)]\s*", ""), r"\s+(?:-|–|by)\s.*$", ""))
    return F.slice(F.transform(titles, lambda t: F.regexp_replace(t, r"^[\"“]+|[\"”]+$", "")), 1, most)


def choice(x: Column, options: int) -> Column:
    """The first number of an answer that is one of ``options``; null if there is none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b(\d{1,3})\b")), lambda s: s.cast("int"))
    return F.try_element_at(F.filter(found, lambda n: (n >= 1) & (n <= options)), F.lit(1))


def split_onset(x: Column) -> Column:
    """(onset, rest) of a syllable; an empty onset where it begins with a vowel."""
    pattern = "^(" + "|".join(ONSETS) + ")?(.*)$"
    return F.struct(F.regexp_extract(x, pattern, 1).alias("onset"), F.regexp_extract(x, pattern, 2).alias("rest"))


def latin_words(x: Column) -> Column:
    """Words that mix Latin with other letters get the Latin letters that theirs look like; other words stay."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.when(w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), F.translate(w, *LOOKALIKES)).otherwise(w)), " ")


def plain_letters(x: Column) -> Column:
    """Ornamental letters as plain ones."""
    return F.translate(x, *ORNAMENTS)


def candidate_probability(similarity: Column, rows: int, bands: int) -> Column:
    """Chance that two sets of a similarity share a band of MinHash rows."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(rows))), F.lit(float(bands)))


def joined_fields(*fields: Column) -> Column:
    """Fields that hold text, one after the other."""
    return F.concat_ws(" ", *(F.nullif(F.trim(f), F.lit("")) for f in fields))
