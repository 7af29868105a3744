"""Text columns. All are JVM-side but ``nfkc``, for which Spark has no function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{ad}\x{e000}-\x{f8ff}]"
SPACES = r"[ \t\n\r\f]+"
WORD_SPLIT = r"[^\p{L}\p{N}]+"
# What counts as a sign of statistics in a text.
STATISTICAL_FORMS = [
    r"\d+[.,]?\d*\s*%",
    r"\d+[.,]?\d*\s*(მლნ|ათასი|მილ|ლარი|ტ\.?\s*ც|ათ\.\s*ადამ)",
    r"\d{4}\s*წელ",
    r"\d{1,3}([.,]\d{3})+",
    r"\d+[.,]\d+",
    r"(^|[^\p{L}\p{N}_])\d{2,}($|[^\p{L}\p{N}_])",
    r"\d+[.,]?\d*\s*(million|billion|thousand|GEL|USD|EUR)",
    r"#\d+",
    r"\d+(st|nd|rd|th)($|[^\p{L}\p{N}_])",
]
STATISTICAL = "|".join(STATISTICAL_FORMS).replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition, an Arrow batch at a time."""
    return values.map(lambda s: None if s is None else s if s.isascii() or unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s))


def strip_invisible(text: Column) -> Column:
    """Without zero-width, bidirectional and private-use characters."""
    return F.regexp_replace(text, INVISIBLE, "")


def sanitize(text: Column) -> Column:
    """NFKC, one blank for several, no invisible characters, trimmed; line breaks stay."""
    return F.trim(F.regexp_replace(strip_invisible(nfkc(text)), r"[ \t]{2,}", " "))


def sanitize_block(text: Column) -> Column:
    """``sanitize`` with every run of white space as one blank."""
    return F.trim(F.regexp_replace(strip_invisible(nfkc(text)), SPACES, " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with single blanks; null for null and blank texts."""
    plain = F.lower(collapse(text))
    return F.when(plain != "", F.sha2(plain, 256))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for null and blank texts."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int")))


def count_matches(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def script_language(text: Column, hint: Column | None = None) -> Column:
    """ka or en by which script has more letters; a hint decides ties its way; neither: the hint, else ka."""
    georgian, latin = count_matches(text, "[ა-ჿ]"), count_matches(text, "[A-Za-z]")
    rule = F.when(georgian >= latin, "ka").otherwise("en")
    if hint is None:
        return F.when(F.coalesce(text, F.lit("")) == "", "ka").otherwise(rule)
    plain = F.lower(F.substring_index(hint, "-", 1))
    known = plain.isin("ka", "en")
    empty = (F.coalesce(F.trim(text), F.lit("")) == "") | ((georgian == 0) & (latin == 0))
    return (
        F.when(known & empty, plain).when(empty, "ka").when(known & (plain == "en") & (latin >= georgian), "en").when(known & (plain == "ka") & (georgian >= latin), "ka").otherwise(rule)
    )


# Usual spellings of the languages' names and three-letter codes.
LANGUAGE_NAMES = {
    "ka": ["kat", "geo", "georgian", "ქართული"],
    "en": ["eng", "english", "ინგლისური"],
    "ru": ["rus", "russian", "русский"],
    "de": ["deu", "ger", "german", "deutsch"],
}


def language_code(label: Column) -> Column:
    """The language a label names, without case, blanks and region; a label that is no known spelling stays as it is, null
    and blank ones are null."""
    plain = F.lower(F.trim(F.regexp_replace(label, r"[-_@.(].*$", "")))
    out = F.when(plain != "", plain)
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(plain.isin(names), code).otherwise(out)
    return out


def language_code_sql(label: str) -> str:
    """``language_code`` in SQL."""
    plain = f"lower(trim(regexp_replace({label}, '[-_@.(].*$', '')))"
    cases = " ".join("when {p} in ({n}) then '{c}'".format(p=plain, n=", ".join(f"'{n}'" for n in names), c=code) for code, names in LANGUAGE_NAMES.items())
    return f"(case {cases} else nullif({plain}, '') end)"


def is_statistical(text: Column) -> Column:
    return F.coalesce(text.rlike(STATISTICAL), F.lit(False))


def encoding_mismatch(url: Column, text: Column) -> Column:
    """A Georgian address whose non-blank text has no Georgian letter."""
    return url.contains("/ka/") & (F.coalesce(F.trim(text), F.lit("")) != "") & ~text.rlike("[Ⴀ-ჿⴀ-⴯]")


def excerpt(text: Column, size: int) -> Column:
    """The text up to ``size`` characters, cut back to the last blank beyond the half, with ... if it was cut."""
    plain = collapse(text)
    head = F.substring(plain, 1, size)
    cut = F.regexp_extract(head, r"^(.*) ", 1)
    return F.when(F.length(plain) <= size, plain).otherwise(F.concat(F.when(F.length(cut) > size // 2, cut).otherwise(head), F.lit("...")))


def display_description(meta: Column, lead: Column, title: Column, section: Column, size: int = 240, least: int = 40) -> Column:
    """The first that is long enough of the page's description and lead, else title and section."""
    fallback = F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws(" — ", title, section)).otherwise(title)
    chosen = F.when(F.length(F.trim(meta)) >= least, F.trim(meta)).when(F.length(F.trim(lead)) >= least, F.trim(lead)).otherwise(F.trim(fallback))
    return F.when(F.length(chosen) > size, F.concat(F.substring(chosen, 1, size - 3), F.lit("..."))).otherwise(chosen)


def first_non_blank(*texts: Column) -> Column:
    """The first text that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(t) != "", F.trim(t)) for t in texts))


def terms(text: Column, least: int = 3) -> Column:
    """The distinct words of at least ``least`` characters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD_SPLIT), lambda t: F.length(t) >= least))


def overlap(words: Column, text: Column) -> Column:
    """The share of ``words`` that the text contains as substrings; 0 without words or text."""
    found = F.size(F.filter(words, lambda t: F.contains(F.lower(text), t)))
    return F.when((F.size(words) > 0) & (F.coalesce(F.trim(text), F.lit("")) != ""), found / F.size(words)).otherwise(0.0)


def normalized_query(query: Column, locale: Column) -> Column:
    """NFKC and single blanks; in lower case if the locale is English."""
    plain = collapse(nfkc(query))
    return F.when(F.coalesce(F.lower(locale).startswith("en"), F.lit(False)), F.lower(plain)).otherwise(plain)


def search_patterns(query: Column, most: int = 8) -> Column:
    """The phrase, then its words of 4 characters and, of 5 or more, each with and without the last one."""
    words = F.filter(F.split(F.lower(F.trim(query)), WORD_SPLIT), lambda w: F.length(w) >= 4)
    spread = F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 5, F.array(w, w.substr(F.lit(1), F.length(w) - 1))).otherwise(F.array(w))))
    return F.slice(F.array_distinct(F.concat(F.filter(F.array(F.trim(query)), lambda q: q != ""), spread)), 1, most)


def token_set(text: Column) -> Column:
    """Distinct words of more than two characters of a-z, 0-9 and _."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-zA-Z0-9_]+"), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def strip_markup(text: Column, least: int = 15, fallback: str = "") -> Column:
    """An answer without bulleted links and addresses, markdown links unwrapped; too short a rest gives ``fallback``."""
    plain = F.regexp_replace(text, r"(?m)^\s*[-*•]\s*https?://\S+\s*$", "")
    plain = F.regexp_replace(plain, r"\[([^\]]*)\]\(https?://[^)]*\)", "$1")
    plain = collapse(F.regexp_replace(plain, r"https?://\S+", ""))
    return F.when(F.length(plain) >= least, plain).otherwise(fallback)


def mentions(text: Column, keyword: str) -> Column:
    """ASCII keywords as whole words, others as substrings; null texts mention nothing."""
    escaped = "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in keyword.lower())
    rule = F.lower(text).rlike(rf"\b{escaped}\b") if keyword.isascii() else F.contains(F.lower(text), F.lit(keyword.lower()))
    return F.coalesce(rule, F.lit(False))
