"""What a page shows of itself: leads, summaries, excerpts of answers. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text

LEAD_LEAST, SUMMARY_MOST = 40, 320


def letters(value: Column) -> Column:
    return text.count_matches(value, r"\p{L}")


def is_display_boilerplate(value: Column, markers: list[str]) -> Column:
    """Null and blank texts, those that start with a closing sign and those that hold a marker, whatever the case."""
    plain = F.lower(text.collapse(value))
    rule = plain.startswith("×")
    for marker in markers:
        rule = rule | F.contains(plain, F.lit(marker.lower()))
    return F.coalesce(rule | (plain == ""), F.lit(True))


def lead_paragraph(body: Column, markers: list[str], least: int = LEAD_LEAST) -> Column:
    """The first paragraph of at least ``least`` characters, half of them letters, that is no boilerplate; else null."""
    parts = F.transform(F.split(body, r"\n+"), text.collapse)
    good = F.filter(parts, lambda p: (F.length(p) >= least) & (letters(p) >= least // 2) & ~is_display_boilerplate(p, markers))
    return F.try_element_at(good, F.lit(1))


def trimmed_summary(value: Column, most: int = SUMMARY_MOST) -> Column:
    """Trimmed, at most ``most`` characters; null if nothing is left."""
    plain = F.trim(F.substring(F.trim(value), 1, most))
    return F.when(plain != "", plain)


def duplicates_title(value: Column, title: Column, most: int = 24) -> Column:
    """Is a text its title over again: equal but for case, or one starts with the other and is at most ``most`` longer?"""
    a, b = F.lower(F.trim(value)), F.lower(F.trim(title))
    same = (a == b) | ((F.abs(F.length(a) - F.length(b)) <= most) & (a.startswith(b) | b.startswith(a)))
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def without_partial_word(value: Column, short: int = 3, least: int = 24) -> Column:
    """Without a first word that looks cut, of up to ``short`` characters or without a vowel, if at least ``least``
    characters are left."""
    first = F.regexp_extract(value, r"^([^ ]*) ", 1)
    rest = F.regexp_replace(value, r"^[^ ]* ", "")
    partial = value.contains(" ") & ((F.length(first) <= short) | ~first.rlike("[აეიოუaeiouAEIOU]")) & (F.length(rest) >= least)
    return F.when(partial, rest).otherwise(value)


def looks_like_prose(value: Column) -> Column:
    """At least 20 letters, or 4 with 4 digits; never below 10 characters."""
    n, digits = letters(value), text.count_matches(value, r"\p{Nd}")
    return F.coalesce((F.length(value) >= 10) & ((n >= 20) | ((digits >= 4) & (n >= 4))), F.lit(False))


def content_excerpt(value: Column, title: Column, markers: list[str], size: int = 240) -> Column:
    """What a link shows of a chunk: prose without a cut first word, unless it is boilerplate or repeats the title."""
    plain = text.collapse(value)
    whole = without_partial_word(plain)
    fine = ~is_display_boilerplate(plain, markers) & looks_like_prose(plain) & ~duplicates_title(whole, title)
    return F.when(fine, text.excerpt(whole, size))


def intro_so_far(buffer: Column, field: str = "intro") -> Column:
    """The value of a string field in JSON that is still being written, as far as it is there, without its escapes; null
    before the value begins. A backslash at the end, whose character is yet to come, is left out."""
    raw = F.regexp_extract(buffer, rf'(?s)"{field}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    there = buffer.rlike(rf'(?s)"{field}"\s*:\s*"')
    whole = F.regexp_replace(F.regexp_replace(raw, r"\\u[0-9a-fA-F]{0,3}$", ""), "\n", r"\\\\n")
    return F.when(there, F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), whole, F.lit('"}')), "$.v"), F.lit("")))


def curated_label(payload: Column, language: str, own: Column) -> Column:
    """The label a curation's JSON gives for a language, else the own one."""
    return F.coalesce(text.first_non_blank(F.get_json_object(payload, f"$.label{language.capitalize()}")), own)
