"""Query understanding: spelling, intent, entities, expansion, topics and prompt budgets. Word lists are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.catalog import first_per_group


def correct_phrases(query: Column, corrections: dict[str, str]) -> Column:
    """Each phrase replaced, whatever its case, the longest first."""
    for wrong in sorted(corrections, key=lambda w: (-len(w), w)):
        escaped = "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in wrong)
        query = F.regexp_replace(query, f"(?i){escaped}", corrections[wrong].replace("$", r"\$"))
    return query


def _deletes(word: Column) -> Column:
    """The word and what is left of it without any one and any two of its letters."""
    single = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), w.substr(i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(word), single(word), F.flatten(F.transform(F.filter(single(word), lambda w: F.length(w) > 0), single))))


def spell_lexicon(texts: DataFrame, overlay: DataFrame) -> DataFrame:
    """(word, frequency) of the Latin words of ``texts`` (text), in how many of them; words of ``overlay`` (word, frequency)
    count as there."""
    counted = texts.select(F.explode(text.terms(F.col("text"), 2)).alias("word")).where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count("*").alias("frequency"))
    both = counted.join(overlay.select(F.lower("word").alias("word"), F.col("frequency").alias("given")).groupBy("word").agg(F.max("given").alias("given")), "word", "full")
    return both.select("word", F.coalesce("given", "frequency").cast("long").alias("frequency"))


def spelling(words: DataFrame, lexicon: DataFrame, distance: int = 2, least: int = 4) -> DataFrame:
    """(word, fixed) of ``words`` (word), Latin ones of at least ``least`` letters that ``lexicon`` (word, frequency)
    does not have: its nearest word within ``distance`` edits, then the most frequent, then the first. Words meet by an
    equi-join on what is left after deletions, so no word is held against all others."""
    distinct = words.select(F.lower("word").alias("word")).distinct()
    unknown = distinct.where(F.col("word").rlike("^[a-z]+$") & (F.length("word") >= least)).join(lexicon.select("word"), "word", "left_anti")
    left = unknown.select("word", F.explode(_deletes(F.col("word"))).alias("key"))
    right = lexicon.where(F.length("word") >= least - distance).select(F.col("word").alias("fixed"), "frequency", F.explode(_deletes(F.col("word"))).alias("key"))
    near = left.join(right, "key").select("word", "fixed", "frequency").distinct().withColumn("edits", F.levenshtein("word", "fixed")).where(F.col("edits") <= distance)
    return first_per_group(near, ["word"], [F.asc("edits"), F.desc("frequency"), F.asc("fixed")]).select("word", "fixed")


@dataclass(frozen=True)
class IntentRule:
    """The intent of queries that mention any of the words, unless they mention one of those in ``unless``."""

    intent: str
    words: tuple[str, ...]
    unless: tuple[str, ...] = ()


def intent(query: Column, rules: list[IntentRule], otherwise: str = "LOOKUP") -> Column:
    """The first rule that fits."""
    out = F.lit(otherwise)
    for rule in reversed(rules):
        fits = F.lit(False)
        for word in rule.words:
            fits = fits | text.mentions(query, word)
        for word in rule.unless:
            fits = fits & ~text.mentions(query, word)
        out = F.when(fits, rule.intent).otherwise(out)
    return out


def years(query: Column, low: int = 1950, high: int = 2039) -> Column:
    """The distinct years a query names, in order."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"(?:^|[^0-9])([0-9]{4})(?=[^0-9]|$)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(low, high)))


def expand(query: Column, terms: list[tuple[list[str], list[str]]]) -> Column:
    """The query, then the phrases of each entry (triggers, phrases) of which it has a trigger, each once."""
    added = F.array().cast("array<string>")
    for triggers, phrases in terms:
        hit = F.lit(False)
        for trigger in triggers:
            hit = hit | F.contains(F.lower(query), F.lit(trigger.lower()))
        added = F.concat(added, F.when(F.coalesce(hit, F.lit(False)), F.array(*map(F.lit, phrases))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(F.concat(F.array(query), added)), " ")


@dataclass(frozen=True)
class TopicRule:
    """A topic whose texts have all of one list of words, any of another and none of a third."""

    topic: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()


def topics(query: Column, rules: list[TopicRule], most: int = 3) -> Column:
    """The first ``most`` topics whose rules fit, in their order."""
    low = F.coalesce(F.lower(query), F.lit(""))
    found = []
    for rule in rules:
        fits = F.lit(True)
        for word in rule.all_of:
            fits = fits & F.contains(low, F.lit(word))
        if rule.any_of:
            some = F.lit(False)
            for word in rule.any_of:
                some = some | F.contains(low, F.lit(word))
            fits = fits & some
        for word in rule.none_of:
            fits = fits & ~F.contains(low, F.lit(word))
        found.append(F.when(fits, rule.topic))
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def model_json(answer: Column) -> Column:
    """The JSON in a model's answer: a fenced block, else from the first to the last bracket."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*([\[{].*[\]}])\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)([\[{].*[\]}])", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


ENTITY = "array<struct<type: string, value: string, normalizedForm: string, confidence: double>>"


def entities(answer: Column, types: list[str]) -> Column:
    """The entities a model's answer lists: known types, years within 1990 to 2030, the value as normal form where none
    is given, confidence within [0, 1] and 1 where none is given; the first of those with one type and normal form."""
    body = model_json(answer)
    listed = F.when(body.startswith("["), F.from_json(body, ENTITY)).otherwise(F.from_json(body, f"struct<entities: {ENTITY}>")["entities"])
    plain = F.transform(
        listed,
        lambda e: F.struct(
            F.upper(F.trim(e["type"])).alias("type"), F.trim(e["value"]).alias("value"), F.coalesce(text.first_non_blank(e["normalizedForm"]), F.trim(e["value"])).alias("form"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(e["confidence"], F.lit(1.0)))).alias("confidence"),
        ),
    )
    year = lambda e: F.regexp_replace(e["value"], "[^0-9]", "").try_cast("int")
    good = F.filter(plain, lambda e: e["type"].isin(types) & (e["value"] != "") & ((e["type"] != "YEAR") | year(e).between(1990, 2030)))
    keys = F.transform(good, lambda e: F.concat_ws("|", e["type"], F.lower(e["form"])))
    numbered = F.transform(good, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda x: F.array_position(keys, F.concat_ws("|", x["e"]["type"], F.lower(x["e"]["form"]))) == x["i"] + 1), lambda x: x["e"])


def merged_entities(first: Column, second: Column) -> Column:
    """Two lists of strings as one, the first's order first, each once whatever its case."""
    both = F.concat(first, second)
    low = F.transform(both, F.lower)
    return F.transform(F.filter(F.transform(both, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: F.array_position(low, F.lower(x["e"])) == x["i"] + 1), lambda x: x["e"])


# What a chat does for each intent.
CHAT_INTENTS = {
    "NAVIGATION": "NAVIGATE", "SMALLTALK": "CLARIFY", "STATISTICAL": "DATA_REQUEST", "COMPARE": "CONCEPT", "DEFINITION": "CONCEPT",
    "FACTUAL": "CONCEPT", "LATEST": "CONCEPT", "LOOKUP": "CONCEPT",
}


def chat_intent(intent_: Column) -> Column:
    """What a chat does for an intent; for none, or one that is not known, it explains."""
    out = F.lit("CONCEPT")
    for name, does in CHAT_INTENTS.items():
        out = F.when(intent_ == name, does).otherwise(out)
    return out


@dataclass(frozen=True)
class SmallTalk:
    """The answers to messages of up to ``most`` characters, 0 for any, that mention a pattern."""

    patterns: tuple[str, ...]
    ka: str
    en: str
    most: int = 0


def small_talk(message: Column, georgian: Column, groups: list[SmallTalk]) -> Column:
    """The first fitting group's answer in the message's language; null if none fits."""
    out = F.lit(None).cast("string")
    for group in reversed(groups):
        fits = F.lit(False)
        for pattern in group.patterns:
            fits = fits | text.mentions(message, pattern)
        if group.most:
            fits = fits & (F.length(message) <= group.most)
        out = F.when(fits, F.when(georgian, group.ka).otherwise(group.en)).otherwise(out)
    return out


@dataclass(frozen=True)
class PortalLists:
    """Words of messages that ask for lists of portals."""

    portals: tuple[str, ...]
    calculators: tuple[str, ...]
    requests: tuple[str, ...]
    excluded: tuple[str, ...]
    most: int


def asks_for_portals(message: Column, words: PortalLists) -> Column:
    """Does a message ask for a list, or name portals or calculators in a few characters, and nothing that is excluded?"""

    def any_of(listed: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for word in listed:
            out = out | text.mentions(message, word)
        return out

    short = (any_of(words.portals) | any_of(words.calculators)) & (F.length(message) < words.most)
    return F.coalesce(~any_of(words.excluded) & (any_of(words.requests) | short), F.lit(False))


@dataclass(frozen=True)
class Indicator:
    """An entity that queries with any of the triggers mean."""

    triggers: tuple[str, ...]
    form: str
    type: str = "INDICATOR"


def hinted_entities(query: Column, indicators: list[Indicator]) -> Column:
    """(type, form, confidence) of the indicators a query has a trigger of, then of the years it names, each once."""
    low = F.coalesce(F.lower(query), F.lit(""))
    found = []
    for indicator in indicators:
        hit = F.lit(False)
        for trigger in indicator.triggers:
            hit = hit | F.contains(low, F.lit(trigger.lower()))
        found.append(F.when(hit, F.struct(F.lit(indicator.type).alias("type"), F.lit(indicator.form).alias("form"), F.lit(0.75).alias("confidence"))))
    named = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<type: string, form: string, confidence: double>>")
    both = F.concat(named, F.transform(years(query).cast("array<string>"), lambda y: F.struct(F.lit("YEAR").alias("type"), y.alias("form"), F.lit(0.85).alias("confidence"))))
    keys = F.transform(both, lambda e: F.concat_ws("|", e["type"], F.lower(e["form"])))
    return F.filter(both, lambda e, i: F.array_position(keys, F.concat_ws("|", e["type"], F.lower(e["form"]))) == i + 1)


def retrieval_text(normalized: Column, forms: Column, expansions: Column) -> Column:
    """What is searched for: the query, its entities' forms and its expansions, each once, in this order; '' for a blank
    query."""
    parts = F.filter(F.concat(F.array(normalized), forms, expansions), lambda p: F.trim(p) != "")
    return F.when(F.coalesce(F.trim(normalized), F.lit("")) == "", "").otherwise(F.array_join(F.array_distinct(parts), " "))


def spelled(queries: DataFrame, fixes: DataFrame, least: int = 4) -> DataFrame:
    """(query_id, query, spelled) of ``queries`` (query_id, query): Latin words of at least ``least`` letters replaced by
    their fixes (word, fixed), whatever their case. Each distinct word is looked up once, by an equi-join."""
    words = queries.select("query_id", "query", F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0).alias("parts"))
    wanted = words.select("query_id", F.explode("parts").alias("part")).select("query_id", F.lower("part").alias("word")).where(F.col("word").rlike(f"^[a-z]{{{least},}}$")).distinct()
    known = wanted.join(fixes.select("word", "fixed"), "word").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("fixed"))
    joined = words.join(known, "query_id", "left")
    fixed = F.transform("parts", lambda p: F.coalesce(F.try_element_at("fixed", F.lower(p)), p))
    return joined.select("query_id", "query", F.array_join(fixed, "").alias("spelled"))


def context_budget(system: Column, history: Column, question: Column, total: int = 28_000, most: int = 12_000, least: int = 1_500, margin: int = 500) -> Column:
    """The characters left for retrieved context."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(total - margin) - system - history - question))
