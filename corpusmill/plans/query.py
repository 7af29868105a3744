"""Query understanding over all chat turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import query
from corpusmill.operators.query import IntentRule, TopicRule
from corpusmill.sources.views import WITH, once, pages

CORRECTIONS = {"retial": "retail", "whta": "what", "number of brith": "number of births"}
RULES = [
    IntentRule("SMALLTALK", ("hello", "thanks", "გამარჯობა")),
    IntentRule("COMPARE", ("compare", "versus", "შეადარე")),
    IntentRule("DEFINITION", ("definition", "mean", "რას ნიშნავს")),
    IntentRule("LATEST", ("latest", "new", "ბოლო")),
    IntentRule("STATISTICAL", ("how many", "number", "rate", "რამდენი"), ("where", "page")),
    IntentRule("NAVIGATION", ("where", "page", "show", "სად")),
]
TERMS = [(["births", "დაბადებ"], ["birth statistics", "დაბადებულთა რაოდენობა"]), (["export", "import"], ["foreign trade", "საგარეო ვაჭრობა"])]
TOPICS = [
    TopicRule("population", any_of=("birth", "death", "marriage", "დაბადებ"), none_of=("export",)),
    TopicRule("trade", any_of=("export", "import", "turnover")),
    TopicRule("prices", all_of=("price",)),
    TopicRule("labour", any_of=("wage", "unemployment", "ხელფას")),
]
TYPES = ["INDICATOR", "YEAR", "REGION", "ORGANIZATION", "INDEX_CODE"]


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return once(spark, root, "chat_turn", "id", "user_message")


def query_intents(spark: SparkSession, root: str) -> DataFrame:
    """(id, corrected, intent, years): what each message asks for."""
    q = query.correct_phrases(F.col("user_message"), CORRECTIONS)
    return _turns(spark, root).select("id", q.alias("corrected"), query.intent(q, RULES).alias("intent"), F.array_join(query.years(q).cast("array<string>"), ",").alias("years"))


def query_expansion(spark: SparkSession, root: str) -> DataFrame:
    """(id, expanded, topics): each message with the phrases of its terms, and its topics."""
    q = F.coalesce("user_message", F.lit(""))
    return _turns(spark, root).select("id", query.expand(q, TERMS).alias("expanded"), F.array_join(query.topics(q, TOPICS), ",").alias("topics"))


def spelling_fixes(spark: SparkSession, root: str) -> DataFrame:
    """(word, fixed): messages' words that no English title has, with the title word that is nearest."""
    words = _turns(spark, root).select(F.explode(text.terms(F.col("user_message"), 4)).alias("word"))
    lexicon = pages(spark, root, "title").select(F.explode(text.terms(F.col("title"), 3)).alias("word")).where("word rlike '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("frequency"))
    return query.spelling(words, lexicon)


def entity_parsing(spark: SparkSession, root: str) -> DataFrame:
    """(id, entities): each message's years and itself as a model would list them, parsed."""
    listed = F.concat(
        F.lit('Here: ```json\n{"entities": [{"type": "indicator", "value": "'), F.regexp_replace(F.coalesce("user_message", F.lit("")), r'["\\\n\r\t]', " "), F.lit('", "confidence": 3}, {"type": "YEAR", "value": "'),
        F.element_at(F.concat(query.years(F.col("user_message")).cast("array<string>"), F.array(F.lit("1900"))), 1), F.lit('"}, {"type": "year", "value": "1900"}, {"type": "other", "value": "x"}]}\n```'),
    )
    found = query.entities(listed, TYPES)
    return _turns(spark, root).select("id", F.array_join(F.transform(found, lambda e: F.concat_ws(":", e["type"], e["form"], e["confidence"].cast("string"))), "|").alias("entities"))


def context_budgets(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, budget): what is left for context after a session's messages."""
    rows = once(spark, root, "chat_turn", "id", "session_id", "user_message").groupBy("session_id").agg(F.coalesce(F.sum(F.length("user_message")), F.lit(0)).alias("used"))
    return rows.select("session_id", query.context_budget(F.lit(9000), F.col("used") * 40, F.lit(300)).cast("long").alias("budget"))


def _mentions(column: str, word: str) -> str:
    return f"coalesce(regexp_matches(lower({column}), '\\b{word}\\b'), false)" if word.isascii() else f"coalesce(contains(lower({column}), '{word}'), false)"


def _corrected() -> str:
    out = "user_message"
    for wrong in sorted(CORRECTIONS, key=lambda w: (-len(w), w)):
        out = f"regexp_replace({out}, '{wrong}', '{CORRECTIONS[wrong]}', 'gi')"
    return out


_INTENT = "case " + " ".join("when (" + " or ".join(_mentions("c", w) for w in r.words) + ")" + "".join(f" and not {_mentions('c', w)}" for w in r.unless) + f" then '{r.intent}'" for r in RULES) + " else 'LOOKUP' end"
_EXPAND = "concat_ws(' ', " + "m, " + ", ".join("case when " + " or ".join(f"contains(lower(m), '{t}')" for t in triggers) + " then '" + " ".join(phrases) + "' end" for triggers, phrases in TERMS) + ")"
_TOPIC = "array_to_string(list_filter([" + ", ".join(
    "case when " + " and ".join([*(f"contains(lower(m), '{w}')" for w in r.all_of), *(["(" + " or ".join(f"contains(lower(m), '{w}')" for w in r.any_of) + ")"] if r.any_of else []), *(f"not contains(lower(m), '{w}')" for w in r.none_of)]) + f" then '{r.topic}' end" for r in TOPICS
) + "], lambda t: t is not null)[1:3], ',')"

QUERIES = {f.__name__: f for f in (query_intents, query_expansion, spelling_fixes, entity_parsing, context_budgets)}
SQL = {
    "query_intents": WITH + f", c as (select id, {_corrected()} as c from turns) select id, c as corrected, {_INTENT} as intent, array_to_string(list_filter(list_distinct(regexp_extract_all(coalesce(c, ''), '[0-9]{{4}}')), lambda y: y::int between 1950 and 2039), ',') as years from c",
    "query_expansion": WITH + f", q as (select id, coalesce(user_message, '') as m from turns) select id, {_EXPAND} as expanded, {_TOPIC} as topics from q",
    "spelling_fixes": WITH + ", w as (select distinct unnest(list_filter(regexp_split_to_array(lower(user_message), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 4)) as word from turns), l as (select word, count(*) as frequency from (select id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3))) as word from pages) where regexp_matches(word, '^[a-z]+$') group by word), u as (select word from w where regexp_matches(word, '^[a-z]+$') and word not in (select word from l)) select u.word, l.word as fixed from u join l on levenshtein(u.word, l.word) <= 2 qualify row_number() over (partition by u.word order by levenshtein(u.word, l.word), frequency desc, l.word) = 1",
    "context_budgets": WITH + "select session_id, cast(least(12000, greatest(1500, 28000 - 500 - 9000 - coalesce(sum(length(user_message)), 0) * 40 - 300)) as bigint) as budget from turns group by 1",
}
