"""Query understanding as one pipeline, catalog matches and what answers show, over all turns, pages and chunks. A corpus
stands in for a topic cluster, and its foremost title word for its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import display, text
from corpusmill.operators import catalog, query, retrieval
from corpusmill.operators.query import Indicator, PortalLists, SmallTalk
from corpusmill.plans.query import RULES, SQL as QUERY_SQL, TERMS, _mentions, spelling_fixes
from corpusmill.plans.query import _INTENT
from corpusmill.session import materialize
from corpusmill.sources.tables import table
from corpusmill.sources.views import WITH, chunks, hits_once, once, pages

INDICATORS = [Indicator(("births", "დაბადებ"), "number of births"), Indicator(("wage", "ხელფას"), "average monthly wage"), Indicator(("price", "ფას"), "consumer price index", "INDEX_CODE"), Indicator(("export",), "export of goods")]
GROUPS = [SmallTalk(("hello", "გამარჯობა"), "გამარჯობა!", "Hello!", 40), SmallTalk(("thanks", "მადლობა"), "არაფრის!", "You are welcome!")]
PORTALS = PortalLists(("portal", "პორტალ"), ("calculator",), ("list", "ჩამონათვალი", "all pages"), ("births",), 60)
MARKERS = ["cookie", "ქუქი", "newsletter", "გამოიწერეთ", "©"]


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return once(spark, root, "chat_turn", "id", "user_message").select("id", F.coalesce("user_message", F.lit("")).alias("message"))


def query_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """(id, spelled, normalized, intent, does, entities, retrieval_text): every message through all steps: spelling, normal
    form, intent, entities, expansion and what is searched for."""
    spelled = query.spelled(_turns(spark, root).toDF("query_id", "query"), spelling_fixes(spark, root))
    normal = text.normalized_query(F.trim("spelled"), text.script_language(F.col("spelled")))
    rows = spelled.select(F.col("query_id").alias("id"), "spelled", normal.alias("normalized"))
    entities, intent = query.hinted_entities(F.col("normalized"), INDICATORS), query.intent(F.col("spelled"), RULES)
    rows = rows.select("*", intent.alias("intent"), entities.alias("found"))
    expansions = F.array(*(F.when(_any(triggers), F.lit(" ".join(phrases))) for triggers, phrases in TERMS))
    searched = query.retrieval_text(F.col("normalized"), F.transform("found", lambda e: e["form"]), F.array_compact(expansions))
    return rows.select("id", "spelled", "normalized", "intent", query.chat_intent(F.col("intent")).alias("does"), F.array_join(F.transform("found", lambda e: F.concat_ws(":", e["type"], e["form"], e["confidence"].cast("string"))), "|").alias("entities"), searched.alias("retrieval_text"))


def _any(triggers: list[str]):
    out = F.lit(False)
    for trigger in triggers:
        out = out | F.contains(F.lower("normalized"), F.lit(trigger))
    return out


def early_exits(spark: SparkSession, root: str) -> DataFrame:
    """(id, answer, portals): messages that small talk answers, and those that ask for lists of portals."""
    m = F.col("message")
    return _turns(spark, root).select("id", query.small_talk(m, text.script_language(m) == "ka", GROUPS).alias("answer"), query.asks_for_portals(m, PORTALS).alias("portals"))


def _keywords(spark: SparkSession, root: str) -> DataFrame:
    rows = pages(spark, root, "corpus_id", text.language_code(F.col("language")).alias("language"), "title").where("language in ('ka', 'en')")
    return materialize(catalog.tfidf(rows.select(F.col("corpus_id").alias("cluster"), "language", F.explode(text.terms(F.col("title"))).alias("keyword")), 30), "cluster-keywords")


def _signals(spark: SparkSession, root: str) -> DataFrame:
    keywords = _keywords(spark, root)
    low = F.lower("message")
    queries = _turns(spark, root).select(F.col("id").alias("query_id"), text.script_language(F.col("message")).alias("language"), low.alias("query"))
    labels = keywords.where("rank = 1").select("cluster", F.col("keyword").alias("label"))
    entity = F.transform(query.hinted_entities(F.col("query"), INDICATORS), lambda e: F.struct(F.lit("entity").alias("kind"), e["form"].alias("form")))
    expansion = F.transform(F.array_compact(F.array(*(F.when(F.contains("query", F.lit(t)), F.lit(t)) for triggers, _ in TERMS for t in triggers))), lambda t: F.struct(F.lit("expansion").alias("kind"), t.alias("form")))
    forms = queries.select("query_id", "language", F.explode(F.concat(entity, expansion)).alias("f")).select("query_id", "language", "f.kind", "f.form")
    return catalog.match_signals(queries, keywords, labels, forms)


def cluster_signals(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, cluster, score, rank): clusters by their four weighted signals."""
    scored = _signals(spark, root).select("query_id", "cluster", F.round(catalog.signal_score(), 6).alias("score")).where("score > 0")
    return catalog.ranked(scored, ["query_id"], [F.desc("score"), F.asc("cluster")], "rank", 5)


def cluster_best(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, cluster, score, rank): clusters by the best of their keywords' frequencies and their label."""
    from corpusmill.operators.points import contained

    keywords = _keywords(spark, root)
    queries = _turns(spark, root).select(F.col("id").alias("query_id"), text.script_language(F.col("message")).alias("language"), F.lower("message").alias("query")).where("length(query) >= 3")
    hits = contained(queries, keywords.select("keyword")).join(queries.select("query_id", "language"), "query_id").join(keywords, ["language", "keyword"])
    by_word = hits.groupBy("query_id", "cluster").agg(F.max("frequency").cast("double").alias("score"))
    labels = keywords.where("rank = 1").select("cluster", F.col("keyword").alias("label"))
    by_label = contained(queries, labels.select(F.col("label").alias("keyword"))).join(labels, F.col("keyword") == F.col("label")).select("query_id", "cluster", F.lit(1.0).alias("score")).distinct()
    return catalog.best_of_signals([by_word, by_label], 5)


def catalog_labels(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, labels): the labels of a message's clusters, under curated names, else its topics' names."""
    from corpusmill.plans.query import TOPICS

    keywords = _keywords(spark, root)
    own = keywords.where("rank = 1").groupBy("cluster").agg(F.min("keyword").alias("label"))
    payload = F.when(F.col("cluster") % 2 == 0, F.concat(F.lit('{"labelEn": "Topic '), F.col("cluster"), F.lit('"}')))
    named = own.select("cluster", display.curated_label(payload, "en", F.col("label")).alias("label"))
    matched = cluster_signals(spark, root).where("rank <= 2").join(named, "cluster").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))
    rows = _turns(spark, root).select(F.col("id").alias("query_id"), query.topics(F.col("message"), TOPICS).alias("topics"))
    return rows.join(matched, "query_id", "left").select("query_id", F.array_join(F.coalesce("labels", "topics"), ", ").alias("labels"))


def static_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, url, kind, rank): static links of the messages' topics: a corpus's pages by kind as a topic's links."""
    kinds = {"portal": "portal", "news": "news", "dataset": "statistics", "report": "specific", "faq": "methodology"}
    kind = F.lit("metadata")
    for own, name in kinds.items():
        kind = F.when(F.col("page_kind") == own, name).otherwise(kind)
    links = pages(spark, root, "corpus_id", "page_kind", "canonical_url").select(F.col("corpus_id").alias("topic"), kind.alias("kind"), F.col("canonical_url").alias("url"), F.col("id").alias("place"))
    topics = cluster_best(spark, root).where("rank = 1").select("query_id", F.col("cluster").alias("topic"))
    latest = _turns(spark, root).select(F.col("id").alias("query_id"), F.coalesce(text.mentions(F.col("message"), "latest") | text.mentions(F.col("message"), "ბოლო"), F.lit(False)).alias("latest"))
    return catalog.static_links(topics.join(latest, "query_id"), links)


def page_displays(spark: SparkSession, root: str) -> DataFrame:
    """(id, lead, summary, repeats_title): what a page shows."""
    rows = pages(spark, root, "title", "content_text", "lead_text", "summary_en")
    return rows.select("id", display.lead_paragraph(F.col("content_text"), MARKERS).alias("lead"), display.trimmed_summary(F.col("summary_en"), 120).alias("summary"), display.duplicates_title(F.col("lead_text"), F.col("title")).alias("repeats_title"))


def chunk_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """(id, excerpt): what a link shows of each chunk."""
    titles = pages(spark, root, "title").withColumnRenamed("id", "document_id")
    rows = chunks(spark, root, "document_id", "text").join(titles, "document_id", "left")
    return rows.select("id", display.content_excerpt(F.col("text"), F.col("title"), MARKERS).alias("excerpt"))


def answer_intros(spark: SparkSession, root: str) -> DataFrame:
    """(id, intro): the intro of each message's answer, whose JSON has come up to 40 characters."""
    plain = F.regexp_replace("message", r'["\\\\\p{Cntrl}]', " ")
    buffer = F.substring(F.concat(F.lit('{"links": [], "intro": "'), plain, F.lit('", "more": 1}')), 1, 40)
    return _turns(spark, root).select("id", display.intro_so_far(buffer).alias("intro"))


def assembled_answers(spark: SparkSession, root: str) -> DataFrame:
    """(turn_id, grounded, n_sources, n_known): whether any page a turn's hits name is quoted by its English summary, how
    many addresses the turn cites, and how many of them are pages that are known."""
    from corpusmill.functions import urls

    detail = pages(spark, root, "summary_en", "lead_text").select(F.col("id").alias("doc"), retrieval.grounded(F.col("summary_en"), F.col("lead_text")).alias("grounded"))
    known = pages(spark, root, "canonical_url").select(urls.source_key(F.col("canonical_url")).alias("key")).distinct().withColumn("known", F.lit(True))
    rows = hits_once(spark, root).withColumn("key", urls.source_key(F.col("source_url"))).join(detail, "doc", "left").join(known, "key", "left")
    per = rows.groupBy("turn_id", "key").agg(F.max(F.coalesce("grounded", F.lit(False))).alias("grounded"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    return per.groupBy("turn_id").agg(F.max("grounded").alias("grounded"), F.count("key").alias("n_sources"), F.count_if("known").alias("n_known"))


def topic_candidates(spark: SparkSession, root: str) -> DataFrame:
    """(id): pages that topics are mined from: parsed, no navigation, with a summary."""
    rows = pages(spark, root, "fetch_status", "page_kind", "summary_ka", "summary_en")
    return rows.where("fetch_status = 'parsed' and not page_kind <=> 'navigation'").where((F.trim("summary_ka") != "") | (F.trim("summary_en") != "")).select("id")


def centroid_samples(spark: SparkSession, root: str) -> DataFrame:
    """(cluster, id, score, rank): of each label the five vectors nearest to its mean."""
    vectors = table(spark, root, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    parts = vectors.select("label", F.posexplode("vector").alias("place", "x")).groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda p: p["mean"]).alias("center"))
    from corpusmill.functions import scores

    scored = vectors.join(centroids, "label").select(F.col("label").alias("cluster"), "id", F.round(scores.cosine(F.col("vector"), F.col("center")), 9).alias("score"))
    best = catalog.ranked(scored, ["cluster"], [F.desc("score"), F.asc("id")], "rank", 5)
    return best.select("cluster", "id", F.round("score", 6).alias("score"), "rank")


def eval_buckets(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, n, intent_accuracy, entity_f1): messages by prompt version; what is expected is the intent and the entities
    of the message before its spelling is mended, so both are 1 where spelling changes nothing."""
    rows = once(spark, root, "chat_turn", "id", "user_message", "prompt_version").where("user_message is not null")
    fixed = query.correct_phrases(F.col("user_message"), {"brith": "births", "wgae": "wage", "exprot": "export"})
    forms = lambda c: F.array_distinct(F.transform(query.hinted_entities(c, INDICATORS), lambda e: F.concat_ws(":", e["type"], e["form"])))
    rows = rows.select("prompt_version", (query.intent(fixed, RULES) == query.intent(F.col("user_message"), RULES)).cast("int").alias("right"), forms(F.col("user_message")).alias("wanted"), forms(fixed).alias("found"))
    both = F.size(F.array_intersect("wanted", "found"))
    f1 = F.when((F.size("wanted") == 0) & (F.size("found") == 0), 1.0).otherwise(2.0 * both / (F.size("wanted") + F.size("found")))
    return rows.groupBy(F.col("prompt_version").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("intent_accuracy"), F.round(F.avg(f1), 6).alias("entity_f1"))


def document_entities(spark: SparkSession, root: str) -> DataFrame:
    """(id, n, entities): the entities each page's title names, as they are kept with the page; pages without any have none."""
    found = query.hinted_entities(F.col("title"), INDICATORS)
    rows = pages(spark, root, "title").select("id", found.alias("found"))
    return rows.select("id", F.size("found").alias("n"), F.array_join(F.transform("found", lambda e: F.concat_ws(":", e["type"], e["form"], e["confidence"].cast("string"))), "|").alias("entities"))


def catalog_warnings(spark: SparkSession, root: str) -> DataFrame:
    """(view, warning): corpora whose newest parsed page is over 60 minutes older than the newest of all."""
    from corpusmill.operators.lifecycle import stale_views

    rows = pages(spark, root, "corpus_id", "updated_at", "fetch_status").where("fetch_status = 'parsed' and updated_at is not null")
    newest = rows.agg(F.max("updated_at").alias("now"))
    audit = rows.select(F.col("corpus_id").alias("view"), F.col("updated_at").alias("refreshed_at"), F.lit(0).alias("rows"), F.lit(True).alias("ok"))
    stale = stale_views(audit, F.lit(newest.first()["now"]).cast("timestamp_ntz"), 1.0).where("stale")
    return stale.select("view", F.concat(F.lit("not refreshed since "), F.date_format("refreshed_at", "yyyy-MM-dd HH:mm:ss")).alias("warning"))


QUERIES = {
    f.__name__: f
    for f in (
        query_pipeline, early_exits, cluster_signals, cluster_best, catalog_labels, static_catalog, page_displays, chunk_excerpts, answer_intros, assembled_answers, topic_candidates, centroid_samples,
        eval_buckets, document_entities, catalog_warnings,
    )
}

_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3))"
_KA = "(length({c}) - length(regexp_replace({c}, '[ა-ჿ]', '', 'g')) >= length({c}) - length(regexp_replace({c}, '[A-Za-z]', '', 'g')))"
_T = "t as (select id, coalesce(user_message, '') as message from turns)"


def _hints(c: str) -> str:
    """The hinted entities of a message as a list of structs."""
    named = ", ".join("case when " + " or ".join(f"contains(lower({c}), '{t}')" for t in i.triggers) + f" then struct_pack(type := '{i.type}', form := '{i.form}', confidence := 0.75::double) end" for i in INDICATORS)
    found = f"list_filter(regexp_extract_all({c}, '(?:^|[^0-9])([0-9]{{4}})(?:[^0-9]|$)', 1), lambda y: y::int between 1950 and 2039)"
    return f"list_concat(list_filter([{named}], lambda e: e is not null), list_transform(list_filter({found}, lambda y, i: list_position({found}, y) = i), lambda y: struct_pack(type := 'YEAR', form := y, confidence := 0.85::double)))"


_FIXES = QUERY_SQL["spelling_fixes"].removeprefix(WITH).lstrip(", ")
_WORDS_CTE, _, _FIX_SELECT = _FIXES.rpartition(") select ")
_EXPANDED = "list_filter([" + ", ".join("case when " + " or ".join(f"contains(lower(normalized), '{t}')" for t in triggers) + " then '" + " ".join(phrases) + "' end" for triggers, phrases in TERMS) + "], lambda x: x is not null)"
_LISTED = "list_filter(list_concat(list_concat([normalized], list_transform(found, lambda e: e.form)), ex), lambda p: trim(p) <> '')"
_DOES = "case intent " + " ".join(f"when '{k}' then '{v}'" for k, v in query.CHAT_INTENTS.items()) + " else 'CONCEPT' end"


def _any_sql(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(_mentions("message", w) for w in words) + ")"


_LANG = text.language_code_sql("language")
_TFIDF = f"tm as (select corpus_id as cluster, {_LANG} as language, unnest({_TERMS.format(c='title')}) as keyword from pages where {_LANG} in ('ka', 'en')), ow as (select cluster, language, keyword, count(*) as frequency from tm group by all), sc as (select language, keyword, count(*) as clusters from ow group by all), kw as (select cluster, language, keyword, frequency, frequency / greatest(1, clusters) as score, row_number() over (partition by cluster, language order by frequency / greatest(1, clusters) desc, keyword) as rank from ow join sc using (language, keyword) qualify rank <= 30)"
_Q = f"{_T}, q as (select id as query_id, case when {_KA.format(c='message')} then 'ka' else 'en' end as language, lower(message) as query from t)"
_FORM = "fo as (select distinct query_id, language, kind, lower(form) as form from (" + f"select query_id, language, 'entity' as kind, unnest(list_transform({_hints('query')}, lambda e: e.form)) as form from q union all " + "select query_id, language, 'expansion', unnest([" + ", ".join(f"case when contains(query, '{t}') then '{t}' end" for triggers, _ in TERMS for t in triggers) + "]) from q) where length(form) >= 3)"
_SIGNALS = f"{_TFIDF}, {_Q}, {_FORM}, lb as (select cluster, keyword as label from kw where rank = 1), sg as (select query_id, cluster, 'keyword' as signal, sum(score) as raw from q join kw on kw.language = q.language and length(query) >= 3 and contains(query, keyword) group by all union all select distinct query_id, cluster, 'label', 1.0 from q join lb on length(query) >= 3 and contains(query, label) union all select query_id, cluster, kind, sum(score) from fo join kw on kw.language = fo.language and contains(keyword, form) group by all), ws as (select query_id, cluster, round(sum(least(1.0, raw / 5.0) * case signal when 'keyword' then 0.35 when 'label' then 0.25 when 'entity' then 0.3 else 0.1 end), 6) as score from sg group by all), cs as (select query_id, cluster, score, row_number() over (partition by query_id order by score desc, cluster) as rank from ws where score > 0 qualify rank <= 5)"
_BEST = f"{_TFIDF}, {_Q}, lb as (select cluster, keyword as label from kw where rank = 1), un as (select query_id, cluster, max(frequency)::double as score from q join kw on kw.language = q.language and length(query) >= 3 and contains(query, keyword) group by all union all select distinct query_id, cluster, 1.0::double from q join lb on length(query) >= 3 and contains(query, label)), cb as (select query_id, cluster, max(score) as score from un group by all), cr as (select *, row_number() over (partition by query_id order by score desc, cluster) as rank from cb qualify rank <= 5)"
_WS = r"'[ \t\n\r\f]+'"
_BOILER = "(" + " or ".join([f"starts_with({{p}}, '×')", *(f"contains({{p}}, '{m.lower()}')" for m in MARKERS)]) + " or {p} = '')"
SQL = {
    "document_entities": WITH + f", e as (select id, {_hints("coalesce(title, '')")} as found from pages) select id, len(found) as n, array_to_string(list_transform(found, lambda e: e.type || ':' || e.form || ':' || e.confidence), '|') as entities from e",
    "catalog_warnings": WITH + ", v as (select corpus_id as view, max(updated_at) as seen from pages where fetch_status = 'parsed' group by 1 having max(updated_at) is not null) select view, 'not refreshed since ' || strftime(seen, '%Y-%m-%d %H:%M:%S') as warning from v where seen < (select max(seen) from v) - interval 60 minutes",
    "query_pipeline": WITH
    + f", {_WORDS_CTE}), sf as (select {_FIX_SELECT}), fx as (select map(list(word), list(fixed)) as m from sf), {_T}, sp as (select id, array_to_string(list_transform(regexp_extract_all(message, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), lambda p: case when regexp_matches(lower(p), '^[a-z]{{4,}}$') then coalesce(m[lower(p)], p) else p end), '') as spelled from t, fx), nm as (select id, spelled, case when {_KA.format(c='spelled')} then trim(regexp_replace(spelled, {_WS}, ' ', 'g')) else lower(trim(regexp_replace(spelled, {_WS}, ' ', 'g'))) end as normalized from sp), en as (select *, {_INTENT.replace('lower(c)', 'lower(spelled)').replace('(c)', '(spelled)')} as intent, {_hints('normalized')} as found, {_EXPANDED} as ex from nm)"
    + f" select id, spelled, normalized, intent, {_DOES} as does, array_to_string(list_transform(found, lambda e: e.type || ':' || e.form || ':' || e.confidence), '|') as entities, case when trim(normalized) = '' then '' else array_to_string(list_filter({_LISTED}, lambda p, i: list_position({_LISTED}, p) = i), ' ') end as retrieval_text from en",
    "early_exits": WITH + f", {_T} select id, case " + " ".join(f"when {_any_sql(g.patterns)}" + (f" and length(message) <= {g.most}" if g.most else "") + f" then case when {_KA.format(c='message')} then '{g.ka}' else '{g.en}' end" for g in GROUPS) + f" end as answer, not {_any_sql(PORTALS.excluded)} and ({_any_sql(PORTALS.requests)} or (({_any_sql(PORTALS.portals)} or {_any_sql(PORTALS.calculators)}) and length(message) < {PORTALS.most})) as portals from t",
    "cluster_signals": WITH + f", {_SIGNALS} select query_id, cluster, score, rank from cs",
    "cluster_best": WITH + f", {_BEST} select query_id, cluster, score, rank from cr",
    "catalog_labels": WITH + f", {_SIGNALS}, lo as (select cluster, case when cluster % 2 = 0 then 'Topic ' || cluster else min(label) end as label from lb group by cluster), mt as (select query_id, string_agg(label, ', ' order by rank) as labels from cs join lo using (cluster) where rank <= 2 group by 1), tp as ({QUERY_SQL['query_expansion'].removeprefix(WITH).lstrip(', ').replace('q as (select id, ', 'select * from (with qq as (select id, ', 1).replace(' from q', ' from qq)')}) select tp.id as query_id, coalesce(mt.labels, replace(topics, ',', ', ')) as labels from tp left join mt on mt.query_id = tp.id",
    "static_catalog": WITH + f", {_BEST}, lk as (select corpus_id as topic, case page_kind when 'portal' then 'portal' when 'news' then 'news' when 'dataset' then 'statistics' when 'report' then 'specific' when 'faq' then 'methodology' else 'metadata' end as kind, canonical_url as url, id as place from pages), fw as (select *, row_number() over (partition by topic, kind order by place, url) as n from lk qualify n <= case kind when 'specific' then 6 when 'portal' then 2 else 8 end), jn as (select cr.query_id, url, kind, n, case when kind = 'news' and (coalesce(regexp_matches(lower(message), '\\blatest\\b'), false) or contains(lower(message), 'ბოლო')) then -1 else list_position(['specific', 'portal', 'statistics', 'metadata', 'methodology', 'sectoral', 'news'], kind) end as o from cr join t on t.id = cr.query_id join fw on fw.topic = cr.cluster where cr.rank = 1), sn as (select * from jn qualify row_number() over (partition by query_id, lower(regexp_replace(url, '[/#]+$', '')) order by o, n, url) = 1) select query_id, url, kind, row_number() over (partition by query_id order by o, n, url) as rank from sn qualify rank <= 8",
    "page_displays": WITH + f", l as (select *, list_filter(list_transform(regexp_split_to_array(content_text, '\\n+'), lambda p: trim(regexp_replace(p, {_WS}, ' ', 'g'))), lambda p: length(p) >= 40 and length(p) - length(regexp_replace(p, '\\p{{L}}', '', 'g')) >= 20 and not {_BOILER.format(p='lower(p)')}) as parts, lower(trim(lead_text)) as a, lower(trim(title)) as b from pages) select id, parts[1] as lead, nullif(trim(substring(trim(summary_en), 1, 120)), '') as summary, coalesce(a <> '' and b <> '' and (a = b or (abs(length(a) - length(b)) <= 24 and (starts_with(a, b) or starts_with(b, a)))), false) as repeats_title from l",
    "answer_intros": WITH + f", {_T}, b as (select id, substring('{{\"links\": [], \"intro\": \"' || regexp_replace(message, '[\"\\\\[:cntrl:]]', ' ', 'g') || '\", \"more\": 1}}', 1, 40) as b from t) select id, regexp_extract(b, '\"intro\": \"([^\"]*)', 1) as intro from b",
    "assembled_answers": WITH + ", g as (" + "select id, coalesce(length(head) >= 20 and len(list_filter(range(1, greatest(2, length(head) - 18)), lambda i: contains(body, substring(head, i, 20)))) > 0, false) as grounded from (select id, trim(regexp_replace(lower(substring(lead_text, 1, 180)), '[ \\t\\n\\r\\f]+', ' ', 'g')) as head, trim(regexp_replace(lower(summary_en), '[ \\t\\n\\r\\f]+', ' ', 'g')) as body from pages)), k as (select distinct lower(regexp_replace(regexp_replace(canonical_url, '#.*$', ''), '/+$', '')) as key from pages), h as (select turn_id, try_cast(trim(document_id, E' \\t\\n\\r') as bigint) as doc, lower(regexp_replace(regexp_replace(source_url, '#.*$', ''), '/+$', '')) as key from hits), p as (select turn_id, h.key, bool_or(coalesce(grounded, false)) as g, bool_or(h.key in (select key from k)) as known from h left join g on g.id = h.doc group by all) select turn_id, bool_or(g) as grounded, count(key) as n_sources, count(*) filter (known) as n_known from p group by 1",
    "topic_candidates": WITH + "select id from pages where fetch_status = 'parsed' and page_kind is distinct from 'navigation' and (trim(summary_ka) <> '' or trim(summary_en) <> '')",
    "centroid_samples": "with p as (select label, i, avg(cast(embedding[i] as double)) as m from embeddings, range(1, 65) r(i) group by all), c as (select label, list(m order by i) as c from p group by label), s as (select label as cluster, vec_id as id, round(list_cosine_similarity(cast(embedding as double[]), c), 9) as score from embeddings join c using (label)) select cluster, id, round(score, 6) as score, row_number() over (partition by cluster order by score desc, id) as rank from s qualify rank <= 5",
}
