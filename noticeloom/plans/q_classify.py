"""Queries on predicates, verdicts, tags and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.functions.sql import register_functions
from noticeloom.operators import dedup as D
from noticeloom.operators import marts as M
from noticeloom.operators import metrics as M2
from noticeloom.operators import rules as R
from noticeloom.plans.catalog import Tables, query
from noticeloom.plans.q_extract import _NOCOMMENT, _stripped
from noticeloom.sources.snapshots import scratch

AS_OF = "1998-08-02"

# Terms for the given corpora: frequent words of the documents and of the parts.
HARD, OVERRIDE, INCLUDE, SERVICE = ["idiot", "disgusting"], ["pathetic"], ["thtion", "ciónes", "ment"], ["lich", "ung"]
STRONG, LOW, PHRASES, VERBS, EQUIPMENT = ["tion", "ción"], ["ible", "heit"], ["of the", "de la"], ["that", "der"], ["and", "die"]
CATEGORIES = [("process", ["thre", "ation"]), ("display", ["ela", "oui"]), ("glass", ["eits", "osas"])]


def _has(column: str, terms: list[str]) -> str:
    norm = f"lower(replace({column}, ' ', ''))"
    return "(" + " OR ".join(f"contains({norm}, '{t.replace(' ', '').lower()}')" for t in terms) + ")"


def _word(column: str, term: str) -> str:
    return f"contains(' ' || lower({column}) || ' ', ' {term} ')"


_CASCADE = [("exclude_hard", HARD), ("exclude_service", OVERRIDE), ("include", INCLUDE), ("exclude_service", SERVICE)]
_DEFAULT_IN = [("exclude_hard", HARD), ("exclude_result", OVERRIDE), ("exclude_service", SERVICE)]
_INCLUDE_FIRST = [("exclude_hard", HARD), ("include", INCLUDE), ("exclude_service", SERVICE)]


def _case(column: str, rules: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(column, terms)} THEN '{v}'" for v, terms in rules) + f" ELSE '{default}' END"


@query("normalize_text", "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS norm FROM part")
def normalize_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.normalize_text(F.col("p_name")).alias("norm"))


@query("any_term", f"SELECT doc_id, {_has('text', HARD + INCLUDE)} AS hit FROM documents")
def any_term(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.any_term(F.col("text"), HARD + INCLUDE).alias("hit"))


@query("token_term", f"SELECT doc_id, {_word('text', 'of')} AS of_word, {_word('text', 'de')} AS de_word FROM documents")
def token_term(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_term(F.col("text"), "of").alias("of_word"), X.token_term(F.col("text"), "de").alias("de_word"))


@query("classify_cascade", f"SELECT doc_id, {_case('text', _CASCADE, 'exclude_no_signal')} AS verdict FROM documents")
def classify_cascade(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.cascade(F.col("text"), _CASCADE, "exclude_no_signal").alias("verdict"))


@query("classify_default_include", f"SELECT doc_id, {_case('text', _DEFAULT_IN, 'include')} AS verdict FROM documents")
def classify_default_include(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.cascade(F.col("text"), _DEFAULT_IN, "include").alias("verdict"))


@query("classify_include_first", f"SELECT doc_id, {_case('text', _INCLUDE_FIRST, 'exclude_no_signal')} AS verdict FROM documents")
def classify_include_first(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.cascade(F.col("text"), _INCLUDE_FIRST, "exclude_no_signal").alias("verdict"))


@query("industry_signal", f"SELECT doc_id, {_word('text', 'en')} OR {_word('text', 'lo')} OR {_has('text', ['thtion'])} AS signal FROM documents")
def industry_signal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.short_or_any(F.col("text"), ["en", "lo", "thtion"]).alias("signal"))


_RELEVANT = f"(NOT {_has('text', HARD)} AND {_has('text', STRONG)} AND NOT {_has('text', LOW)})"
_PURCHASE = f"(NOT {_has('text', HARD)} AND ({_has('text', PHRASES)} OR ({_has('text', VERBS)} AND {_has('text', EQUIPMENT)})))"


@query("list_relevance", f"SELECT doc_id, {_RELEVANT} AS relevant FROM documents")
def list_relevance(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.list_relevant(F.col("text"), HARD, STRONG, LOW).alias("relevant"))


@query("purchase_context", f"SELECT doc_id, {_PURCHASE} AS purchase FROM documents")
def purchase_context(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.purchase_context(F.col("text"), HARD, PHRASES, VERBS, EQUIPMENT).alias("purchase"))


@query("relevance_combined", f"SELECT doc_id, {_RELEVANT} AND {_PURCHASE} AS relevant FROM documents")
def relevance_combined(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", (R.list_relevant(c, HARD, STRONG, LOW) & R.purchase_context(c, HARD, PHRASES, VERBS, EQUIPMENT)).alias("relevant"))


@query("two_stage_filter", f"SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE {_has('d.lang', ['en', 'fr'])} AND {_has('d.text', STRONG)}")
def two_stage_filter(t: Tables) -> DataFrame:
    listed = t.documents.where(X.any_term(F.col("lang"), ["en", "fr"]))
    return listed.join(t.labels, "doc_id").where(X.any_term(F.col("text"), STRONG)).select("doc_id", "source", "quality")


_TAGS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS category FROM documents WHERE {_has('text', terms)}" for n, terms in CATEGORIES)
_ANY = " OR ".join(_has("text", terms) for _, terms in CATEGORIES)


@query("category_tags", f"{_TAGS} UNION ALL SELECT doc_id, 'process' FROM documents WHERE text IS NOT NULL AND NOT ({_ANY})")
def category_tags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(R.category_tags(F.col("text"), CATEGORIES, "process")).alias("category"))


@query("classification_status", f"SELECT doc_id, CASE WHEN {_ANY} THEN 'confirmed' ELSE 'review' END AS status FROM documents")
def classification_status(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.classification_status(R.category_tags(F.col("text"), CATEGORIES)).alias("status"))


@query("notice_type_rules", "SELECT p_partkey, CASE WHEN contains(lower(replace(p_name, ' ', '')), 'redbolt') THEN 'result' WHEN contains(lower(replace(p_name, ' ', '')), 'small') THEN 'prespec' ELSE 'formal' END AS notice_type FROM part")
def notice_type_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.cascade(F.col("p_name"), [("result", ["red bolt"]), ("prespec", ["small"])], "formal").alias("notice_type"))


@query("notice_type_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'result' WHEN 'P' THEN 'change' ELSE 'formal' END AS notice_type FROM orders")
def notice_type_map(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.type_by_map(F.col("o_orderstatus"), {"F": "result", "P": "change"}, "formal").alias("notice_type"))


_DAYS = f"date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE))"


def _due():
    return F.col("o_orderdate").cast("date")


def _as_of():
    return F.lit(AS_OF).cast("date")


@query("deadline_status", f"SELECT o_orderkey, CASE WHEN {_DAYS} < 0 THEN 'closed' WHEN {_DAYS} <= 7 THEN 'closing' ELSE 'open' END AS status FROM orders")
def deadline_status(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", M.deadline_status(_due(), _as_of()).alias("status"))


@query("lookback_filter", "SELECT event_id, event_type FROM events WHERE ts IS NULL OR CAST(ts AS DATE) >= DATE '2024-01-15' - 7")
def lookback_filter(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts").isNull() | (F.col("ts").cast("date") >= F.date_sub(F.lit("2024-01-15").cast("date"), 7))).select("event_id", "event_type")


@query("open_filter", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate IS NULL OR {_DAYS} >= 0")
def open_filter(t: Tables) -> DataFrame:
    return t.orders.where(M.is_open(_due(), _as_of())).select("o_orderkey", "o_custkey")


@query("due_soon", f"SELECT o_orderkey, {_DAYS} BETWEEN 0 AND 7 AS soon FROM orders")
def due_soon(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", M.due_soon(_due(), _as_of()).alias("soon"))


@query("is_new", "SELECT event_id, ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 48 HOUR AS is_new FROM events")
def is_new(t: Tables) -> DataFrame:
    return t.events.select("event_id", M.is_new(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("is_new"))


@query("type_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def type_filter(t: Tables) -> DataFrame:
    chosen = ["F", "P"]
    return t.orders.where(F.col("o_orderstatus").isin(*chosen) if chosen else F.lit(True)).select("o_orderkey", "o_orderstatus")


_PLACED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def placed(t: Tables) -> DataFrame:
    """Orders as notices with a country."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))


@query("region_filter", f"SELECT o_orderkey, r_name = 'AMERICA' AS domestic, r_name <> '' AND r_name <> 'AMERICA' AS overseas FROM {_PLACED}")
def region_filter(t: Tables) -> DataFrame:
    country = F.col("r_name")
    return placed(t).select("o_orderkey", M.region_matches(country, "domestic", "AMERICA").alias("domestic"), M.region_matches(country, "overseas", "AMERICA").alias("overseas"))


@query("category_filter", f"SELECT doc_id, source FROM documents WHERE {_has('text', CATEGORIES[1][1])}")
def category_filter(t: Tables) -> DataFrame:
    return t.documents.where(F.array_contains(R.category_tags(F.col("text"), CATEGORIES), "display")).select("doc_id", "source")


@query("valid_items", f"SELECT o_orderkey, r_name FROM {_PLACED} WHERE {_DAYS} >= 0 AND r_name <> 'AMERICA'")
def valid_items(t: Tables) -> DataFrame:
    rows = placed(t).where(F.col("o_orderkey").isNotNull()).dropDuplicates(["o_orderkey"])
    return rows.where(M.is_open(_due(), _as_of()) & M.region_matches(F.col("r_name"), "overseas", "AMERICA")).select("o_orderkey", "r_name")


@query("term_hits", "SELECT p_partkey, term FROM part, (VALUES ('red bolt'), ('small'), ('gear'), ('old')) v(term) WHERE contains(lower(replace(p_name, ' ', '')), lower(replace(term, ' ', '')))")
def term_hits(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("red bolt",), ("small",), ("gear",), ("old",)], "term string")
    return R.term_hits(t.part, "p_partkey", "p_name", terms)


@query("verdict_funnel", f"SELECT source, count(*) AS raw, count(*) FILTER (v = 'exclude_hard') AS hard, count(*) FILTER (v = 'exclude_service') AS service, count(*) FILTER (v = 'include') AS included, count(*) FILTER (v = 'exclude_no_signal') AS no_signal FROM (SELECT source, {_case('text', _CASCADE, 'exclude_no_signal')} AS v FROM documents) GROUP BY source")
def verdict_funnel(t: Tables) -> DataFrame:
    rows = t.documents.select("source", R.cascade(F.col("text"), _CASCADE, "exclude_no_signal").alias("v"))
    n = lambda verdict, name: F.count_if(F.col("v") == verdict).alias(name)
    return rows.groupBy("source").agg(F.count("*").alias("raw"), n("exclude_hard", "hard"), n("exclude_service", "service"), n("include", "included"), n("exclude_no_signal", "no_signal"))


_PRESPEC = [("prespec", ["than", "thou"])]


@query("included_by_type", f"SELECT source, count(*) AS included, count(*) FILTER (notice_type = 'prespec') AS pre_spec, count(*) FILTER (notice_type <> 'prespec') AS formal FROM (SELECT source, {_case('text', _CASCADE, 'exclude_no_signal')} AS v, {_case('text', _PRESPEC, 'formal')} AS notice_type FROM documents) WHERE v = 'include' GROUP BY source")
def included_by_type(t: Tables) -> DataFrame:
    """Of the included rows of each source, how many announce a specification and how many are formal notices."""
    rows = t.documents.select("source", R.cascade(F.col("text"), _CASCADE, "exclude_no_signal").alias("v"), R.cascade(F.col("text"), _PRESPEC, "formal").alias("notice_type"))
    n = lambda test, name: F.count_if(test).alias(name)
    return rows.where("v = 'include'").groupBy("source").agg(F.count("*").alias("included"), n(F.col("notice_type") == "prespec", "pre_spec"), n(F.col("notice_type") != "prespec", "formal"))


@query("verdict_funnel_entry", f"""WITH rows AS (SELECT 'pages' AS source, {_stripped(_NOCOMMENT)} AS text FROM pages UNION ALL SELECT source, text FROM documents),
v AS (SELECT source, {_case('text', _CASCADE, 'exclude_no_signal')} AS verdict, {', '.join(f"{_has('text', terms)} AS has_{name}" for name, terms in CATEGORIES)} FROM rows),
c AS (SELECT source, verdict, unnest(CASE WHEN {' OR '.join(f'has_{name}' for name, _ in CATEGORIES)} THEN list_filter([{', '.join(f"CASE WHEN has_{name} THEN '{name}' END" for name, _ in CATEGORIES)}], lambda x: x IS NOT NULL) ELSE ['process'] END) AS category FROM v)
SELECT source, verdict, category, count(*) AS n FROM c GROUP BY ALL""")
def verdict_funnel_entry(t: Tables) -> DataFrame:
    """Pages, stripped of tags, and documents through the cascade and the tags: rows by source, verdict and category."""
    pages = t.pages.select(F.lit("pages").alias("source"), X.strip_tags(F.col("html"), comments=True).alias("text"))
    rows = pages.unionByName(t.documents.select("source", "text"))
    tagged = rows.select("source", R.cascade(F.col("text"), _CASCADE, "exclude_no_signal").alias("verdict"), F.explode(R.category_tags(F.col("text"), CATEGORIES, "process")).alias("category"))
    return tagged.groupBy("source", "verdict", "category").agg(F.count("*").alias("n"))


_TERM_WORDS = "SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM benchmark)"


def benchmark_terms(t: Tables) -> DataFrame:
    """The longer words of the benchmark: a term table that is data."""
    return t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), F.lit(1))).alias("w")).select(F.lower("w").alias("term")).distinct()


@query("term_hits_index", f"WITH terms AS ({_TERM_WORDS}), d AS (SELECT doc_id, lower(replace(text, ' ', '')) AS t FROM documents) SELECT doc_id, term FROM d JOIN terms ON contains(t, term)")
def term_hits_index(t: Tables) -> DataFrame:
    """Which of thousands of terms occur in which texts: one automaton a block of terms, one pass over each text."""
    return R.term_hits(t.documents, "doc_id", "text", benchmark_terms(t))


_RULES_SQL = f"SELECT term, CASE WHEN length(term) > 12 THEN 0 WHEN length(term) > 9 THEN 1 ELSE 2 END AS priority FROM ({_TERM_WORDS})"


@query("rule_table_cascade", f"WITH rules AS ({_RULES_SQL}), d AS (SELECT doc_id, lower(replace(text, ' ', '')) AS t FROM documents), h AS (SELECT doc_id, min(priority) AS p FROM d JOIN rules ON contains(t, term) GROUP BY doc_id) SELECT doc_id, CASE p WHEN 0 THEN 'exclude_hard' WHEN 1 THEN 'include' WHEN 2 THEN 'exclude_service' ELSE 'exclude_no_signal' END AS verdict FROM d LEFT JOIN h USING (doc_id)")
def rule_table_cascade(t: Tables) -> DataFrame:
    """The cascade of a rule table with far more than 50 terms: one automaton, one pass over each text."""
    terms = benchmark_terms(t)
    size = F.length("term")
    rules = terms.select("term", F.when(size > 12, 0).when(size > 9, 1).otherwise(2).alias("priority")).withColumn("verdict", F.element_at(F.array(F.lit("exclude_hard"), F.lit("include"), F.lit("exclude_service")), F.col("priority") + 1))
    return t.documents.select("doc_id", R.cascade(F.col("text"), R.compile_rules(rules), "exclude_no_signal").alias("verdict"))


_WORTH = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, lower(replace(text, ' ', '')) ORDER BY doc_id) AS r, " + _case("text", _CASCADE, "exclude_no_signal") + " AS v, regexp_matches(text, '[éèñß]') AS rest FROM documents"


@query("run_funnels", f"""WITH d AS ({_WORTH}), x AS (SELECT d.*, l.quality FROM d LEFT JOIN labels l USING (doc_id))
SELECT lang AS source_code, CASE WHEN count(*) FILTER (r = 1 AND v = 'include' AND quality = 1) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) FILTER (r = 1 AND v = 'include' AND quality = 1) AS n, count(*) AS raw, count(*) FILTER (r > 1) AS duplicates, count(*) FILTER (r = 1 AND v = 'exclude_hard') AS hard, count(*) FILTER (r = 1 AND v = 'exclude_service') AS service,
count(*) FILTER (r = 1 AND v = 'exclude_no_signal') AS no_signal, count(*) FILTER (r = 1 AND v = 'include' AND quality IS NULL) AS no_detail, count(*) FILTER (r = 1 AND v = 'include' AND quality = 0) AS excluded_after_detail, count(*) FILTER (r = 1 AND v = 'include' AND quality = 1 AND rest) AS translation_incomplete
FROM x WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang""")
def run_funnels(t: Tables) -> DataFrame:
    """Four sources are worked through and written; all counters come from those runs' own plans, by way of the run log."""
    path = scratch(t.spark, "funnels")

    def work(lang: str):
        def plan(funnel: M2.Funnel) -> DataFrame:
            rows = funnel.watch(t.documents.where(F.col("lang") == lang).select("doc_id", "text", F.sha2(X.normalize_text(F.col("text")), 256).alias("same")), raw=F.count("*"))
            rows = D.first_by(rows, ["same"], "doc_id").withColumn("v", R.cascade(F.col("text"), _CASCADE, "exclude_no_signal"))
            rows = funnel.watch(rows, distinct=F.count("*"), **{v: F.count_if(F.col("v") == v) for v in ("exclude_hard", "exclude_service", "exclude_no_signal")})
            rows = rows.where("v = 'include'").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
            rows = funnel.watch(rows, no_detail=F.count_if(F.col("quality").isNull()), excluded_after_detail=F.count_if(F.col("quality") == 0)).where("quality = 1")
            return funnel.watch(rows, included=F.count("*"), translation_incomplete=F.count_if(F.col("text").rlike("[éèñß]"))).select("doc_id", "text")

        return plan

    for lang in ("en", "de", "fr", "es"):
        M2.logged_run(t.spark, lang, work(lang), lambda df: df.write.mode("append").parquet(f"{path}/notices"), f"{path}/log", AS_OF)
    log = t.spark.read.schema(M2.RUN_LOG).parquet(f"{path}/log").where("elapsed_s > 0")
    c = lambda name: F.col("counters")[name]
    return log.select("source_code", "status", "n", c("raw").alias("raw"), (c("raw") - c("distinct")).alias("duplicates"), c("exclude_hard").alias("hard"), c("exclude_service").alias("service"), c("exclude_no_signal").alias("no_signal"), c("no_detail").alias("no_detail"), c("excluded_after_detail").alias("excluded_after_detail"), c("translation_incomplete").alias("translation_incomplete"))


_ARRAY = lambda terms: "array(" + ", ".join(f"'{x}'" for x in terms) + ")"


@query("sql_surface", f"SELECT doc_id, {_RELEVANT} AS relevant, {_PURCHASE} AS purchase, {_word('text', 'of')} AS has_of, CAST(length(lower(replace(text, ' ', ''))) AS VARCHAR) AS size FROM documents")
def sql_surface(t: Tables) -> DataFrame:
    """The predicates in SQL text alone."""
    register_functions(t.spark, "notice_")
    return t.spark.sql(
        f"""SELECT doc_id, notice_list_relevant(text, {_ARRAY(HARD)}, {_ARRAY(STRONG)}, {_ARRAY(LOW)}) AS relevant,
        notice_purchase_context(text, {_ARRAY(HARD)}, {_ARRAY(PHRASES)}, {_ARRAY(VERBS)}, {_ARRAY(EQUIPMENT)}) AS purchase,
        notice_token_term(text, 'of') AS has_of, cast(char_length(notice_normalize_text(text)) AS string) AS size FROM {{docs}}""",
        docs=t.documents,
    )
