"""Queries on glossary translation, on words of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.operators import translate as L
from noticeloom.plans.catalog import Tables, query

UNITS = [(r"#0*(\d)(\d{3})\b", "No. $1 thousand $2"), (r"#0*(\d{1,3})\b", "No. $1")]
GLOSSARY = L.compile_glossary([(0, "red bolt", "RB(red)"), (0, "bolt", "Bolzen"), (1, "red", "rot"), (1, "small", "klein"), (1, "old", "alt"), (0, "widget", "Teil")])
ACCENTS = [("é", "e"), ("è", "e"), ("ñ", "ny"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("í", "i")]
_SET = "éèñöüßíóçêä"


def _folded(column: str) -> str:
    expr = column
    for s, target in GLOSSARY:
        expr = f"replace({expr}, '{s}', ' {target} ')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


_UNITS_SQL = "regexp_replace(regexp_replace(c_name, '#0*(\\d)(\\d{3})\\b', 'No. \\1 thousand \\2', 'g'), '#0*(\\d{1,3})\\b', 'No. \\1', 'g')"


@query("numeric_unit_rewrite", f"SELECT c_custkey, {_UNITS_SQL} AS name FROM customer")
def numeric_unit_rewrite(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", L.numeric_units(F.col("c_name"), UNITS).alias("name"))


@query("glossary_fold", f"SELECT p_partkey, p_name AS original, {_folded('p_name')} AS name FROM part")
def glossary_fold(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_name").alias("original"), L.glossary_fold(F.col("p_name"), GLOSSARY).alias("name"))


@query("glossary_expand", "SELECT n_name, s AS suffix, n_name || s AS expanded FROM nation, (VALUES (''), (' city'), (' province')) v(s)")
def glossary_expand(t: Tables) -> DataFrame:
    return L.expand_suffixes(t.nation.select("n_name"), "n_name", ["", " city", " province"])


@query("script_ratio", f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^{_SET}]', '', 'g')) / length(text) END, 6) AS ratio FROM documents")
def script_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(L.script_ratio(F.col("text"), _SET), 6).alias("ratio"))


_TABLE_SQL = ", ".join(f"('{c}', '{s[0].upper() + s[1:]}')" for c, s in ACCENTS)


@query("transliterate", f"""WITH r AS (SELECT conv_id, turn, regexp_extract_all(text, '[{_SET}]+') AS runs FROM conversations), e AS (SELECT conv_id, turn, runs, unnest(range(1, len(runs) + 1)) AS i FROM r),
c AS (SELECT conv_id, turn, i, runs[i] AS run, unnest(range(1, length(runs[i]) + 1)) AS k FROM e)
SELECT conv_id * 1000 + turn AS id, CAST(i - 1 AS INTEGER) AS pos, run, string_agg(coalesce(s, substring(run, CAST(k AS INTEGER), 1)), '' ORDER BY k) AS syllables FROM c LEFT JOIN (VALUES {_TABLE_SQL}) v(ch, s) ON substring(run, CAST(k AS INTEGER), 1) = ch GROUP BY conv_id, turn, i, run""")
def transliterate(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(ACCENTS, "char string, syllable string")
    return L.transliterate(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text", table, _SET)


@query("translate_ok", f"SELECT p_partkey, {_folded('p_name')} AS text, NOT regexp_matches({_folded('p_name')}, '[gz]') AS ok FROM part")
def translate_ok(t: Tables) -> DataFrame:
    out = L.translated(F.col("p_name"), [], GLOSSARY, "gz")
    return t.part.select("p_partkey", out["text"].alias("text"), out["ok"].alias("ok"))


@query("region_translate", "SELECT p_partkey, CASE WHEN contains(p_name, 'hot gear') THEN replace(p_name, 'hot gear', 'HG') WHEN contains(p_name, 'hot') THEN replace(p_name, 'hot', 'HG') WHEN contains(p_name, 'old gear') THEN replace(p_name, 'old gear', 'OG') WHEN contains(p_name, 'old') THEN replace(p_name, 'old', 'OG') ELSE p_name END AS region FROM part")
def region_translate(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.region_translate(F.col("p_name"), [("hot", "HG"), ("old", "OG")], [" gear", ""]).alias("region"))


@query("translation_incomplete", "SELECT p_partkey, NOT (NOT regexp_matches(p_name, 'g') AND coalesce(CASE WHEN p_size > 10 THEN NOT regexp_matches(p_brand, '3') END, true)) AS incomplete FROM part")
def translation_incomplete(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.incomplete(~F.col("p_name").rlike("g"), F.when(F.col("p_size") > 10, ~F.col("p_brand").rlike("3"))).alias("incomplete"))


# Targets that hold sources: a single pass leaves them alone, rescanning would not.
_NESTED = L.compile_glossary([(0, "red bolt", "bolt of red"), (0, "bolt", "small bolt"), (1, "red", "hot red gear"), (1, "small", "red"), (2, "old", "small old")])
_FORMS = "|".join(sorted((s for s, _ in _NESTED), key=len, reverse=True))


def _once(column: str) -> str:
    """Every hit is put between marks first, so that no replacement sees another."""
    expr = f"regexp_replace({column}, '({_FORMS})', chr(1) || '\\1' || chr(2), 'g')"
    for s, target in _NESTED:
        expr = f"replace({expr}, chr(1) || '{s}' || chr(2), ' {target} ')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


@query("glossary_single_pass", f"SELECT p_partkey, {_once('p_name')} AS name FROM part")
def glossary_single_pass(t: Tables) -> DataFrame:
    """Sources that occur in targets are not replaced again."""
    return t.part.select("p_partkey", L.glossary_fold(F.col("p_name"), _NESTED, rescan=False).alias("name"))


def _rebuilt(rows: str, text: str, keys: str, script: str, table: str) -> str:
    """SQL of the whole text with its script in syllables: rows is a query of keys and text."""
    return f"""WITH t AS ({rows}), g AS (SELECT row_number() OVER () AS rid, * FROM t),
s AS (SELECT rid, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT rid, regexp_extract_all({text}, '(?s)[{script}]{{1,2}}|[^{script}]+') AS l FROM g)),
p AS (SELECT rid, i, l[i] AS seg, regexp_matches(l[i], '[{script}]') AS isit, i > 1 AND regexp_matches(l[greatest(i - 1, 1)], '[{script}]') AS after FROM s),
w AS (SELECT rid, i, CASE WHEN NOT isit THEN seg ELSE (CASE WHEN after THEN ' ' ELSE '' END) || coalesce(a.s, substring(seg, 1, 1)) || coalesce(b.s, substring(seg, 2, 1)) END AS piece
      FROM p LEFT JOIN (VALUES {table}) a(ch, s) ON isit AND substring(seg, 1, 1) = a.ch LEFT JOIN (VALUES {table}) b(ch, s) ON isit AND substring(seg, 2, 1) = b.ch),
j AS (SELECT rid, string_agg(piece, '' ORDER BY i) AS done FROM w GROUP BY rid)
SELECT {keys}, CASE WHEN {text} = '' THEN '' ELSE done END AS rebuilt FROM g LEFT JOIN j USING (rid)"""


_SPANISH = L.compile_glossary([(0, "ción", "tion"), (0, "é", "e")])


@query("romanize_text", _rebuilt("SELECT conv_id, turn, role, text FROM conversations", "text", "conv_id, turn, role", _SET, _TABLE_SQL))
def romanize_text(t: Tables) -> DataFrame:
    """Whole texts with every run of the script in syllables, two characters at a time."""
    table = t.spark.createDataFrame(ACCENTS, "char string, syllable string")
    return L.romanized(t.conversations.select("conv_id", "turn", "role", "text"), "text", table, _SET, "rebuilt").select("conv_id", "turn", "role", "rebuilt")


_FOLD_SQL = "trim(regexp_replace(replace(replace(text, 'ción', ' tion '), 'é', ' e '), '\\s+', ' ', 'g'))"


@query("translate_romanized", _rebuilt(f"SELECT conv_id, turn, role, CASE WHEN text = '' THEN text ELSE {_FOLD_SQL} END AS folded FROM conversations", "folded", f"conv_id, turn, role, folded = '' OR NOT regexp_matches(folded, '[{_SET}]') AS ok", _SET, _TABLE_SQL))
def translate_romanized(t: Tables) -> DataFrame:
    """The glossary first; what it leaves of the script in syllables, and then not ok."""
    table = t.spark.createDataFrame(ACCENTS, "char string, syllable string")
    rows = L.translate_rows(t.conversations.select("conv_id", "turn", "role", "text"), "text", [], _SPANISH, table, _SET)
    return rows.select("conv_id", "turn", "role", F.col("text_translated").alias("rebuilt"), F.col("text_ok").alias("ok"))


_REGION_SQL = "CASE WHEN contains(p_name, 'hot gear') THEN replace(p_name, 'hot gear', 'HG') WHEN contains(p_name, 'hot') THEN replace(p_name, 'hot', 'HG') WHEN contains(p_name, 'old gear') THEN replace(p_name, 'old gear', 'OG') WHEN contains(p_name, 'old') THEN replace(p_name, 'old', 'OG') ELSE p_name END"
_LETTERS = [("g", "ge"), ("e", "eh"), ("d", "de")]


@query("region_romanized", _rebuilt(f"SELECT p_partkey, {_REGION_SQL} AS region FROM part", "region", "p_partkey", "gedi", ", ".join(f"('{c}', '{s[0].upper() + s[1:]}')" for c, s in _LETTERS)))
def region_romanized(t: Tables) -> DataFrame:
    """One region is replaced; the script's letters beside it are written in syllables, those without one stay."""
    table = t.spark.createDataFrame(_LETTERS, "char string, syllable string")
    rows = L.region_rows(t.part.select("p_partkey", "p_name"), "p_name", [("hot", "HG"), ("old", "OG")], [" gear", ""], table, "gedi")
    return rows.select("p_partkey", F.col("p_name_translated").alias("rebuilt"))
