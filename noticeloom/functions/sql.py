"""The helpers as SQL functions, so that a query in SQL text needs no Python: `register_functions(spark)`, then `SELECT strip_tags(html) ...`.

Bodies are SQL expressions, so Spark inlines and optimises them as it does the Column forms, whose results they share.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from noticeloom.functions.text import ENTITIES, SPACE


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entities(text: str) -> str:
    for name, char in ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(char)})"
    return text


def _day(pattern: str) -> str:
    part = lambda k: f"regexp_extract(t, {_quoted(pattern)}, {k})"
    return f"CASE WHEN {part(1)} <> '' THEN concat_ws('-', {part(1)}, lpad({part(2)}, 2, '0'), lpad({part(3)}, 2, '0')) END"


#: name: (arguments, type of the result, body). Later ones may use earlier ones.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "normalize_text": ("t STRING", "STRING", "lower(replace(t, ' ', ''))"),
    "clean_space": ("t STRING", "STRING", f"trim(regexp_replace(t, {_quoted(SPACE + '+')}, ' '))"),
    "unescape_entities": ("t STRING", "STRING", _entities("t")),
    "strip_tags": ("t STRING", "STRING", "clean_space(unescape_entities(regexp_replace(t, '<[^>]+>', ' ')))"),
    "strip_tags_comments": ("t STRING", "STRING", "strip_tags(regexp_replace(t, '(?s)<!--.*?-->', ' '))"),
    "any_within": ("norm STRING, terms ARRAY<STRING>", "BOOLEAN", "exists(terms, x -> contains(norm, lower(replace(x, ' ', ''))))"),  # functions can't be called inside a lambda
    "any_term": ("t STRING, terms ARRAY<STRING>", "BOOLEAN", "any_within(normalize_text(t), terms)"),
    "token_term": ("t STRING, term STRING", "BOOLEAN", "contains(concat(' ', lower(t), ' '), concat(' ', lower(term), ' '))"),
    "list_relevant": ("t STRING, hard ARRAY<STRING>, strong ARRAY<STRING>, low ARRAY<STRING>", "BOOLEAN", "NOT any_term(t, hard) AND any_term(t, strong) AND NOT any_term(t, low)"),
    "purchase_context": ("t STRING, hard ARRAY<STRING>, phrases ARRAY<STRING>, verbs ARRAY<STRING>, equipment ARRAY<STRING>", "BOOLEAN", "NOT any_term(t, hard) AND (any_term(t, phrases) OR (any_term(t, verbs) AND any_term(t, equipment)))"),
    "dotted_date": ("t STRING", "STRING", _day(r"^(\d{4})\.(\d{1,2})\.(\d{1,2})")),
    "iso_date": ("t STRING", "STRING", _day(r"(\d{4})-(\d{1,2})-(\d{1,2})")),
    "safe_date": ("t STRING", "DATE", "try_to_date(t, 'yyyy-MM-dd')"),
    "positive_amount": ("t STRING", "DECIMAL(20,2)", "CASE WHEN try_cast(replace(t, ',', '') AS DECIMAL(20,2)) > 0 THEN try_cast(replace(t, ',', '') AS DECIMAL(20,2)) END"),
    "days_until": ("due DATE, as_of DATE", "INT", "datediff(due, as_of)"),
    "deadline_status": ("due DATE, as_of DATE", "STRING", "CASE WHEN due IS NULL THEN 'open' WHEN due < as_of THEN 'closed' WHEN datediff(due, as_of) <= 7 THEN 'closing' ELSE 'open' END"),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions in the session, each name behind the prefix; returns the names."""
    known = re.compile(r"\b(" + "|".join(FUNCTIONS) + r")\(")
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {known.sub(lambda m: f'{prefix}{m[1]}(', body)}")
    return [prefix + name for name in FUNCTIONS]
