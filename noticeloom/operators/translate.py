"""Glossary translation: ordered replacement that always leaves the original beside the result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.terms import replace_terms
from noticeloom.functions.text import clean_space

CJK = "一-鿿"


def numeric_units(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered rewrites of numbers with units."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def compile_glossary(entries: Sequence[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """(dictionary rank, source, target): dictionaries in order, in each the longest source first, else as given."""
    return [(s, t) for _, s, t in sorted(entries, key=lambda e: (e[0], -len(e[1])))]


def glossary_fold(text: Column, glossary: Sequence[tuple[str, str]], rescan: bool = True) -> Column:
    """Each source becomes its target between blanks. With rescan, entry by entry: later entries see what earlier ones wrote.
    Without, in a single pass that takes the longest source at each place and never looks at a target again."""
    if not rescan:
        return clean_space(replace_terms(text, glossary))
    return clean_space(reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(f" {e[1]} ")), glossary, text))


def expand_suffixes(glossary: DataFrame, src: str, suffixes: Sequence[str]) -> DataFrame:
    return glossary.select("*", F.explode(F.array(*map(F.lit, suffixes))).alias("suffix")).withColumn("expanded", F.concat(src, "suffix"))


def script_ratio(text: Column, chars: str = CJK) -> Column:
    """Share of the characters of a class; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, f"[^{chars}]", "")) / F.length(text))


def transliterate(rows: DataFrame, key: str, text: str, table: DataFrame, chars: str = CJK) -> DataFrame:
    """(key, pos, run, syllables): each remaining run of the script by characters, joined with a table (char, syllable); unknown ones stay."""
    runs = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"([{chars}]+)"), F.lit(1))).alias("pos", "run"))
    each = runs.select("*", F.posexplode(F.filter(F.split("run", ""), lambda c: c != "")).alias("at", "char"))
    named = each.join(table, "char", "left").groupBy(key, "pos", "run").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.initcap("syllable"), F.col("char")).alias("s")))).alias("p"))
    return named.select(key, "pos", "run", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("syllables"))


def romanize_all(rows: DataFrame, columns: dict[str, str], table: DataFrame, chars: str = CJK) -> DataFrame:
    """The rows with a new column for each text column named: the whole text, what is left of the script written in syllables.

    A run of the script is cut in pairs of characters; a pair becomes the capitalised syllables of a table (char, syllable), pairs are
    parted by blanks, and everything else stays as and where it is. Characters without syllable stay; null and texts
    without the script are themselves. Equal texts of all columns are rebuilt once: their segments carry their places, meet the table (at most
    one row for each character there is, so it may be broadcast) and are put together again by place.
    """
    script = lambda s: s.rlike(f"[{chars}]")
    held = lambda c: F.coalesce(script(F.col(c)), F.lit(False))
    left = F.array_compact(F.array(*(F.when(held(c), F.struct(F.sha2(c, 256).alias("_digest"), F.col(c).alias("_text"))) for c in columns)))
    pending = rows.select(F.explode(left).alias("_p")).select("_p._digest", "_p._text").dropDuplicates(["_digest"])
    segments = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s)([{chars}]{{1,2}}|[^{chars}]+)"), F.lit(1))
    placed = pending.select("_digest", F.posexplode(segments).alias("at", "segment"), segments.alias("all"))
    placed = placed.select("_digest", "at", "segment", script(F.col("segment")).alias("is"), (F.col("at").cast("boolean") & script(F.get("all", F.greatest(F.col("at") - 1, F.lit(0))))).alias("after"))
    for k in (1, 2):
        char = F.when(F.col("is"), F.nullif(F.substring("segment", k, 1), F.lit("")))
        syllables = table.select(F.col("char").alias(f"c{k}"), F.initcap("syllable").alias(f"s{k}")).dropDuplicates([f"c{k}"])
        placed = placed.withColumn(f"c{k}", char).join(syllables, f"c{k}", "left")
    word = F.concat(F.when(F.col("after"), " ").otherwise(""), F.coalesce("s1", "c1"), F.coalesce("s2", "c2", F.lit("")))
    pieces = placed.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("is"), word).otherwise(F.col("segment")).alias("p")))).alias("ps"))
    rebuilt = pieces.select("_digest", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("_rebuilt"))
    for c, out in columns.items():
        key = F.when(held(c), F.sha2(c, 256)).otherwise(F.concat(F.lit("-"), F.xxhash64(c).cast("string")))  # texts that stay meet nothing, but not all in one task
        rows = rows.withColumn("_digest", key).join(rebuilt, "_digest", "left").withColumn(out, F.when(held(c), F.col("_rebuilt")).otherwise(F.col(c))).drop("_digest", "_rebuilt")
    return rows


def romanized(rows: DataFrame, text: str, table: DataFrame, chars: str = CJK, out: str = "romanized") -> DataFrame:
    """As romanize_all, of one column."""
    return romanize_all(rows, {text: out}, table, chars)


def translated(text: Column, rules: Sequence[tuple[str, str]], glossary: Sequence[tuple[str, str]], chars: str = CJK, rescan: bool = True) -> Column:
    """struct(text, ok): ok if nothing of the script is left; an empty text is itself and ok."""
    out = glossary_fold(numeric_units(text, rules), glossary, rescan)
    return F.struct(F.when(text == "", text).otherwise(out).alias("text"), F.when(text == "", True).otherwise(~out.rlike(f"[{chars}]")).alias("ok"))


def translate_rows(rows: DataFrame, texts: str | Sequence[str], rules: Sequence[tuple[str, str]], glossary: Sequence[tuple[str, str]], table: DataFrame, chars: str = CJK, rescan: bool = True) -> DataFrame:
    """The rows with `<text>_translated` and `<text>_ok` for each text: the glossary's work, and where it leaves some of the script, that in syllables and not ok."""
    texts = [texts] if isinstance(texts, str) else list(texts)
    for c in texts:
        rows = rows.withColumn("_t", translated(F.col(c), rules, glossary, chars, rescan)).withColumns({f"_folded_{c}": F.col("_t.text"), f"{c}_ok": F.col("_t.ok")}).drop("_t")
    return romanize_all(rows, {f"_folded_{c}": f"{c}_translated" for c in texts}, table, chars).drop(*(f"_folded_{c}" for c in texts))


def region_rows(rows: DataFrame, text: str, regions: Sequence[tuple[str, str]], suffixes: Sequence[str], table: DataFrame, chars: str = CJK) -> DataFrame:
    """The rows with `<text>_translated`: the first region that occurs is replaced, what is left of the script becomes syllables."""
    named = rows.withColumn("_region", region_translate(F.col(text), regions, suffixes))
    return romanized(named, "_region", table, chars, f"{text}_translated").drop("_region")


def region_translate(text: Column, regions: Sequence[tuple[str, str]], suffixes: Sequence[str]) -> Column:
    """The first region, in order, that occurs (with a suffix first, then bare) is replaced; then it stops."""
    forms = [(r + s, t) for r, t in regions for s in suffixes]
    return reduce(lambda c, f: c.when(F.contains(text, F.lit(f[0])), F.replace(text, F.lit(f[0]), F.lit(f[1]))), forms, F.when(F.lit(False), text)).otherwise(text)


def incomplete(*oks: Column) -> Column:
    return ~reduce(lambda a, b: a & b, (F.coalesce(o, F.lit(True)) for o in oks))
