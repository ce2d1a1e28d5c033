"""Operator 2: secrets by fixed patterns and by character Markov models.

Two first-order models of characters are trained from labelled samples, one of random strings and one of ordinary
identifiers. A run of token characters whose log-likelihood ratio favours the random model is a span of kind ``markov``,
beside the spans of the fixed patterns. Everything is DataFrame code; a text's spans are found within its own row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import spread, table, texts

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: The same with the least lengths; characters that are listed one by one are told faster than ranges.
ACCESS_LONG = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX_LONG = rf"[0123456789abcdef]{{{HEX_LEAST},}}"

#: Characters that the models know; a run of them is scored if it has at least MARKOV_LEAST.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MARKOV_LEAST = 20
MARKOV = rf"[{ALPHABET}]{{{MARKOV_LEAST},}}"  # '-' comes last
#: A run is a secret from this sum of log ratios on.
THRESHOLD = 8.0
#: Training rows of each label at most (those with the least hash), and about how many documents they come from: random ones, ordinary ones.
SAMPLE_ROWS = 20_000
RANDOM_DOCUMENTS = 20_000
SAMPLE_DOCUMENTS = 2_000
#: Weight of what is expected before any sample in a character's transitions: for random strings all characters alike, for ordinary ones their own shares.
PRIOR = 8.0


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row: inside a lambda everything but its variables is worked out anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sums(values: Column) -> Column:
    """Sums of all values up to each, by doubling: log2 n passes over n values, so that a million matches in one text stay cheap."""
    zero = F.lit(0).cast("long")

    def doubled(sums: Column, step: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), step)
        return F.zip_with(sums, F.concat(F.array_repeat(zero, far), F.slice(sums, F.lit(1), F.size(sums) - far)), lambda a, b: a + b)

    steps = F.ceil(F.log2(F.size(values))).cast("int")
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), values, doubled)


def spans(text: Column, pattern: str, kind: str, keep, group: int = 0, holds: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, value): code points, end exclusive, rank of the kind; keep(value) drops failing ones.

    The pieces between matches and the matches alternate, so lengths add up to positions. Each list is made once a text. `holds` tells texts with a match, if there
    is a cheaper test than the pattern.
    """
    rank = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,value:string>>")
    value = lambda w: F.regexp_extract(w, pattern, group) if group else w

    def placed(whole: Column) -> Column:
        sizes = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        row = lambda ends: lambda w, i: F.struct((F.get(ends, i) - F.length(w)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"), value(w).alias("value"))
        return _bound(_bound(sizes, _sums), lambda ends: F.transform(whole, row(ends)))

    found = F.filter(_bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), lambda s: keep(s["value"]))
    return F.when(text.rlike(pattern) if holds is None else holds, found).otherwise(empty)


def _holds_assign(text: Column) -> Column:
    """Whether ASSIGN matches: texts without its sign or its words, which are told far faster, are not tried."""
    lower = F.lower(text)
    words = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in ("passw", "secret", "token", "api")))
    return (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & words & text.rlike(ASSIGN)


def base_holds(text: Column) -> list[Column]:
    """Whether a text has a match of each of the three fixed kinds, before `keep`."""
    return [_holds_assign(text), F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS_LONG), text.rlike(HEX_LONG)]


def base_spans(text: Column) -> list[Column]:
    """The three fixed kinds. Matches of access and hex have no shorter variant in the same run, so their least length stands in the pattern."""
    always = lambda v: F.lit(True)
    assign, access, hexadecimal = base_holds(text)
    return [
        spans(text, ASSIGN, "assign", lambda v: F.length(v) >= ASSIGN_LEAST, 2, assign),
        spans(text, ACCESS_LONG, "access", always, holds=access),
        spans(text, HEX_LONG, "hex", always, holds=hexadecimal),
    ]


def labelled_samples(documents: DataFrame) -> DataFrame:
    """(value, random): what the fixed patterns find in a sample of documents is random; runs of six and more in a smaller one of documents without such a find are ordinary.

    Documents are drawn by the hash of id and text against a bound that follows from their number, so about RANDOM_DOCUMENTS
    and SAMPLE_DOCUMENTS of any table are looked at, all of a small one; equal rows are one. Of each label the SAMPLE_ROWS values of least
    hash count. Long texts are drawn like others.
    """
    docs = texts(documents)
    n = docs.count()
    drawn = lambda some: docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // some))) == 0).select("doc_id", "text").distinct()
    found = reduce(lambda a, b: F.concat(a, b), base_spans(F.col("text")))
    anything = reduce(lambda a, b: a | b, base_holds(F.col("text")))
    positive = drawn(RANDOM_DOCUMENTS).where(anything).select(F.explode(F.transform(found, lambda s: s["value"])).alias("value")).select("value", F.lit(True).alias("random"))
    negative = drawn(SAMPLE_DOCUMENTS).where(~anything).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_-]{6,}"), F.lit(0))).alias("value")).select("value", F.lit(False).alias("random"))
    least = lambda df: df.orderBy(F.xxhash64("value"), "value").limit(SAMPLE_ROWS)
    return least(positive).unionByName(least(negative))


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the transition probabilities, random over ordinary, for each pair of ALPHABET; smoothed, so that no samples mean no preference."""
    pairs = samples.select("random", F.regexp_replace("value", "[^A-Za-z0-9+/_-]", "").alias("v")).where("length(v) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring("v", i, F.lit(2)))).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # at most two rows for each pair of characters
    models = []
    for label in (True, False):
        into = [sum(counts.get((label, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET]
        share = [1 / len(ALPHABET) if label else n / sum(into) for n in into]  # of a pair never seen
        rows = [[counts.get((label, a + b), 0) + PRIOR * p for b, p in zip(ALPHABET, share)] for a in ALPHABET]
        models.append([log(x / sum(row)) for row in rows for x in row])
    return [x - y for x, y in zip(*models)]


def markov_spans(text: Column, ratios: list[float]) -> Column:
    """Runs whose transitions together favour the random model; the table of ratios has one entry for each pair of characters."""
    k = len(ALPHABET)
    ratio = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")

    def random(value: Column) -> Column:
        codes = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
        scores = _bound(codes, lambda all_: F.transform(all_, lambda a, i: F.coalesce(F.get(ratio, a * k + F.get(all_, i + 1)), F.lit(0.0))))
        return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) >= THRESHOLD

    return spans(text, MARKOV, "markov", random)


def find_secrets(documents: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id and found: every span (start, rank, end, value), by start and then kind. A text without any has an empty list; null is empty."""
    kinds = [*base_spans(F.col("text")), markov_spans(F.col("text"), ratios)]
    return spread(texts(documents)).select("doc_id", F.array_sort(reduce(lambda a, b: F.concat(a, b), kinds)).alias("found"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = find_secrets(documents, train(labelled_samples(documents)))
    named = lambda spans_: F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")
    count = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.filter("found", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))
