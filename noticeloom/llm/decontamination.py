"""Operator 12: benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ten words (an item of fewer words is one window). The shingles of a window are its pairs of
neighbouring words. Only a document that holds all shingles of a window can contain it, so a prefix of one shingle is
necessary and enough: the window's rarest by its count over all documents. Each place of a document meets the
windows whose prefix shingle it holds; the place says where the window has to begin, which bounds it by the document's ends, and then the
window's words are compared with the document's, one by one. Equal hashes only propose; words alone decide.

Windows with the same words are one; windows of the same items share a class, so that a document names the items of a
passage once. Prefixes go to the documents in blocks of a fixed number of windows, however many items there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, spread, table, texts

WINDOW_WORDS = 10
#: Windows, or shingles to count, that are broadcast at once; a window is ten words and a few numbers.
BLOCK_WINDOWS = 100_000

#: Fixed value: what stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT row_number() OVER () AS rid, doc_id, w FROM d),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS m, w[i:i + {WINDOW_WORDS - 1}] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT rid, m, i, w[i:i + m - 1] AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM r, lengths WHERE len(w) >= m)),
found AS (SELECT p.rid, p.i, p.m, v.item_id FROM places p JOIN windows v ON p.m = v.m AND p.win = v.win),
hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT rid, i, m FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM r LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; other letters stay as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(window, items): each distinct window and the sorted names of the items that hold it. A null item_id is the name ''."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW_WORDS - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW_WORDS))).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingles(window: Column) -> Column:
    """(key, offset) of each pair of neighbouring words; of a window of one word that word."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(window) - 2), lambda i: F.struct(F.xxhash64(F.get(window, i), F.get(window, i + 1)).alias("key"), i.alias("offset")))
    return F.when(F.size(window) > 1, pairs).otherwise(F.array(F.struct(F.xxhash64(F.get(window, F.lit(0))).alias("key"), F.lit(0).alias("offset"))))


def _places(docs: DataFrame, single_words: bool) -> DataFrame:
    """docs with a row for each place: pos from 1 and the key of the shingle there, and one row at pos 0 for the document itself with key 0."""
    placed = docs.select("*", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    pair = F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("word", F.get("words", F.col("pos"))))
    if not single_words:
        return placed.withColumn("key", pair)
    one = F.when(F.col("pos") > 0, F.xxhash64("word"))
    return placed.withColumn("key", F.explode(F.array_compact(F.array(pair, one))))


def _blocks(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows by key in blocks of about BLOCK_WINDOWS, each bounded however many rows there are."""
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    return [rows.where(F.pmod("key", F.lit(blocks)) == k) if blocks > 1 else rows for k in range(blocks)]


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans (first word from 0, end exclusive).

    Null texts have no words and are no window. Rows that share a doc_id are rated each by its own text; rows that repeat id and
    text are all returned. Items that share an item_id are one item. A text is one row, so a very long one is split
    into words in one task. Extra columns play no part; without items nothing is hit.
    """
    spark = documents.sparkSession
    docs = spread(texts(documents)).select("doc_id", F.md5("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    windows = materialize(item_windows(benchmark), "windows")
    classes = materialize(windows.select("items").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    n, shortest = windows.agg(F.count("*"), F.min(F.size("window"))).first()
    single_words = shortest == 1

    shingles = windows.join(classes, "items").select("window", "class", F.explode(_shingles(F.col("window"))).alias("s")).select("window", "class", "s.key", "s.offset")
    keys = materialize(shingles.select("key").distinct(), "shingles")
    counts = None
    for block in _blocks(keys, n * (WINDOW_WORDS - 1)):
        places = _places(docs, single_words).where("pos > 0").select("key").join(F.broadcast(block), "key").groupBy("key").agg(F.count("*").alias("n"))
        counts = places if counts is None else counts.unionByName(places)
    counts = materialize(counts, "counts")
    rarest = shingles.join(counts, "key", "left").groupBy("window", "class").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("s"))
    prefixes = materialize(rarest.select("s.key", F.struct(F.col("s.offset").alias("offset"), F.col("window").alias("words"), "class").alias("w")).groupBy("key").agg(F.collect_list("w").alias("windows")), "prefixes")

    itself = spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(None).cast(prefixes.schema["windows"].dataType).alias("windows"))
    # Only the words around a place go on from the join, not the document's: a window's shingles begin at its last word but one at the latest.
    first = F.greatest(F.col("pos") - (WINDOW_WORDS - 2), F.lit(1))
    start = lambda w: F.col("pos") - w["offset"]
    inside = lambda w: (start(w) >= 1) & (start(w) + F.size(w["words"]) - 1 <= F.col("n_words"))
    same = lambda w: inside(w) & (F.slice("near", F.greatest(start(w) - F.col("first") + 1, F.lit(1)), F.size(w["words"])) == w["words"])
    span = lambda w: F.struct((start(w) - 1).alias("start"), (start(w) - 1 + F.size(w["words"])).alias("end"), w["class"].alias("class"))
    met = None
    for k, block in enumerate(_blocks(prefixes, n)):
        here = _places(docs, single_words).join(F.broadcast(block.unionByName(itself) if k == 0 else block), "key")
        here = here.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "pos", first.alias("first"), F.slice("words", first, 2 * (WINDOW_WORDS - 1)).alias("near"), "windows")
        here = here.select("doc_id", "text_key", "n_words", "pos", F.transform(F.filter("windows", same), span).alias("hits"))
        met = here if met is None else met.unionByName(here)
    spans = F.array_sort(F.flatten(F.collect_set(F.when(F.size("hits") > 0, F.col("hits")))))
    rated = met.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("pos") == 0).alias("copies"), spans.alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    rated = rated.select("doc_id", "text_key", "n_words", "copies", covered.alias("n_hit"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"), F.array_distinct(F.transform("spans", lambda s: s["class"])).alias("classes"))
    named = rated.withColumn("class", F.explode_outer("classes")).join(classes, "class", "left")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    whole = named.groupBy("doc_id", "text_key").agg(*(F.first(c).alias(c) for c in ("n_words", "copies", "n_hit", "spans")), items.alias("items"))
    return whole.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
