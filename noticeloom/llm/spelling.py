"""Operator 13: spelling variant grouping by Bloom-guided neighbourhoods.

The words of all documents are counted. Blocked Bloom filters over the frequent ones, sharded by word length, are built by an
aggregate and broadcast; each word then generates the words one edit away and probes the filters, and only what they
seem to hold is shuffled, to an exact join with the vocabulary that removes the false ones. An insertion is a deletion seen
from the other word and a replacement works both ways, so each pair is generated once: by deletion from the longer word, or by
the smaller letter. Hashes are polynomials in the code points, so an edit changes a hash in a few operations, whole batches at a time.

A filter has a fixed number of bits a word; the filters are broadcast in slices of a fixed size, one pass over the vocabulary each, so
their memory is bounded for any vocabulary. Forms are followed to their roots by pointer doubling in joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, spread, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_TIMES = 5
SLIP_EVERY = 199
#: What is no letter, and the letters that are lower-cased.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK_BITS = 256
WORDS_A_BLOCK = 16
#: Blocks of 32 bytes that are broadcast at once.
SLICE_BLOCKS = 1 << 20
#: Words of this many letters and more share a filter.
LONGEST_SHARD = 64
#: Edits that are generated at once.
STEP = 400_000

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Odd multipliers, one a lane, as split-block filters in Parquet files use them.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], "uint64")


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of the frequent words: runs of letters, A-Z lower-cased; a run whose crc32 with its doc_id is a multiple of 199 has lost one letter."""
    docs = spread(documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    runs = docs.select("id", F.explode(F.split("text", BETWEEN)).alias("run")).where(F.char_length("run") >= LEAST_LENGTH)
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.expr("cast(h % char_length(run) AS int)")
    words = runs.select(F.when(F.col("h") % SLIP_EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{length}").view("uint32").reshape(len(words), length).astype("uint64")


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, "uint64"), np.full(length - 1, BASE)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shards:
    """Where each length's blocks begin among all blocks."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.places: dict[int, tuple[int, int]] = {}
        self.blocks = 0
        for shard, n in sorted(counts.items()):
            self.places[shard] = (self.blocks, -(-n // WORDS_A_BLOCK))
            self.blocks += self.places[shard][1]

    def block(self, mixed: np.ndarray, length: int) -> np.ndarray | None:
        """The blocks of hashes of words of this length; none if there is no such word."""
        place = self.places.get(min(length, LONGEST_SHARD))
        return place and ((mixed >> np.uint64(32)) * np.uint64(place[1]) >> np.uint64(32)).astype("int64") + place[0]


def _bits(mixed: np.ndarray, lane: int) -> np.ndarray:
    """The bit of each hash in one of the eight 32-bit lanes of its block."""
    return (((mixed & np.uint64(0xFFFFFFFF)) * SALTS[lane]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, words.iloc[rows].tolist()


def _filled(shards: Shards) -> Callable:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, _, words in _by_length(batch["word"]):
                mixed = _mixed((_codes(words, length) * _powers(length)).sum(1, dtype="uint64"))
                lanes = [np.uint64(1) << (_bits(mixed, 2 * k) + np.uint64(32)) | np.uint64(1) << _bits(mixed, 2 * k + 1) for k in range(4)]
                yield pd.DataFrame({"block": shards.block(mixed, length), **{f"q{k}": lane.view("int64") for k, lane in enumerate(lanes)}})

    return rows


def _edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hash, word, place, letter) of the edits of words of one length; letter 0 is a deletion."""
    n, length = codes.shape
    powers = _powers(length)
    terms = codes * powers
    upto = np.add.accumulate(terms, axis=1, dtype="uint64")
    whole = upto[:, -1:]
    if length > LEAST_LENGTH:
        other = np.ones((n, length), bool)
        other[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours one is deleted
        word, place = np.nonzero(other)
        yield length - 1, (upto - terms + (whole - upto) * INVERSE)[word, place], word, place, np.zeros(len(word), "uint64")
    step = max(1, STEP // (n * len(alphabet)))
    for first in range(0, length, step):
        here = codes[:, first : first + step]
        word, place, letter = np.nonzero(alphabet[None, None, :] < here[:, :, None])
        put = alphabet[letter]
        yield length, whole[word, 0] + (put - here[word, place]) * powers[first + place], word, place + first, put


def _probed(shards: Shards, lanes, first: int, alphabet: np.ndarray) -> Callable:
    """lanes: the broadcast slice of the filters, from block `first` on."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = lanes.value
        for batch in batches:
            for length, at, words in _by_length(batch["word"]):
                together = max(1, STEP // max(1, min(length, 64) * len(alphabet)))
                for begin in range(0, len(words), together):
                    some = words[begin : begin + together]
                    found = []
                    for goal, h, word, place, letter in _edits(_codes(some, length), alphabet):
                        mixed = _mixed(h)
                        block = shards.block(mixed, goal)
                        if block is None:
                            continue
                        block = block - first
                        left = np.flatnonzero((block >= 0) & (block < len(filters)))
                        for lane in range(8):
                            left = left[(filters[block[left], lane] >> _bits(mixed[left], lane).astype("uint32")) & np.uint32(1) == 1]
                        found += [(w, some[w][:p] + (chr(c) if c else "") + some[w][p + 1 :]) for w, p, c in zip(word[left].tolist(), place[left].tolist(), letter[left].tolist())]
                    if found:
                        numbers = at[begin : begin + together][[w for w, _ in found]]
                        yield pd.DataFrame({"word": batch["word"].iloc[numbers].to_numpy(), "n": batch["n"].iloc[numbers].to_numpy(), "other": [o for _, o in found]})

    return rows


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart, once."""
    spark = vocabulary.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONGEST_SHARD))
    counts = {r.shard: r.n for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}  # one row a length up to 64
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r.letter) for r in letters), "uint64")
    shards = Shards(counts)
    filled = vocabulary.select("word").mapInPandas(_filled(shards), "block long, q0 long, q1 long, q2 long, q3 long")
    blocks = materialize(filled.groupBy("block").agg(*(F.bit_or(f"q{k}").alias(f"q{k}") for k in range(4))), "filters")
    found = None
    for first in range(0, max(shards.blocks, 1), SLICE_BLOCKS):
        size = min(SLICE_BLOCKS, shards.blocks - first)
        part = blocks.where(F.col("block").between(first, first + size - 1)).toPandas()  # SLICE_BLOCKS rows at most
        lanes = np.zeros((max(size, 0), 8), "uint32")
        for k in range(4):
            q = part[f"q{k}"].to_numpy("int64").view("uint64")
            lanes[part["block"].to_numpy("int64") - first, 2 * k] = (q >> np.uint64(32)).astype("uint32")
            lanes[part["block"].to_numpy("int64") - first, 2 * k + 1] = (q & np.uint64(0xFFFFFFFF)).astype("uint32")
        positives = vocabulary.mapInPandas(_probed(shards, spark.sparkContext.broadcast(lanes), first, alphabet), "word string, n long, other string")
        found = positives if found is None else found.unionByName(positives)
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the end of the chain of forms. Each round doubles the steps taken."""
    ends = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = materialize(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots")
        if ends.where("went").isEmpty():
            return ends.select("word", "root")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each frequent word.

    Null and empty texts have no words; a null doc_id is the empty string in the run's hash, and rows that repeat count each. Words of any length
    take part. Ties for the form go to the first word in code-point order. Without frequent words the result is empty.
    """
    vocabulary = materialize(word_counts(documents), "vocabulary")
    pairs = materialize(near_pairs(vocabulary), "near-words")
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    most: Column = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), most.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    has_form = -F.col("best.n") >= FORM_TIMES * F.col("n")
    forms = materialize(joined.select("word", F.when(has_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.n")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
