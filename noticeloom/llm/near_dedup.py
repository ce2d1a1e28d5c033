"""Operator 6: near-duplicates by order MinHash, verified by banded alignment.

Each k-mer of five words carries the number of its occurrence. For each of ORDERS random orders the sketch takes the least
few labelled k-mers and keeps them in text order, so that two sketches agree where the texts agree in content and in
sequence (of three k-mers each pair is a sketch). Documents that share a sketch are aligned word by word within a band of edits; a link needs an edit
similarity of 0.8 or more. Classes are the connected components of the links.

Exact copies are one node. A bucket (documents that share a sketch) first compares all members with its least member.
Where that leaves several components, buckets of up to SMALL members are compared in full. Larger ones mostly hold texts
that share a passage and little else. Their members meet again by their rarest word pairs: an edit changes two word pairs
at most, so texts with few enough edits share one of so many of their rarest, whatever else they share. Members that share
one and are in different components are compared in full, in pairs of blocks where there are many. No two texts that share
a sketch stay untested unless a chain of links joins them or exact bounds on edits rule a link out.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, table, texts
from noticeloom.llm.components import components, extended

WORDS = 5
SIMILARITY = 0.8
#: Random orders of k-mers; of the LEAST first k-mers of each, every KMERS[0] make a sketch.
ORDERS = 26
LEAST = 3
KMERS = (2,)
SMALL = 24
#: Bins of the bags of words by which pairs are compared before their texts are; a power of two.
BAG = 256
#: Fixed value: what parts words, as SQL's \\s.
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
#: Buckets of rare word pairs whose members are paired where they lie, and the number of such buckets that two texts must share; members of larger ones are compared in blocks.
MIDDLE = 256
SHARED = 4
#: Rows of a large bucket that are compared with as many others in one group.
BLOCK = 256
#: Bits by which texts are told that may be wanted; 16 MiB.
BITS = 1 << 27
SEED = 3
#: Edits of the widest band.
NARROW = 32
#: Characters of the pairs that are aligned together.
PAIR_CHARS = 1 << 24
#: Elements of the alignment tables that are filled together.
CELLS = 1 << 18


def words(text: Column) -> Column:
    """The lower-cased runs without blanks."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(ranked: np.ndarray, many: int) -> np.ndarray:
    """The places of the `many` least mixed values of each row, ascending; overwrites ranked."""
    ranked ^= ranked >> np.uint64(30)
    ranked *= np.uint64(0xBF58476D1CE4E5B9)
    ranked ^= ranked >> np.uint64(27)
    ranked *= np.uint64(0x94D049BB133111EB)
    ranked ^= ranked >> np.uint64(31)
    places, rows = np.empty((len(ranked), many), "int64"), np.arange(len(ranked))
    for i in range(many):
        places[:, i] = ranked.argmin(axis=1)
        ranked[rows, places[:, i]] = np.iinfo("uint64").max
    return np.sort(places, axis=1)


def sketch(hashes: np.ndarray, size: int = KMERS[0], orders: int = ORDERS) -> np.ndarray:
    """The keys of the word hashes of one text: in each order all choices of `size` of the least k-mers, in text order; a text of fewer than five words is a single k-mer."""
    h = hashes.astype("uint64")
    k = min(WORDS, len(h))
    kmers = np.zeros(len(h) - k + 1, "uint64")
    for i in range(k):
        kmers = _mixed(kmers * np.uint64(31) + h[i : len(h) - k + 1 + i])
    labelled = _mixed(kmers + _occurrences(kmers) * np.uint64(0x9E3779B97F4A7C15))
    seeds = _mixed(np.arange(1, orders + 1, dtype="uint64") + np.uint64(SEED << 32))
    many = min(LEAST, len(labelled))
    step = max(1, CELLS // 8 // len(labelled))
    places = np.concatenate([_least(labelled[None, :] ^ seeds[i : i + step, None], many) for i in range(0, orders, step)])
    keys = []
    for chosen in itertools.combinations(range(many), min(size, many)):
        key = seeds + np.uint64(size)
        for i in chosen:
            key = _mixed(key * np.uint64(31) + labelled[places[:, i]])
        keys.append(key)
    return np.concatenate(keys).astype("int64")


def sketch_lists(nodes: DataFrame, size: int) -> DataFrame:
    """(node, buckets, n, bag): the sketches of each row (node, text) that has a word, its number of words, and how many of them fall in each of BAG bins."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = batch["words"].values.to_numpy(zero_copy_only=False), batch["words"].offsets.to_numpy()
            parts = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:]) if b > a]
            ids = batch["node"].to_numpy(zero_copy_only=False)[np.diff(offsets) > 0]
            if parts:
                found = [sketch(p, size) for p in parts]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype("int32")
                bags = [np.minimum(np.bincount(p & (BAG - 1), minlength=BAG), 255).astype("uint8").tobytes() for p in parts]
                columns = [pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))), pa.array([len(p) for p in parts], pa.int64()), pa.array(bags, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "buckets", "n", "bag"])

    return nodes.select("node", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words")).mapInArrow(of, "node long, buckets array<long>, n long, bag binary")


def sketches(nodes: DataFrame, size: int) -> DataFrame:
    """(node, bucket): the same, a row each."""
    return sketch_lists(nodes, size).select("node", F.explode("buckets").alias("bucket"))


def _filled(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of rows of a (lengths n) and b (lengths m) with |n - m| <= band, filled along the band; beyond band they are only known to exceed it."""
    width, far = 2 * band + 1, 1 << 28
    padded = np.full((len(b), a.shape[1] + width + 1), -2, "int32")
    padded[:, band : band + b.shape[1]] = b[:, : a.shape[1] + band + 1]
    steps = np.arange(width, dtype="int32")
    row = np.broadcast_to(np.where(steps >= band, steps - band, far), (len(a), width)).astype("int32")
    out = np.where(n == 0, m, far)
    for i in range(1, a.shape[1] + 1):
        best = row + (padded[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        if i <= band:
            best[:, : band - i] = far
            best[:, band - i] = i
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        if (here := n == i).any():
            out[here] = row[here, (m - n + band)[here]]
    return out


def _within(x: np.ndarray, y: np.ndarray, allowed: int) -> bool:
    """Whether x becomes y in `allowed` edits, by Myers' bit vectors: a column of the alignment is two whole numbers, of one bit a row."""
    n = len(x)
    if not n:
        return len(y) <= allowed
    matches: dict[int, int] = {}
    for i, word in enumerate(x.tolist()):
        matches[word] = matches.get(word, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << n >> 1
    up, down, edits = every, 0, n
    for left, word in enumerate(y.tolist(), 1 - len(y)):
        same = matches.get(word, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, fewer = down | ~(level | up), up & level
        if more & last:
            edits += 1
        elif fewer & last:
            edits -= 1
        if edits + left > allowed:  # each word to come takes away one at most
            return False
        more, fewer = more << 1 | 1, fewer << 1
        up, down = (fewer | ~(level | more)) & every, more & level & every
    return edits <= allowed


def similar(pairs: list[tuple[list[str], list[str]]], least: float = SIMILARITY) -> np.ndarray:
    """Whether the edit similarity of the words, 1 - edits / longer length, is `least` or more.

    Pairs are aligned along bands of up to NARROW edits together. What these leave open, or what has more edits for certain,
    is aligned by bit vectors, pair by pair, so that a text of very many words costs its square over the bits of a machine word.
    """
    result = np.zeros(len(pairs), bool)
    waiting = []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        allowed = int(longer * (1 - least) + 1e-9)
        if abs(len(a) - len(b)) > allowed:
            continue
        codes: dict[str, int] = {}
        x = np.fromiter((codes.setdefault(w, len(codes)) for w in a), "int32", len(a))
        y = np.fromiter((codes.setdefault(w, len(codes)) for w in b), "int32", len(b))
        shared = np.minimum(np.bincount(x, minlength=len(codes)), np.bincount(y, minlength=len(codes))).sum() if codes else 0
        if longer - shared > allowed:
            continue
        if longer - shared > NARROW:
            result[i] = _within(x, y, allowed)
            continue
        waiting.append((i, x, y, allowed))
    band = 8
    while waiting:
        waiting.sort(key=lambda w: len(w[1]))
        rest, begin = [], 0
        while begin < len(waiting):
            end = begin + 1
            while end < len(waiting) and (end - begin + 1) * (2 * band + 1) <= CELLS // 8 and len(waiting[end][1]) <= 1.3 * len(waiting[begin][1]) + 32:
                end += 1
            part = waiting[begin:end]
            begin = end
            now = [w for w in part if abs(len(w[1]) - len(w[2])) <= band]
            rest += [w for w in part if abs(len(w[1]) - len(w[2])) > band]
            if not now:
                continue
            n, m = (np.array([len(w[k]) for w in now]) for k in (1, 2))
            a, b = np.full((len(now), n.max()), -1, "int32"), np.full((len(now), m.max()), -2, "int32")
            for r, w in enumerate(now):
                a[r, : n[r]], b[r, : m[r]] = w[1], w[2]
            for w, edits in zip(now, _filled(a, n, b, m, band)):
                if edits <= min(band, w[3]):
                    result[w[0]] = True
                elif band < w[3] and edits > band:
                    rest.append(w)
        waiting, band = rest, band * 4
        if band > NARROW:
            for i, x, y, allowed in waiting:
                result[i] = _within(x, y, allowed)
            break
    return result


def split_words(text: str) -> list[str]:
    """As `words`, of one text."""
    return [w for w in BLANKS.split(text.lower()) if w]


def like(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags (node, n, bag) don't rule a link out: an edit moves two words between bins at most. So texts that differ too much never travel."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "uint8").reshape(-1, BAG).astype("int16") for c in ("x", "y"))
            longer = np.maximum(batch["na"].to_numpy(), batch["nb"].to_numpy())
            near = np.abs(x - y).sum(1) <= 2 * (longer * (1 - SIMILARITY) + 1e-9).astype("int64")
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near))

    bag = lambda key, name: bags.select(F.col("node").alias(key), F.col("n").alias(f"n{key}"), F.col("bag").alias(name))
    return pairs.join(bag("b", "y"), "b").join(bag("a", "x"), "a").select("a", "b", "na", "nb", "x", "y").mapInArrow(check, "a long, b long")


def marked(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of nodes whose number is in wanted, and a few others: hashes of wanted are bits of up to BITS, broadcast, by which most other texts stay where they lie."""
    bits = min(BITS, max(1 << 15, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("node"), F.lit(bits)) + 1
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = nodes.join(F.broadcast(materialize(maps, "bits")), F.bitmap_bucket_number(place) == F.col("part"))
    return found.where(F.getbit(byte, at % 8) == 1).select(*nodes.columns)


def verified(pairs: DataFrame, nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; nodes has (node, text) of all of them, bags (node, n, bag)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.cumsum(batch["x"].str.len() + batch["y"].str.len()) // PAIR_CHARS
            for _, rows in batch.groupby(part):
                ok = similar([(split_words(x), split_words(y)) for x, y in zip(rows["x"], rows["y"])])
                yield rows[ok][["a", "b"]]

    near = materialize(like(pairs, bags), "like")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    text = lambda key, name: nodes.join(wanted, "node", "left_semi").select(F.col("node").alias(key), F.col("text").alias(name))
    return near.join(text("b", "y"), "b").join(text("a", "x"), "a").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def word_pairs(texts_: DataFrame) -> DataFrame:
    """(node, n, label, pairs): the word pairs of each row (node, label, text) of n words, counted with their occurrences and the borders of the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = batch["words"].values.to_numpy(zero_copy_only=False), batch["words"].offsets.to_numpy()
            parts = [_labelled(np.append(values[a:b], np.int64(0)).astype("uint64"), np.append(np.int64(0), values[a:b]).astype("uint64")) for a, b in zip(offsets[:-1], offsets[1:])]
            lists = _listed([p.astype("int64") for p in parts])
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(np.diff(offsets).astype("int64")), batch["label"], lists], names=["node", "n", "label", "pairs"])

    listed = texts_.select("node", "label", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    return listed.mapInArrow(of, "node long, n long, label long, pairs array<long>")


def _listed(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, "int64")))


def _frequent(listed: DataFrame, common: DataFrame) -> DataFrame:
    """(node, n, label, many): of each row's pairs those in common (bucket, rows), rarest first. There are fewer of these than pairs / MIDDLE, so they are broadcast and no row is dealt out by them."""
    table_ = common.toArrow()
    order = np.argsort(table_["bucket"].to_numpy())
    known = listed.sparkSession.sparkContext.broadcast((table_["bucket"].to_numpy()[order], table_["rows"].to_numpy()[order]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, rows = known.value
        for batch in batches:
            values, offsets = batch["pairs"].values.to_numpy(zero_copy_only=False), batch["pairs"].offsets.to_numpy()
            at = np.minimum(np.searchsorted(buckets, values), max(len(buckets) - 1, 0))
            hit = buckets[at] == values if len(buckets) else np.zeros(len(values), bool)
            parts = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                own = at[a:b][hit[a:b]]
                parts.append(buckets[own[np.lexsort((buckets[own], rows[own]))]])
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], batch["label"], _listed(parts)], names=["node", "n", "label", "many"])

    return listed.mapInArrow(of, "node long, n long, label long, many array<long>")


def rare_pairs(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, n, label, few, many): each row (node, text) with a label (node, label) under its rarest word pairs; few are those of up to MIDDLE rows, many those of more.

    Pairs that rows of one label have alone link nothing; they come first in the order and are left out. Of a text's pairs so many come that two
    texts of different labels whose edit similarity is SIMILARITY or more share SHARED of them at least, or all the pairs they have to share if these
    are fewer. An edit takes two pairs at most, so a text with more pairs that no other label has than its edits can take is like none of them, and goes.
    """
    listed = materialize(word_pairs(nodes.join(labels, "node")), "word-pairs")
    each = listed.select("node", "label", F.explode("pairs").alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    common = materialize(counted.where("l0 <> l1").select("bucket", "rows"), "common")
    rare = each.select("node", "bucket").join(common.where(F.col("rows") <= MIDDLE), "bucket")
    ranked = rare.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rows", "bucket"))).alias("few"))
    both = _frequent(listed, common.where(F.col("rows") > MIDDLE)).join(ranked, "node", "left").withColumn("few", F.coalesce("few.bucket", F.array().cast("array<long>")))
    lone = F.col("n") + 1 - F.size("few") - F.size("many")
    room = (2 * _allowed(F.col("n")) + 2 + SHARED - lone).cast("int")
    fitting = both.where(lone <= 2 * _allowed(F.col("n"))).withColumn("room", room)
    return fitting.select("node", "n", "label", F.slice("few", F.lit(1), F.col("room")).alias("few"), F.slice("many", F.lit(1), F.greatest(F.lit(0), F.col("room") - F.size("few"))).alias("many"))


def _allowed(n: Column) -> Column:
    """Edits that texts of n words at most may have."""
    return F.floor(n * (1 - SIMILARITY) + 1e-9)


def _rare_candidates(open_: DataFrame) -> DataFrame:
    """The pairs (a, b), a > b, of different labels that share enough buckets and are of like length."""
    mine = open_.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    other = mine.select("bucket", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("la").alias("lb"))
    longer = F.greatest("na", "nb")
    near = F.abs(F.col("na") - F.col("nb")) <= _allowed(longer)
    met = mine.join(other, "bucket").where((F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & near)
    return met.groupBy("a", "b", longer.alias("n")).agg(F.count("*").alias("shared")).where(F.col("shared") >= F.least(F.lit(SHARED), F.col("n") + 1 - 2 * _allowed(F.col("n")))).select("a", "b")


def _labelled(after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of pairs with the number of their occurrence."""
    pairs = _mixed(_mixed(before * np.uint64(31) + np.uint64(7)) + after)
    return _mixed(pairs + _occurrences(pairs) * np.uint64(0x9E3779B97F4A7C15))


def _occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(values, kind="stable")
    new = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
    out = np.empty(len(values), "uint64")
    out[order] = np.arange(len(values)) - np.repeat(new, np.diff(np.append(new, len(values))))
    return out


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with the label of their node: the root of its component, or itself."""
    return rows.join(roots, "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("label"))


def _open(named: DataFrame) -> DataFrame:
    """The rows (bucket, node, label, size and others) of buckets that hold several labels."""
    named = materialize(named, "labelled")
    spread = named.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket")
    return materialize(named.join(materialize(spread, "spread"), "bucket", "left_semi"), "open")


def _pairs_apart(open_: DataFrame) -> DataFrame:
    """The pairs (a, b), a > b, of different labels in small buckets."""
    mine = open_
    other = mine.select(F.col("bucket").alias("bucket2"), F.col("node").alias("b"), F.col("label").alias("lb"))
    return mine.join(other, (F.col("bucket") == F.col("bucket2")) & (F.col("node") > F.col("b")) & (F.col("label") != F.col("lb"))).select(F.col("node").alias("a"), "b").distinct()


def _numbered(values: list[np.ndarray]) -> np.ndarray:
    """The values of all texts, one text after the other, numbered so that the nth of a value in one text equals the nth in another."""
    every = np.unique(np.concatenate(values), return_inverse=True)[1]
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    order = np.lexsort((every, row))
    new = np.flatnonzero(np.append(True, (np.diff(every[order]) != 0) | (np.diff(row[order]) != 0)))[: len(order)]
    occurrence = np.empty(len(every), "int64")
    occurrence[order] = np.arange(len(every)) - np.repeat(new, np.diff(np.append(new, len(every))))
    return np.unique(every * (occurrence.max(initial=0) + 1) + occurrence, return_inverse=True)[1]


def _links_across(group: pd.DataFrame) -> pd.DataFrame:
    """The links between the blocks of one group, whose rows are (i, j, own, node, label, text, lower): every pair of rows of different blocks,
    or of one block if i = j, is aligned unless it is joined by then, is handled in a lower bucket, or has lengths or too few shared words
    or word pairs that rule a link out (an edit changes one word and two of the word pairs at most).
    """
    nodes, split, lower = group["node"].to_numpy(), [split_words(t) for t in group["text"]], [set(x) for x in group["lower"]]
    codes: dict[str, int] = {}
    padded = [np.array([0, *(codes.setdefault(w, len(codes) + 1) for w in ws), 0], "int64") for ws in split]
    lengths = np.array([len(ws) for ws in split])
    kinds = [(_numbered([x[1:-1] for x in padded]), lengths), (_numbered([x[:-1] * (len(codes) + 1) + x[1:] for x in padded]), lengths + 1)]

    up = np.unique(group["label"], return_inverse=True)[1]
    one = group["i"].iloc[0] == group["j"].iloc[0]
    left = np.flatnonzero(group["own"] == group["i"])
    right = left if one else np.flatnonzero(group["own"] == group["j"])
    found: list[tuple[int, int]] = []
    if len(right):
        pairs, shares = [], []
        tables = [(ids, np.concatenate([[0], np.cumsum(n)]), np.zeros(len(ids) + 1, "int32")) for ids, n in kinds]
        theirs = [np.concatenate([np.append(ids[at[k] : at[k + 1]], len(ids)) for k in right]) for ids, at, _ in tables]  # each with an end that nothing marks
        begins = [np.concatenate([[0], np.cumsum(n[right] + 1)[:-1]]) for _, n in kinds]
        for place, a in enumerate(left):
            shared = []
            for (ids, at, mark), other, begin in zip(tables, theirs, begins):
                own = ids[at[a] : at[a + 1]]
                mark[own] = 1
                shared.append(np.add.reduceat(mark[other], begin))
                mark[own] = 0
            longer = np.maximum(lengths[right], lengths[a])
            allowed = (longer * (1 - SIMILARITY) + 1e-9).astype("int64")
            may = (up[right] != up[a]) & (np.abs(lengths[right] - lengths[a]) <= allowed) & (shared[0] >= longer - allowed) & (shared[1] >= longer + 1 - 2 * allowed)
            if one:
                may[: place + 1] = False
            for k in np.flatnonzero(may):
                if lower[a].isdisjoint(lower[right[k]]):
                    pairs.append((a, right[k]))
                    shares.append(shared[1][k] / longer[k])
        waiting, step = np.array(pairs, "int64").reshape(-1, 2)[np.argsort(-np.array(shares), kind="stable")], 64
        while len(waiting):
            now, waiting, step = waiting[:step], waiting[step:], min(2 * step, 2048)
            for a, b in now[similar([(split[a], split[b]) for a, b in now])]:
                found.append((a, b))
                up[up == up[b]] = up[a]
            waiting = waiting[up[waiting[:, 0]] != up[waiting[:, 1]]]
    ends = np.sort(nodes[np.array(found, "int64").reshape(-1, 2)], axis=1)
    return pd.DataFrame({"a": ends[:, 1], "b": ends[:, 0]})


def _families(large: DataFrame) -> DataFrame:
    """(bucket, node, label): rows (node, label, many) by the buckets they list; buckets that hang together by common rows as one, where that is less to compare
    than each by itself. A row takes part by its first bucket, and by all of them only where each is by itself. Buckets of one label are left out."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values, offsets = batch["many"].values.to_numpy(zero_copy_only=False), batch["many"].offsets.to_numpy()
            leads = np.repeat(values[offsets[:-1]], np.diff(offsets))
            found, rows = np.unique(np.stack([values[offsets[0] : offsets[-1]], leads]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(rows)], names=["a", "b", "m"])

    links = materialize(large.select("many").mapInArrow(stars, "a long, b long, m long").groupBy("a", "b").agg(F.sum("m").alias("m")), "bucket-links")
    roots = components(links.select("a", "b"))
    family = materialize(links.groupBy("a").agg(F.sum("m").alias("m")).join(roots.withColumnRenamed("node", "a"), "a", "left").select(F.col("a").alias("first"), "m", F.coalesce("root", "a").alias("family")), "families")
    named = materialize(large.withColumn("first", F.col("many")[0]).join(family.drop("m"), "first"), "in-families")
    apart = family.groupBy("family").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    together = named.groupBy("family").agg((F.count("*") * F.count("*")).alias("together"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    better = materialize(together.join(apart, "family").select("family", (F.col("together") <= F.col("apart")).alias("better")), "family-sizes")
    told = named.join(better, "family")
    whole = told.where("better").select(F.xxhash64(F.lit("family"), "family").alias("bucket"), "node", "label")
    single = materialize(told.where("not better").select(F.explode("many").alias("bucket"), "node", "label"), "single")
    spread = materialize(single.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket"), "spread")
    return materialize(whole.unionByName(single.join(spread, "bucket", "left_semi")), "large")


def _across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links that join labels in buckets (bucket, node, label) of any size: no pair of different labels stays untested.

    A bucket's largest label needs no comparison within. Its rows and the others are dealt into blocks of about BLOCK rows;
    each block of the others meets all blocks, one pair of blocks a group.
    """
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    shape = materialize(main.select("bucket", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("size") - F.col("most")).alias("others")), "shape")
    lists = materialize(members.groupBy("node").agg(F.collect_list("bucket").alias("mine")), "lists")
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    placed = members.join(shape, "bucket").withColumn("own", F.when(F.col("label") == F.col("main"), F.col("others") + block(F.col("mains"))).otherwise(block(F.col("others"))))
    last = F.when(F.col("label") == F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    placed = placed.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), last))).join(lists, "node")
    rows = placed.select("bucket", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "node", "label", F.expr("filter(mine, x -> x < bucket)").alias("lower"))
    return rows.join(nodes.select("node", "text"), "node").groupBy("bucket", "i", "j").applyInPandas(_links_across, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept, text_sha256 for each row of documents: class_id is the least doc_id of the class, null where no row of it has one.

    A document is a text with its doc_id: texts that share a doc_id, or have none, are classed each by itself. Exact copies share a class, empty and null
    texts among themselves too. Of each class the document with the least doc_id is kept, ties to the least text_sha256, rows without
    doc_id last; rows that repeat doc_id and text are one document and share its fate. Without rows the result is empty.
    Very long texts are aligned by bit vectors, in time that grows with the square of their words.
    """
    docs = texts(documents)
    keys = materialize(docs.select(F.col("doc_id").alias("id"), "doc_id", F.sha2("text", 256).alias("key")), "keys")
    if not keys.groupBy("doc_id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("doc_id is null or k0 <> k1").isEmpty():  # ids that don't name one text: rows get numbers
        docs = materialize(docs.withColumn("id", F.monotonically_increasing_id()), "numbered")
        keys = materialize(docs.select("id", "doc_id", F.sha2("text", 256).alias("key")), "keys")
    else:
        docs = docs.withColumn("id", F.col("doc_id"))
    firsts = materialize(keys.groupBy("key").agg(F.min("id").alias("node")), "firsts")
    present = docs.select(F.col("id").alias("node"), "text")
    lists = materialize(sketch_lists(present, KMERS[0]).join(firsts.select("node").distinct(), "node", "left_semi"), "sketches")
    rows, bags = lists.select("node", F.explode("buckets").alias("bucket")), lists.select("node", "n", "bag")
    buckets = materialize(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lead")).where("size > 1"), "buckets")
    members = materialize(rows.join(buckets, "bucket"), "members")
    nodes = materialize(marked(present, materialize(members.select("node").distinct(), "wanted")), "candidates")  # the few others meet no pair
    led = materialize(members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    roots = components(materialize(verified(led, nodes, bags), "verified"))
    open_ = _open(_named(members.where((F.col("size") > 2) & (F.col("size") <= SMALL)).drop("lead"), roots))
    more = materialize(_pairs_apart(open_).join(led, ["a", "b"], "left_anti"), "more-pairs")
    roots = extended(roots, materialize(verified(more, nodes, bags), "more-verified"))
    wide = members.where(F.col("size") > SMALL).drop("lead")
    if not wide.isEmpty():
        again = _open(_named(wide, roots)).select("node", "label").distinct()
        pairs = materialize(rare_pairs(nodes, materialize(again, "again")), "rare-pairs")
        rare = materialize(pairs.select(F.explode("few").alias("bucket"), "node", "n", "label"), "rare-rows")
        sizes = materialize(rare.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "rare-sizes")
        open_ = _open(rare.join(sizes, "bucket"))
        tried = led.unionByName(more)
        few = materialize(_rare_candidates(open_).join(tried, ["a", "b"], "left_anti"), "rare-candidates")
        few = materialize(verified(few, nodes, bags), "rare-verified")
        many = _across(_families(pairs.where(F.size("many") > 0)), nodes)
        roots = extended(roots, few.unionByName(materialize(many, "across")))
    named = materialize(firsts.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("class")), "named")
    sized = materialize(keys.join(named, "key").select("doc_id", "key", "class"), "sized")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key"))
    sizes = materialize(sized.groupBy("class").agg(F.count("*").alias("class_size"), first.alias("first")), "class-sizes")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return sized.join(sizes, "class").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"), F.col("key").alias("text_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
