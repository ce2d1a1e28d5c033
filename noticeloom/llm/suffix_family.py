"""Operator 7: removal of repeated passages with a logarithmic family of suffix arrays.

A suffix array holds the suffixes of its texts that some 50-byte string keeps: of its 35 suffix starts each string keeps
the one whose 16 bytes have the least hash, so equal strings keep equal suffixes and one suffix in about 18 bytes is
enough. Suffixes are sorted by their first eight bytes in text order, equal ones by a 64-bit hash of their region, which
is all the consecutive 50-byte strings that keep the suffix. Suffixes with equal regions are one entry.

Documents come in batches of ascending doc_id. A batch gets a suffix array of its own and is merge-scanned against itself
and every level that exists. Levels of equal size are merged before the next batch comes. A scan finds two things: entries
whose whole region occurs in a smaller document, which go, and entries that share a suffix and 17 bytes on one side of it
but not the region (any common 50-byte string shows so). The regions of the latter are fetched from their texts and
compared string by string.

Texts are dealt into chunks, suffixes into shards by a hash; both are bucketed tables, so that scans, merges and the passes
over the texts move nothing. An entry comes once for each chunk however often its passage does. A suffix around which very
many different regions lie (a line in ever new contexts) would fill its shard: a sample tells which these are, and
their strings are compared one by one over the whole cluster instead. Hashes decide with 128 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import Bucketed, bucketed, discard, materialize, new_path, release, table, texts

MATCH = 50
HEAD = 16
#: Bytes beside a suffix's head, on its left or right, that a common string of 50 bytes shares as well.
SIDE = (MATCH - HEAD + 1) // 2
#: Batches, by doc_id, in which the query's documents come.
BATCHES = 8
#: Bytes of text that a task holds at once; a shard holds the suffixes of SHARD_CHUNKS times as many. Longer texts come whole.
CHUNK_BYTES = 4 << 20
SHARD_CHUNKS = 4
#: Different regions of one suffix that a shard may hold; strings around others are compared over the cluster. Goes with CHUNK_BYTES.
TOGETHER = 50_000
#: The part of the texts, by hash, that tells which suffixes those are (all if there is one shard only), and their least number of regions in it.
SAMPLE_EVERY = 64
SAMPLE_LEAST = 32
#: Bytes whose suffixes are hashed together.
PIECE = 1 << 17
NO_ID = -(1 << 63) + 1
OLD = -(1 << 63)
#: What a row of a scan's result says: an entry of the new level, entries that go, entries to compare, single strings that go, strings by hash that go.
LEVEL, GONE, BORDER, STRINGS, SPREAD = range(5)
FOUND = "kind int, shard int, chunk int, n int, payload binary"
_FOUND = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _joined(words: np.ndarray, at: np.ndarray, steps: tuple[int, ...], seed: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the words at the given steps from each place."""
    out = np.full(len(at), seed, "uint64") if isinstance(seed, int) else seed
    for step in steps:
        out = _mixed(out * _ODD + words[at + step])
    return out


def _ordered(head: np.ndarray, region: np.ndarray, doc: np.ndarray | None = None, runs: bool = False) -> np.ndarray:
    """The order by head, region and doc; most heads differ, and runs=True tells that sorted parts follow each other."""
    order = np.argsort(head, kind="stable" if runs else None)
    same = head[order][1:] == head[order][:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))[: len(order)]
    part = order[tied]
    order[tied] = part[np.lexsort((region[part], head[part]) if doc is None else (doc[part], region[part], head[part]))]
    return order


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first as differences, by byte planes and compressed."""
    first = np.diff(columns[0].view("uint64"), prepend=np.uint64(0))
    planes = (np.ascontiguousarray(c).view("uint8").reshape(-1, 8).T.tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(payload: bytes, n: int) -> list[np.ndarray]:
    """The columns, as unsigned numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "uint8")
    rows = np.ascontiguousarray(raw.reshape(-1, 8, n).transpose(0, 2, 1)).view("uint64").reshape(-1, n) if n else np.zeros((5, 0), "uint64")
    return [np.cumsum(rows[0], dtype="uint64"), *rows[1:]]


class Suffixes:
    """The kept suffixes of the texts of a chunk, in text order: each with its region, sorting key and hashes."""

    def __init__(self, texts_: pa.ChunkedArray) -> None:
        text = texts_.cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], "<i8")[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, "int64")
        self.offsets = offsets - offsets[0]
        self.size = int(self.offsets[-1])
        self.data = (bytes(memoryview(text.buffers()[2])[offsets[0] : offsets[-1]]) if self.size else b"") + bytes(MATCH)
        self.words = np.ndarray((self.size + MATCH - 7,), "<u8", self.data, strides=(1,))  # places before the first one are read from the end, and not used then
        self.start, self.count, place = self._kept()
        words, size = self.words, self.count + MATCH - 1
        self.head = words[place].byteswap().astype("uint64")
        self.hash = _joined(words, place, (0, 8))
        region = _joined(words, self.start, tuple(range(0, MATCH - 7, 8)), size.astype("uint64"))
        for at in range((MATCH - 7) // 8 * 8 + 8, int(size.max(initial=0)), 8):
            more = np.flatnonzero(at + 8 <= size)
            region[more] = _mixed(region[more] * _ODD + words[self.start[more] + at])
        self.region = _mixed(region * _ODD + words[self.start + size - 8])
        one = np.uint64(1)
        self.sides = np.zeros(len(place), "uint64")
        for has, steps, low in ((place - self.start >= SIDE, (-SIDE, -9, -8), 32), (self.start + size - place - HEAD >= SIDE, (HEAD, HEAD + 8, HEAD + 9), 0)):
            k = np.flatnonzero(has)
            self.sides[k] |= (_joined(words, place[k], steps, self.hash[k] + np.uint64(low)) >> np.uint64(32) | one) << np.uint64(low)
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1

    def _kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first string, strings, place of the kept suffix) of each region."""
        n = max(self.size - MATCH + 1, 0)
        place = np.empty(n, "int32")
        for base in range(0, n, PIECE):
            m = min(PIECE, n - base) + MATCH - HEAD
            h = _mixed(_mixed(self.words[base : base + m] * _ODD) + self.words[base + 8 : base + 8 + m])
            least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype="uint64")
            for width in (1, 2, 4, 8, 16):
                least = np.minimum(least[:-width], least[width:])
            over = MATCH - HEAD + 1 - 32
            least = np.minimum(least[: len(least) - over], least[over:])
            place[base : base + len(least)] = (least & np.uint64(0xFFFFFF)).astype("int32") + base
        across = np.zeros(self.size + 2, "int32")  # strings that would cross the end of their text
        np.add.at(across, np.maximum(self.offsets[:-1], self.offsets[1:] - MATCH + 1), 1)
        np.add.at(across, self.offsets[1:], -1)
        fits = np.cumsum(across)[:n] == 0
        if not fits.any():
            return (np.zeros(0, "int64"),) * 3
        new = fits & np.append(True, (place[1:] != place[:-1]) | ~fits[:-1])
        start = np.flatnonzero(new)
        stop = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True))
        return start, stop - start + 1, place[start].astype("int64")

    def entries(self, doc: np.ndarray, hot: np.ndarray) -> None:
        """Sorts the suffixes and joins those with equal regions: `first` are the entries' suffixes in sorted order, `entry` each
        suffix's entry, `least` each entry's smallest document. Suffixes with many regions (`spread`) have no part in it."""
        self.doc = doc[self.row]
        self.spread = _among(self.hash, hot)
        usual = np.flatnonzero(~self.spread)
        order = usual[_ordered(self.head[usual], self.region[usual])]
        new = np.append(True, (np.diff(self.head[order]) != 0) | (np.diff(self.region[order]) != 0) | (np.diff(self.sides[order]) != 0))[: len(order)]
        begins = np.flatnonzero(new)
        self.first = order[begins]
        self.entry = np.full(len(self.start), -1)
        self.entry[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.doc[order], begins) if len(order) else np.zeros(0, "int64")
        self.id = _identity(self.head[self.first], self.region[self.first])

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(two hashes, start, suffix) of every 50-byte string of the suffixes named."""
        suffix, at = _each(self.start[which], self.count[which])
        return *_hashed(self.words, at), at, which[suffix]


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values if len(sorted_) else np.zeros(len(values), bool)


def _identity(head: np.ndarray, region: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(head * _ODD) + region)


def _each(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the region, start) of every string of regions."""
    index = np.repeat(np.arange(len(start)), count)
    return index, start[index] + np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)


def _hashed(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the 50 bytes at each place."""
    steps = (0, 8, 16, 24, 32, 40, MATCH - 8)
    return _joined(words, at, steps, 1), _joined(words, at, steps, 0x5851F42D4C957F2D)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND) if rows else _FOUND.empty_table()


def _by_chunk(kind: int, shard: int, chunk: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """A row for each chunk with its part of the columns."""
    order = np.argsort(chunk, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(chunk[order].view("int64")) != 0))[: len(order)]
    return [(kind, shard, int(chunk[part[0]]), len(part), packed(*(c[part] for c in columns))) for part in np.split(order, begins[1:]) if len(part)]


def _blocks(shards: int, hot):
    """A chunk's suffix array, cut by shard: rows (shard, chunk, n, payload of head, region, sides, least)."""

    def of(rows: pa.Table) -> pa.Table:
        found = Suffixes(rows["text"])
        found.entries(rows["doc"].to_numpy(), hot.value)
        k = found.first
        shard = (found.hash[k] >> np.uint64(17)) % np.uint64(shards)
        order = np.argsort(shard.astype("uint16" if shards <= 65_536 else "uint32"), kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(shard[order].view("int64")) != 0))[: len(order)]
        chunk = rows["chunk"][0].as_py()
        parts = [p for p in np.split(order, begins[1:]) if len(p)]
        return _rows([(LEVEL, int(shard[p[0]]), chunk, len(p), packed(found.head[k[p]], found.region[k[p]], found.sides[k[p]], found.least[p])) for p in parts])

    return of


def _loaded(rows: pa.Table) -> list[np.ndarray]:
    """head, region, sides, least and chunk of all entries of blocks, or of a level's shard (without least)."""
    parts = [[*unpacked(p, n), np.full(n, c, "uint64")] for p, n, c in zip(rows["payload"].to_pylist(), rows["n"].to_pylist(), rows["chunk"].to_pylist())]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, "uint64")] * 5


def _scanned(shard: int, head: np.ndarray, region: np.ndarray, sides: np.ndarray, doc: np.ndarray, chunk: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Rows that say which entries go and which are to be compared, and the place of the first of equal ones; doc is OLD for entries of a level."""
    order = _ordered(head, region, doc, True)
    head, region, sides, doc, chunk = (x[order] for x in (head, region, sides, doc, chunk))
    new = np.append(True, (np.diff(head) != 0) | (np.diff(region) != 0) | (np.diff(sides) != 0))[: len(head)]
    entry = np.cumsum(new) - 1
    gone = doc > doc[np.flatnonzero(new)][entry]
    border = np.zeros(len(head), bool)
    half = np.uint64(0xFFFFFFFF)
    heads = np.flatnonzero(np.append(True, head[1:] != head[:-1]))[: len(head)]
    sizes = np.diff(np.append(heads, len(head)))
    tied = np.repeat(entry[heads] != entry[heads + sizes - 1], sizes)
    for side in (sides >> np.uint64(32), sides & half):
        least = np.flatnonzero(tied & ~gone & (side != 0))
        key = _mixed(head[least] * _ODD + side[least])
        by = np.argsort(key)
        begins = np.flatnonzero(np.append(True, np.diff(key[by].view("int64")) != 0))[: len(by)]
        if len(by):
            e, now = entry[least[by]], doc[least[by]] != OLD
            differ = (np.minimum.reduceat(e, begins) < np.maximum.reduceat(e, begins)) & np.logical_or.reduceat(now, begins)
            border[least[by]] |= np.repeat(differ, np.diff(np.append(begins, len(by))))
    ids = _identity(head, region)
    rows = [r for kind, which in ((GONE, gone & (doc != OLD)), (BORDER, border)) for r in _by_chunk(kind, shard, chunk[which], ids[which], sides[which])]
    return rows, order[new]


def _within(rows: pa.Table) -> pa.Table:
    """The scan of a batch against itself, and its entries as a level."""
    shard = rows["shard"][0].as_py()
    head, region, sides, doc, chunk = _loaded(rows)
    found, first = _scanned(shard, head, region, sides, doc.view("int64"), chunk)
    return _rows([*found, (LEVEL, shard, -1, len(first), packed(*(x[first] for x in (head, region, sides, chunk))))])


def _against(batch: pa.Table, level: pa.Table) -> pa.Table:
    """The merge-scan of a batch against a level: the level's entries with a head of the batch meet the batch's."""
    if not len(batch) or not len(level):
        return _FOUND.empty_table()
    head, region, sides, doc, chunk = _loaded(batch)
    old = unpacked(level["payload"][0].as_py(), level["n"][0].as_py())
    met = _among(old[0], np.unique(head))
    old = [x[met] for x in old]
    met = _among(head, old[0])
    head, region, sides, doc, chunk = (x[met] for x in (head, region, sides, doc, chunk))
    now = [np.concatenate(p) for p in zip((head, region, sides, chunk), old)]
    rows, _ = _scanned(batch["shard"][0].as_py(), *now[:3], np.append(doc.view("int64"), np.full(len(old[0]), OLD)), now[3])
    return _rows(rows)


def _merged(older: pa.Table, newer: pa.Table) -> pa.Table:
    """Two levels' shards as one; of equal entries the older stays."""
    if not len(older) or not len(newer):
        return newer if len(newer) else older
    sides_ = [unpacked(t["payload"][0].as_py(), t["n"][0].as_py()) for t in (older, newer)]
    head, region, sides, chunk = (np.concatenate(p) for p in zip(*sides_))
    order = _ordered(head, region, np.repeat([0, 1], [len(s[0]) for s in sides_]), True)
    new = np.append(True, (np.diff(head[order]) != 0) | (np.diff(region[order]) != 0) | (np.diff(sides[order]) != 0))[: len(order)]
    kept = order[new]
    return _rows([(LEVEL, older["shard"][0].as_py(), -1, len(kept), packed(*(x[kept] for x in (head, region, sides, chunk))))])


class SuffixFamily:
    """The levels: bucketed tables with a sorted array for each shard, each with the number of batches it covers."""

    def __init__(self, spark: SparkSession, shards: int = 1, hot=None) -> None:
        self.spark, self.shards = spark, shards
        self.hot = hot or spark.sparkContext.broadcast(np.zeros(0, "uint64"))
        self.levels: list[tuple[int, DataFrame]] = []
        self._tables: list[Bucketed] = []
        self._results: list[Bucketed] = []

    def merge(self) -> None:
        """Levels of equal size become one, until all sizes differ."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, newer), (m, older) = self.levels.pop(), self.levels.pop()
            both = older.groupBy("shard").cogroup(newer.groupBy("shard")).applyInArrow(lambda a, b: _merged(a, b), FOUND)
            merged = bucketed(both.where(F.col("kind") == LEVEL), "suffix-level", self.shards, "shard", "kind", spread=False)
            for used in (self._tables.pop(), self._tables.pop()):
                used.drop(f"kind={LEVEL}")
            self.levels.append((n + m, merged.frame().where(F.col("kind") == LEVEL)))
            self._tables.append(merged)
            release(self.spark)

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (chunk, doc, text; without the first two it is one chunk of one document) whose documents come after all
        before; returns what the scans found, as rows (kind, shard, chunk, n, payload)."""
        self.merge()
        batch = batch.withColumns({c: F.lit(0).cast(t) for c, t in (("chunk", "int"), ("doc", "long")) if c not in batch.columns})
        blocks = batch.select("chunk", "doc", "text").groupBy("chunk").applyInArrow(_blocks(self.shards, self.hot), FOUND).repartition(self.shards, "shard")
        rows = blocks.groupBy("shard").applyInArrow(lambda rows: _within(rows), FOUND)
        for _, older in self.levels:
            rows = rows.unionByName(blocks.groupBy("shard").cogroup(older.groupBy("shard")).applyInArrow(lambda a, b: _against(a, b), FOUND))
        made = bucketed(rows, "suffix-level", self.shards, "shard", "kind", spread=False)
        release(self.spark)
        self.levels.append((1, made.frame().where(F.col("kind") == LEVEL)))
        self._tables.append(made)
        self._results.append(made)
        return made.frame().where(F.col("kind") != LEVEL)

    def drop(self) -> None:
        """Takes the tables away, also those of results."""
        for used in {t.name: t for t in self._tables + self._results}.values():
            used.drop()
        self.levels, self._tables, self._results = [], [], []


def _spread_heads(docs: DataFrame, every: int, size: int) -> np.ndarray:
    """The suffixes, by hash, around which more than TOGETHER different regions are expected to lie: fewer than suffixes / TOGETHER."""
    if size <= TOGETHER * HEAD:
        return np.zeros(0, "uint64")

    def regions(batches):
        for batch in batches:
            found = Suffixes(pa.chunked_array([batch["text"]]))
            yield pa.RecordBatch.from_pydict({"head": found.hash.view("int64"), "region": found.region.view("int64")})

    sample = docs.where(F.pmod(F.xxhash64("text", "doc"), F.lit(every)) == 0) if every > 1 else docs
    least = max(TOGETHER // every, SAMPLE_LEAST) if every > 1 else TOGETHER
    many = sample.select("text").mapInArrow(regions, "head long, region long").distinct().groupBy("head").count().where(F.col("count") > least)
    return np.sort(many.select("head").toArrow()["head"].to_numpy().view("uint64"))


def _contents(shards: int, hot):
    """The regions to compare: (shard, chunk, a, b, doc, content), a the entry's identity; and the strings around spread suffixes, each once for the chunk, with a and b its hashes and shard -1."""
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("content", pa.binary())])

    def of(rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        found = Suffixes(rows["text"])
        found.entries(rows["doc"].to_numpy(), hot.value)
        out = []
        wanted = np.unique(np.concatenate([np.zeros(0, "uint64"), *(unpacked(p, n)[0] for p, n in zip(marks["payload"].to_pylist(), marks["n"].to_pylist()))]))
        which = np.flatnonzero(_among(found.id, wanted))
        chunk, k = rows["chunk"][0].as_py(), found.first[which]
        if len(k):
            content = [found.data[s : s + c + MATCH - 1] for s, c in zip(found.start[k].tolist(), found.count[k].tolist())]
            shard = (found.hash[k] >> np.uint64(17)) % np.uint64(shards)
            out.append((shard.astype("int32"), np.full(len(k), chunk, "int32"), found.id[which].view("int64"), found.sides[k].view("int64"), found.least[which], pa.array(content, pa.binary())))
        if found.spread.any():
            a, b, _, suffix = found.strings(np.flatnonzero(found.spread))
            order = np.lexsort((b, a))
            begins = np.flatnonzero(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
            n = len(begins)
            least = np.minimum.reduceat(found.doc[suffix][order], begins)
            out.append((np.full(n, -1, "int32"), np.full(n, chunk, "int32"), a[order][begins].view("int64"), b[order][begins].view("int64"), least, pa.nulls(n, pa.binary())))
        return pa.concat_tables([pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema) for columns in out]) if out else schema.empty_table()

    return of, "shard int, chunk int, a long, b long, doc long, content binary"


def _compared(rows: pa.Table) -> pa.Table:
    """The single strings of regions that a smaller document has too: for each chunk (identity of the entry, sides, bits of its strings)."""
    content = rows["content"].combine_chunks()
    content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
    offsets = np.frombuffer(content.buffers()[1], "<i4")[content.offset : content.offset + len(content) + 1].astype("int64")
    data = bytes(memoryview(content.buffers()[2])[: offsets[-1]]) + bytes(8)
    row, at = _each(offsets[:-1], np.diff(offsets) - MATCH + 1)
    a, b = _hashed(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)), at)
    doc = rows["doc"].to_numpy()[row]
    order = np.lexsort((doc, b, a))
    begins = np.flatnonzero(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    least = np.repeat(doc[order][begins], np.diff(np.append(begins, len(order))))
    later = order[least < doc[order]]
    bits = np.zeros(len(offsets) - 1, "uint64")
    np.bitwise_or.at(bits, row[later], np.uint64(1) << (at[later] - offsets[:-1][row[later]]).astype("uint64"))
    hit = np.flatnonzero(bits)
    ids, sides = (rows[c].to_numpy()[hit].view("uint64") for c in ("a", "b"))
    return _rows(_by_chunk(STRINGS, rows["shard"][0].as_py(), rows["chunk"].to_numpy().astype("int64")[hit], ids, sides, bits[hit]))


def _gathered(rows: pa.Table) -> pa.Table:
    a, b = (rows[c].to_numpy().view("uint64") for c in ("a", "b"))
    return _rows(_by_chunk(SPREAD, -1, rows["chunk"].to_numpy().astype("int64"), a, b))


def _cut(hot):
    """The rows of the result for a chunk's texts and what was found for it."""

    def of(rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Suffixes(rows["text"])
        own.entries(rows["doc"].to_numpy(), hot.value)
        marks: dict[int, list[np.ndarray]] = {}
        for kind in (GONE, STRINGS, SPREAD):
            parts = [unpacked(p, n) for k, p, n in zip(found["kind"].to_pylist(), found["payload"].to_pylist(), found["n"].to_pylist()) if k == kind]
            marks[kind] = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, "uint64")] * 3
        by_id = np.argsort(own.id, kind="stable")

        def entries(ids: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(which of the marks are entries here, their entries)."""
            if not len(by_id) or not len(ids):
                return np.zeros(0, "int64"), np.zeros(0, "int64")
            e = by_id[np.minimum(np.searchsorted(own.id, ids, sorter=by_id), len(by_id) - 1)]
            hit = np.flatnonzero((own.id[e] == ids) & (own.sides[own.first[e]] == sides))
            return hit, e[hit]

        gone = np.zeros(len(own.first), bool)
        gone[entries(marks[GONE][0], marks[GONE][1])[1]] = True
        usual = ~own.spread
        whole = np.zeros(len(own.start), bool)
        whole[usual] = gone[own.entry[usual]] | (own.doc[usual] > own.least[own.entry[usual]])
        spans = [(own.start[whole], own.count[whole])]
        hit, e = entries(marks[STRINGS][0], marks[STRINGS][1])
        bits = np.zeros(len(own.first), "uint64")
        np.bitwise_or.at(bits, e, marks[STRINGS][2][hit])
        some = np.flatnonzero(usual & ~whole)
        some = some[bits[own.entry[some]] != 0]
        if len(some):
            suffix, at = _each(own.start[some], own.count[some])
            on = bits[own.entry[some]][suffix] >> (at - own.start[some][suffix]).astype("uint64") & np.uint64(1) == 1
            spans.append((at[on], np.ones(int(on.sum()), "int64")))
        if own.spread.any():
            a, b, at, suffix = own.strings(np.flatnonzero(own.spread))
            doc, key = own.doc[suffix], np.append(a, marks[SPREAD][0])
            order = np.lexsort((np.append(doc, np.full(len(marks[SPREAD][0]), OLD)), np.append(b, marks[SPREAD][1]), key))
            begins = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(np.append(b, marks[SPREAD][1])[order]) != 0)))
            docs = np.append(doc, np.full(len(marks[SPREAD][0]), OLD))[order]
            later = order[np.repeat(docs[begins], np.diff(np.append(begins, len(order)))) < docs]
            spans.append((at[later], np.ones(len(later), "int64")))
        edge = np.zeros(own.size + 1, "int32")
        for start, count in spans:
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + MATCH - 1, -1)
        cut = np.cumsum(edge[:-1]) > 0
        before, after = own.offsets[:-1], own.offsets[1:]
        total = np.concatenate([[0], np.cumsum(cut)])
        opened = cut & ~np.append(False, cut[:-1])
        opened[before[before < own.size]] = cut[before[before < own.size]]
        opens = np.concatenate([[0], np.cumsum(opened)])
        removed, data = total[after] - total[before], np.frombuffer(own.data, "uint8")
        sums = [hashlib.sha256(data[x:y][~cut[x:y]] if r else data[x:y]).hexdigest() for x, y, r in zip(before.tolist(), after.tolist(), removed.tolist())]
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(after - before, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(opens[after] - opens[before], pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    return lambda rows, found: of(rows, found) if len(rows) else pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})


def repeated_passages(documents: DataFrame, batches: int = BATCHES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of documents.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Null and short texts lose
    nothing; a null doc_id is below all others; rows with equal doc_ids take nothing from each other, but any of them
    from smaller ones. A very long text is a chunk of its own. Without rows the result is empty. Other columns play no part.
    """
    spark = documents.sparkSession
    docs = texts(documents).select("doc_id", F.coalesce(F.greatest("doc_id", F.lit(NO_ID + 1)), F.lit(NO_ID)).alias("doc"), "text")
    shape = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.percentile_approx("doc", [i / batches for i in range(1, batches + 1)], 1_000).alias("cuts")).first()
    size, cuts = shape["bytes"] or 0, (shape["cuts"] or [])[: batches - 1]
    per = max(1, -(-size // (batches * chunk_bytes)))
    shards = max(1, -(-size // (SHARD_CHUNKS * chunk_bytes)))
    batch = sum((F.col("doc") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    dealt = docs.withColumn("batch", batch).withColumn("chunk", (F.col("batch") * per + F.pmod(F.xxhash64("doc", "text"), F.lit(per))).cast("int"))
    chunks = bucketed(dealt, "passage-texts", per, "chunk", "batch").frame()
    release(spark)
    hot = spark.sparkContext.broadcast(_spread_heads(chunks, SAMPLE_EVERY if shards > 1 else 1, size))

    family, found = SuffixFamily(spark, shards, hot), []
    for k in range(len(cuts) + 1):
        found.append(family.append(chunks.where(F.col("batch") == k)))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    marks = bucketed(every.select(*_FOUND.names), "passage-marks", per, "chunk", "kind").frame()
    family.drop()
    release(spark)
    of, schema = _contents(shards, hot)
    contents = chunks.select("chunk", "doc", "text").groupBy("chunk").cogroup(marks.where(F.col("kind") == BORDER).groupBy("chunk")).applyInArrow(of, schema)
    path = new_path(spark, "passage-contents")
    contents = materialize(contents, "passage-contents", path)
    strings = contents.where("shard >= 0").groupBy("shard").applyInArrow(lambda rows: _compared(rows), FOUND)
    verdicts = marks.where(F.col("kind") == GONE).select(*_FOUND.names).unionByName(strings)
    if len(hot.value):
        spread = contents.where("shard < 0").select("a", "b", "doc", "chunk")
        least = spread.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("a", "b", "least")
        later = spread.join(least, ["a", "b"]).where("doc > least").select("chunk", "a", "b")
        verdicts = verdicts.unionByName(later.groupBy("chunk").applyInArrow(lambda rows: _gathered(rows), FOUND))
    verdicts = bucketed(verdicts, "passage-verdicts", per, "chunk").frame()
    discard(spark, path)
    release(spark)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return chunks.select("chunk", "doc_id", "doc", "text").groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(_cut(hot), result)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
