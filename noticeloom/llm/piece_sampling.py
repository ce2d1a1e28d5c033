"""Operator 5: SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for each vocabulary piece; a character that no
piece holds is a chain of byte pieces. An edge weighs 1 / (1 + rank) ** alpha, rank being the piece's place among the
merges (Zipf's law for the piece's share). Forward filtering sums the weights of all paths to each node; backward
sampling draws from the end, so a segmentation comes out with its exact share of the total. No piece spans the start of
a run of blanks, so the lattice falls into segments there and filtered segments are reused.

The random numbers are a hash of (seed, row key, segment, step): a row's segmentation depends on nothing else.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import spread, table, texts

MODEL = "piece_bpe_32k.model"
SEED = 20_240_501
ALPHA = 1.0
#: Filtered segments that a worker remembers in a store; a full one is kept beside the next until that is full too. Longer segments aren't kept.
STORE_SEGMENTS = 200_000
KEPT_CHARS = 64
#: Characters of a batch that are sampled together.
GROUP_CHARS = 400_000

SEGMENT = re.compile(" *[^ \n]+| +|\n")


class Pieces:
    """The vocabulary: pieces with a blank for the blank sign, byte pieces, and what ids decode to."""

    def __init__(self, path: str, alpha: float) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids, self.bytes = [0] * 256, []
        special = [i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i)]
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif i in special:
                self.bytes.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.ids[text] = (i, (1.0 - model.get_score(i)) ** -alpha)
                self.bytes.append(text.encode())
        self.longest = max(map(len, self.ids))
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.single = {p for p in self.ids if len(p) == 1}
        states = {"": 0} | {p: k for k, p in enumerate(sorted(self.starts), 1)}
        steps = sorted((states[p[:-1]] << 21 | ord(p[-1]), states[p]) for p in self.starts)
        #: The trie of all pieces: (state, character) -> state, and each state's piece, if it is one.
        self.step_keys, self.step_to = np.array([k for k, _ in steps], "int64"), np.array([t for _, t in steps], "int64")
        self.state_id, self.state_weight = np.full(len(states), -1, "int32"), np.zeros(len(states))
        for piece, (i, weight) in self.ids.items():
            self.state_id[states[piece]], self.state_weight[states[piece]] = i, weight


class Lattices:
    """Filtered segments, flat: the edges into node v start at begin[v] and have v < cut <= v + 1, cut being v plus the cumulated share."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.segments: dict[str, int] = {}
        self.first, self.last = array.array("q"), array.array("q")
        self.cut, self.source, self.id, self.begin = array.array("d"), array.array("q"), array.array("i"), array.array("q")
        self.nodes = 0

    def add(self, segment: str) -> None:
        """Forward filtering of one segment, with common scaling so that long segments don't underflow."""
        pieces, n, base = self.pieces, len(segment), self.nodes
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        total = [0.0] * (n + 1)
        total[0] = 1.0
        chains: list[tuple[int, int, bytes]] = []
        extra = 0
        for i in range(n):
            if i and total[i] < 1e-150:
                low = max(0, i - pieces.longest)
                factor = 1.0 / total[i]
                for k in range(low, min(n, i + pieces.longest) + 1):
                    total[k] *= factor
                    into[k] = [(s, w * factor, p) for s, w, p in into[k]]
            here = total[i]
            for j in range(i + 1, min(n, i + pieces.longest) + 1):
                part = segment[i:j]
                if part not in pieces.starts:
                    break
                if hit := pieces.ids.get(part):
                    into[j].append((i, here * hit[1], hit[0]))
                    total[j] += here * hit[1]
            if segment[i] not in pieces.ids:
                code = segment[i].encode()
                chains.append((i, n + 1 + extra, code))
                extra += len(code) - 1
                into[i + 1].append((n + extra if len(code) > 1 else i, here, pieces.byte_ids[code[-1]]))
                total[i + 1] += here
        for v in range(n + 1):
            run, share = 0.0, total[v] or 1.0
            self.begin.append(len(self.cut))
            for k, (s, w, p) in enumerate(into[v]):
                run += w / share
                self.cut.append(base + v + (1.0 if k == len(into[v]) - 1 else min(run, 1.0)))
                self.source.append(base + s)
                self.id.append(p)
        for i, at, code in chains:
            for k, b in enumerate(code[:-1]):
                self.begin.append(len(self.cut))
                self.cut.append(base + at + k + 1.0)
                self.source.append(base + (i if k == 0 else at + k - 1))
                self.id.append(pieces.byte_ids[b])
        self.segments[segment] = len(self.first)
        self.first.append(base)
        self.last.append(base + n)
        self.nodes += n + 1 + extra

    def add_all(self, segments: list[str]) -> None:
        """Forward filtering of many short segments together: all walk the trie a character at a time, then sums pass from position to position."""
        plain = [s for s in segments if len(s) <= KEPT_CHARS and self.pieces.single.issuperset(s)]
        for s in set(segments).difference(plain) if len(plain) < len(segments) else ():
            self.add(s)
        if not plain:
            return
        pieces, lengths = self.pieces, np.fromiter(map(len, plain), "int64", len(plain))
        codes = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4").astype("int64")
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        left = np.repeat(lengths, lengths) - place
        node = np.arange(len(codes)) + np.repeat(np.arange(len(plain)), lengths)  # a segment of n characters has n + 1 nodes
        at, state, found = np.arange(len(codes)), np.zeros(len(codes), "int64"), []
        for n in range(1, pieces.longest + 1):
            key = state << 21 | codes[at + n - 1]
            hit = np.minimum(np.searchsorted(pieces.step_keys, key), len(pieces.step_keys) - 1)
            go = pieces.step_keys[hit] == key
            at, state = at[go], pieces.step_to[hit[go]]
            piece = pieces.state_id[state] >= 0
            found.append((at[piece], np.full(int(piece.sum()), n), state[piece]))
            more = left[at] > n
            at, state = at[more], state[more]
            if not len(at):
                break
        at, n, state = map(np.concatenate, zip(*found))
        source, weight = node[at], pieces.state_weight[state]
        total = np.zeros(len(codes) + len(plain))
        total[starts + np.arange(len(plain))] = 1.0
        order = np.argsort(place[at] * 32 + n, kind="stable")
        group = (place[at] * 32 + n)[order]
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            e = order[a:b]  # one edge of each segment: no target comes twice
            total[source[e] + n[e]] += total[source[e]] * weight[e]
        target = source + n
        order = np.lexsort((source, target))
        source, target, state = source[order], target[order], state[order]
        run = np.cumsum(total[source] * weight[order] / total[target])
        first = np.flatnonzero(np.diff(target, prepend=-1))
        final = np.append(first[1:], len(target)) - 1
        run -= np.repeat(np.append(0.0, run[final[:-1]]), final - first + 1)
        run = np.minimum(run, 1.0)
        run[final] = 1.0
        base = self.nodes
        into = np.bincount(target, minlength=len(codes) + len(plain))
        self.begin.frombytes((len(self.cut) + np.cumsum(into) - into).tobytes())
        self.cut.frombytes((base + target + run).tobytes())
        self.source.frombytes((base + source).tobytes())
        self.id.frombytes(pieces.state_id[state].tobytes())
        begin = base + starts + np.arange(len(plain))
        known = len(self.first)
        self.first.frombytes(begin.tobytes())
        self.last.frombytes((begin + lengths).tobytes())
        self.segments.update(zip(plain, range(known, known + len(plain))))
        self.nodes += len(codes) + len(plain)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    def __init__(self, path: str, seed: int = SEED, alpha: float = ALPHA) -> None:
        self.lattices = Lattices(Pieces(path, alpha))
        self.before = Lattices(self.lattices.pieces)
        self.seed = np.uint64(seed)

    def _filtered(self, distinct: set[str]) -> tuple[list[Lattices], dict[str, int]]:
        """The stores that hold the segments, and each segment's place: its number times their number plus the store's."""
        pieces = self.lattices.pieces
        new = lambda: [s for s in distinct if s not in self.lattices.segments and s not in self.before.segments]
        fresh = new()
        if len(self.lattices.segments) + len(fresh) > STORE_SEGMENTS:
            self.before, self.lattices = self.lattices, Lattices(pieces)
            fresh = new()
        aside = Lattices(pieces)
        self.lattices.add_all([s for s in fresh if len(s) <= KEPT_CHARS])
        aside.add_all([s for s in fresh if len(s) > KEPT_CHARS])
        stores = [self.lattices, self.before, aside]
        return stores, {s: number * len(stores) + k for k, store in enumerate(stores) for s in distinct & store.segments.keys() for number in (store.segments[s],)}

    def sample(self, rows: list[tuple[int | None, str]]) -> list[np.ndarray]:
        """The piece ids of each (key, text). A leading blank is added, as the model's own normalization does; empty texts have no pieces."""
        split = [SEGMENT.findall(" " + text) if text else [] for _, text in rows]
        stores, places = self._filtered(set().union(*split))
        counts = np.array([len(s) for s in split], "int64")
        n = int(counts.sum())
        which = np.fromiter((u for s in split for u in map(places.__getitem__, s)), "int64", n)
        keys = _mixed(np.array([(k or 0) & 0xFFFFFFFFFFFFFFFF for k, _ in rows], "uint64") ^ _mixed(np.array([self.seed])))
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        state = _mixed(np.repeat(keys, counts) + place.astype("uint64") * np.uint64(0x9E3779B97F4A7C15))
        length, steps = np.zeros(n, "int64"), []
        for k, store in enumerate(stores):
            units = np.flatnonzero(which % len(stores) == k)
            if len(units):
                self._drawn(store, units, which[units] // len(stores), state[units], length, steps)
        ends = np.cumsum(length)
        out = np.zeros(int(ends[-1]) if n else 0, "int32")
        for step, where, found in steps:
            out[ends[where] - step] = found
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])] if n else np.zeros(len(rows) + 1, "int64")
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    @staticmethod
    def _drawn(store: Lattices, units: np.ndarray, segment: np.ndarray, state: np.ndarray, length: np.ndarray, steps: list) -> None:
        """Backward sampling of the units (segments of one store), all a piece at a time: adds (step, units, pieces) to steps and counts pieces in length."""
        cut, source, ids, begin = np.frombuffer(store.cut, "d"), np.frombuffer(store.source, "q"), np.frombuffer(store.id, "i"), np.frombuffer(store.begin, "q")  # views, gone before the store grows
        first, node = np.frombuffer(store.first, "q")[segment], np.frombuffer(store.last, "q")[segment]
        live = np.flatnonzero(node > first)
        units, state, first, node = units[live], state[live], first[live], node[live]
        for step in range(1, 1 << 40):
            if not len(units):
                return
            u = (_mixed(state + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)).astype("d") * 2.0**-52
            drawn = np.minimum(node + u, np.nextafter(node + 1.0, 0.0))
            edge = begin[node]
            more = np.flatnonzero(cut[edge] <= drawn)
            while len(more):  # a node has few edges, and the first ones, of the longest pieces, are the likeliest
                edge[more] += 1
                more = more[cut[edge[more]] <= drawn[more]]
            node = source[edge]
            length[units] += 1
            steps.append((step, units, ids[edge]))
            live = np.flatnonzero(node != first)
            if len(live) < len(units):
                units, state, first, node = units[live], state[live], first[live], node[live]


def encode_sampled(documents: DataFrame, path: str | None = None, seed: int = SEED, alpha: float = ALPHA, keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """doc_id, the columns of keep, text and piece_ids: a sampled segmentation of each whole text, seeded by its doc_id.

    Empty and null texts have no pieces; rows that repeat get the same pieces; a null doc_id counts as 0 for the seed.
    With decoded, a column of that name holds the text that the pieces decode to, made by the same worker.
    """
    path = path or public_tokenizers.path(MODEL)
    docs = spread(texts(documents, *keep))
    more = [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(path, seed, alpha)
        content = sampler.lattices.pieces.bytes
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(batch):  # about GROUP_CHARS at a time
                done = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, done + GROUP_CHARS)))
                part = batch.slice(begin, end - begin)
                begin = end
                found = sampler.sample(list(zip(part["doc_id"].to_pylist(), part["text"].to_pylist())))
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype("int32")
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))]
                if decoded:
                    columns.append(pa.array([_text(ids, content) for ids in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *(f.name for f in more)])

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *more]))


def _text(ids: np.ndarray, content: list[bytes]) -> str:
    """The pieces' bytes joined, without the leading blank that encoding added."""
    return b"".join(map(content.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def decode_pieces(piece_ids, path: str | None = None):
    """The text of each list of piece ids; null for null."""
    path = path or public_tokenizers.path(MODEL)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        content = Pieces(path, ALPHA).bytes
        for batch in batches:
            yield pd.Series([None if ids is None else _text(ids, content) for ids in batch], dtype="object")

    return decode(piece_ids)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_sampled(table(spark, sf_dir, "documents"), decoded=True)
    return encoded.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("lossless"))
