"""Operator 3: token ids in binary blocks under a shared zstandard dictionary.

A dictionary is trained on the serialized id arrays of a bounded sample; each document is compressed as a frame of its
own. Blocks hold the frames of neighbouring documents with their offset index and the dictionary's hash, so that one
short document is read without its neighbours. Spark writes the blocks and the dictionary as tables (its committer
makes lost and repeated tasks harmless, on any store that Spark reaches).

Layout of a folder: ``blocks`` (shard, block, first_doc_id, last_doc_id, ids_before, dict_hash, doc_ids, n_ids, offsets,
payload; a document's frame is payload[offsets[i]:offsets[i + 1]], unsigned 32-bit little-endian ids inside) and
``dictionary`` (dict_hash, content). Shards are ranges of doc_id in ascending order.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticeloom.llm.common import discard, materialize, new_path, shuffles_dropped, spread, table, texts
from noticeloom.llm.token_counts import SIMPLE_BELOW, _byte_alphabet, _letters_class

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: The dictionary learns from about so many documents of at most so many bytes, drawn by the hash of their id.
SAMPLE_DOCUMENTS = 2000
SAMPLE_BYTES = 65_536
DICTIONARY_BYTES = 65_536
#: A block is closed at so many bytes or documents.
BLOCK_BYTES = 4 << 20
BLOCK_DOCUMENTS = 4096
#: Bytes of frames in a shard.
SHARD_BYTES = 16 << 20
#: Pre-tokens whose ids a worker remembers in a table; a full one is kept beside the next until that is full too.
MEMO_ENTRIES = 400_000
PIECES = 200_000

BLOCKS = "shard int, block int, first_doc_id long, last_doc_id long, ids_before long, dict_hash string, doc_ids array<long>, n_ids array<long>, offsets array<long>, payload binary"


class Merged(dict):
    """The packed ids of pre-tokens, merged when they are first asked for."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.merge, self.shown = tokenizer.model.tokenize, str.maketrans({chr(b): c for c, b in _byte_alphabet().items()})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = array.array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.shown))]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Texts to packed ids, as Tokenizer.encode gives them; pre-tokens met before are looked up."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        specials = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_ids, self.special = specials, re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        letters, numbers = _letters_class()
        space = r"\t-\r \x85\xa0"
        self.simple = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.other = re.compile(f"[^\\x00-{chr(SIMPLE_BELOW - 1)}]")
        self.memo = Merged(self.tokenizer)

    def pieces(self, text: str) -> Iterator[str]:
        if not self.other.search(text):
            return (m[0] for m in self.simple.finditer(text)) if len(text) > 8 * PIECES else iter(self.simple.findall(text))
        return (text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.special_ids:
                out.append(self.special_ids[part])
                continue
            pieces = self.pieces(part)
            while block := list(itertools.islice(pieces, PIECES)):
                out.append(b"".join(map(self.memo.__getitem__, block)))
        return b"".join(out)


def train_dictionary(documents: DataFrame, path: str) -> DataFrame:
    """One row (dict_hash, content). Content is empty, with a warning in the task's log, where zstandard finds the sample too small or too uniform to train on."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        samples = [encoder.encode(t) for b in batches for t in b["text"]]
        try:
            content = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 20 else b""
        except zstandard.ZstdError as refusal:
            warnings.warn(f"no dictionary from {len(samples)} samples: {refusal}", stacklevel=1)
            content = b""
        yield pd.DataFrame({"dict_hash": [hashlib.sha256(content).hexdigest()], "content": [content]})

    fits = documents.where(F.octet_length("text").between(1, SAMPLE_BYTES))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, fits.count() // SAMPLE_DOCUMENTS)))  # about SAMPLE_DOCUMENTS rows, twice as many at most
    return fits.where(slot == 0).repartition(1).sortWithinPartitions("doc_id", "text").select("text").mapInPandas(train, "dict_hash string, content binary")


def write_token_files(documents: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of every text, each with end_id after it, in ascending doc_id order.

    Texts are encoded and compressed where they lie, and only their frames are put in order. An empty or null text gives
    end_id alone. Rows with the same doc_id follow each other, ordered by their frames; a null doc_id comes first. A very
    long text is one frame. Without rows the tables are empty. Other columns play no part.
    """
    spark = documents.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    docs = texts(documents)
    train_dictionary(docs, path).write.parquet(f"{folder}/dictionary")
    trained = spark.read.schema("dict_hash string, content binary").parquet(f"{folder}/dictionary").first()  # one row of bounded size
    dict_hash, content = (trained.dict_hash, bytes(trained.content)) if trained else (hashlib.sha256(b"").hexdigest(), b"")
    end = np.array([end_id], "<u4").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdCompressor(level=3)
        for batch in batches:
            counts, found = [], []
            for text in batch["text"]:
                raw = encoder.encode(text.as_py()) + end
                counts.append(len(raw) // 4)
                found.append(compressor.compress(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_ids", "frame"])

    scratch = new_path(spark, "token-frames")
    framed = materialize(spread(docs).mapInArrow(frames, "doc_id long, n_ids long, frame binary"), "token-frames", scratch)
    shards = max(1, -(-(framed.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0) // SHARD_BYTES))
    ordered = framed.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "frame").withColumn("shard", F.spark_partition_id())
    with shuffles_dropped(spark):
        ordered.mapInArrow(_blocks(dict_hash), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(spark, scratch)


def _blocks(dict_hash: str):
    """Frames in order to blocks."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("ids_before", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, size, shard = 0, 0, 0, 0
        ids, counts, frames = [], [], []

        def block() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [shard, number, min(known, default=None), max(known, default=None), before, dict_hash, ids, counts, [0, *itertools.accumulate(map(len, frames))], b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for doc_id, n, frame, shard in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_ids", "frame", "shard"))):
                frames.append(frame)
                ids.append(doc_id)
                counts.append(n)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS:
                    yield block()
                    before += sum(counts)
                    number, size, ids, counts, frames = number + 1, 0, [], [], []
        if ids:
            yield block()

    return blocks


def _decompressors(folder: str, spark: SparkSession) -> dict[str, bytes]:
    """The folder's dictionaries by hash: one of bounded size."""
    return {r.dict_hash: bytes(r.content) for r in spark.read.schema("dict_hash string, content binary").parquet(f"{folder}/dictionary").collect()}


def _opened(dict_hash: str, dictionaries: dict[str, bytes]) -> zstandard.ZstdDecompressor:
    content = dictionaries.get(dict_hash, b"")
    if hashlib.sha256(content).hexdigest() != dict_hash:
        raise ValueError(f"no dictionary with hash {dict_hash}")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdDecompressor()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (packed unsigned 32-bit little-endian) of every document."""
    stored = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    dictionaries = _decompressors(folder, spark)
    totals = stored.groupBy("shard").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()  # a row for each shard
    starts = dict(zip((r.shard for r in totals), itertools.accumulate((r.n for r in totals), initial=0)))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            for row in batch.to_pylist():
                frame = opened.setdefault(row["dict_hash"], None) or opened.update({row["dict_hash"]: _opened(row["dict_hash"], dictionaries)}) or opened[row["dict_hash"]]
                begins = [starts[row["shard"]] + row["ids_before"] + n for n in itertools.accumulate(row["n_ids"], initial=0)]
                at = row["offsets"]
                for i in range(0, len(row["doc_ids"]), 256):
                    part = range(i, min(i + 256, len(row["doc_ids"])))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"][i : i + 256], pa.int64()), "start": pa.array(begins[i : i + len(part)], pa.int64()), "ids": pa.array([frame.decompress(row["payload"][at[k] : at[k + 1]]) for k in part], pa.binary())})

    return stored.mapInArrow(documents, "doc_id long, start long, ids binary")


def fetch_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents named: only blocks whose range holds one are read, only its frame is decompressed."""
    wanted = sorted(set(doc_ids))
    dictionaries = _decompressors(folder, spark)
    holds = F.exists(F.array(*map(F.lit, wanted)), lambda x: x.between(F.col("first_doc_id"), F.col("last_doc_id"))) if wanted else F.lit(False)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = {h: _opened(h, dictionaries) for h in dictionaries}
        for batch in batches:
            rows = [(d, np.frombuffer(opened[b.dict_hash].decompress(b.payload[b.offsets[i] : b.offsets[i + 1]]), "<u4").astype("int64")) for b in batch.itertuples() for i, d in enumerate(b.doc_ids) if d in wanted]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(holds).mapInPandas(frames, "doc_id long, ids array<long>")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
