"""Operator 1: token counts with a whole-token shortcut.

The vocabulary of a BPE tokenizer with word ends holds strings that, standing alone as a pre-token, encode as exactly
one token. :func:`prove_whole_tokens` finds them offline by encoding every vocabulary string once. Counting then splits
a text into pre-tokens, counts those that are proven directly, and runs the merges only for the rest; merged counts are
remembered per worker in a table of bounded size.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from noticeloom.llm.common import spread, table, texts

VOCABULARY = "word_bpe_49k.json"
#: Merged counts that a worker remembers; the table is emptied when full.
MEMO_ENTRIES = 400_000
#: Pre-tokens that are counted at a time, so that a very long text needs no list of all its pre-tokens.
BLOCK = 200_000
#: Below this code point every text is in NFC already and lower-casing needs no context.
SIMPLE_BELOW = 0x300


def _letters_class() -> tuple[str, str]:
    """Character classes, from the Unicode categories, of the letters and numbers below SIMPLE_BELOW."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(SIMPLE_BELOW) if unicodedata.category(chr(c))[0] == kind)
    return of("L"), of("N")


class PretokenCounter:
    """Counts tokens as Tokenizer.encode does without added special tokens; special strings inside a text count as one token each."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.full = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.base = dict.fromkeys(whole, 1)
        self.memo = dict(self.base)
        specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        letters, numbers = _letters_class()
        space = r"\t-\r \x85\xa0"
        self.simple = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.other = re.compile(f"[^\\x00-{chr(SIMPLE_BELOW - 1)}]")

    def pretokens(self, text: str) -> Iterator[str]:
        """The pre-tokens of a text without special strings; texts beyond the simple range are split by the library itself."""
        if not self.other.search(text):
            return (m[0] for m in self.simple.finditer(text.lower())) if len(text) > 8 * BLOCK else iter(self.simple.findall(text.lower()))
        text = self.full.normalizer.normalize_str(text)
        return (text[a:b] for _, (a, b) in self.full.pre_tokenizer.pre_tokenize_str(text))

    def merge_rest(self, words: set[str]) -> None:
        """Afterwards the table holds all the words; a full table is emptied before, but for what is proven."""
        rest = [w for w in words if w not in self.memo]
        if rest and len(self.memo) + len(rest) > MEMO_ENTRIES + len(self.base):
            self.memo = dict(self.base)
            rest = [w for w in words if w not in self.memo]
        if rest:
            self.memo.update(zip(rest, (len(e.ids) for e in self.merger.encode_batch_fast(rest, add_special_tokens=False))))

    def count(self, text: str) -> int:
        n = 0
        parts = [text]
        if self.special and "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            words = self.pretokens(part)
            while block := list(itertools.islice(words, BLOCK)):
                self.merge_rest(set(block))
                n += sum(map(self.memo.__getitem__, block))
        return n


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that provably encode alone as one token: each vocabulary string is decoded to text, split and encoded once."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.normalizer = normalizers.Sequence([])
    suffix = tokenizer.model.end_of_word_suffix or ""
    alphabet = _byte_alphabet()
    candidates = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith(suffix):
            try:
                candidates.append(bytes(alphabet[c] for c in piece[: len(piece) - len(suffix)]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    candidates = [c for c in candidates if c and [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(c)] == [(0, len(c))]]
    specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    encoded = tokenizer.encode_batch(candidates, add_special_tokens=False)
    return frozenset(c for c, e in zip(candidates, encoded) if len(e.ids) == 1 and c not in specials)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stays, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of each text, as the library's encode gives them without begin, end or added special tokens. A null text has none.

    The proof runs once where the plan is built; what goes to the workers is bounded by the vocabulary. Empty texts have
    no tokens; a text of any length is counted whole, in blocks.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    whole = prove_whole_tokens(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PretokenCounter(path, whole)
        for batch in batches:
            yield pd.Series([counter.count(t or "") for t in batch], dtype="int64")

    return count(text)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(texts(table(spark, sf_dir, "documents")))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text")).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 2048)
