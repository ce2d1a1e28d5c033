"""Many terms at once: an automaton (a trie with failure links) reads each text a single time, however many terms there are.

The terms are rules, so they come with the plan; each Python worker builds their automaton once and keeps it. Texts
come in Arrow batches. A table of terms that is data itself comes in blocks: operators.rules.term_hits.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=16)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """Each distinct term with its first place in the list and its length; empty terms are none."""
    found = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        if term and term not in found:
            found.add_word(term, (place, len(term)))
    if not len(found):
        return None
    found.make_automaton()
    return found


def occurrences(text: str, terms: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
    """(start, end, place of the term) from left to right: where several terms begin the longest counts, and none begins within another."""
    found = automaton(terms)
    longest: dict[int, tuple[int, int]] = {}
    for last, (place, size) in found.iter(text) if found else ():
        if size > longest.get(last - size + 1, (0, 0))[0]:
            longest[last - size + 1] = (size, place)
    upto = 0
    for start in sorted(longest):
        if start >= upto:
            size, place = longest[start]
            upto = start + size
            yield start, upto, place


def replace_terms(text: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """Every occurrence of a source becomes its target between blanks, in one pass: what a target holds is not looked at again. Of equal sources the first entry counts."""
    sources, targets = tuple(s for s, _ in entries), [f" {t} " for _, t in entries]

    def replaced(value: str) -> str:
        out, upto = [], 0
        for start, end, place in occurrences(value, sources):
            out += [value[upto:start], targets[place]]
            upto = end
        return "".join([*out, value[upto:]])

    @F.pandas_udf("string")
    def each(values: pd.Series) -> pd.Series:
        return values.map(replaced, na_action="ignore")

    return each(text)


def first_rule(text: Column, rules: Sequence[Sequence[str]]) -> Column:
    """The place of the first rule of which a term occurs in the text; null where none does. All rules are tested in one pass."""
    rank: dict[str, int] = {}
    for place, terms in enumerate(rules):
        for term in terms:
            rank.setdefault(term, place)
    terms, ranks = tuple(rank), list(rank.values())

    def first(value: str | None) -> int | None:
        found = automaton(terms)
        best = None
        for _, (place, _) in found.iter(value) if found and value else ():
            if best is None or ranks[place] < best:
                best = ranks[place]
                if not best:
                    break
        return best

    @F.pandas_udf("int")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([first(v) for v in values], dtype="Int32", index=values.index)

    return each(text)


@lru_cache(maxsize=1)
def _byte_automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Each word with its place in the list; one such automaton at a time is kept."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for place, word in enumerate(words):
        found.add_word(word, place)
    found.make_automaton()
    return found


def places_held(text: Column, words: Sequence[bytes]) -> Column:
    """The places in the list of the distinct, non-empty words that occur in the text, each once; none in a null text.

    Words and text are read byte by byte, so that a node has few ways on in any script; in UTF-8 no word begins within a character.
    """
    letters = tuple(w.decode("latin-1") for w in words)

    @F.arrow_udf("array<int>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = _byte_automaton(letters) if letters else None
        for batch in batches:
            places, ends = array("i"), [0]
            for value in batch:
                if found and value.is_valid:
                    places.extend({place for _, place in found.iter(value.as_py().decode("latin-1"))})
                ends.append(len(places))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(places, np.int32) if places else [], pa.int32()))

    return each(text.cast("binary"))
