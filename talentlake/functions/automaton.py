"""Matching of whole taxonomies in one pass over a text.

All synonyms of any number of taxonomies stand in one Aho-Corasick automaton, so a text is read once, however many there are, and the
plan holds one expression.  The automaton is built once in each worker; its entries travel with the function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Entries = Sequence[tuple[str, str]]


class Automaton:
    """The synonyms of several taxonomies, each a list of (synonym, canonical) in order of preference."""

    def __init__(self, tables: Sequence[Entries]):
        import ahocorasick

        self.tables = tables
        places: dict[str, list[tuple[int, int]]] = {}
        for t, entries in enumerate(tables):
            for rank, (synonym, _) in enumerate(entries):
                if synonym:
                    places.setdefault(synonym, []).append((t, rank))
        self.found = ahocorasick.Automaton()
        for synonym, where in places.items():
            self.found.add_word(synonym, (len(synonym), where))
        if places:
            self.found.make_automaton()

    def _matches(self, low: str | None) -> Iterator:
        return self.found.iter(low) if low and len(self.found) else iter(())

    def first(self, low: str | None) -> list[str | None]:
        """Of each taxonomy the canonical of the most preferred synonym that is a substring."""
        best: list[int | None] = [None] * len(self.tables)
        for _, (_, where) in self._matches(low):
            for t, rank in where:
                if best[t] is None or rank < best[t]:
                    best[t] = rank
        return [None if r is None else self.tables[t][r][1] for t, r in enumerate(best)]

    def every(self, low: str | None) -> list[list[str]]:
        """Of each taxonomy the canonicals of all synonyms that stand as whole tokens, in order of preference."""
        ranks: list[set[int]] = [set() for _ in self.tables]
        for end, (n, where) in self._matches(low):
            start = end - n + 1
            if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                continue
            for t, rank in where:
                ranks[t].add(rank)
        return [list(dict.fromkeys(self.tables[t][r][1] for r in sorted(found))) for t, found in enumerate(ranks)]


_built: dict[str, Automaton] = {}


def _automaton(digest: str, tables: Sequence[Entries]) -> Automaton:
    if digest not in _built:
        if len(_built) >= 8:
            _built.clear()
        _built[digest] = Automaton(tables)
    return _built[digest]


def _reader(text: Column, tables: Sequence[Entries], lowered: bool, whole: bool) -> Column:
    tables = tuple(tuple(t) for t in tables)
    digest = hashlib.sha256(repr(tables).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("array<array<string>>" if whole else "array<string>")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = _automaton(digest, tables)
        take = found.every if whole else found.first
        for s in parts:
            yield pd.Series([take(x if lowered or x is None else x.lower()) for x in s.tolist()], dtype=object)

    return read(text)


def first_in(text: Column, tables: Sequence[Entries], lowered: bool = False) -> Column:
    """array<string>: for each taxonomy the canonical of its most preferred synonym that is a substring of the text, or null."""
    return _reader(text, tables, lowered, whole=False)


def every_in(text: Column, tables: Sequence[Entries], lowered: bool = False) -> Column:
    """array<array<string>>: for each taxonomy the canonicals with a synonym that stands in the text as a whole token."""
    return _reader(text, tables, lowered, whole=True)
