"""Operator 4: byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch lie as one flat
symbol array, and each round merges, in every word at once, the pairs of lowest
rank.  Ranks are found by binary search over sorted pair keys.  No shuffle.

Defined results: null text counts as empty (no ids); an empty text has no ids and
decodes to the empty text; rows are independent, so ties, repeated rows and extra
columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.common import add_columns, held, table

#: The published pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of Latin letters up to U+024F, and the characters for which it may differ.
LATIN_PRE_TOKEN = r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_LATIN = r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f]"


@functools.cache
def byte_letters() -> dict[str, int]:
    """The published byte alphabet of such vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A byte-level BPE vocabulary file, as arrays."""

    def __init__(self, path: str, word_bound: int = 150_000):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.base = np.zeros(256, np.int64)
        pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.base[letters[token]] = i
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.byte_size = np.fromiter(map(len, pieces), np.int64, size)
        self.byte_at, self.bytes = np.cumsum(self.byte_size) - self.byte_size, np.frombuffer(b"".join(pieces), np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.into = key[order], order.astype(np.int64), into
        self.pattern, self._plain, self._odd = regex.compile(PRE_TOKEN), re.compile(LATIN_PRE_TOKEN), re.compile(NOT_LATIN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.word_bound = word_bound
        self._forget()

    def _forget(self) -> None:
        """Starts the table of known words: a number for each, and where its ids lie in one flat array."""
        self.known: dict = {(t,): k for k, t in enumerate(self.added)}
        self.flat = np.array([*self.added.values(), *[0] * 1024], np.uint32)
        self.filled = len(self.added)
        self.sizes, self.starts = np.ones(1024 + self.filled, np.int64), np.arange(1024 + self.filled)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; Latin texts take an equal pattern that is faster."""
        return (self.pattern if self._odd.search(text) else self._plain).findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; a number past all ranks where the pair never merges."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int64(len(self.keys)))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, one after the other, and how many each has; all words are merged together round by round."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_sym, done_word = [], []
        none = len(self.keys)
        rank = self.rank(sym[:-1], sym[1:]) if len(sym) > 1 else np.zeros(0, np.int64)
        rank[word[:-1] != word[1:]] = none
        while len(sym):
            n = len(raw)
            # the lowest rank in each word: words lie in order, so a segmented minimum finds it
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            padded = np.append(rank, none)
            low = np.minimum.reduceat(padded, starts)
            lowest = np.zeros(n, np.int64)
            lowest[word[starts]] = low
            live = lowest[word] < none
            if not live.all():
                done_sym.append(sym[~live]), done_word.append(word[~live])
                sym, word, padded = sym[live], word[live], padded[live]
                if not len(sym):
                    break
            hit = padded == lowest[word]  # the left symbols of pairs that merge
            # of overlapping hits (a a a) the leftmost wins: every other one of a run
            at = np.flatnonzero(hit)
            new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            sym[at] = self.into[padded[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            # ranks change beside merged symbols only
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            fresh, padded = fresh[keep], padded[keep]
            sym, word = sym[keep], word[keep]
            redo = np.flatnonzero(fresh[:-1] | fresh[1:]) if len(sym) > 1 else np.zeros(0, np.int64)
            new = self.rank(sym[redo], sym[redo + 1]) if len(redo) else np.zeros(0, np.int64)
            padded[redo] = np.where(word[redo] == word[redo + 1], new, none) if len(redo) else new
            if len(sym):
                padded[-1] = none
            rank = padded[:-1]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(raw))

    def learn(self, words: set) -> None:
        """Puts the ids of new words into the table of known words, which starts anew beyond its bound."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.word_bound:
            self._forget()
            new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            ids, sizes = self.merge(part)
            if self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.uint32)])
            self.flat[self.filled : self.filled + len(ids)] = ids
            n = len(self.known)
            if n + len(part) > len(self.sizes):  # room for as many again, so that growing stays cheap
                more = np.zeros(n + len(part), np.int64)
                self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            self.starts[n : n + len(part)] = self.filled + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(part)] = sizes
            self.filled += len(ids)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin and the last end.

        Whole texts are encoded; strings of added tokens in a text become those tokens.
        """
        cut = [self._parts(t or "") for t in texts]
        self.learn(set().union(*cut))
        counts = [len(words) for words in cut]
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(counts))
        ids = _gather(self.flat, self.starts[codes], sizes := self.sizes[codes])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_flat(texts)
        return [ids[a:b].astype("<u4") for a, b in zip(at[:-1], at[1:], strict=True)]

    def _parts(self, text: str) -> list:
        if self.special is None or not any(t in text for t in self.added):
            return self.split(text)
        return [w for p in self.special.split(text) if p for w in ([(p,)] if p in self.added else self.split(p))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens included; bytes that aren't UTF-8 become replacement signs."""
        return _gather(self.bytes, self.byte_at[ids], self.byte_size[ids]).tobytes().decode("utf-8", "replace")


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def bpe(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once per Python worker."""
    return held(("bpe", path), lambda: Bpe(path))


def _id_lists(path: str, texts: list[str | None]) -> pa.ListArray:
    ids, at = bpe(path).encode_flat(texts)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) in place of its own column of that name, if any."""
    return add_columns(docs, [text], "token_ids array<int>", lambda texts: [_id_lists(path, texts)])


def decode(encoded: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``token_ids`` in column ``into``.  Null ids decode to the empty text."""
    return add_columns(encoded, ["token_ids"], f"`{into}` string", lambda ids: [[bpe(path).decode(np.array(x or [], np.int64)) for x in ids]])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens, the digest of the ids, and ``decoded``, what the ids decode to: both ways in one pass over the texts."""

    def make(texts: list[str | None]) -> list[list]:
        vocab = bpe(path)
        ids = vocab.encode(texts)
        return [[len(x) for x in ids], [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], [vocab.decode(x) for x in ids]]

    return add_columns(docs, ["text"], "n_tokens long, ids_sha256 string, decoded string", make, 512)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has a public vocabulary file; each executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
