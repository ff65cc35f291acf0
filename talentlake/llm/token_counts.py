"""Operator 7: token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf stands for a few
consecutive pre-tokens and holds their characters and tokens, an inner node the sums
of its two children; node 1 is the whole document.  An edit finds its leaves by
character sums, re-encodes these and as many after them as it takes until the old and the new
cuts agree, and updates the sums above.  What lies outside is never encoded again.

A cut stays valid if the two characters after it stay, as no pre-token pattern looks further
ahead; re-encoding starts at the last leaf that begins two characters before the edit.

Defined results: null text counts as empty and has a tree of zeros; strings of added tokens are plain text here;
edits of a document apply in order of seq, ties by start, length and text; a null or negative start is 0, one past
the end is the end, lengths are cut off there, null length is 0 and null text is empty; edits of
unknown documents or null ids do nothing; rows that repeat a document each get its edits; columns
that clash with the added ones are replaced; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.bpe import Bpe, bpe, vocabulary_path
from talentlake.llm.common import add_columns, table

LEAF = 32


def _tree(leaves: np.ndarray) -> np.ndarray:
    """Sums of a segment tree: node k has the children 2k and 2k + 1, the leaves are the last half."""
    half = 1
    while half < len(leaves):
        half *= 2
    tree = np.zeros(2 * half, np.int64)
    tree[half : half + len(leaves)] = leaves
    while half > 1:
        tree[half // 2 : half] = tree[half : 2 * half].reshape(-1, 2).sum(1)
        half //= 2
    return tree


class TokenTree:
    """A text with the sums of characters and tokens over its pre-tokens."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, leaves: int):
        self.text, self.chars, self.tokens, self.leaves = text, chars, tokens, leaves
        self.encoded = 0

    @staticmethod
    def leaf_sums(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each leaf."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, len(words), LEAF)
        return np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)), at), np.add.reduceat(sizes, at)

    @classmethod
    def of_all(cls, texts: list[str], vocab: Bpe) -> list[TokenTree]:
        """The trees of a batch, whose new pre-tokens are all merged together."""
        cut = [vocab.split(t) for t in texts]
        vocab.learn(set().union(*cut))
        leaves = [cls.leaf_sums(words, _sizes(words, vocab)) for words in cut]
        return [cls(t, _tree(c), _tree(k), len(c)) for t, (c, k) in zip(texts, leaves, strict=True)]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end), and where that leaf begins."""
        node, before, half = 1, 0, len(self.chars) // 2
        while node < half:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return node - half, before

    def cut(self, start: int | None, length: int | None, new: str | None, vocab: Bpe) -> list[str]:
        """Changes the text and finds the pre-tokens to encode; ``settle`` must follow."""
        start = min(max(0, start or 0), len(self.text))
        length = min(max(0, length or 0), len(self.text) - start)
        new = new or ""
        first, begin = self.leaf_at(max(0, start - 2))
        text = self.text[:start] + new + self.text[start + length :]
        shift, half = len(new) - length, len(self.chars) // 2
        words: list[str] = []
        # the first old leaf that begins past the edit is where both cuts may agree
        last, end = first, begin
        at = begin
        for m in vocab.pattern.finditer(text, begin):
            while last < self.leaves and (end < start + length or end + shift < at):
                end += int(self.chars[half + last])
                last += 1
            if last < self.leaves and end >= start + length and end + shift == at and at >= start + len(new):
                break
            words.append(m.group())
            at = m.end()
        else:
            last = self.leaves
        self.text, self.todo = text, (first, last, words)
        return words

    def settle(self, vocab: Bpe) -> None:
        """Puts the sums of the re-encoded leaves in place, once ``vocab`` knows their pre-tokens."""
        first, last, words = self.todo
        half = len(self.chars) // 2
        self.encoded += sum(map(len, words))
        chars, tokens = self.leaf_sums(words, _sizes(words, vocab))
        if len(chars) == last - first:  # the same leaves: only the sums above them change
            for tree, leaves in ((self.chars, chars), (self.tokens, tokens)):
                a, b = half + first, half + last
                tree[a:b] = leaves
                while a > 1 and b > a:
                    a, b = a // 2, (b + 1) // 2
                    tree[a:b] = tree[2 * a : 2 * b].reshape(-1, 2).sum(1)
        else:
            old = [t[half : half + self.leaves] for t in (self.chars, self.tokens)]
            chars, tokens = (np.concatenate([o[:first], x, o[last:]]) for o, x in zip(old, (chars, tokens), strict=True))
            self.chars, self.tokens, self.leaves = _tree(chars), _tree(tokens), len(chars)

    def edit(self, start: int | None, length: int | None, new: str | None, vocab: Bpe) -> None:
        vocab.learn(set(self.cut(start, length, new, vocab)))
        self.settle(vocab)


def _sizes(words: list[str], vocab: Bpe) -> np.ndarray:
    return vocab.sizes[np.fromiter(map(vocab.known.__getitem__, words), np.int64, len(words))]


def edit_all(trees: list[TokenTree], edits: list[list], vocab: Bpe) -> None:
    """Applies each tree's edits in turn; the k-th edits of all trees are encoded together."""
    for k in range(max(map(len, edits), default=0)):
        now = [(t, e[k]) for t, e in zip(trees, edits, strict=True) if k < len(e)]
        vocab.learn({w for t, e in now for w in t.cut(e["start"], e["length"], e["new"], vocab)})
        for t, _ in now:
            t.settle(vocab)


TREE = "n_tokens long, leaves int, char_sums array<int>, token_sums array<int>"


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the columns of TREE; null texts become empty."""

    def make(texts: list[str | None]) -> list[list]:
        trees = TokenTree.of_all([t or "" for t in texts], bpe(path))
        return [[int(t.tokens[1]) for t in trees], [t.leaves for t in trees], [t.chars for t in trees], [t.tokens for t in trees]]

    return add_columns(docs, ["text"], TREE, make)


def apply_edits(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """``trees`` after the edits (doc_id, seq, start, length, text), with chars_encoded: how many characters were encoded for that."""
    # edits of one document are a list beside its text, as the text itself is one value
    listed = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", F.col("text").alias("new")))).alias("__edits"))

    def make(texts: list, leaves: list, chars: list, tokens: list, edits: list) -> list[list]:
        done = [TokenTree(t or "", np.array(c, np.int64), np.array(k, np.int64), n) for t, n, c, k in zip(texts, leaves, chars, tokens, strict=True)]
        edit_all(done, [e or [] for e in edits], bpe(path))
        return [
            [t.text for t in done], [t.encoded for t in done], [int(t.tokens[1]) for t in done],
            [t.leaves for t in done], [t.chars for t in done], [t.tokens for t in done],
        ]

    joined = trees.join(listed, "doc_id", "left")
    ddl = f"__text string, chars_encoded long, {TREE}"
    after = add_columns(joined, ["text", "leaves", "char_sums", "token_sums", "__edits"], ddl, make)
    kept = [c for c in trees.columns if c not in ("n_tokens", "leaves", "char_sums", "token_sums", "chars_encoded")]
    return after.withColumn("text", F.col("__text")).select(*kept, "n_tokens", "leaves", "char_sums", "token_sums", "chars_encoded")


def planned_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, placed by its id: a deletion, an insertion and a replacement."""
    place = lambda k: F.crc32(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(k)).cast("binary")) % (F.coalesce(F.char_length("text"), F.lit(0)) + 1)
    plan = ((1, 40, ""), (2, 0, " an edit, don't count twice "), (3, 12, "\n\n  New"))
    each = F.array(*[F.struct(F.lit(k).alias("seq"), place(k).cast("int").alias("start"), F.lit(n).alias("length"), F.lit(t).alias("text")) for k, n, t in plan])
    return docs.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()
    before = build_trees(docs, path).withColumn("n_before", F.col("n_tokens"))
    after = apply_edits(before, planned_edits(docs), path)
    return after.select(
        "doc_id", F.col("n_before").alias("n_tokens_before"), F.col("n_tokens").alias("n_tokens_after"), F.char_length("text").cast("long").alias("n_chars_after"), "chars_encoded"
    )
