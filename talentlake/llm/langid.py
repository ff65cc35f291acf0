"""Operator 6: language identification by compression.

For each language of the training rows a zstandard raw-content dictionary is made of
excerpts of its texts.  A text goes to the language whose dictionary compresses it best; with a
narrow margin it is rejected.  Letters alone count: other characters are blanks.
Long texts are compressed block by block, all of them, so that a text's own repeats don't
drown the dictionary.

Defined results: text that is null or has no letter is ``und`` with score 0, rejected; ties go to
the language that comes first by name; rows are independent, so repeated rows and extra columns
change nothing; an empty table gives an empty table; without any training row all texts are ``und``.
"""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.llm.common import add_columns, crc_mod, held, table

UNKNOWN = "und"
#: Blocks that stand for a text longer than a language's whole budget.
SPREAD = 16
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """The letters of a text in lower case, with their marks, runs of all else being one blank; nothing if there are marks alone."""
    kept = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} ".encode("utf-8", "surrogatepass") if _LETTER.search(kept) else b""


def excerpts(train: DataFrame, each: int = 400, chars: int = 400_000, total: int = 40_000_000) -> dict[str, bytes]:
    """Dictionary contents by language.

    The sample is bounded: whole texts of a language in order of their hashes, ``each`` at most and ``chars`` characters at most, or
    an equal share of ``total`` characters where there are many languages.  Of a text that is longer than all that, which
    is only used where no other is there, ``SPREAD`` blocks are taken, spread over the whole of it.  So what the driver gathers is bounded by ``total`` characters.
    A dictionary needs eight bytes: fewer are repeated.  A language whose texts have no letter isn't learnt.
    """
    known = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    room = min(chars, total // max(1, languages))
    # of a common language a few times as many texts as are needed go on, by their hashes; 10,000 languages at most are common
    common = counts.where((F.col("n") > 8 * each) & (F.col("n") * 10_000 >= rows))
    share = F.xxhash64(F.col("doc_id").cast("string"), F.lit("share"), "text").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    drawn = known.select("lang", "text", "doc_id").join(F.broadcast(common), "lang", "left").where(F.col("n").isNull() | (share < 8.0 * each / F.col("n")))
    size, width = F.char_length("text"), max(1, room // SPREAD)
    starts = [(F.floor((size - width) * k / (SPREAD - 1)) + 1).cast("int") for k in range(SPREAD)]
    spread = F.concat_ws(" ", *[F.col("text").substr(at, F.lit(width)) for at in starts])
    order = W.partitionBy("lang").orderBy((size > room).cast("int"), F.xxhash64(F.col("doc_id").cast("string"), "text"), "text")
    ranked = drawn.select("lang", F.row_number().over(order).alias("k"), F.when(size <= room, F.col("text")).otherwise(spread).alias("piece")).where(F.col("k") <= each)
    filled = ranked.withColumn("upto", F.sum(F.char_length("piece").cast("long")).over(W.partitionBy("lang").orderBy("k"))).where((F.col("upto") <= room) | (F.col("k") == 1))
    found = filled.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p")).collect()
    made = {r["lang"]: b" ".join(letters(x["piece"]) for x in reversed(r["p"])) for r in found}
    return {k: v * -(-8 // len(v)) for k, v in sorted(made.items()) if v}


class Compressors:
    """One compressor per language, over a raw-content dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int = 9, block: int = 1024):
        self.names, self.block, self.made = list(contents), block, []
        for content in contents.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(p)) for p in parts) - 6 * len(parts) for c in self.made]


def classify(text: str | None, by: Compressors, narrow: float) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether the margin is too narrow."""
    data = letters(text)
    if not data or not by.made:
        return UNKNOWN, 0.0, True
    sizes = by.sizes(data)
    first, *rest = sorted(range(len(sizes)), key=lambda i: (sizes[i], by.names[i]))
    if not rest:
        return by.names[first], 1.0, False
    margin = (sizes[rest[0]] - sizes[first]) / max(1, sizes[rest[0]])
    return by.names[first], 1 - 0.5 * math.exp(-margin / 0.05), margin < narrow


def identify(docs: DataFrame, contents: dict[str, bytes], narrow: float = 0.01) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; like-named columns are replaced."""

    def make(texts: list[str | None]) -> list[list]:
        by = held(("compressors", tuple(contents.items())), lambda: Compressors(contents))
        return [list(x) for x in zip(*(classify(t, by, narrow) for t in texts), strict=True)]

    return add_columns(docs, ["text"], "lang_pred string, score double, rejected boolean", make)


def held_out() -> Column:
    return crc_mod("doc_id", 4) == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = excerpts(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), contents)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
