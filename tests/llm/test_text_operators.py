"""Operators that work text by text, against plain computations and the tokenizers library."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from talentlake.llm import bpe, chat, decontaminate, gam, langid, lattice_lm, quality_rules, token_counts

#: Nulls, empties, a long text, repeats and odd characters; extra columns clash with what operators add.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "one", None, "a"), (3, "one", None, "a"), (None, "no id here", "en", None),
    (2**62 + 1, "x " * 5000 + "<|endoftext|> end  don't é \U0001f600", "en", "a"), (7, " \t\n\x0b", "de", "b"), (8, "123 !!! ###", "de", "b"),
]
CLASH = ["token_ids", "n_tokens", "score", "lang_pred", "hit_spans", "n_words", "removed", "decoded"]


@pytest.fixture(scope="module")
def odd(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *CLASH)]])
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in ODD], schema)


def test_bpe_matches_the_library(odd, spark):
    path = bpe.vocabulary_path()
    reference = Tokenizer.from_file(path)
    both = bpe.decode(bpe.encode(odd, path), path)
    assert both.count() == len(ODD) and sorted(both.columns) == sorted(odd.columns)
    for r in both.collect():
        want = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want and r["decoded"] == reference.decode(want, skip_special_tokens=False) and r["score"] == "clash"
    for r in bpe.round_trip(odd, path).collect():
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(ids)
    assert bpe.encode(odd.limit(0), path).count() == 0
    rng = random.Random(1)
    vocab = bpe.Bpe(path, word_bound=50)
    for _ in range(300):
        text = "".join(rng.choices(["a", "aa", " ", "\n", "'s", "1", "é", "日", "\x1c", "²", "the", "<|endoftext|>", "!"], k=rng.randrange(40)))
        assert vocab.encode([text])[0].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_edits_match_counting_anew(odd, spark):
    path = bpe.vocabulary_path()
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    vocab, rng = bpe.bpe(path), random.Random(3)
    parts = ["a", " ", "  ", "\n", "'", "'s", "1", "é", ".", "日", "'re", " the", "r", "<|endoftext|>"]
    for _ in range(400):
        tree = token_counts.TokenTree.of_all(["".join(rng.choices(parts, k=rng.choice([0, 1, 5, 50, 400])))], vocab)[0]
        for _ in range(4):
            tree.edit(rng.randint(-1, len(tree.text) + 1), rng.choice([0, 1, 3, 50, None]), "".join(rng.choices(parts, k=rng.choice([0, 1, 6, 60]))), vocab)
            assert tree.tokens[1] == len(reference.encode(tree.text, add_special_tokens=False).ids) and tree.chars[1] == len(tree.text)
    trees = token_counts.build_trees(odd, path)
    edits = spark.createDataFrame([(3, 1, 0, 1, "O"), (3, 0, None, None, None), (3, 2, 99, 5, "!"), (None, 0, 0, 1, "x"), (55, 0, 0, 1, "x")], "doc_id long, seq int, start int, length int, text string")
    after = token_counts.apply_edits(trees, edits, path)
    assert sorted(r["text"] for r in after.where("doc_id = 3").collect()) == ["One!", "One!"] and after.count() == len(ODD)
    for r in after.collect():
        assert r["n_tokens"] == len(reference.encode(r["text"], add_special_tokens=False).ids)
    assert token_counts.apply_edits(trees.limit(0), edits, path).count() == 0


def test_long_edits_reencode_little():
    vocab = bpe.bpe(bpe.vocabulary_path())
    tree = token_counts.TokenTree.of_all(["word " * 20_000], vocab)[0]
    tree.edit(50_000, 3, "new", vocab)
    assert tree.encoded < 1000


def test_language(odd, spark):
    rng = random.Random(4)
    say = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["uno", "dos", "tres", "cuatro"]}
    rows = [(k, " ".join(rng.choices(say[lang], k=30)), lang) for k, lang in enumerate(["aa", "bb"] * 30)]
    contents = langid.excerpts(spark.createDataFrame([*rows, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert list(contents) == ["aa", "bb"]
    tried = spark.createDataFrame([(k, " ".join(rng.choices(say[lang], k=8)).upper() + "!!", lang) for k, lang in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    assert langid.identify(tried, contents).where("lang_pred <> lang OR rejected").count() == 0
    for r in langid.identify(odd, contents).collect():
        letters = re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and r["n_tokens"] == "clash"
    assert langid.excerpts(odd.limit(0)) == {} and {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_excerpts_of_scarce_and_of_long_texts(spark):
    """A language of one letter is learnt, one without letters isn't; of a text beyond the budget blocks from all of it are taken."""
    long = " ".join(f"{'abcdefghij'[k // 100]}{'qrstuvwxyz'[k // 10 % 10]}{'klmnopqrst'[k % 10]}word" for k in range(1000))
    rows = [(1, "x", "short"), (2, "12 !", "none"), (3, long, "long"), (4, None, "long"), (5, long, "both"), (6, "small text", "both")]
    contents = langid.excerpts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=1600)
    assert list(contents) == ["both", "long", "short"] and set(contents["short"]) == set(b" x") and len(contents["short"]) >= 8
    assert contents["both"] == b" small text " and 1500 <= len(contents["long"]) <= 1700
    assert all(f" {x}" in contents["long"].decode() for x in "abcdefghij")
    assert langid.identify(spark.createDataFrame([(1, "X x")], "doc_id long, text string"), contents).first()["lang_pred"] in contents


def test_language_of_marks_alone():
    by = langid.Compressors({"aa": b" alpha beta gamma "})
    assert [langid.classify(t, by, 0.01) for t in ("\u0301\u0302 \u0301", "12 \u093e!")] == [("und", 0.0, True)] * 2
    assert langid.classify("e\u0301", by, 0.01)[0] == "aa" and langid.letters("e\u0301") == " e\u0301 ".encode()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_rules(odd, spark):
    rng = random.Random(6)
    rows = [(10_000 + k, " ".join(f"w{rng.randrange(900)}" for _ in range(60)), "en", f"s{k % 3}") for k in range(900)]
    rows += [(11_000 + k, " ".join(f"w{rng.randrange(900)}###" for _ in range(60)), "en", "s0") for k in range(9)] + [(12_000, "a b c\na b c\na b c\n" * 9, None, None)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_words").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    judged = quality_rules.judge(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in judged:
        n, *_, again = want = plain_counts(r["text"])
        assert tuple(r[c] for c in quality_rules.COUNTS) == want and r["base_failed"] == (n < 20 or 100 * again > 30 * n)
    kept = {r["doc_id"] for r in judged if r["kept"]}
    assert len(kept & set(range(10_000, 10_900))) >= 895 and not kept & set(range(11_000, 12_001))
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_fences_of_groups_of_every_size(spark):
    """Every group's own quartiles count, by their weight against the language's, from one text to many."""
    rng = random.Random(12)
    rows = [(lang, source, rng.uniform(3, 7) + shift) for lang, source, n, shift in (("en", "a", 1, 4.0), ("en", "b", 10, 4.0), ("en", "c", 150, 1.0), ("en", "d", 700, 0.0), ("de", "a", 60, 2.0), (None, None, 5, 0.0)) for _ in range(n)]
    counts = spark.createDataFrame(rows, "lang string, source string, word_length double")
    counts = counts.withColumns({"symbol_share": F.lit(0.0), "dup_line_share": F.lit(0.0), "repeat_share": F.lit(0.0), "base_failed": F.lit(False)})
    got = {(r["lang"], r["source"]): (r["word_length_low"], r["word_length_high"]) for r in quality_rules.fences(quality_rules.sketches(counts)).collect()}

    def quartiles(keep):
        buckets = sorted(1 + int(np.floor(np.log(v / 1e-3) / np.log(1.02))) for lang, source, v in rows if keep(lang, source))
        at = lambda q: next(b for k, b in enumerate(buckets, 1) if k >= q * len(buckets))
        return len(buckets), *(1e-3 * 1.02 ** at(q) for q in (0.25, 0.75))

    plain = set()
    for lang, source in {r[:2] for r in rows}:
        (n, *own), (m, *of_lang), (_, *every) = quartiles(lambda a, b: (a, b) == (lang, source)), quartiles(lambda a, b: a == lang), quartiles(lambda a, b: True)  # noqa: B023
        low, high = ((n * q + 200 * (m * l + 200 * e) / (m + 200)) / (n + 200) for q, l, e in zip(own, of_lang, every, strict=True))  # noqa: E741
        spread = 3 * max(high - low, 0.3)
        assert np.allclose(got[lang, source], (low - spread, high + spread), rtol=1e-9)
        plain.add(got[lang, source])
    assert len(plain) == 6  # no group takes another's fences


def test_quality_sketch_merges(spark):
    """Quartiles of merged sketches are within a bucket of the true ones, however rows are dealt."""
    values = [(k % 7, 0.01 * (k * k % 997 + 1)) for k in range(2000)]
    df = spark.createDataFrame(values, "part int, x double").select("part", F.lit("r").alias("ratio"), quality_rules._bucket(F.col("x")).alias("bucket"))
    sketch = df.groupBy("part", "ratio", "bucket").agg(F.count("*").alias("n"))
    got = quality_rules._quartiles(sketch, []).first()
    true = np.quantile([v for _, v in values], [0.25, 0.75], method="inverted_cdf")
    assert abs(got["q25"] / true[0] - 1) < 0.03 and abs(got["q75"] / true[1] - 1) < 0.03


def test_classifier(odd, spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices(["river", "stone", "walks", "along", "the", "of", "quiet."], k=40))
    docs = [(k, good() if k % 2 else "$$$ ".join(rng.choices(["BUY", "now!!"], k=20))) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([*[(k, k % 2) for k, _ in docs[:300]], (1, None), (None, 1)], "doc_id long, quality int")
    model = gam.train(frame, labels)
    scored = gam.score(frame, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored) and len(model.pairs) > 0
    assert all(0 <= r["score"] <= 1 for r in gam.score(odd, model).collect()) and gam.score(odd.limit(0), model).count() == 0
    assert [r["score"] for r in gam.score(odd, gam.train(frame, labels.limit(0))).collect()] == [0.5] * len(ODD)
    # an interaction that no single table can express
    x = np.random.default_rng(0).random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((gam.fit(x, y).score(x) > 0.5) == y).mean() > 0.95


def brute_lattice(word, by, logp, known):
    t = "▁" + word
    a = [1.0] + [0.0] * len(t)
    for e in range(1, len(t) + 1):
        a[e] = sum(a[s] * np.exp(logp[known[t[s:e]]]) for s in range(e) if t[s:e] in known)
        if t[e - 1] not in known:
            a[e] += a[e - 1] * np.exp(sum(logp[by.bytes[b]] for b in t[e - 1].encode()))
    return np.log(a[-1])


def test_lattice(odd, spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    by, sp = lattice_lm.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    words, logp = ["the", "nting", "éeau", "日本x", "a", "\U0001f600", "͸z"], by.start()
    got = lattice_lm.Lattice.of([w.encode() for w in words], by).log_probability(logp)
    assert np.allclose(got, [brute_lattice(w, by, logp, known) for w in words])
    long = lattice_lm.Lattice.of([b"xyz" * 2000], by)
    assert np.isfinite(long.log_probability(logp)).all()
    assert len(lattice_lm.Lattice.of([], by).log_probability(logp)) == 0

    docs = odd.select("doc_id", "text", "n_tokens").unionByName(spark.createDataFrame([(1000 + k, f"The cat {k} sat on the mat") for k in range(50)], "doc_id long, text string"), allowMissingColumns=True)
    learn = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    for head in (3, 500_000):
        rows = lattice_lm.score(docs, learn, path, head=head).collect()
        texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
        by_id = {i: t for i, t in texts}
        counts = collections.Counter()
        for r in docs.collect():
            if r["doc_id"] is None or r["doc_id"] % 5 != 1:
                counts.update(lattice_lm.tokens(r["text"])), counts.update(["END"])
        n, v = sum(counts.values()), len(counts)
        for r in rows:
            said = [*lattice_lm.tokens(by_id[r["doc_id"]]), "END"]
            base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in said)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(said), sum(w in counts for w in said), n)
            assert np.isclose(r["base_score"], base) and r["score"] <= 0
    assert lattice_lm.score(docs.limit(0), learn, path).count() == 0


def test_lattice_held_out(spark):
    """Unseen words made of known parts score better than noise of the same length."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = [(k, " ".join(f"{a}ing {a}ed {a}er" for a in ("walk", "talk", "jump", "paint", "print"))) for k in range(20)] + [(100, "printable walker"), (101, "qzxvjkpwy vjxqkz")]
    rows = {r["doc_id"]: r["score"] for r in lattice_lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 100, path).collect()}
    assert rows[100] > rows[101]


def plain_hits(text, benchmark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w, hit, items = pattern.findall(low(text)), set(), set()
    for item, t in benchmark:
        b = pattern.findall(low(t))
        for i in range(max(1, len(b) - 9) if b else 0):
            win = b[i : i + 10]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    items.add(str(item))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("blocks", [60, 1_000_000])
def test_decontamination(odd, spark, blocks):
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(12)] + ["É9", "x_y"]
    benchmark = [(k, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 10, 25])))) for k in range(12)] + [(50, None), (None, "v1 v2"), (5, "V1, v2-v3")]
    docs = [(100 + k, "-".join([*rng.choices([*vocab, "other"], k=60), (benchmark[k % 12][1] or "").upper(), *rng.choices(vocab, k=9)])) for k in range(40)]
    frame = odd.unionByName(spark.createDataFrame([*docs, *docs[:3]], "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    found = decontaminate.find(frame, items, shard_bytes=900, block_bytes=blocks).collect()
    for r in found:
        spans = r["hit_spans"] or []
        n, hit, items_hit = plain_hits(r["text"], benchmark)  # an item without an id is searched, but not named
        assert (r["n_words"], sum(spans[1::2]) - sum(spans[::2]), r["hit_items"]) == (n, hit, [x for x in items_hit if x != "None"])
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(frame, items.where("item_id IN (3, 4, 9)"), shard_bytes=900).collect()}
    assert cleaned[1] is None and cleaned[2] == "" and len(found) == len(ODD) + 43
    assert decontaminate.find(frame.limit(0), items).count() == 0 and not any(r["hit_items"] for r in decontaminate.find(frame, items.limit(0)).collect())
    assert decontaminate.without_spans("One TWO, three four.", [1, 3]) == "One  four."


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, symbols in ((1, 3), (50, 4), (400, 5), (300, 200)):
        t = np.append(rng.integers(1, symbols, n), 0)
        t[: n // 2] = t[n // 2 : 2 * (n // 2)]  # long repeats
        assert decontaminate.suffix_array(t, symbols).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    for text in (said, "<\\|im_end|>", "<\\\\|", "", "a\nb", "<|<|\\|"):
        turns = [("user", text), ("assistant", text), ("odd\nrole%0A<|", "x\ny")]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns and [chat.unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)] == [text]
    events = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", "he"), (1, 3, "delta", 2, None, "llo"), (1, 4, "message", 3, "user", "more"), (1, 5, "edit", 1, None, "hey"),
        (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "again"), (2, None, "delta", None, None, None), (None, 1, None, None, None, None), (None, 1, None, None, None, None),
        (2**60 + 1, 1, "regenerate", 9, "user", "x"), (2**60 + 1, 2, "delta", 9, "user", "y"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq int, kind string, msg long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.reconstruct(log).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "again")], 2: [("", "")], None: [("", ""), ("", "")], 2**60 + 1: [("user", "y")]}
    assert chat.reconstruct(log.limit(0)).count() == 0
    rows = chat.digests(chat.reconstruct(log)).where("conv_id = 1").first()
    assert (rows["n_turns"], rows["loss_chars"], rows["loss_sha256"]) == (2, 5, hashlib.sha256(b"again").hexdigest())
    assert rows["turns_sha256"] == hashlib.sha256(b"user\nhey\nassistant\nagain\n").hexdigest()


def test_crc(spark):
    from talentlake.llm.common import crc_mod

    got = spark.range(50).select("id", crc_mod("id", 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
