"""The registered queries themselves: their columns against DuckDB's SQL, a library or a plain computation, on odd tables and on the smallest driver tables."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake.llm import chat, gam, langid, lattice_lm, token_counts
from talentlake.llm.common import table
from talentlake.llm.queries import ORACLE_SQL, QUERIES
from talentlake.llm.textstats import FEATURES, features

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Nulls, empties, repeats, ties, a very long text, crowds of near copies and shared passages, in tables with extra columns that clash."""
    sf, rng = str(tmp_path_factory.mktemp("odd")), random.Random(17)
    words = [f"w{k}" for k in range(300)]
    say = lambda n: rng.choices(words, k=n)
    passage, lines = say(40), [" ".join(say(rng.choice([0, 1, 4, 7, 12, 25]))) for _ in range(12)]
    texts = [" ".join(say(60)) for _ in range(30)]
    texts += [" ".join([*t.split()[:-2], *say(2)]) for t in texts[:10]] + texts[:5] + [" ".join([*passage, *say(rng.randrange(3, 40))]) for _ in range(25)]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(40)] + [" ".join(say(9)) * 3 + " " + "\n".join(["again and again", ""] * 9)]
    texts += [None, "", " \t\n\x0b", "one", "One", "a b", "A  b", "x y z w " * 4000, "<|endoftext|> é \U0001f600 don't", "#$%& |<>* ###", "́", "12 34"]
    ids = [*range(len(texts) - 3), 5, 5, None]
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s0", "s1", None]), 7, "clash", "clash") for i, t in zip(ids, texts, strict=True)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score string").write.parquet(f"{sf}/documents.parquet")
    bench = [(1, " ".join(passage[5:30])), (2, " ".join(texts[3].split()[:12]).upper()), (3, "w1 w2"), (3, "w1 w2"), (4, None), (5, ""), (None, " ".join(texts[4].split()[:11])), (10, "w5")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([*[(i, i % 2, 0) for i in range(0, 60)], (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    said = ["hi", None, "", "<|im_end|>", "<\\|x", "a\nb", "é" * 50]
    turns = [(c, t, rng.choice(["user", "assistant", "odd%\nrole", None]), rng.choice(said)) for c in [*range(12), None] for t in range(rng.randrange(1, 7))]
    spark.createDataFrame([*turns, *turns[:3]], "conv_id long, turn int, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    # few distinct components, so that many distances tie; nulls, gaps, other lengths, huge values and repeated rows
    grid = [[rng.choice([-0.5, 0.0, 0.25]) if j < 4 else 0.0 for j in range(64)] for _ in range(150)]
    odd = [None, [], [0.1] * 63, [0.1] * 65, [None, *[0.1] * 63], [float("nan"), *[0.1] * 63], [float("inf"), *[0.1] * 63], [1e30, *[-1e30] * 63], [2e4 * rng.random()] * 64]
    vectors = [(i, v, "clash", 5) for i, v in enumerate(grid + odd)] + [(None, grid[0], "clash", 5), (3, grid[9], "clash", 5), (3, grid[9], "clash", 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, cluster string, distance int").write.parquet(f"{sf}/embeddings.parquet")
    return sf


@pytest.fixture(scope="module")
def empty_tables(spark, odd_tables, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        table(spark, odd_tables, t).limit(0).write.parquet(f"{sf}/{t}.parquet")
    return sf


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def in_duckdb(sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    found = con.sql(ORACLE_SQL[name])
    at = [found.columns.index(c) for c in sorted(found.columns)]
    return sorted(found.columns), sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def in_spark(spark, sf, name):
    df = QUERIES[name](spark, sf)
    return sorted(df.columns), sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, odd_tables, name):
    assert in_spark(spark, odd_tables, name) == in_duckdb(odd_tables, name)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql_on_driver_tables(spark, name):
    assert in_spark(spark, SF, name) == in_duckdb(SF, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).count() == (1 if name == "op10_chat_formatting" else 0)


def rows_of(spark, sf, name):
    """Result rows beside the text they are for; ids that occur once only."""
    texts = collections.defaultdict(list)
    for r in table(spark, sf, "documents").collect():
        texts[r["doc_id"]].append(r["text"])
    got = QUERIES[name](spark, sf).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, t in texts.items() for _ in t)
    return [(texts[r["doc_id"]][0], r) for r in got if len(texts[r["doc_id"]]) == 1]


def held_out(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_bpe_codec(spark, odd_tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, r in rows_of(spark, odd_tables, "op4_bpe_codec"):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r["n_tokens"], (r["ids_sha256"], r["decoded_sha256"])) == (len(ids), want)


def test_token_counts(spark, odd_tables):
    from tokenizers import Tokenizer

    from talentlake.llm.bpe import vocabulary_path

    reference = Tokenizer.from_file(vocabulary_path())
    reference.encode_special_tokens = True
    edits = collections.defaultdict(list)
    for e in token_counts.planned_edits(table(spark, odd_tables, "documents").select("doc_id", "text")).orderBy("seq").collect():
        edits[e["doc_id"]].append(e)
    for text, r in rows_of(spark, odd_tables, "op7_token_counts"):
        now = text or ""
        assert r["n_tokens_before"] == len(reference.encode(now, add_special_tokens=False).ids)
        for e in edits[r["doc_id"]] if r["doc_id"] is not None else ():
            at = min(e["start"], len(now))
            now = now[:at] + e["text"] + now[at + e["length"] :]
        assert (r["n_tokens_after"], r["n_chars_after"]) == (len(reference.encode(now, add_special_tokens=False).ids), len(now))


def slow_score(model, x):
    """The sum of table entries, one feature and one pair at a time."""
    bins = [bisect.bisect_right(list(e), v) for e, v in zip(model.edges, x, strict=True)]
    z = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i] // 4][bins[j] // 4] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + math.exp(-z))


def test_classifier_scores(spark, odd_tables):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, odd_tables, "labels").collect() if r["quality"] is not None}
    model = gam.train(table(spark, odd_tables, "documents"), table(spark, odd_tables, "labels").where(~gam.held_out()))
    assert model.edges and len(model.edges) == len(FEATURES) and labels
    for text, r in rows_of(spark, odd_tables, "op5_quality_classifier"):
        assert r["held_out"] == (held_out(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.5)
        assert math.isclose(r["score"], slow_score(model, features([text])[0]), abs_tol=1e-9)


def test_first_split_is_the_best():
    """The first cut of a shallow tree against all cuts, one by one."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h, n = rng.normal(size=12), rng.random(12) + 0.1, rng.integers(0, 30, 12)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
        cuts = [(gain(0, k) + gain(k, 12), k) for k in range(1, 12) if n[:k].sum() >= 10 and n[k:].sum() >= 10]
        out = gam._leaves(g, h, n, 2, 10, 2.0)
        if cuts and max(cuts)[0] - gain(0, 12) > 1e-9:
            k = max(cuts)[1]
            assert np.allclose(out, [*[g[:k].sum() / (h[:k].sum() + 2.0)] * k, *[g[k:].sum() / (h[k:].sum() + 2.0)] * (12 - k)])


@needs_tables
def test_classifier_on_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"](spark, SF).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert rows and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def slow_language(text, contents):
    """The smallest of the sums of compressed blocks, with a new compressor for every block."""
    import zstandard

    data = langid.letters(text)
    if not data:
        return "und", 0.0
    sizes = []
    for name, content in sorted(contents.items()):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=9)
        each = lambda p: len(zstandard.ZstdCompressor(level=9, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) - 6  # noqa: B023, E731
        sizes.append((sum(each(data[i : i + 1024]) for i in range(0, len(data), 1024)), name))
    (least, name), *rest = sorted(sizes)
    return name, 1.0 if not rest else 1 - 0.5 * math.exp(-((rest[0][0] - least) / max(1, rest[0][0])) / 0.05)


def test_language_rows(spark, odd_tables):
    docs = table(spark, odd_tables, "documents")
    contents = langid.excerpts(docs.where(~langid.held_out()))
    assert set(contents) == {"aa", "bb"}
    for text, r in rows_of(spark, odd_tables, "op6_language_id"):
        name, score = slow_language(text, contents)
        assert r["held_out"] == (held_out(r["doc_id"], 4) == 2) and r["lang_pred"] == name and math.isclose(r["score"], score, abs_tol=1e-9)
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))


@needs_tables
def test_language_on_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    rows = [r for r in QUERIES["op6_language_id"](spark, SF).collect() if r["held_out"] and lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def slow_lattice(word, by, logp, known):
    """The log probability of a word by all its segmentations, place by place."""
    t = "▁" + word
    a = [0.0] + [-math.inf] * len(t)
    for e in range(1, len(t) + 1):
        ways = [a[s] + logp[known[t[s:e]]] for s in range(max(0, e - 60), e) if t[s:e] in known]
        if t[e - 1] not in known:
            ways.append(a[e - 1] + sum(logp[by.bytes[b]] for b in t[e - 1].encode()))
        top = max(ways)
        a[e] = top + math.log(sum(math.exp(w - top) for w in ways))
    return a[-1]


def test_language_model_rows(spark, odd_tables):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, odd_tables, "documents")
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    counts, ends = collections.Counter(), 0
    for r in docs.collect():
        if held_out(r["doc_id"], 5) != 1:
            counts.update(lattice_lm.tokens(r["text"]))
            ends += 1
    by, sp = lattice_lm.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}

    def weights(t):
        """From the scores in the file alone."""
        w = [(10 + (sp.get_piece_size() if sp.is_byte(i) else -sp.get_score(i))) ** -t for i in range(sp.get_piece_size())]
        return [math.log(x / math.fsum(w)) for x in w]

    tried = [(sum(c * slow_lattice(w.decode(), by, logp, known) for w, c in counts.items()), -t, logp) for t in lattice_lm.POWERS for logp in [weights(t)]]
    logp = max(tried)[2]
    assert np.allclose(lattice_lm.fit(lattice_lm.word_counts(docs, train), path), logp)
    n, v = counts.total() + ends, len(counts) + 1
    word = lambda w: math.log10(counts.total() / n) + slow_lattice(w.decode(), by, logp, known) / math.log(10)
    memo = {}
    for text, r in rows_of(spark, odd_tables, "op8_lm_scoring"):
        said = lattice_lm.tokens(text)
        for w in set(said) - memo.keys():
            memo[w] = word(w)
        base = sum(math.log10(((counts[w] if w is not None else ends) + 0.5) / (n + 0.5 * (v + 1))) for w in [*said, None])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(r["doc_id"], 5) == 1, len(said) + 1, sum(counts[w] > 0 for w in said) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], sum(memo[w] for w in said) + math.log10(ends / n), rel_tol=1e-6)


def test_learnt_score_rows(spark, odd_tables):
    """The arcs of whole words, from the lattice's own score; held-out texts of known words come near the base."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    by, sp = lattice_lm.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    learnt, held, counts, ends = [], [], collections.Counter(), 0
    for r in table(spark, odd_tables, "documents").collect():
        if held_out(r["doc_id"], 5) != 1:
            counts.update(lattice_lm.tokens(r["text"]))
            ends += 1
    n, once, twice = counts.total() + ends, sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    logp = lattice_lm.fit(spark.createDataFrame(list(counts.items()), "word binary, c long"), path)  # tested above
    word = lambda w: math.log10(max(counts[w] - d, 0) / n + d * len(counts) / n * math.exp(slow_lattice(w.decode(), by, logp, known)))
    memo = {}
    for text, r in rows_of(spark, odd_tables, "op8_lm_scoring"):
        said = lattice_lm.tokens(text)
        for w in set(said) - memo.keys():
            memo[w] = word(w)
        assert math.isclose(r["learnt_score"], sum(memo[w] for w in said) + math.log10(ends / n), rel_tol=1e-6)
        learnt.append(r["learnt_score"])
        if r["held_out"] and said and r["n_known"] == r["n_tokens"]:
            held.append(r)
    assert held and np.isfinite(learnt).all()
    assert sum(r["learnt_score"] for r in held) > 1.05 * sum(r["base_score"] for r in held)  # both are negative


def slow_fold(events):
    """A conversation's final messages, by rules on a plain list."""
    messages, dropped = [], {}
    for kind, msg, role, text in events:
        at = len(messages) - 1 if msg is None else next((i for i in range(len(messages) - 1, -1, -1) if messages[i][0] == msg), -1)
        if kind not in ("delta", "edit", "regenerate"):
            messages.append([msg, role or "", text or ""])
        elif kind == "regenerate":
            if at >= 0:
                dropped |= {m[0]: m[1] for m in messages[at:]}
                again = [messages[at][0] if msg is None else msg, role or messages[at][1], text or ""]
                messages = [*messages[:at], again]
        elif at < 0:
            messages.append([msg, role or dropped.get(msg, ""), text or ""])
        elif kind == "edit":
            messages[at][2] = text or ""
        else:
            messages[at][2] += text or ""
    return [(role, text) for _, role, text in messages]


def test_fold_of_random_logs(spark):
    rng = random.Random(31)
    rows = []
    for conv in range(60):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", None, "odd"])
            rows.append((conv, seq, kind, rng.choice([None, 1, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "<|im_end|>", "b\n"])))
    want = {c: slow_fold([r[2:] for r in rows if r[0] == c]) for c in range(60)}
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, seq int, kind string, msg long, role string, text string")
    assert {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.reconstruct(log).collect()} == want


def test_pipeline_on_odd_tables(spark, odd_tables, empty_tables):
    """Repeated ids, nulls and clashing columns pass through all stages; only stated documents go."""
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_tables).count() == 0
    docs = table(spark, odd_tables, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, odd_tables)
        assert after.columns[:5] == list(corpus_pipeline.COLUMNS), name
        after.count()
    rows = corpus_pipeline.run(spark, odd_tables).collect()
    assert rows and all(r["text"] and len(r["token_ids"]) == r["n_tokens"] and r["n_chars"] == len(r["text"]) for r in rows)
