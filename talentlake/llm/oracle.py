"""DuckDB SQL for the operators whose results SQL can express, written apart from the Spark code."""

from __future__ import annotations

from talentlake.llm.quality_rules import RATIOS

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

#: Shingle sets as classes, all pairs of classes that share a shingle, and what each class reaches over links.
NEAR_DUP = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_ASCII_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
k AS (SELECT rid, doc_id, s, len(s) AS n, sha256(array_to_string(s, chr(10))) AS class FROM s),
c AS (SELECT class, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS node FROM k WHERE n > 0 AND doc_id IS NOT NULL GROUP BY class),
x AS (SELECT class, n, unnest(s) AS x FROM c),
links AS (SELECT a.class AS a, b.class AS b FROM x a JOIN x b ON a.x = b.x AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT class, class AS root FROM c UNION SELECT e.b, r.root FROM r JOIN both_ways e ON e.a = r.class),
least_of AS (SELECT r.class, min(c.node) AS component FROM r JOIN c ON c.class = r.root GROUP BY r.class)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.doc_id IS NOT NULL THEN coalesce(l.component, k.doc_id) END AS component_id, coalesce(k.doc_id = coalesce(l.component, k.doc_id), TRUE) AS kept
FROM k LEFT JOIN least_of l ON l.class = k.class AND k.n > 0"""


def _quality(reach: float = 3.0, prior: float = 200.0) -> str:
    """Base counts, quartiles of the buckets of each ratio by lang and source, by lang and overall, and the fences that follow."""
    ratios = ", ".join(f"{x} AS {k}" for k, (x, _, _) in RATIOS.items())
    listed = ", ".join(f"{{'ratio': '{k}', 'v': CAST({k} AS DOUBLE), 'least': {least}::DOUBLE, 'lower': {str(lower).upper()}}}" for k, (_, least, lower) in RATIOS.items())

    def level(name: str, keys: str) -> str:
        over = f"PARTITION BY {keys} ratio"
        group = f"{keys} ratio"
        return f"""{name}_n AS (SELECT {group}, bucket, count(*) AS n FROM long GROUP BY {group}, bucket),
{name}_c AS (SELECT *, sum(n) OVER ({over} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS below, sum(n) OVER ({over}) AS total FROM {name}_n),
{name}_b AS (SELECT {group}, max(total) AS total, min(bucket) FILTER (below >= 0.25 * total) AS b25, min(bucket) FILTER (below >= 0.75 * total) AS b75 FROM {name}_c GROUP BY {group}),
{name} AS (SELECT {group}, total, CASE WHEN b25 = 0 THEN 0 ELSE 0.001::DOUBLE * pow(1.02::DOUBLE, b25) END AS q25, CASE WHEN b75 = 0 THEN 0 ELSE 0.001::DOUBLE * pow(1.02::DOUBLE, b75) END AS q75 FROM {name}_b)"""

    drawn = lambda n, q, to: f"({n}.total::DOUBLE * {q} + {prior}::DOUBLE * {to}) / ({n}.total::DOUBLE + {prior}::DOUBLE)"
    pick = lambda q: drawn("o", f"o.{q}", drawn("l", f"l.{q}", f"a.{q}"))
    return rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS win FROM w WHERE len(w) >= 8),
again AS (SELECT rid, win FROM win GROUP BY rid, win HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win JOIN again USING (rid, win)) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
base AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
judged AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {ratios} FROM base),
each AS (SELECT rid, lang, source, base_failed, unnest([{listed}]) AS r FROM judged),
long AS (SELECT lang, source, r.ratio AS ratio, CASE WHEN r.v <= 0.001 THEN 0 ELSE 1 + floor(ln(r.v / 0.001) / ln(1.02)) END AS bucket FROM each WHERE NOT base_failed),
{level("o", "lang, source,")},
{level("l", "lang,")},
{level("a", "")},
f AS (SELECT o.lang, o.source, o.ratio, {pick("q25")} AS q25, {pick("q75")} AS q75 FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio JOIN a ON o.ratio = a.ratio),
bad AS (SELECT rid, r.ratio AS ratio, coalesce((r.lower AND r.v < q25 - greatest(q75 - q25, r.least) * {reach}) OR r.v > q75 + greatest(q75 - q25, r.least) * {reach}, FALSE) AS bad
  FROM each LEFT JOIN f ON each.lang IS NOT DISTINCT FROM f.lang AND each.source IS NOT DISTINCT FROM f.source AND f.ratio = r.ratio),
out AS (SELECT rid, {", ".join(f"bool_or(bad) FILTER (ratio = '{k}') AS {k}_bad" for k in RATIOS)} FROM bad GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, concat_ws(',', {", ".join(f"CASE WHEN {k}_bad THEN '{k}' END" for k in RATIOS)}) AS outside,
  NOT base_failed AND NOT ({" OR ".join(f"{k}_bad" for k in RATIOS)}) AS kept FROM judged JOIN out USING (rid)"""


QUALITY = _quality()

#: A line goes if it lies in a run of 20 words or more that an earlier document holds; the shortest runs from and up to each line cover all such runs.
LINE_DEDUP = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
l AS (SELECT *, list_transform(raw, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS l FROM d),
p AS (SELECT rid, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) AS n FROM l WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT rid, i, n, sum(n) OVER (PARTITION BY rid ORDER BY i) AS upto FROM p),
ends AS (SELECT rid, upto, min(i) AS j FROM c GROUP BY rid, upto),
starts AS (SELECT rid, upto - n AS before, max(i) AS i FROM c GROUP BY rid, upto - n),
runs AS (SELECT DISTINCT rid, i, j FROM (SELECT c.rid, c.i, greatest(c.i, e.j) AS j FROM c ASOF JOIN ends e ON c.rid = e.rid AND c.upto - c.n + 20 <= e.upto
  UNION ALL SELECT c.rid, s.i, c.i FROM c ASOF JOIN starts s ON c.rid = s.rid AND c.upto - 20 >= s.before)),
keyed AS (SELECT r.rid, l.doc_id, r.i, r.j, array_to_string(l.l[r.i : r.j], chr(10)) AS key FROM runs r JOIN l USING (rid)),
first_of AS (SELECT key, min(doc_id) AS first FROM keyed GROUP BY key),
gone AS (SELECT DISTINCT rid, unnest(range(i, j + 1)) AS i FROM keyed JOIN first_of USING (key) WHERE first < doc_id),
lost AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(raw) END::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(gone, i)), lambda i: raw[i]), chr(10)) END AS text
FROM d LEFT JOIN lost USING (rid)"""

#: All windows of the benchmark, joined with all windows of the documents of the same sizes.
DECONTAMINATION = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN sizes ON len(w) >= size)),
hit AS (SELECT dw.rid, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, list_sort(list_distinct(list(item))) AS items FROM hit WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN items USING (rid)"""

_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
#: Texts in order of turn; the output's length follows from the template, one more stroke for each escaped string.
CHAT = rf"""WITH e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
t AS (SELECT *, length('<|im_start|>') + length(replace(replace({_ESCAPED.format("role")}, '%', '%25'), chr(10), '%0A')) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1 AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

#: The table of crc32 by its rule, and the crc32 of a string's UTF-8 bytes.
_CRC_TABLE = "tt AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_transform(range(1, 2 * strlen({0}), 2), lambda k: ('0x' || substr(hex(encode({0})), k, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"

#: Every edit of the slot map is one step of the recursion; its last step gives the map.
SHARDING = f"""WITH RECURSIVE {_CRC_TABLE},
rec AS (SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, tt),
grouped AS (SELECT doc_id, size, text_crc32, count(*) AS n FROM rec GROUP BY doc_id, size, text_crc32),
dealt AS (SELECT *, unnest(range(0, (n - 1) // 64 + 1)) AS run FROM grouped),
v AS (SELECT *, least(64, n - run * 64) AS m, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, text_crc32, run)), 1, 8))::BIGINT % 8192 AS slot FROM dealt),
b AS (SELECT r.slot, coalesce(sum(m * size), 0)::BIGINT AS size FROM range(8192) r(slot) LEFT JOIN v ON v.slot = r.slot GROUP BY r.slot),
steps AS (SELECT 0 AS it, slot, slot % 40 AS shard, size FROM b UNION ALL
  SELECT it + 1, slot, CASE WHEN slot = best.d THEN low ELSE shard END, size FROM (
    SELECT *, min(CASE WHEN load = least THEN shard END) OVER () AS low, min(CASE WHEN size > 0 AND size < load - least AND load - least > 0.001::DOUBLE * total / 40
      THEN {{'a': -load, 'b': shard, 'c': abs(2 * size - (load - least)), 'd': slot}} END) OVER () AS best
    FROM (SELECT *, min(load) OVER () AS least FROM (SELECT *, (sum(size) OVER (PARTITION BY shard))::BIGINT AS load, (sum(size) OVER ())::BIGINT AS total FROM steps) l)) WHERE best IS NOT NULL),
map AS (SELECT slot, shard FROM steps WHERE it = (SELECT max(it) FROM steps)),
numbered AS (SELECT v.*, shard, sum(m) OVER (PARTITION BY shard ORDER BY v.slot, doc_id NULLS FIRST, size, text_crc32, run ROWS UNBOUNDED PRECEDING) - m AS first FROM v JOIN map ON v.slot = map.slot)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, unnest(range(first::BIGINT, (first + m)::BIGINT)) AS slot, NULL::INTEGER AS grown_shard, slot::INTEGER AS virtual_slot FROM numbered"""

#: Near words share what is left when one code point is taken from each, at the same place, or from the longer one.
SPELLING = rf"""WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({_ASCII_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
typed AS (SELECT doc, w, count(*) AS n FROM run GROUP BY doc, w),
hashed AS (SELECT w, n, {_CRC.format("(doc || ':' || w)")} AS h FROM typed, tt),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.d UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.d),
best AS (SELECT word, count(*) AS n_near, min({{'o': -m, 'w': other}}) AS b FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.o >= 2 * n THEN b.w END AS form, CASE WHEN -b.o >= 2 * n THEN (-b.o)::BIGINT END AS form_n FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM formed f JOIN up USING (word) JOIN formed last ON last.word = up.root WHERE last.form IS NULL"""


def _centroids(rounds: int = 5, k: int = 40) -> str:
    """Each round as two tables: all distances and the nearest centroid, then the floors of the means."""
    parts = [
        f"""vec AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: greatest(least(floor(256 * x::DOUBLE), 134217728), -134217728)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h, vec_id NULLS FIRST, v) - 1)::INTEGER AS c, v AS mid FROM (SELECT *, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM vec) ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT rid, min(d).d AS distance, min(d).c AS cluster FROM (SELECT rid, {{'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - mid[i]) * (v[i] - mid[i])))::BIGINT, 'c': c}} AS d FROM vec, c{i}) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT cluster, j, sum(v[j]) AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS j FROM a{i} JOIN vec USING (rid)) GROUP BY cluster, j),
c{i + 1} AS (SELECT c, coalesce(f, mid) AS mid FROM c{i} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS f FROM s{i} GROUP BY cluster) ON cluster = c)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256
FROM a{rounds} JOIN vec USING (rid) JOIN c{rounds} ON c = cluster"""


CENTROIDS = _centroids()

ORACLE_SQL = {
    "op1_near_dup": NEAR_DUP, "op2_quality_rules": QUALITY, "op3_line_dedup": LINE_DEDUP, "op9_decontamination": DECONTAMINATION, "op10_chat_formatting": CHAT,
    "op11_sharding": SHARDING, "op12_spelling": SPELLING, "op13_centroids": CENTROIDS,
}
