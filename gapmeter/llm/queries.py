"""Registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, bpe, chat, collocations, divergence, improbable, langid, mixing, simhash, suffix, toxicity, trie, warc
from .common import held_out_column, table
from .stages import read_vocabulary


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=100)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable.compare_edited(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.substring_dedup(table(spark, sf_dir, "documents"), window=13)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, ~held_out_column())
    return langid.identify(docs.select("doc_id", held_out_column().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_quality(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, quality=quality)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_whole(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out_column())
    return toxicity.score(docs, model, [F.col("doc_id"), held_out_column().alias("held_out")])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), read_vocabulary(), public_tokenizers.PATTERN)


def op11_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200)


QUERIES = {f.__name__: f for f in (op1_warc, op2_fingerprints, op3_substring_dedup, op4_language_id, op5_simhash, op6_mixing,
                                  op7_chat, op8_toxicity, op9_quality, op10_bpe, op11_conv_trie, op12_collocations, op13_suffix_dedup)}

_SPACE = r"[\x20\x09-\x0D]"


def _divergence_sql(class_factor=2.0, word_factor=2.0, least_chars=200, least_words=80, words=20, least_docs=20, least_limit=0.1) -> str:
    """op9 in SQL: counts, learned words, histograms per language, Jensen-Shannon distances, limits from medians."""
    classes = [*divergence.CLASSES.values()]
    counted = [f"len(regexp_replace(text, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in classes]
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, COALESCE(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, (w[i], w[i + 1], w[i + 2]) AS k FROM s, unnest(range(1, len(w) - 1)) u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, SUM(LEAST(3, COALESCE(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
d AS (SELECT s.doc_id, s.lang, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             COALESCE(c.n, 0) AS n_repeat_words, [{', '.join(counted)}, len(text) - ({" + ".join(counted)})] AS classes, w, s.rid
      FROM s LEFT JOIN c ON s.rid = c.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM d),
many AS (SELECT lang FROM b WHERE lang IS NOT NULL AND n_words >= 50 GROUP BY lang HAVING COUNT(*) >= {least_docs}),
dw AS (SELECT DISTINCT rid, lang, unnest(w) AS word FROM b WHERE n_words >= 50 AND lang IN (SELECT lang FROM many)),
lw AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, word) AS place FROM dw GROUP BY lang, word),
v AS (SELECT DISTINCT word FROM lw WHERE place <= {words}),
kw AS (SELECT rid, word, COUNT(*) AS n FROM (SELECT rid, unnest(w) AS word FROM b) WHERE word IN (SELECT word FROM v) GROUP BY rid, word),
h AS (SELECT rid, 'c' AS kind, i::VARCHAR AS bin, classes[i] AS n FROM b, unnest(range(1, len(classes) + 1)) u(i)
      UNION ALL SELECT b.rid, 'w', v.word, COALESCE(kw.n, 0) FROM b CROSS JOIN v LEFT JOIN kw ON kw.rid = b.rid AND kw.word = v.word
      UNION ALL SELECT b.rid, 'w', ' ', n_words - COALESCE((SELECT SUM(n) FROM kw WHERE kw.rid = b.rid), 0) FROM b),
q AS (SELECT *, n / GREATEST(SUM(n) OVER (PARTITION BY rid, kind), 1)::DOUBLE AS p FROM h),
refs AS (SELECT lang FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING COUNT(*) >= {least_docs}),
ref AS (SELECT lang, kind, bin, SUM(n) / SUM(SUM(n)) OVER (PARTITION BY lang, kind)::DOUBLE AS p
        FROM h JOIN b ON h.rid = b.rid WHERE NOT base_failed AND lang IN (SELECT lang FROM refs) GROUP BY lang, kind, bin),
js AS (SELECT rid, lang, q.kind, ROUND(sqrt(GREATEST(SUM(({half.format("q.p", "ref.p")} + {half.format("ref.p", "q.p")}) / 2), 0)), 6) AS d
       FROM q JOIN ref ON q.kind = ref.kind AND q.bin = ref.bin GROUP BY rid, lang, q.kind),
lim AS (SELECT js.lang, js.kind, GREATEST({least_limit}, ROUND(CASE js.kind WHEN 'c' THEN {class_factor} ELSE {word_factor} END * quantile_cont(ROUND(d, 4), 0.5), 6)) AS most
        FROM js JOIN b ON js.rid = b.rid AND js.lang = b.lang
        WHERE NOT base_failed AND CASE js.kind WHEN 'c' THEN word_chars >= {least_chars} ELSE n_words >= {least_words} END GROUP BY js.lang, js.kind),
fit AS (SELECT js.rid, js.lang, bool_and(most IS NULL OR d <= most OR NOT CASE js.kind WHEN 'c' THEN word_chars >= {least_chars} ELSE n_words >= {least_words} END) AS ok
        FROM js JOIN b ON js.rid = b.rid LEFT JOIN lim ON lim.lang = js.lang AND lim.kind = js.kind GROUP BY js.rid, js.lang),
f AS (SELECT rid, bool_or(ok) AS ok FROM fit GROUP BY rid),
j AS (SELECT rid, MIN(d) FILTER (kind = 'c') AS class_distance, MIN(d) FILTER (kind = 'w') AS word_distance FROM js GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, class_distance, word_distance, NOT base_failed AND COALESCE(f.ok, TRUE) AS kept
FROM b LEFT JOIN j ON b.rid = j.rid LEFT JOIN f ON b.rid = f.rid"""


ORACLE = {
    "op12_collocations": r"""
WITH t AS (SELECT row_number() OVER () AS rid, COALESCE(lang, 'und') AS lang,
                  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
size AS (SELECT lang, SUM(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, COUNT(*) AS a
      FROM p, unnest(range(1, 5)) x(k), unnest(range(1, len(w) - k + 2)) y(i) GROUP BY ALL HAVING COUNT(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, i, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
      FROM c, unnest(range(1, k)) u(i)
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:i], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[i + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
z AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, MAX(a) AS longer FROM c, unnest(range(2, k)) x(m), unnest(range(1, k - m + 2)) y(i) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN z ON b.lang = z.lang AND b.phrase = z.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT o.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN size ON o.lang = size.lang WHERE rank <= 2000""",
    "op11_conv_trie": """
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT b::BIGINT AS b, list_reduce(list_concat([b::BIGINT], range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
         FROM range(256) r(b)),
tab AS (SELECT list(v ORDER BY b) AS v FROM bits),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS root, n,
             xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                             lambda a, x: xor(a // 256, v[xor(a & 255, x) + 1])), 4294967295) % 6 AS h
      FROM (SELECT conv_id, COUNT(*) AS n FROM t GROUP BY conv_id), tab),
own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS l FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, list_concat(CASE WHEN h = 0 THEN [] ELSE COALESCE(head.l, [])[1:h] END, own.l[h + 1:]) AS l
      FROM c JOIN own ON c.conv_id = own.conv_id LEFT JOIN own head ON head.conv_id = c.root),
k AS (SELECT conv_id, list_transform(l, lambda x: sha256(length(x.r) || ':' || x.r || x.t)) AS ids, list_transform(l, lambda x: length(x.t)) AS chars FROM s),
m AS (SELECT conv_id, d AS depth, len(ids) AS n, sha256(array_to_string(ids[1:d], ',')) AS node, sha256(array_to_string(ids[1:d - 1], ',')) AS up,
             CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars
      FROM k, unnest(range(0, len(ids) + 1)) u(d)),
g AS (SELECT node, depth, MIN(conv_id) AS conv_id, MIN(up) AS up, COUNT(*) AS n_convs, (COUNT(*) - 1) * MIN(chars) AS saved,
             sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
      FROM m GROUP BY node, depth),
ch AS (SELECT up, COUNT(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
f AS (SELECT g.*, COALESCE(n_children, 0) AS n_children FROM g LEFT JOIN ch ON g.node = ch.up),
a AS (SELECT DISTINCT m1.node AS top, m1.depth AS top_depth, m2.node FROM m m1 JOIN m m2 ON m1.conv_id = m2.conv_id AND m1.depth <= m2.depth),
z AS (SELECT top, SUM(saved) AS saved_tokens, COUNT(*) FILTER (n_children = 0) AS n_leaves FROM a JOIN f ON a.node = f.node GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, z.n_leaves::BIGINT AS n_leaves,
       z.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN z ON f.node = z.top LEFT JOIN f p ON f.depth > 0 AND f.up = p.node""",
    "op13_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(COALESCE(text, ''))) AS hx FROM documents),
ks AS (SELECT rid, list_transform(range(1, length(hx) // 2 - 198), lambda i: hash(substr(hx, 2 * i - 1, 400), 1) :: HUGEINT * 4294967296 + hash(substr(hx, 2 * i - 1, 400)) % 4294967296) AS l FROM d),
w AS (SELECT rid, unnest(l) AS k, generate_subscripts(l, 1) AS i FROM ks),
g AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prv FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
sp AS (SELECT rid, MIN(i) AS a, MAX(i) + 200 AS e
       FROM (SELECT rid, i, SUM(CASE WHEN prv IS NULL OR i - prv > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS s FROM g) GROUP BY rid, s),
r AS (SELECT rid, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, SUM(e - a) AS n_removed, COUNT(*) AS n_spans FROM sp GROUP BY rid)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN r.rid IS NULL THEN hx ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j: substr(hx,
         2 * (CASE WHEN j = 0 THEN 1 ELSE e[j] END) - 1,
         2 * ((CASE WHEN j = len(a) THEN length(hx) // 2 + 1 ELSE a[j + 1] END) - (CASE WHEN j = 0 THEN 1 ELSE e[j] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN r ON d.rid = r.rid""",
    "op9_quality": _divergence_sql(),
    "op1_warc": """
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, MIN(page_id) AS first_id, COUNT(*) AS n FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN f.n > 1 AND d.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.n > 1 AND d.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""",
    "op7_chat": """
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, turn FROM conversations),
c AS (SELECT conv_id, COUNT(*) AS n, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS own,
             string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>', chr(10) ORDER BY turn NULLS FIRST, role, text) AS rendered
      FROM t GROUP BY conv_id),
k AS (SELECT conv_id, n, rendered, i, list_reduce(list_concat([''], own[1:i]), lambda a, x: sha256(a || x)) AS chain
      FROM c, unnest(range(1, n + 1)) u(i)),
m AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY conv_id NULLS LAST) AS place FROM k
      WHERE i = n AND chain NOT IN (SELECT chain FROM k WHERE i < n))
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, rendered, chain AS chain_sha256 FROM m WHERE place = 1""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
q AS (SELECT doc_id, 0.2 + 0.8 * AVG(quality) AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln((CAST('0x' || substr(md5(COALESCE(CAST(d.doc_id AS VARCHAR), 'null') || ':6'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
             / COALESCE(q.weight, 0.6) AS key
      FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, SUM(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0 * source_size AS lim, row_number() OVER (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST) AS place FROM w),
l AS (SELECT *, ((SELECT SUM(source_size) FROM r) * 1.5 - COALESCE(SUM(lim) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / SUM(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT level FROM l WHERE lim / weight >= level ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, LEAST(lim, weight * (SELECT level FROM v)) AS target FROM l),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
             SUM(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, upto - (target - epochs * source_size) AS gap FROM p),
e AS (SELECT *, epochs + CASE WHEN gap <= 0 OR (gap < size AND gap < size - gap) THEN 1 ELSE 0 END AS c FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * c AS BIGINT) AS taken, CAST(CASE WHEN size > 0 THEN c ELSE 0 END AS BIGINT) AS copies
FROM e""",
}
