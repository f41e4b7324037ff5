"""The registered queries of this subpackage: thin, over whole tables, next to their SQL twins where SQL can express them."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.llm import (collocations, infill, langid, linedup, mixing, neighbours, pieces, pii, quality, rules, secretscan,
                          simhash, toxicity)
from telltale.llm.common import table

WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_quality_rules(spark, sf_dir):
    book = rules.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.verdict("base-1")).alias("base_failed"), rules.verdict("web-2").alias("kept"), "fail_bits",
        "n_lines", "n_capitals", "n_letters", "n_marks")


OP1_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORD_SQL} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS rid FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i : i + 7]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest(range(0, 8)) AS o FROM k WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters, CAST(length(regexp_replace(t, '[^!?]', '', 'g')) AS BIGINT) AS n_marks
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
  + 8 * CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS BIGINT) + 16 * CAST(2 * n_dup_lines > n_lines AS BIGINT)
  + 32 * CAST(2 * n_capitals > n_letters AS BIGINT) + 64 * CAST(2 * n_marks > n_words AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
  fail_bits, n_lines, n_capitals, n_letters, n_marks FROM b"""


def op2_simhash(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op3_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=~toxicity.held_out())
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_classifier(spark, sf_dir):
    """The source stands for the host, the language for the path within it."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model, F.col("source"), F.col("lang")).select(
        "doc_id", "own", "path_docs", "host_docs", "score", (F.col("score") >= quality.KEEP).alias("kept"))


def op6_sentence_pieces(spark, sf_dir):
    """Pieces of every text, and whether they decode to it."""
    rows = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return rows.select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "lossless")


def op7_line_dedup(spark, sf_dir):
    return linedup.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op9_neighbours(spark, sf_dir):
    rows = neighbours.usable(table(spark, sf_dir, "embeddings"))
    index = neighbours.fit(rows, k=20)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return neighbours.search(rows, F.col("vec_id") % 20 == 0, index, k=20)


def op10_language_id(spark, sf_dir):
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model)


def op11_collocations(spark, sf_dir):
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    rows = infill.inverted(infill.transformed(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op13_secret_scan(spark, sf_dir):
    return secretscan.detect(table(spark, sf_dir, "documents"))


ODD = r"[#*$%&|<>0-9{}\[\]=_~^@\\]"
OP8_SQL = rf"""WITH d AS (SELECT doc_id, source, CAST(len({WORD_SQL}) AS BIGINT) AS size,
  coalesce(greatest(0.05::DOUBLE, 1 - (length(text) - length(regexp_replace(text, '{ODD}', '', 'g')))::DOUBLE / nullif(length(text), 0)), 1.0::DOUBLE) AS w,
  (CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
sw AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sw, 3 * source_size AS cap FROM s),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER z, 0))::DOUBLE / (sum(sw) OVER () - coalesce(sum(sw) OVER z, 0)) AS level,
  row_number() OVER (ORDER BY cap / sw, source NULLS LAST) AS pos FROM sw
  WINDOW z AS (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CAST(least(coalesce((SELECT arg_min(level, pos) FROM lv WHERE level * sw <= cap) * sw, cap), cap) AS DOUBLE) AS target FROM lv),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS rest FROM t),
o AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.whole, p.rest, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST((whole + CAST(rest > 0 AND before + size / 2.0 <= rest AS INT)) * size AS BIGINT) AS taken,
  CAST(whole + CAST(rest > 0 AND before + size / 2.0 <= rest AS INT) AS INT) AS epochs FROM o"""

# Grams are counted one by one; a path is walked edge by edge.
OP11_SQL = r"""WITH RECURSIVE p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS gram, k, count(*) AS c
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE c >= 30),
x AS (SELECT lang, gram, k, c, unnest(range(1, k)) AS cut, string_split(gram, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT x.lang, x.gram, x.k, x.c AS a, cut, l.c AS l, r.c AS r, CAST((2000000::HUGEINT * x.c) // (l.c + r.c) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.gram = array_to_string(ws[:cut], ' ') JOIN f r ON r.lang = x.lang AND r.gram = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
i AS (SELECT y.lang, array_to_string(string_split(y.gram, ' ')[o : o + n - 1], ' ') AS gram, max(y.c) AS longer
  FROM f y, (SELECT unnest([2, 3]) AS n), (SELECT unnest([1, 2, 3]) AS o) WHERE y.k > n AND o + n - 1 <= y.k GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN i USING (lang, gram) WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
e AS (SELECT lang, gram, c, array_to_string(string_split(gram, ' ')[:3], ' ') AS head, array_to_string(string_split(gram, ' ')[2:], ' ') AS tail FROM f WHERE k = 4),
nxt AS (SELECT a.lang, a.gram, z.gram AS after FROM f v JOIN e a ON a.lang = v.lang AND a.tail = v.gram AND a.c = v.c
  JOIN e z ON z.lang = v.lang AND z.head = v.gram AND z.c = v.c WHERE v.k = 3),
walk AS (SELECT e.lang, e.gram AS start, e.gram FROM e ANTI JOIN nxt ON nxt.lang = e.lang AND nxt.after = e.gram
  UNION ALL SELECT walk.lang, start, after FROM walk JOIN nxt ON nxt.lang = walk.lang AND nxt.gram = walk.gram),
size AS (SELECT lang, gram, count(*) OVER (PARTITION BY lang, start) + 3 AS path_words FROM walk),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(gram)) AS rank FROM kept)
SELECT o.lang, rank, o.gram AS phrase, a, l, r, t.n, score, CAST(coalesce(path_words, k) AS BIGINT) AS path_words
FROM o JOIN t USING (lang) LEFT JOIN size ON size.lang = o.lang AND size.gram = o.gram WHERE rank <= 2000"""

OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''),
  '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
y AS (SELECT *, array_to_string(u[:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM y"""

QUERIES = {
    "op1_quality_rules": (op1_quality_rules, OP1_SQL),
    "op2_simhash": (op2_simhash, None),
    "op3_personal_data": (op3_personal_data, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_sentence_pieces": (op6_sentence_pieces, None),
    "op7_line_dedup": (op7_line_dedup, None),
    "op8_mixing": (op8_mixing, OP8_SQL),
    "op9_neighbours": (op9_neighbours, None),
    "op10_language_id": (op10_language_id, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_fill_in_middle": (op12_fill_in_middle, OP12_SQL),
    "op13_secret_scan": (op13_secret_scan, None),
}
