"""Text queries with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import records, text as tx
from telltale.sources import tables

QUERY = "how does the re tion and en la"


def headed(spark, sf_dir):
    """Documents in which lines that begin with some words count as headings."""
    docs = tables.documents(spark, sf_dir)
    return docs.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"),
        F.regexp_replace("text", "(^|\n)(An|En|El|Die|Le)", "$1## $2").alias("text"))


def text_sections(spark, sf_dir):
    return tx.sections(headed(spark, sf_dir)).select(
        "name", "heading", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"), F.md5("chunk").alias("chunk_md5"))


def lexical_search(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), "text")
    out = tx.search(tx.sections(docs), QUERY, 8)
    return out.select("name", F.col("start_line").cast("bigint").alias("start_line"), F.round("score", 6).alias("score"))


def redacted_documents(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return docs.select("doc_id", tx.redact_text("text").alias("_t"), "text").select(
        "doc_id", F.md5("_t").alias("redacted_md5"), (F.col("_t") != F.col("text")).cast("int").alias("changed"))


def unsafe_texts(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = tables.table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    asked = F.concat("text", F.when(F.length("text") % 3 == 0, " Do not share the password.").when(
        F.length("text") % 3 == 1, " Please send your api key").otherwise(""))
    return docs.unionByName(turns).select("kind", "id", tx.unsafe_text(asked).cast("int").alias("unsafe"))


def conversation_bounds(spark, sf_dir):
    out = tx.conversation_bounds(tables.table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "messages", "shortest", "longest", "characters", "unknown_roles",
                      F.col("within_bounds").cast("int").alias("within_bounds"))


def cited_answers(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations")
    answer = F.concat("text", F.when(F.col("turn") % 3 == 0, " [E1] and [V1]").when(F.col("turn") % 3 == 1, " [E1] [X9]").otherwise(""))
    return turns.select("conv_id", "turn", tx.grounded(answer, F.array(F.lit("E1"), F.lit("V1"))).cast("int").alias("grounded"))


def causal_claims(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    claim = F.concat(F.lit("Car 3 is ranked first because "), F.col("text"))
    plain = F.concat(F.lit("The ranking. "), F.col("text"))
    return docs.select("doc_id", tx.causal_claim(F.when(F.col("lang") == "en", claim).otherwise(plain)).cast("int").alias("causal"))


def wording_check(spark, sf_dir):
    lines = tables.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    sentence = F.concat(F.lit("Review the record and "), F.col("words"))
    return lines.select("doc_id", "line", *[
        F.coalesce(tx.wording_problem(sentence, name), F.lit("accepted")).alias(name) for name in tx.SUBSYSTEMS])


def redacted_records(spark, sf_dir):
    e = tables.table(spark, sf_dir, "conversations")
    record = F.create_map(F.lit("api_key"), F.col("role"), F.lit("note"), F.concat(F.lit("token = abc123 "), F.col("text")))
    clean = tx.redact_map(record)
    return e.select("conv_id", "turn", clean["api_key"].alias("api_key"), clean["note"].alias("note"))


def _nested(spark, sf_dir):
    """One record of depth 6 per message, with a score that is not a number in every other one."""
    e = tables.table(spark, sf_dir, "conversations")
    lines = F.split("text", "\n", -1)
    deep = F.struct(F.struct(F.struct(F.concat(F.lit("token = abc123 "), F.col("text")).alias("note"), F.array("role").alias("by")).alias("c")).alias("b"))
    who = F.struct(F.col("role").alias("name"), F.struct(F.col("text").alias("t")).alias("access_token"), lines.alias("lines"), deep.alias("a"))
    score = F.when(F.col("turn") % 2 == 0, "NaN").otherwise("0.5")
    return e.select("conv_id", "turn", F.concat(
        F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "score": '), score, F.lit(', "who": '), F.to_json(who), F.lit("}")).alias("record"))


def nested_records(spark, sf_dir):
    return records.redact_records(_nested(spark, sf_dir), "record", ["conv_id", "turn"])


def record_summaries(spark, sf_dir):
    return records.bounded_records(_nested(spark, sf_dir), "record", ["conv_id", "turn"], max_depth=3, items=2, chars=40)


def bounded_lines(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    b = tx.bounded_list(F.split("text", "\n", -1))
    return docs.select("doc_id", F.size(b["items"]).alias("kept"), b["omitted"].alias("omitted"),
                       F.length(tx.bounded_text("text")).alias("shown"))


H = """
d AS (SELECT source || '/' || doc_id AS name, regexp_replace(text, '(^|\n)(An|En|El|Die|Le)', '\\1## \\2', 'g') AS text FROM documents WHERE length(text) > 0),
ln AS (SELECT name, i - 1 AS i, len(l) AS n, l[i] AS line, l FROM (SELECT name, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT name, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM d))),
st AS (SELECT name, i AS s, n, line, l FROM ln WHERE i = 0 OR regexp_matches(line, '^#{1,6}\\s|^(async\\s+)?def\\s|^class\\s')),
se AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY name ORDER BY s), n) AS e FROM st),
ck AS (SELECT name, line, l, e, unnest(range(s, e, 22)) AS c FROM se)"""

def sql_text(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def redacted_sql(text: str) -> str:
    """The redaction of an SQL expression, in the operator's order and with its marked patterns."""
    for pattern, put in ((tx.PRIVATE_KEY, tx.REDACTED), (tx.TOKEN, tx.REDACTED), (tx.BEARER, "\\1" + tx.REDACTED),
                         (tx.URL_AUTH, "\\1" + tx.REDACTED + "@"), ("(?i)" + tx.ASSIGNED_NAME + tx.ASSIGNED_VALUE, "\\1" + tx.REDACTED)):
        text = f"regexp_replace({text}, {sql_text(pattern)}, '{put}', 'g')"
    return text


ASK = ("(?i)(" + tx.NEGATION.replace("'", "''") + ")?" + tx.EXPORT_REQUEST)

TERMS = tx.query_terms(QUERY)
SEARCH = """WITH d AS (SELECT source || '/' || doc_id AS name, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0),
ck AS (SELECT name, l, unnest(range(0, len(l), 22)) AS c FROM d),
h AS (SELECT name, c + 1 AS start_line, lower(name) AS head, lower(name || ' ' || name || ' ' || array_to_string(l[c + 1 : c + 28], chr(10))) AS hay FROM ck),
s AS (SELECT name, start_line, """ + " + ".join(f"CAST(regexp_matches(hay, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in TERMS) + " AS hits, " + " + ".join(
    f"(CASE WHEN regexp_matches(hay, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 2 + least(3, (length(hay) - length(replace(hay, '{t}', ''))) // {len(t)})"
    f" + CASE WHEN contains(head, '{t}') THEN 4 ELSE 0 END ELSE 0 END)" for t in TERMS) + f""" AS score FROM h)
SELECT name, start_line, round(score + 2.0 * hits / {len(TERMS)}, 6) AS score FROM s WHERE hits > 0
ORDER BY score + 2.0 * hits / {len(TERMS)} DESC, name, start_line LIMIT 8"""


def sq(s: str) -> str:
    return s.replace("'", "''")


WORDING = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS w, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line, 'Review the record and ' || w AS raw, trim(regexp_replace('Review the record and ' || w, '\\s+', ' ', 'g'), ' ') AS t FROM l)
SELECT doc_id, CAST(line AS INT) AS line, """ + ", ".join(f"""CASE WHEN length(raw) > 350 THEN 'too long'
  WHEN len(string_split(t, ' ')) < 6 OR len(string_split(t, ' ')) > 18 THEN 'word count'
  WHEN regexp_matches(regexp_replace(t, '\\.+$', ''), '[.!?]') THEN 'not one review sentence'
  WHEN regexp_matches(t, {sql_text(tx.UNSUPPORTED)}) THEN 'unsupported claim'
  WHEN NOT regexp_matches(t, {sql_text(rf"(?i)\b(?:{tx.REVIEW_TERMS[name]})\b")}) THEN 'unrelated'
  WHEN regexp_matches(t, '(?i)[<>{{}}\\[\\]`]|https?://|\\bwww\\.') THEN 'not plain text' ELSE 'accepted' END AS {name}""" for name in tx.SUBSYSTEMS) + " FROM s"

QUERIES = {
    "text_sections": (text_sections, f"""WITH {H}
SELECT name, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s|^(async\\s+)?def\\s|^class\\s') THEN substr(trim(regexp_replace(line, '^[# ]+', '')), 1, 160) ELSE name END AS heading,
  c + 1 AS start_line, least(e, c + 28) AS end_line, md5(array_to_string(l[c + 1 : least(e, c + 28)], chr(10))) AS chunk_md5 FROM ck"""),
    "lexical_search": (lexical_search, SEARCH),
    "redacted_documents": (redacted_documents, f"""WITH r AS (SELECT doc_id, text, {redacted_sql('text')} AS t FROM documents)
SELECT doc_id, md5(t) AS redacted_md5, CAST(t <> text AS INT) AS changed FROM r"""),
    "unsafe_texts": (unsafe_texts, f"""WITH a AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations),
b AS (SELECT kind, id, text || CASE length(text) % 3 WHEN 0 THEN ' Do not share the password.' WHEN 1 THEN ' Please send your api key' ELSE '' END AS t FROM a)
SELECT kind, id, CAST({redacted_sql('t')} <> t OR len(list_filter(regexp_extract_all(t, '{ASK}', 1), lambda x: coalesce(x, '') = '')) > 0 AS INT) AS unsafe FROM b"""),
    "conversation_bounds": (conversation_bounds, """
SELECT conv_id, count(*) AS messages, CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest,
  CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (role NOT IN ('user', 'assistant')) AS unknown_roles,
  CAST(count(*) <= 12 AND min(length(text)) >= 1 AND max(length(text)) <= 12000 AND sum(length(text)) <= 40000
    AND count(*) FILTER (role NOT IN ('user', 'assistant')) = 0 AS INT) AS within_bounds FROM conversations GROUP BY conv_id"""),
    "cited_answers": (cited_answers, r"""WITH a AS (SELECT conv_id, turn, regexp_extract_all(text || CASE turn % 3 WHEN 0 THEN ' [E1] and [V1]' WHEN 1 THEN ' [E1] [X9]' ELSE '' END,
  '\[([A-Z][0-9]+)\]', 1) AS c FROM conversations)
SELECT conv_id, turn, CAST(len(c) > 0 AND len(list_filter(c, lambda x: x NOT IN ('E1', 'V1'))) = 0 AS INT) AS grounded FROM a"""),
    "causal_claims": (causal_claims, f"""SELECT doc_id, CAST(regexp_matches(CASE WHEN lang = 'en' THEN 'Car 3 is ranked first because ' || text
  ELSE 'The ranking. ' || text END, '{sq(tx.CAUSAL)}') AS INT) AS causal FROM documents"""),
    "wording_check": (wording_check, WORDING),
    "redacted_records": (redacted_records, f"""WITH r AS (SELECT conv_id, turn, 'token = abc123 ' || text AS t FROM conversations)
SELECT conv_id, turn, '[REDACTED]' AS api_key, {redacted_sql('t')} AS note FROM r"""),
    "nested_records": (nested_records, f"""WITH r AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l, 'token = abc123 ' || text AS t FROM conversations)
SELECT conv_id, turn, '{{"turn":' || turn || ',"score":' || CASE WHEN turn % 2 = 0 THEN 'null' ELSE '0.5' END
|| ',"who":{{"name":' || to_json(role) || ',"access_token":"[REDACTED]","lines":' || to_json(list_transform(l, lambda x: {redacted_sql('x')}))
|| ',"a":{{"b":{{"c":{{"note":' || to_json({redacted_sql('t')}) || ',"by":[' || to_json(role) || ']}}}}}}}}}}' AS safe FROM r"""),
    "record_summaries": (record_summaries, f"""WITH r AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations),
s AS (SELECT *, list_transform(l[:2], lambda x: {redacted_sql('x')}) AS k FROM r)
SELECT conv_id, turn, '{{"turn":' || turn || ',"score":' || CASE WHEN turn % 2 = 0 THEN 'null' ELSE '0.5' END || ',"who":{{"name":' || to_json(role) || ',"lines":['
|| array_to_string(list_transform(k, lambda x: to_json(CASE WHEN length(x) > 40 THEN x[:40] || '… [text truncated]' ELSE x END)), ',')
|| CASE WHEN len(l) > 2 THEN ',{{"omitted_items":' || (len(l) - 2) || '}}' ELSE '' END || '],"a":{{"b":{{"c":"[nested details omitted]"}}}}}}}}' AS summary FROM s"""),
    "bounded_lines": (bounded_lines, f"""WITH r AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, length({redacted_sql('text')}) AS k FROM documents)
SELECT doc_id, CAST(least(n, 24) AS INT) AS kept, CAST(greatest(0, n - 24) AS INT) AS omitted, CAST(CASE WHEN k > 1000 THEN 1018 ELSE k END AS INT) AS shown FROM r"""),
}
