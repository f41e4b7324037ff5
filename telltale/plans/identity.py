"""Digests of actions and cases and the total order of telemetry, with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import identity
from telltale.plans.streams import SEG, cut, event_segments
from telltale.sources import tables


def segment_digests(spark, sf_dir):
    return identity.segment_digests(event_segments(spark, sf_dir, 6), ["reading"])


def repeated_segments(spark, sf_dir):
    """Actions whose readings agree to whole units."""
    digests = identity.segment_digests(event_segments(spark, sf_dir, 6), ["reading"], resolution=1.0)
    out = identity.repeated_content(digests, F.struct("stream_id", "segment"))
    return out.select("digest", "n_rows", "members", F.col("first.stream_id").alias("stream_id"), F.col("first.segment").alias("segment"))


def case_digests(spark, sf_dir):
    return identity.case_digests(tables.case_readings(spark, sf_dir), ["cabin", "target"], ["mode"])


def telemetry_order(spark, sf_dir):
    rows = tables.plain_telemetry(spark, sf_dir).select("ts", "train_id", "component", "ord")
    return identity.global_places(rows, ["ts", "train_id", "component", "ord"])


def fold(keys: str, source: str, levels: int = 3) -> str:
    """CTEs t1, t2, ... over (keys, p, d): blocks of 4096 digests hashed in order; three levels hold 4096 ** 3 rows."""
    steps = []
    for i in range(1, levels + 1):
        below, n = (source, "count(*)") if i == 1 else (f"t{i - 1}", "CAST(sum(n) AS BIGINT)")
        steps.append(f"""t{i} AS (SELECT {keys}, p // 4096 AS p, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d,
  {n} AS n FROM {below} AS b GROUP BY {keys}, b.p // 4096)""")
    return ", ".join(steps)


def segment_sql(scale: str) -> str:
    return f"""WITH {SEG}, {cut('s', '21600')},
r AS (SELECT stream_id, segment, row_number() OVER (PARTITION BY stream_id, segment ORDER BY ts, ord) - 1 AS p,
  sha256(coalesce(CAST(CAST(round(reading * {scale}) AS BIGINT) AS VARCHAR), '')) AS d FROM s),
{fold('stream_id, segment', 'r')},
f AS (SELECT stream_id, segment, n AS n_rows, sha256(n || ':' || d) AS digest FROM t3)"""


QUERIES = {
    "segment_digests": (segment_digests, f"{segment_sql('1e6')} SELECT * FROM f"),
    "repeated_segments": (repeated_segments, f"""{segment_sql('1')}
SELECT digest, n_rows, count(*) AS members, min(stream_id) AS stream_id, arg_min(segment, (stream_id, segment)) AS segment
FROM f GROUP BY digest, n_rows HAVING count(*) > 1"""),
    "case_digests": (case_digests, f"""WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS file_id, l_shipdate AS ts, lpad(CAST(s_suppkey % 8 + 1 AS VARCHAR), 2, '0') AS car,
  avg(l_quantity) AS cabin, max(l_returnflag) AS mode FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
r AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ts, car) - 1 AS p, sha256('cabin=' ||
  coalesce(CAST(CAST(round(cabin * 1e6) AS BIGINT) AS VARCHAR), '') || '|car=' || car || '|mode=' || coalesce(mode, '') ||
  '|target=25000000|ts=' || epoch_us(ts)) AS d FROM c),
{fold('file_id', 'r')}
SELECT file_id, n AS n_rows, sha256(n || ':' || d) AS digest FROM t3"""),
    "telemetry_order": (telemetry_order, """SELECT ts, train_id, component, ord, row_number() OVER (ORDER BY ts, train_id, component, ord) AS place
FROM (SELECT ts, 'U' || user_id % 20 AS train_id, event_type AS component, event_id AS ord FROM events)"""),
}
