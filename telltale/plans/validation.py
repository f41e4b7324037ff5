"""Validation by left-out groups on the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import nested
from telltale.sources import tables

CANDIDATES = {"mean": ([], 0.0), "quantity": (["l_quantity"], 10.0), "discount": (["l_discount"], 10.0), "tax": (["l_tax"], 10.0)}


def prices(spark, sf_dir):
    """Unit prices in hundreds, by supplier; little explains them, so the choice among the candidates is a close one."""
    li = tables.table(spark, sf_dir, "lineitem")
    return li.withColumn("price", F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double") / 100)


def left_out_errors(spark, sf_dir):
    found = nested.left_out_errors(prices(spark, sf_dir), "l_suppkey", "price", CANDIDATES)
    return found.select("l_suppkey", "name", "rows", F.round("error", 6).alias("error"))


def nested_choice(spark, sf_dir):
    found = nested.nested_choice(prices(spark, sf_dir), "l_suppkey", "price", CANDIDATES)
    return found.select("l_suppkey", "selected", *[F.round(c, 6).alias(c) for c in ("inner_error", "error")])


SUMS = """WITH r AS (SELECT l_suppkey AS g, l_extendedprice::DOUBLE / l_quantity::DOUBLE / 100 AS y, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem),
c AS (SELECT g, y, unnest(['mean', 'quantity', 'discount', 'tax']) AS name, unnest([0, 1, 2, 3]) AS place, unnest([0::DOUBLE, q, d, t]) AS x FROM r),
s AS (SELECT g, name, place, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM c GROUP BY ALL),
a AS (SELECT name, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s GROUP BY name)"""


def fitted(sums: str) -> str:
    """The held-out error of a ridge line of penalty 10; input: training sums n_, x_, y_, xx_, xy_ beside those of the held-out group."""
    return f"""(SELECT *, (yy - 2 * w * xy - 2 * b * y + w * w * xx + 2 * b * w * x + n * b * b) / n AS error FROM (SELECT *, (y_ - w * x_) / n_ AS b FROM
  (SELECT *, CASE WHEN place > 0 THEN (xy_ - x_ * y_ / n_) * n_ / ((xx_ - x_ * x_ / n_) * (n_ + 10)) ELSE 0 END AS w FROM {sums})))"""


ONE = fitted("""(SELECT s.*, a.n - s.n AS n_, a.x - s.x AS x_, a.y - s.y AS y_, a.xx - s.xx AS xx_, a.xy - s.xy AS xy_ FROM s JOIN a USING (name))""")
TWO = fitted("""(SELECT o.g AS outer_g, h.*, a.n - o.n - h.n AS n_, a.x - o.x - h.x AS x_, a.y - o.y - h.y AS y_, a.xx - o.xx - h.xx AS xx_, a.xy - o.xy - h.xy AS xy_
  FROM s o JOIN s h ON o.name = h.name AND o.g <> h.g JOIN a ON a.name = o.name)""")

QUERIES = {
    "left_out_errors": (left_out_errors, f"""{SUMS}
SELECT g AS l_suppkey, name, n AS rows, round(error, 6) AS error FROM {ONE}"""),
    "nested_choice": (nested_choice, f"""{SUMS},
e AS (SELECT g, name, error FROM {ONE}),
i AS (SELECT outer_g AS g, name, any_value(place) AS place, avg(error) AS score FROM {TWO} GROUP BY outer_g, name),
b AS (SELECT g, arg_min(name, (score, place)) AS name, min(score) AS score FROM i GROUP BY g)
SELECT g AS l_suppkey, name AS selected, round(score, 6) AS inner_error, round(error, 6) AS error FROM b JOIN e USING (g, name)"""),
}
