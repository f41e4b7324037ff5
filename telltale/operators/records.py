"""Redaction and bounded summaries of nested JSON records, as windows over their tokens.

A record is taken apart into tokens, one row each. Running sums give every token its depth,
running last values the fate of the members around it, and the kept tokens are put together
again in order. So keys keep their order, no depth needs a step of its own, and all windows
and the last grouping share the one shuffle by record.

Null, empty, malformed or ambiguous text (a key twice in one object) gives null. Numbers that
are not finite become null. Rows may repeat; each is a record of its own.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.operators.text import HIDDEN_KEY, REDACTED, SENSITIVE_KEY, redact_text

# Depth and node budget of redacted records, and the texts that stand for what is left out.
RECORD_DEPTH, RECORD_NODES = 16, 12_000
DEEP_TEXT = "[Data omitted: context budget exceeded]"
MORE_FIELDS = '"_omitted":"Remaining fields exceeded the context budget."'
MORE_ITEMS = '"[Remaining items omitted: context budget exceeded]"'
# Depth, list, map, key and text bounds of summaries.
SUMMARY_DEPTH, LIST_ITEMS, MAP_ITEMS, KEY_CHARS, TEXT_CHARS = 5, 24, 30, 100, 1000
NESTED_TEXT = "[nested details omitted]"

# Escaped backslashes and quotes become control characters, which no JSON string holds as they
# are; after that a string ends at the next quote.
SLASH, QUOTE = "\x01", "\x02"
TASK_BYTES = 2_000_000  # of records in one task
TOKEN = r'"[^"]*+"|[{}\[\],:]|[^\s{}\[\],:"]++'
KEEP, WITHHOLD, DROP = 0, 1, 2


def valid_json(text: str | Column) -> Column:
    """Is it one JSON value, with each key once? NaN and Infinity may stand for numbers."""
    numbers = F.regexp_replace(text, r"-?\bInfinity\b|\bNaN\b", "null")
    return F.coalesce(F.try_parse_json(numbers).isNotNull(), F.lit(False))


def _plain(token: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', "")


def _strings(rows: DataFrame, form) -> DataFrame:
    """`plain`: the text of a string token; `quoted`: `form` of it as a token. A column each, so each is computed once."""
    rows = rows.withColumn("plain", F.when(F.col("tok").startswith('"') & ~F.col("outer"), _plain(F.col("tok"))))
    return rows.withColumn("shown", form(F.col("plain"))).withColumn("quoted", _quoted(F.col("shown")))


def _tokens(records: DataFrame, text: str, keys: list[str]) -> DataFrame:
    marked = F.replace(F.replace(F.col(text), F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))
    found = F.when(valid_json(F.col(text)), F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0)))
    rows = records.select(F.struct(*keys).alias("keys"), F.monotonically_increasing_id().alias("rec"), found.alias("found"))
    rows = rows.select("rec", F.when(F.lit(True), F.col("keys")).alias("keys"), F.posexplode_outer("found").alias("pos", "mark"))
    token = F.replace(F.replace("mark", F.lit(SLASH), F.lit("\\\\")), F.lit(QUOTE), F.lit('\\"'))
    # A token costs far more than its bytes in the orderings that follow, so a task gets a bounded share of the text.
    size = records.agg(F.sum(F.octet_length(text))).first()[0] or 0
    places = max(records.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    # The columns of the caller travel with the first token only.
    return rows.repartition(places, "rec").select("rec", F.coalesce("pos", F.lit(0)).alias("pos"), token.alias("tok"),
                       F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("keys")).alias("keys"))


def _placed(tokens: DataFrame, levels: int) -> DataFrame:
    """Depth before each token, its kind, the container around it and its member's number there."""
    order = Window.partitionBy("rec").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tok = F.col("tok")
    rows = tokens.withColumns({
        "opens": tok.isin("{", "["), "closes": tok.isin("}", "]"), "comma": tok == ",",
        "is_key": F.coalesce(F.lead("tok").over(order) == ":", F.lit(False)) & tok.startswith('"'),
        "after_colon": F.coalesce(F.lag("tok").over(order) == ":", F.lit(False)),
        "before_key": F.coalesce(F.lead("tok", 2).over(order) == ":", F.lit(False))})
    rows = rows.withColumn("depth", F.sum(F.col("opens").cast("int") - F.col("closes").cast("int")).over(so_far)
                           - F.col("opens").cast("int") + F.col("closes").cast("int"))
    rows = rows.withColumn("is_value", F.col("opens") | ~(F.col("closes") | F.col("comma") | F.col("is_key") | (tok == ":")))
    opened = [F.last(F.when(F.col("opens") & (F.col("depth") == k - 1), F.col("pos")), ignorenulls=True).over(so_far)
              for k in range(1, levels + 1)]
    rows = rows.withColumn("inside", F.get(F.array(*opened), F.col("depth").cast("int") - 1))
    members = Window.partitionBy("rec", "inside").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("member", F.sum(F.col("comma").cast("int")).over(members))


def _fates(rows: DataFrame, levels: int, key_fate: Column, comma_fate: Column) -> DataFrame:
    """`outer`: lies inside a member that does not show; `fate`: that of its own member.

    key_fate is given for the column `key`, the text of a key.
    """
    rows = rows.withColumn("key", F.when(F.col("is_key"), _plain(F.col("tok")))).withColumns({
        "key_fate": key_fate, "comma_fate": comma_fate}).drop("key")
    so_far = Window.partitionBy("rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.col("depth")
    fates = []
    for k in range(1, levels + 1):
        event = (F.when(F.col("opens") & (depth == k - 1), F.lit(KEEP)).when(F.col("comma") & (depth == k), F.col("comma_fate"))
                 .when(F.col("is_key") & (depth == k), F.col("key_fate")))
        fates.append(F.last(event, ignorenulls=True).over(so_far))
    rows = rows.withColumn("fates", F.array(*fates))
    around = F.slice("fates", F.lit(1), F.greatest(F.least(depth - 1, F.lit(levels)), F.lit(0)).cast("int"))
    return rows.withColumns({
        "outer": F.exists(around, lambda f: f != KEEP) | (depth > levels),
        "fate": F.coalesce(F.get("fates", depth.cast("int") - 1), F.lit(KEEP))}).drop("fates")


def _joined(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Records from `out` (null: left out), with commas before every member but the first."""
    members = Window.partitionBy("rec", "inside").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("out").isNotNull() & (F.col("depth") >= 1) & F.col("starts")
    earlier = F.coalesce(F.max(starts).over(members), F.lit(False))
    rows = rows.withColumn("out", F.when(starts & earlier, F.concat(F.lit(","), "out")).otherwise(F.col("out")))
    parts = F.array_sort(F.collect_list(F.when(F.col("out").isNotNull(), F.struct("pos", "out"))))
    whole = F.array_join(F.transform(parts, lambda p: p["out"]), "")
    one = F.count_if(F.col("is_value") & (F.col("depth") == 0)) == 1
    done = rows.groupBy("rec").agg(F.first("keys", ignorenulls=True).alias("keys"), F.when(one, whole).alias(name))
    return done.select(*[F.col("keys").getField(k).alias(k) for k in keys], name)


def _scalar() -> Column:
    """A token that stands for one value."""
    tok = F.col("tok")
    number = F.expr("try_cast(tok AS double)")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    return F.when(tok.startswith('"'), F.col("quoted")).when(tok.isin("true", "false", "null") | finite, tok).otherwise(F.lit("null"))


def redact_records(records: DataFrame, text: str, keys: list[str], secrets: list[str] | None = None,
                   max_depth: int = RECORD_DEPTH, max_nodes: int = RECORD_NODES, name: str = "safe") -> DataFrame:
    """`keys` and the record without credentials, at any depth.

    Values of sensitive keys are withheld whole, strings and keys are redacted, what lies below
    `max_depth` is replaced by a note, and after `max_nodes` values each open list or object ends
    with a note in place of the rest.
    """
    levels = max_depth + 1
    order = Window.partitionBy("rec").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sensitive = F.when(F.col("key").rlike(SENSITIVE_KEY), F.lit(WITHHOLD)).otherwise(F.lit(KEEP))
    rows = _fates(_placed(_tokens(records, text, keys), levels), levels, sensitive, F.lit(KEEP))
    counted = (F.col("is_value") & ~F.col("outer") & (F.col("fate") == KEEP)).cast("int")
    rows = rows.withColumn("late", F.sum(counted).over(so_far) - counted >= max_nodes)
    # Behind the budget, a token belongs to a container that is still open if nothing shallower came since.
    rows = rows.withColumn("floor", F.min(F.when(F.col("late"), F.col("depth"))).over(so_far))
    rows = rows.withColumn("open_still", F.col("late") & (F.col("depth") == F.col("floor")))
    cut = F.col("open_still") & F.col("is_value")
    at_floor = Window.partitionBy("rec", "floor").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("note", cut & (F.sum(cut.cast("int")).over(at_floor) == 1))
    rows = _strings(rows, lambda t: redact_text(t, secrets))
    shown = (F.when(F.col("outer") | F.col("comma"), F.lit(None))
             .when(F.col("note"), F.when(F.col("after_colon"), F.lit(MORE_FIELDS)).otherwise(F.lit(MORE_ITEMS)))
             .when(F.col("late"), F.when(F.col("closes") & F.col("open_still"), F.col("tok")))
             .when(F.col("is_value") & (F.col("fate") == WITHHOLD), F.lit(f'"{REDACTED}"'))
             .when(F.col("is_value") & (F.col("depth") > max_depth), F.lit(f'"{DEEP_TEXT}"'))
             .when(F.col("is_key"), F.col("quoted"))
             .when(F.col("is_value") & ~F.col("opens"), _scalar()).otherwise(F.col("tok")))
    # Below the last shown depth only the value itself stands for all it holds.
    starts = F.col("is_key") | (F.col("is_value") & ~F.col("after_colon")) | F.col("note")
    return _joined(rows.withColumns({"out": shown, "starts": starts}), keys, name)


def bounded_records(records: DataFrame, text: str, keys: list[str], max_depth: int = SUMMARY_DEPTH, items: int = LIST_ITEMS,
                    fields: int = MAP_ITEMS, chars: int = TEXT_CHARS, name: str = "summary") -> DataFrame:
    """`keys` and a bounded form of the record.

    The first `items` of a list and a count of the others; of the first `fields` of an object
    those whose key may show; texts redacted and cut at `chars`; a note below `max_depth`.
    """
    levels = max_depth + 1
    placed = _placed(_tokens(records, text, keys), levels)
    hidden = F.when(F.col("key").rlike(HIDDEN_KEY) | (F.col("member") >= fields), F.lit(DROP)).otherwise(F.lit(KEEP))
    beyond = F.when(F.col("member") >= F.when(F.col("before_key"), F.lit(fields)).otherwise(F.lit(items)), F.lit(DROP)).otherwise(F.lit(KEEP))
    rows = _fates(placed, levels, hidden, beyond)
    rows = _strings(rows, redact_text)
    text = F.col("shown")
    cut = F.when(F.col("is_key"), F.substring("plain", 1, KEY_CHARS)).when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("… [text truncated]"))).otherwise(text)
    rows = rows.withColumn("quoted", _quoted(cut))
    more = F.col("member") + 1 - items
    shown = (F.when(F.col("outer") | F.col("comma"), F.lit(None))
             .when((F.col("tok") == "]") & (more > 0),
                   F.concat(F.lit(',{"omitted_items":'), more.cast("string"), F.lit("}]")))
             .when(F.col("closes"), F.col("tok"))
             .when(F.col("fate") == DROP, F.lit(None))
             .when(F.col("is_value") & (F.col("depth") > max_depth), F.lit(f'"{NESTED_TEXT}"'))
             .when(F.col("is_key"), F.col("quoted"))
             .when(F.col("is_value") & ~F.col("opens"), _scalar()).otherwise(F.col("tok")))
    starts = F.col("is_key") | (F.col("is_value") & ~F.col("after_colon"))
    return _joined(rows.withColumns({"out": shown, "starts": starts}), keys, name)
