"""Tool calls linked to their results, ordered, validated and serialised, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions.prefix import Ordered
from reviewrank.session import cut_lineage

# fixed values: tools and their parameters as (name, JSON type, required, least, most, allowed)
TOOLS = {
    "search": [("query", "string", True, None, None, None), ("limit", "integer", True, 1, 20, None)],
    "summarize": [("query", "string", True, None, None, None), ("style", "string", True, None, None, ("long", "short"))],
    "measure": [("query", "string", True, None, None, None), ("exact", "boolean", False, None, None, None)],
}
_VARIANT_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE"), "boolean": ("BOOLEAN",)}


def _argument_errors(parsed: Column, tool: str, params: list[tuple]) -> Column:
    """Every violation of one tool's schema by the parsed arguments, in the schema's order."""
    checks = []
    for name, kind, required, least, most, allowed in params:
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        type_of = F.regexp_replace(F.schema_of_variant(value), r"^DECIMAL.*", "DOUBLE")
        there = value.isNotNull() & (type_of != "VOID")
        if required:
            checks.append(F.when(~there | value.isNull(), f"{name}: missing"))
        checks.append(F.when(there & ~type_of.isin(*_VARIANT_TYPES[kind]), f"{name}: not {kind}"))
        if least is not None:
            checks.append(F.when(F.try_variant_get(parsed, f"$.{name}", "double") < least, f"{name}: below {least}"))
        if most is not None:
            checks.append(F.when(F.try_variant_get(parsed, f"$.{name}", "double") > most, f"{name}: above {most}"))
        if allowed is not None:
            checks.append(F.when(~F.try_variant_get(parsed, f"$.{name}", "string").isin(*allowed), f"{name}: not allowed"))
    return F.array(*checks)


def argument_errors(name: Column, arguments: Column, tools: dict[str, list[tuple]] = TOOLS) -> Column:
    """Violations of the called tool's schema as an array of texts; empty when the arguments are valid."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    keys = F.coalesce(F.map_keys(F.from_json(arguments, "map<string,string>")), F.array().cast("array<string>"))
    of_tool = F.array(F.lit("unknown tool"))
    for tool, params in tools.items():
        known = F.array(*[F.lit(p[0]) for p in params])
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(": unexpected")))
        of_tool = F.when(name == tool, F.concat(_argument_errors(parsed, tool, params), extra)).otherwise(of_tool)
    errors = F.filter(of_tool, lambda e: e.isNotNull())
    return F.when(F.coalesce(is_object, F.lit(False)), errors).otherwise(F.array(F.lit("arguments: not an object")))


def _behind(key: Column, steps: Column) -> Column:
    """The place ``steps`` behind a place; null stays null."""
    return F.when(key.isNotNull(), F.struct(key["at"].alias("at"), (key["bump"] + steps).alias("bump")))


def topological_keys(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, at, bump, settled)``: sorting by ``(at, bump, call_id)`` puts every call behind what it depends on.

    A call stands at its turn, or directly behind the last of what it depends on if that stands there or later.  Only
    identifiers are joined, and only calls with a dependency take part.  A dependency on a call that has just one itself is
    replaced by that one, with the places passed on the way; doing so again doubles the steps, so chains of any length
    take as many rounds as the logarithm of their length.  What is left, calls with several dependencies, move round by
    round until nothing moves.  Rounds have no limit but the number of calls: a dependency that outlasts it is on
    a cycle or leads to one and orders nothing; calls with such a one are not ``settled``.  Dependencies on unknown calls
    or on the call itself order nothing.
    """
    node = ["conv_id", "call_id"]
    own = cut_lineage(calls.groupBy(*node).agg(F.min(F.struct(F.col("turn").alias("at"), F.lit(0).alias("bump"))).alias("k")))
    place = own.select("conv_id", F.col("call_id").alias("dep"), F.col("k").alias("dk"))
    edges = calls.select(*node, F.explode("after").alias("dep")).where("dep <> call_id").distinct().join(place.select("conv_id", "dep"), ["conv_id", "dep"])
    none = F.lit(None).cast(own.schema["k"].dataType)
    edges = cut_lineage(edges.select(*node, "dep", none.alias("floor"), F.lit(1).alias("steps")))
    per_call = edges.groupBy(*node).agg(F.count("*").alias("n"))
    single = cut_lineage(per_call.where("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("passes")))
    most = own.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        onward = edges.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("floor").alias("next_floor"), F.col("steps").alias("next_steps"))
        onward = onward.join(single, ["conv_id", "dep"]).join(place, ["conv_id", "dep"])
        met = edges.join(onward, ["conv_id", "dep"], "left")
        if met.where("passes").isEmpty():
            break
        steps = F.col("steps")
        floor = F.greatest("floor", _behind(F.col("dk"), steps), _behind(F.col("next_floor"), steps))
        edges = cut_lineage(met.select(
            *node, F.coalesce("next", "dep").alias("dep"), F.when(F.col("passes"), floor).otherwise(F.col("floor")).alias("floor"),
            (steps + F.coalesce("next_steps", F.lit(0))).alias("steps")))
    endless = edges.join(single, ["conv_id", "dep"], "left_semi").select(*node)
    edges = cut_lineage(edges.join(single, ["conv_id", "dep"], "left_anti"))
    several = per_call.where("n > 1").groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    keys, n = own, 0
    while True:
        dep = keys.select("conv_id", F.col("call_id").alias("dep"), F.col("k").alias("dk"))
        need = edges.join(dep, ["conv_id", "dep"]).groupBy(*node).agg(F.max(F.greatest("floor", _behind(F.col("dk"), F.col("steps")))).alias("need"))
        moved = cut_lineage(need.join(keys, node).where(F.col("need") > F.col("k")).select(*node, "need"))
        if moved.isEmpty() or n > 2 * several + 2:
            break
        if n > several:
            endless = endless.unionByName(moved.select(*node))
        keys, n = cut_lineage(keys.join(moved, node, "left").select(*node, F.coalesce("need", "k").alias("k"))), n + 1
    marked = keys.join(endless.distinct().withColumn("settled", F.lit(False)), node, "left")
    return marked.select(*node, "k.at", "k.bump", F.coalesce("settled", F.lit(True)).alias("settled"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, list[tuple]] = TOOLS) -> DataFrame:
    """One row per call: ``(conv_id, seq, call_id, tool, n_results, settled, errors, canonical_json)``.

    ``calls(conv_id, call_id, turn, name, arguments, after)`` and ``results(conv_id, call_id, turn, content)`` meet by
    identifier in a hash join; of several results the earliest counts (equal turns: the smaller text) and ``n_results``
    tells how many there were.  ``seq`` numbers a conversation's calls from 0 in topological order (see
    :func:`topological_keys`); a repeated identifier keeps one place per row.  ``canonical_json`` has sorted keys, no
    white space and null for what is missing; arguments that are no JSON are null there and an error.  Rows without
    a conversation or call identifier are left out: they cannot be linked.  Results without a call give no row.
    """
    calls = calls.where("conv_id is not null and call_id is not null").select(
        "conv_id", "call_id", "turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")
    )
    first = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n_results"), F.min(F.struct("turn", "content"))["content"].alias("content")
    )
    keys = topological_keys(calls.select("conv_id", "call_id", "turn", "after"))
    linked = calls.hint("shuffle_hash").join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(keys, ["conv_id", "call_id"], "left")
    rows = linked.select(
        "conv_id", "call_id", "at", "bump", "turn", F.monotonically_increasing_id().alias("tie"), F.col("name").alias("tool"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "settled",
        argument_errors(F.col("name"), F.col("arguments"), tools).alias("errors"),
        canonical(F.col("call_id"), F.col("name"), F.col("arguments"), F.col("after"), F.col("content")).alias("canonical_json"),
    )
    order = [F.col(c) for c in ("at", "bump", "call_id", "tie")]
    placed = Ordered(rows, ["conv_id"], order).running(sums={"upto": F.lit(1)})
    return placed.select(
        "conv_id", (F.col("upto") - 1).cast("long").alias("seq"), "call_id", "tool", "n_results", "settled",
        F.array_join("errors", "; ").alias("errors"), "canonical_json",
    )


def _json_text(c: Column) -> Column:
    """A string as a JSON value, null as ``null``."""
    quoted = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return F.when(c.isNull(), "null").otherwise(quoted)


def canonical(call_id: Column, name: Column, arguments: Column, after: Column, content: Column) -> Column:
    """One call with its result as canonical JSON: keys in order, no white space, arguments with sorted keys."""
    sorted_arguments = F.coalesce(F.to_json(F.try_parse_json(arguments)), F.lit("null"))
    return F.concat(
        F.lit('{"after":'), F.coalesce(F.to_json(F.array_sort(after)), F.lit("[]")), F.lit(',"arguments":'), sorted_arguments,
        F.lit(',"id":'), _json_text(call_id), F.lit(',"name":'), _json_text(name), F.lit(',"result":'), _json_text(content), F.lit("}"),
    )


def calls_of(conversations: DataFrame) -> DataFrame:
    """Conversations seen as tool use: every assistant turn is a call whose query is its whole text.

    The text's length picks the tool and the other arguments, some of them against the schema.  A call depends on the call
    two turns before; where conversation and turn add up to 0 or 1 modulo 10, on the one two turns later.
    """
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    place = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10))
    id_at = lambda shift: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + shift).cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("summarize"), F.lit("measure")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    other = (
        F.when(F.pmod(n, F.lit(3)) == 0, F.concat(F.lit(',"limit":'), F.pmod(n, F.lit(25)).cast("string")))
        .when(F.pmod(n, F.lit(3)) == 1, F.concat(F.lit(',"style":'), F.when(F.pmod(n, F.lit(7)) == 0, F.lit('"odd"')).otherwise(F.lit('"short"'))))
        .otherwise(F.concat(F.lit(',"exact":'), F.when(F.pmod(n, F.lit(5)) == 0, F.lit('"yes"')).otherwise(F.lit("true"))))
    )
    after = F.when(place < 2, F.array(id_at(2))).when(place < 4, F.array().cast("array<string>")).otherwise(F.array(id_at(-2)))
    return conversations.where("role = 'assistant'").select(
        "conv_id", id_at(0).alias("call_id"), "turn", tool.alias("name"),
        F.concat(F.lit('{"query":'), _json_text(F.col("text")), other, F.lit("}")).alias("arguments"), after.alias("after"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """The user turn that follows a call is its result."""
    call = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    return conversations.where("role = 'user' and turn > 0").select("conv_id", call.alias("call_id"), "turn", F.col("text").alias("content"))


def tool_conversations(conversations: DataFrame) -> DataFrame:
    """:func:`link_calls` over the calls and results that whole ``conversations`` are seen as."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return link_calls(calls_of(rows), results_of(rows))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, length(text) AS n, (conv_id + turn) % 10 AS place, text
  FROM conversations WHERE role = 'assistant'
), k AS (
  SELECT *, CASE WHEN place < 2 THEN conv_id || '-' || (turn + 2) WHEN place < 4 THEN NULL ELSE conv_id || '-' || (turn - 2) END AS dep,
    CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'summarize' ELSE 'measure' END AS tool,
    CASE n % 3 WHEN 0 THEN '"limit":' || (n % 25) WHEN 1 THEN '"style":' || CASE WHEN n % 7 = 0 THEN '"odd"' ELSE '"short"' END
      ELSE '"exact":' || CASE WHEN n % 5 = 0 THEN '"yes"' ELSE 'true' END END AS other,
    CASE n % 3 WHEN 0 THEN CASE WHEN n % 25 < 1 THEN 'limit: below 1' WHEN n % 25 > 20 THEN 'limit: above 20' ELSE '' END
      WHEN 1 THEN CASE WHEN n % 7 = 0 THEN 'style: not allowed' ELSE '' END
      ELSE CASE WHEN n % 5 = 0 THEN 'exact: not boolean' ELSE '' END END AS errors
  FROM c
), r AS (
  SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS content
  FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY ALL
), placed AS (
  SELECT k.*, k.place < 2 AND d.call_id IS NOT NULL AS back, CASE WHEN k.place < 2 AND d.call_id IS NOT NULL THEN k.turn + 2 ELSE k.turn END AS spot
  FROM k LEFT JOIN k d ON d.conv_id = k.conv_id AND d.call_id = k.dep
)
SELECT placed.conv_id, row_number() OVER (PARTITION BY placed.conv_id ORDER BY spot, back, placed.call_id) - 1 AS seq, placed.call_id, tool,
  coalesce(n_results, 0) AS n_results, true AS settled, errors,
  '{"after":' || CASE WHEN dep IS NULL THEN '[]' ELSE '["' || dep || '"]' END || ',"arguments":{'
    || CASE WHEN other < '"query"' THEN other || ',"query":' || to_json(text) ELSE '"query":' || to_json(text) || ',' || other END
    || '},"id":"' || placed.call_id || '","name":"' || tool || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS canonical_json
FROM placed LEFT JOIN r ON r.conv_id = placed.conv_id AND r.call_id = placed.call_id
"""
