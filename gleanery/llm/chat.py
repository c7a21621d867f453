"""Chat formatting: tool calls linked with their results, ordered, validated, serialised.  DataFrame functions only.

Calls (conv_id, call_id, turn, tool, arguments, depends_on) and results (conv_id, call_id, turn, content) are joined by the hash of conversation and
identifier.  A call comes after all calls of its conversation that it depends on: ``level`` is the length of the longest chain
of calls below it, found by rounds that each settle the calls whose dependencies are settled; the order of a conversation's
calls is (level, turn, call_id), and a result follows its call.  Arguments are parsed as variants, checked against the tool's schema, and
written as canonical JSON: keys sorted at all depths, no blanks.

One row per call or result comes out; no conversation is ever gathered, so one of any length costs no more than
many short ones.  A round moves only the identifiers of calls that are not settled; there are as many rounds as the
longest chain has calls.

Special cases.  Rows with null conv_id or call_id link with nothing; they stay and are marked.  Of several calls with one identifier the first by turn
(then by a hash of tool and arguments) is the call and the others are marked ``duplicate_id``; results likewise.  A call without result is ``unanswered``, a result
without call ``orphan``.  Dependencies that name no call are marked ``missing_dependency`` and do not hold a call
back; calls on a cycle, or after one, are marked ``cycle`` and have no level.  Null or unreadable arguments are
``bad_json``, arguments that aren't an object ``not_an_object``.  Empty tables give the rows of the others.  Further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.operators.skew import lookup_join
from gleanery.session import counted, write_out

SCHEMA = "tool string, param string, type string, required boolean, low double, high double"
#: Variant types that a schema's type admits.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"],
         "array": ["ARRAY"], "object": ["OBJECT"]}


def settle(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, missing of calls (conv_id, call_id, depends_on), whose identifiers are unique.

    Calls on cycles, or that need such calls, do not come out.
    """
    asked = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    known = calls.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    edges = write_out(asked.join(known.hint("shuffle_hash"), ["conv_id", "needs"], "left"), "edges")
    gone = edges.where("there IS NULL").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("needs")).alias("missing"))
    wait, left = counted(edges.where("there").select("conv_id", "call_id", "needs", F.lit(0).alias("floor")), "edges")
    settled = write_out(calls.select("conv_id", "call_id").join(
        wait.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    all_settled, newest = settled, settled
    while left:
        now = newest.select("conv_id", F.col("call_id").alias("needs"), (F.col("level") + 1).alias("up"))
        met = wait.join(now, ["conv_id", "needs"], "left")
        # Per call: whether some need is open, and the highest need that is settled.
        calls_now = write_out(met.groupBy("conv_id", "call_id").agg(
            F.max(F.greatest("floor", F.coalesce("up", F.lit(0)))).alias("level"),
            F.count(F.when(F.col("up").isNull(), 1)).alias("open")), "round")
        newest, more = counted(calls_now.where("open = 0").select("conv_id", "call_id", "level"), "level")
        floors = calls_now.where("open > 0").select("conv_id", "call_id", F.col("level").alias("floor"))
        wait, still = counted(met.where("up IS NULL").select("conv_id", "call_id", "needs").join(floors, ["conv_id", "call_id"]), "edges")
        all_settled = all_settled.unionByName(newest)
        if not more:
            break
        left = still
    return all_settled.join(gone, ["conv_id", "call_id"], "left")


def first_of(rows: DataFrame, contents: list[str]) -> DataFrame:
    """``rows`` with ``first``: whether the row is the first of its identifier.

    The first is the one with the least turn, then the least hash of the contents; of equal rows any one.  The aggregate
    moves numbers only.
    """
    marked = write_out(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    best = marked.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.xxhash64(*contents), "_row"))["_row"].alias("_row")).select(
        "_row", F.lit(True).alias("first"))
    return marked.join(best, "_row", "left").withColumn(
        "first", F.coalesce("first", F.lit(False)) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).drop("_row")


def schema_maps(schemas: DataFrame) -> DataFrame:
    """tool, spec: one map from parameter to its rules per tool; ``needed``: its required parameters."""
    rule = F.struct("type", "required", "low", "high")
    return schemas.groupBy("tool").agg(
        F.map_from_entries(F.collect_list(F.struct("param", rule))).alias("spec"),
        F.sort_array(F.collect_list(F.when(F.col("required"), F.col("param")))).alias("needed"))


def argument_errors(parsed: Column, raw: Column, spec: Column, needed: Column) -> Column:
    """Sorted list of what is wrong with a call's arguments."""
    kind = F.schema_of_variant(parsed)
    args = F.when(kind.startswith("OBJECT"), F.map_entries(parsed.cast("map<string,variant>")))
    none = F.array().cast("array<string>")
    admitted = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def check(arg: Column) -> Column:
        rule, name = F.try_element_at(spec, arg["key"]), arg["key"]
        real = F.regexp_extract(F.schema_of_variant(arg["value"]), r"^[A-Z]+", 0)
        size = F.when(real == "STRING", F.length(F.try_variant_get(arg["value"], "$", "string")).cast("double")).when(
            real == "ARRAY", F.lit(None).cast("double")).otherwise(F.try_variant_get(arg["value"], "$", "double"))
        return (F.when(rule.isNull(), F.concat(F.lit("unknown:"), name))
                .when(~F.array_contains(F.try_element_at(admitted, rule["type"]), real), F.concat(F.lit("type:"), name))
                .when((size < rule["low"]) | (size > rule["high"]), F.concat(F.lit("range:"), name)))

    missing = F.transform(F.array_except(needed, F.transform(args, lambda a: a["key"])), lambda n: F.concat(F.lit("missing:"), n))
    wrong = F.filter(F.transform(args, check), lambda e: e.isNotNull())
    return (F.when(raw.isNull() | parsed.isNull(), F.array(F.lit("bad_json")))
            .when(spec.isNull(), F.array(F.lit("unknown_tool")))
            .when(~kind.startswith("OBJECT"), F.array(F.lit("not_an_object")))
            .otherwise(F.sort_array(F.concat(F.coalesce(missing, none), F.coalesce(wrong, none)))))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result.

    conv_id, level, turn, part (0 call, 1 result, of the call's level and turn), call_id, valid, errors (sorted list), json.
    """
    calls = first_of(calls.select("conv_id", "call_id", "turn", "tool", "arguments",
                                  F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")),
                     ["tool", "arguments"])
    results = first_of(results.select("conv_id", "call_id", "turn", "content"), ["content"])
    levels = write_out(settle(calls.where("first").select("conv_id", "call_id", "depends_on")), "levels")
    specs, tools = counted(schema_maps(schemas), "schemas")
    parsed = calls.withColumn("_v", F.try_parse_json("arguments"))
    held = (parsed.join(F.broadcast(specs), "tool", "left") if tools <= 1000
            else lookup_join(parsed, specs, ["tool"], "left", ["conv_id", "call_id"]))
    checked = held.select("conv_id", "call_id", "turn", "tool", "first", F.to_json("_v").alias("canonical"),
                          argument_errors(F.col("_v"), F.col("arguments"), F.col("spec"), F.col("needed")).alias("bad"))
    there = checked.where("first").join(levels, ["conv_id", "call_id"], "left").withColumn("cycle", F.col("level").isNull())
    others = checked.where("NOT first").withColumns({
        "level": F.lit(None).cast("int"), "missing": F.lit(None).cast("array<string>"), "cycle": F.lit(False)})
    answers = results.where("first").select("conv_id", "call_id", F.col("turn").alias("_turn"), "content", F.lit(True).alias("answered"))
    called = there.unionByName(others)
    # Only first calls have an answer, and only first results are one.
    paired = called.where("first").join(answers, ["conv_id", "call_id"], "full").unionByName(
        called.where("NOT first"), allowMissingColumns=True)
    is_call = F.col("first").isNotNull()
    note = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call_errors = F.concat(
        F.coalesce("bad", F.array().cast("array<string>")), note(F.col("cycle"), "cycle"),
        note(~F.col("first") & named, "duplicate_id"), note(~F.col("first") & ~named, "no_id"),
        F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda m: F.concat(F.lit("missing_dependency:"), m)),
        note(F.col("first") & F.col("answered").isNull(), "unanswered"))
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    call_json = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), text("call_id"),
        F.lit(',"name":'), text("tool"), F.lit(',"role":"assistant","type":"tool_call"}'))
    result_json = F.concat(F.lit('{"content":'), text("content"), F.lit(',"role":"tool","tool_call_id":'), text("call_id"),
                           F.lit(',"type":"tool_result"}'))
    row = lambda part, turn, errors, json: F.struct(
        F.lit(part).alias("part"), turn.cast("long").alias("turn"), F.sort_array(errors).alias("errors"), json.alias("json"))
    both = F.array(
        F.when(is_call, row(0, F.col("turn"), call_errors, call_json)),
        F.when(F.col("answered"), row(1, F.coalesce("turn", "_turn"), note(~is_call, "orphan"), result_json)))
    made = paired.select("conv_id", "call_id", "level", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("m"))
    spare = results.where("NOT first").select(
        "conv_id", "call_id", F.lit(None).cast("int").alias("level"),
        row(1, F.col("turn"), F.when(named, F.array(F.lit("duplicate_id"))).otherwise(F.array(F.lit("no_id"))), result_json).alias("m"))
    return made.unionByName(spare).select(
        "conv_id", "level", "m.turn", "m.part", "call_id", (F.size("m.errors") == 0).alias("valid"), "m.errors", "m.json")


#: Tools of the calls that are derived from the conversations.
TOOLS = [
    ("search", "query", "string", True, 1.0, 2000.0), ("search", "limit", "integer", True, 1.0, 200.0),
    ("search", "after", "string", False, None, None), ("lookup", "key", "string", True, 1.0, 60.0),
    ("lookup", "exact", "boolean", False, None, None), ("lookup", "after", "string", False, None, None),
    ("store", "items", "array", True, None, None), ("store", "note", "string", False, None, 100.0),
]


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of conversations: an assistant turn is a call, the user's next turn its result.

    A call of turn t depends on the call of turn t / 2, if that one is the assistant's.
    """
    words = F.split("text", r"\s+")
    ident = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn, kind = F.col("turn"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    half = F.floor(turn / 2)
    search = F.to_json(F.struct(F.col("text").alias("query"), F.size(words).alias("limit"), ident(half).alias("after")))
    lookup = F.to_json(F.struct(F.lit(True).alias("exact"), F.get(words, F.lit(0)).alias("key"), ident(half).alias("after")))
    store = F.to_json(F.struct(F.col("text").alias("note"), words.alias("items"), turn.alias("turn")))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", ident(turn).alias("call_id"), "turn",
        F.when(kind == 0, "search").when(kind == 1, "lookup").when(kind == 2, "store").otherwise("search").alias("tool"),
        F.when(kind == 0, search).when(kind == 1, lookup).when(kind == 2, store).otherwise(F.col("text")).alias("arguments"),
        F.when(half > 0, F.array(ident(half))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = conversations.where("role = 'user' AND turn > 0").select(
        "conv_id", ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def report(conversations: DataFrame) -> DataFrame:
    calls, results = derived(conversations)
    spark: SparkSession = conversations.sparkSession
    return link(calls, results, spark.createDataFrame(TOOLS, SCHEMA))
