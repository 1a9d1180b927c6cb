"""Chat formatting: tool calls and their results linked, ordered, validated and written as canonical JSON. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: What a schema's type is called where the value is described by ``schema_of_variant``.
_TYPES = {
    "string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$", "object": r"^OBJECT.*$", "array": r"^ARRAY.*$", "null": r"^VOID$",
}
CALL = ["thread", "call_id"]


def _chains(singles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((thread, call_id, head, far), the same of the rest) of calls (thread, call_id, need) with one need each.

    Each call points to a call further up its chain, and every round it takes over where
    that one points, so a chain of n calls needs log2(n) rounds. ``head`` is the first
    call up the chain that has not one need, ``far`` the number of steps to it. Calls that
    have no such head, in or behind a circle, are the rest.
    """
    state = saved(singles.select(*CALL, F.col("need").alias("head"), F.lit(1).cast("long").alias("far")))
    size, reach = state.count(), 1
    while True:
        onward = state.select("thread", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        both = state.join(onward, ["thread", "head"], "left")
        if reach > size or both.where("next IS NOT NULL").isEmpty():
            break
        state = saved(
            both.select(*CALL, F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        )
        reach *= 2
    return tuple(saved(both.where(F.col("next").isNull() == found).select(*CALL, "head", "far")) for found in (True, False))


def levels(calls: DataFrame) -> DataFrame:
    """(thread, call_id, level, lost): the length of the longest chain of needed calls before each distinct call.

    Chains of calls with one need are contracted first (see ``_chains``). Of the others,
    all whose needs have a level get theirs, in rounds: as many as calls of several needs
    stand in one another's chains. A need that no call of the thread meets is counted in
    ``lost`` and does not hold its call back; calls in or behind a circle have a null level.
    """
    nodes = saved(calls.select(*CALL).distinct())
    needs = calls.select(*CALL, F.explode("needs").alias("need")).distinct().where("need IS NOT NULL")
    known = nodes.select("thread", F.col("call_id").alias("need"), F.lit(True).alias("known"))
    edges = saved(needs.join(known, ["thread", "need"], "left"))
    lost = edges.where("known IS NULL").groupBy(*CALL).agg(F.count("*").alias("lost"))
    edges = edges.where("known").drop("known")
    number = saved(edges.groupBy(*CALL).agg(F.count("*").alias("n"), F.min("need").alias("need")))
    chained, stuck = _chains(number.where("n = 1"))
    ends = chained.select("thread", F.col("call_id").alias("need"), "head", "far")
    behind = stuck.select("thread", F.col("call_id").alias("need"), F.lit(True).alias("stuck"))
    several = edges.join(number.where("n > 1").select(*CALL), CALL, "left_semi").join(ends, ["thread", "need"], "left").join(behind, ["thread", "need"], "left")
    left = saved(
        several.select(
            *CALL, F.when(F.col("stuck").isNull(), F.coalesce("head", "need")).alias("head"),
            (1 + F.coalesce("far", F.lit(0))).alias("far"),
        )
    )
    done = [nodes.join(number.select(*CALL), CALL, "left_anti").withColumn("level", F.lit(0).cast("long"))]
    while not left.isEmpty():
        so_far = done[0]
        for more in done[1:]:
            so_far = so_far.union(more)
        before = so_far.select("thread", F.col("call_id").alias("head"), "level")
        most = left.join(before, ["thread", "head"], "left").groupBy(*CALL).agg(
            F.count("*").alias("n"), F.count("level").alias("known"),
            F.max(F.col("level") + F.col("far")).alias("level"),
        )
        ready = saved(most.where("n = known").select(*CALL, "level"))
        if ready.isEmpty():
            break
        done.append(ready)
        left = saved(left.join(ready.select(*CALL), CALL, "left_anti"))
    heads = done[0]
    for more in done[1:]:
        heads = heads.union(more)
    heads = saved(heads)
    of_chain = chained.join(
        heads.select("thread", F.col("call_id").alias("head"), "level"), ["thread", "head"],
    ).select(*CALL, (F.col("level") + F.col("far")).alias("level"))
    level = heads.union(of_chain)
    return nodes.join(level, CALL, "left").join(lost, CALL, "left").select(
        *CALL, F.col("level").cast("int").alias("level"),
        F.coalesce("lost", F.lit(0).cast("long")).alias("lost"),
    )


def _faults(kinds: Column, schema: Column) -> Column:
    """What is wrong with arguments (a map of name to type name) under a schema (a map of name to type and required)."""
    missing = F.transform(
        F.filter(F.map_keys(schema), lambda k: F.element_at(schema, k)["required"] & ~F.array_contains(F.map_keys(kinds), k)),
        lambda k: F.concat(F.lit("missing "), k),
    )
    unknown = F.transform(
        F.filter(F.map_keys(kinds), lambda k: ~F.array_contains(F.map_keys(schema), k)),
        lambda k: F.concat(F.lit("unknown "), k),
    )
    pattern = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    fits = lambda k: F.regexp(
        F.element_at(kinds, k),
        F.coalesce(F.element_at(pattern, F.element_at(schema, k)["type"]), F.lit(".*")),
    )
    wrong = F.transform(
        F.filter(F.map_keys(kinds), lambda k: F.array_contains(F.map_keys(schema), k) & ~fits(k)),
        lambda k: F.concat(F.lit("type "), k),
    )
    return F.array_sort(F.concat(missing, unknown, wrong))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(thread, call_id, kind, name, level, n_results, errors, json), a row a call and a row a result without a call.

    calls: thread, call_id, name, arguments (JSON text), needs (array of call_ids).
    results: thread, call_id, content. schemas: name, parameter, type, required. All ids
    are strings. Calls meet results by a hash join on (thread, call_id); of several
    results of one call the first by content counts, ``n_results`` tells, and each further
    content has a row of its own, error "repeated". ``json`` is
    canonical: keys sorted at all depths, no white space, null for what is absent.
    Arguments that are no JSON object (or beyond the size of a VARIANT, 128 MB), that lack
    or exceed what the schema names, or that
    have another type, a name without a schema, a need that is not met and a circle of
    needs are each an error; no error: an empty array. Rows with a null id link to
    nothing; repeated calls each have their row; further columns are ignored.
    """
    calls = calls.select(*CALL, "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    order = levels(calls.where("thread IS NOT NULL AND call_id IS NOT NULL"))
    each = saved(results.where("thread IS NOT NULL AND call_id IS NOT NULL").groupBy(*CALL, "content").agg(F.count("*").alias("n")))
    first = saved(each.groupBy(*CALL).agg(F.min("content").alias("content"), F.sum("n").alias("n_results")))
    further = each.join(
        first.select(*CALL, F.col("content").alias("first")).hint("shuffle_hash"), CALL,
    ).where("content <> first").select(*CALL, "content", F.col("n").alias("n_results"))
    unkeyed = results.where("thread IS NULL OR call_id IS NULL").select(*CALL, "content", F.lit(1).cast("long").alias("n_results"))
    entry = F.map_from_entries(F.collect_list(F.struct("parameter", "rule")))  # as long as one tool's signature
    rules = schemas.where("name IS NOT NULL AND parameter IS NOT NULL").groupBy("name", "parameter").agg(F.min(F.struct(
        "type", F.coalesce("required", F.lit(False)).alias("required"),
    )).alias("rule"))
    rules = rules.groupBy("name").agg(entry.alias("schema"))
    parsed = F.try_parse_json("arguments")
    members = F.from_json(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)), "map<string,variant>")
    rows = calls.join(order.hint("shuffle_hash"), CALL, "left").join(first.hint("shuffle_hash"), CALL, "left").join(rules, "name", "left").withColumn(
        "kinds", F.transform_values(members, lambda _, v: F.schema_of_variant(v)),
    )
    errors = F.concat(
        F.when(F.col("kinds").isNull(), F.array(F.lit("arguments"))).when(F.col("schema").isNull(), F.array(F.lit("schema"))).otherwise(_faults(F.col("kinds"), F.col("schema"))),
        F.when(F.col("lost") > 0, F.array(F.lit("need"))).otherwise(F.array().cast("array<string>")),
        F.when(
            F.col("level").isNull() & F.col("thread").isNotNull() & F.col("call_id").isNotNull(),
            F.array(F.lit("circle")),
        ).otherwise(F.array().cast("array<string>")),
    )
    text = lambda arguments, call, name, result: F.to_json(
        F.struct(arguments.alias("arguments"), call.alias("call_id"), name.alias("name"), result.alias("result")),
        {"ignoreNullFields": "false"},
    )
    count = F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results")
    called = rows.select(
        *CALL, F.lit("call").alias("kind"), "name", "level", count, errors.alias("errors"),
        text(parsed, F.col("call_id"), F.col("name"), F.col("content")).alias("json"),
    )
    alone = first.join(
        calls.select(*CALL).distinct().hint("shuffle_hash"), CALL, "left_anti",
    ).union(unkeyed.select(first.columns)).withColumn("error", F.lit("call"))
    alone = alone.union(further.withColumn("error", F.lit("repeated")))
    none = F.lit(None).cast("string")
    orphans = alone.select(
        *CALL, F.lit("result").alias("kind"), none.alias("name"), F.lit(None).cast("int").alias("level"),
        "n_results", F.array("error").alias("errors"),
        text(F.lit(None).cast("variant"), F.col("call_id"), none, F.col("content")).alias("json"),
    )
    return called.union(orphans)


def in_order(linked: DataFrame) -> DataFrame:
    """``linked`` with ``place``: the row's place in its thread, calls topologically by level, then by call_id; rows without a level last.

    One range exchange deals the rows out by that order, so a thread of any length spans
    as many tasks as it needs; its rows in each are counted, and the counts of earlier
    tasks are added. Rows alike in all of thread, level, call_id and kind are told apart by their
    JSON. A null thread counts as one.
    """
    last = F.coalesce("level", F.lit(2**31 - 1))
    ranged = linked.repartitionByRange("thread", last, "call_id", "kind").withColumn("part_", F.spark_partition_id())
    ranged = saved(ranged)
    inside = F.row_number().over(Window.partitionBy("part_", "thread").orderBy(last, "call_id", "kind", "json"))
    counts = saved(ranged.groupBy("part_", "thread").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("thread").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("part_").alias("of_part"), F.col("thread").alias("of_thread"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    both = ranged.withColumn("inside_", inside).join(
        before, (F.col("part_") == F.col("of_part")) & F.col("thread").eqNullSafe(F.col("of_thread")),
    )
    return both.withColumn("place", F.col("before") + F.col("inside_") - 1).select(*linked.columns, "place")


def of_conversations(turns: DataFrame) -> DataFrame:
    """Conversations read as calls: every turn but the assistant's calls (a user ``reply``, others ``configure``) and needs the
    call before it, at the turn before or else two before; an assistant's turn is the result of the turn before.

    Arguments are the text, the turn and the turn that is needed. The schema of a reply asks for all three, that of
    ``configure`` for a turn in words, so first replies and configurations have errors. A null conv_id or turn links
    to nothing, a null role is not the assistant's, a null text is a missing argument; repeated rows each have their
    row, as a call, and count as results; further columns are ignored; no rows give none.
    """
    thread, name = F.col("conv_id").cast("string").alias("thread"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name")
    other = F.coalesce(F.col("role") != "assistant", F.lit(True))
    call = turns.where(other).select(thread, F.col("turn").cast("long").alias("turn"), name, "text")
    after = call.select(F.col("thread").alias("of_thread"), (F.col("turn") + 1).alias("after")).distinct()
    call = call.join(after.hint("shuffle_hash"), (F.col("thread") == F.col("of_thread")) & (F.col("turn") == F.col("after")), "left")
    previous = F.when(F.col("after").isNotNull(), F.col("turn") - 1).when(F.col("turn") >= 2, F.col("turn") - 2)
    call = call.select(
        "thread", F.col("turn").cast("string").alias("call_id"), "name",
        F.to_json(F.struct(previous.alias("previous"), "text", "turn")).alias("arguments"),
        F.array_compact(F.array(previous.cast("string"))).alias("needs"),
    )
    result = turns.where(~other).select(thread, (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    rules = [
        ("reply", "previous", "integer", True), ("reply", "text", "string", True),
        ("reply", "turn", "integer", True), ("configure", "text", "string", True),
        ("configure", "turn", "string", True), ("configure", "previous", "integer", False),
    ]
    return link_calls(
        call, result,
        turns.sparkSession.createDataFrame(rules, "name string, parameter string, type string, required boolean"),
    )
