"""Tool-call linking: join calls with results, validate, order topologically, serialise. DataFrame
functions only.

``link`` takes three tables. calls: conv_id, call_id, pos, name, arguments (JSON text), depends_on
(array of call_ids of the same conversation). results: conv_id, call_id, pos, content. schemas:
name, required (array), types (map of argument to ``BIGINT``, ``STRING``, ``BOOLEAN``, …, as
``schema_of_variant`` names them; ``DECIMAL``, ``ARRAY`` and ``OBJECT`` stand for all of their kind).

* Calls and results meet in a hash join on (conv_id, call_id), so a conversation with a third of
  all rows is spread by its calls. Rows that repeat an id are pre-aggregated to the first by
  position and counted.
* Order: positions are a topological order wherever every dependency stands before its call. Only
  conversations with a dependency on a later call go through levels (Kahn: a call's level is one
  above its dependencies', a round a level, each written to the shared folder). Calls on a cycle, or
  behind one, get level null, are flagged and come last. ``turn`` numbers a conversation's calls in
  that order by a global range-partitioned numbering, so no task holds a conversation.
* Arguments are parsed to a variant: canonical JSON has sorted keys and no blanks; text that is
  no JSON object (or repeats a key) is invalid.

Cases: null ids are dropped; unknown tools, missing, unknown and wrongly typed arguments, missing
dependencies, cycles, repeated ids and missing results are each named in ``errors``; results
without a call are ``orphans``; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ranking import global_row_number
from tillroll.sources.stage import scratch_path, write_stage

KEY = ["conv_id", "call_id"]


def _first(rows: DataFrame, columns: list[str], n: str) -> DataFrame:
    """The first row of each id by position (ties: by content), and how many there are."""
    rows = rows.where("conv_id is not null and call_id is not null")
    least = F.min(F.struct(F.col("pos"), *columns)).alias("f")
    return rows.groupBy(*KEY).agg(least, F.count("*").alias(n)).select(*KEY, "f.*", n)


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with args (variant of the arguments, null if invalid) and errors of validation."""
    parsed = calls.withColumn("args", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("args", F.expr("if(schema_of_variant(args) like 'OBJECT%', args, null)"))
    parsed = parsed.withColumn("kinds", F.expr("transform_values(from_json(to_json(args), 'map<string, variant>'), (k, v) -> schema_of_variant(v))"))
    known = schemas.where("name is not null").groupBy("name").agg(F.min(F.struct("required", F.map_entries("types").alias("types"))).alias("s"))
    joined = parsed.join(known.select("name", "s.required", F.map_from_entries("s.types").alias("types"), F.lit(True).alias("tool")), "name", "left")
    none = "cast(array() as array<string>)"
    errors = F.expr(f"""
        case when tool is null then array('unknown tool')
             when args is null then array('arguments are no JSON object')
             else concat(
               transform(array_sort(array_except(coalesce(required, {none}), coalesce(map_keys(kinds), {none}))), k -> concat('missing ', k)),
               transform(array_sort(array_except(coalesce(map_keys(kinds), {none}), coalesce(map_keys(types), {none}))), k -> concat('unknown ', k)),
               transform(array_sort(filter(coalesce(map_keys(kinds), {none}), k -> types[k] is not null and not startswith(kinds[k], types[k]))), k -> concat('wrong type ', k)))
        end""")
    return joined.withColumn("errors", errors).drop("required", "types", "tool", "kinds")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level for the calls of conversations where a dependency stands later."""
    spark = calls.sparkSession
    at = calls.select(*KEY, "pos")
    edges = (calls.select(*KEY, "pos", F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep is not null")
             .join(at.select("conv_id", F.col("call_id").alias("dep"), F.col("pos").alias("dep_pos")), ["conv_id", "dep"]))
    late = edges.where(F.struct("dep_pos", "dep") >= F.struct("pos", "call_id")).select("conv_id").distinct()
    edges = write_stage(edges.join(late, "conv_id", "left_semi").select(*KEY, "dep"), scratch_path(spark, "edges"))
    nodes = write_stage(at.join(late, "conv_id", "left_semi").select(*KEY), scratch_path(spark, "nodes"))
    ready = nodes.join(edges.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0))
    done = write_stage(ready, scratch_path(spark, "levels"))
    fresh, level = done, 0
    while fresh.head(1):
        level += 1
        # calls behind the last level, all of whose dependencies are done
        next_ = edges.join(fresh.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").select(*KEY).distinct()
        open_ = edges.join(done.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti").select(*KEY).distinct()
        fresh = write_stage(next_.join(open_, KEY, "left_anti").withColumn("level", F.lit(level)), scratch_path(spark, "levels"))
        done = done.unionByName(fresh)
    return nodes.join(done, KEY, "left").select(*KEY, "level", F.lit(True).alias("levelled"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call: conv_id, turn (1, 2, … in topological order), call_id, name, valid, errors
    and record (canonical JSON with arguments, depends_on, id, name and result)."""
    spark = calls.sparkSession
    calls = _first(calls, ["name", "arguments", F.coalesce("depends_on", F.lit(None).cast("array<string>")).alias("depends_on")], "n_calls")
    calls = write_stage(calls, scratch_path(spark, "calls"))
    ids = calls.select("conv_id", F.col("call_id").alias("dep"))
    lost = (calls.select(*KEY, F.explode("depends_on").alias("dep")).where("dep is not null").join(ids, ["conv_id", "dep"], "left_anti")
            .groupBy(*KEY).agg(F.array_sort(F.collect_set("dep")).alias("lost")))
    answers = _first(results, ["content"], "n_results").select(*KEY, "content", "n_results")
    whole = checked(calls, schemas).join(answers, KEY, "left").join(lost, KEY, "left").join(levels(calls), KEY, "left")
    more = F.expr("""filter(array(
        if(n_calls > 1, 'repeated call id', null), if(n_results > 1, 'repeated result', null), if(n_results is null, 'no result', null),
        if(lost is not null, concat('missing dependency ', array_join(lost, ' ')), null),
        if(levelled and level is null, 'dependency cycle', null)), x -> x is not null)""")
    whole = whole.withColumn("errors", F.concat("errors", more)).withColumn("valid", F.size("errors") == 0)
    record = F.to_json(F.struct(
        F.coalesce("args", F.try_parse_json(F.lit("null"))).alias("arguments"), F.array_sort(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("depends_on"),
        F.col("call_id").cast("string").alias("id"), "name", F.col("content").alias("result")))
    order = [F.col("conv_id"), F.col("levelled").isNotNull() & F.col("level").isNull(), F.coalesce("level", F.lit(0)), F.col("pos"), F.col("call_id")]
    numbered, _ = global_row_number(whole.select("conv_id", "call_id", "pos", "level", "levelled", "name", "valid", "errors", record.alias("record")), order, "_row")
    first = numbered.groupBy("conv_id").agg(F.min("_row").alias("_first"))
    return numbered.join(first, "conv_id").select("conv_id", (F.col("_row") - F.col("_first") + 1).alias("turn"), "call_id", "name", "valid", "errors", "record")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call does not exist."""
    return results.where("conv_id is not null and call_id is not null").join(calls.select(*KEY).distinct(), KEY, "left_anti")
