"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results are tables of their own, joined by identifier. A call may name the call whose
result it uses; following these names by pointer doubling gives each call its level, and levels
are a topological order (a call comes after what it uses) without any conversation being gathered
in one place. Arguments are checked against the tool's schema and written as canonical JSON: keys
sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.llm.shared import discard, written

#: Types of JSON Schema and the names that Spark gives to such values.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}

#: The tools of the registered query: JSON Schema, of which type, required, properties,
#: additionalProperties, enum, minimum, maximum and maxLength are understood.
TOOLS = {
    "lookup": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 200}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}, "additionalProperties": False},
    "count": {"type": "object", "required": ["text", "unit"], "properties": {"text": {"type": "string"}, "unit": {"type": "string", "enum": ["words", "characters"]}}, "additionalProperties": False},
    "score": {"type": "object", "required": ["value"], "properties": {"value": {"type": "number", "minimum": 0}, "strict": {"type": "boolean"}}, "additionalProperties": True},
}


def _kind(value: Column) -> Column:
    """The name of a variant's type, without what is inside."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def errors_of(arguments: Column, name: Column, tools: dict[str, dict] = TOOLS) -> Column:
    """What is wrong with a call's JSON arguments, sorted; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    checks = F.when(name.isNull() | ~F.coalesce(name.isin(*tools), F.lit(False)), F.array(F.lit("tool: unknown")))
    for tool, schema in tools.items():
        found = []
        properties = schema.get("properties", {})
        for key in schema.get("required", []):
            found.append(F.when(F.try_variant_get(parsed, f"$.{key}", "variant").isNull(), F.lit(f"{key}: missing")))
        for key, rule in properties.items():
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            right = _kind(value).isin(*TYPES[rule["type"]])
            found.append(F.when(value.isNotNull() & ~right, F.lit(f"{key}: not {rule['type']}")))
            number = F.try_variant_get(parsed, f"$.{key}", "double")
            if "minimum" in rule:
                found.append(F.when(right & (number < rule["minimum"]), F.lit(f"{key}: under {rule['minimum']}")))
            if "maximum" in rule:
                found.append(F.when(right & (number > rule["maximum"]), F.lit(f"{key}: over {rule['maximum']}")))
            if "maxLength" in rule:
                found.append(F.when(right & (F.length(F.try_variant_get(parsed, f"$.{key}", "string")) > rule["maxLength"]), F.lit(f"{key}: longer than {rule['maxLength']}")))
            if "enum" in rule:
                found.append(F.when(right & ~F.try_variant_get(parsed, f"$.{key}", "string").isin(*rule["enum"]), F.lit(f"{key}: not one of its values")))
        if schema.get("additionalProperties") is False:
            more = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, properties)))
            found.append(F.when(F.size(more) > 0, F.concat(F.lit("not allowed: "), F.array_join(F.sort_array(more), ", "))))
        checks = checks.when(name == tool, F.sort_array(F.array_compact(F.array(*found))))
    broken = parsed.isNull() | (_kind(parsed) != "OBJECT")
    return F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit("arguments: no JSON object"))).otherwise(checks)


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null for what isn't JSON. A number has one form,
    whatever its notation: digits without an exponent, without zeros that say nothing, exact up to
    38 digits; only what is under a thousandth or beyond 38 digits and came with an exponent keeps one."""
    return one_number_form(F.to_json(F.try_parse_json(json)))


def one_number_form(written: Column) -> Column:
    """Compact JSON text with the numbers that have a point and a zero, or an exponent, in plain form."""
    # two characters that JSON never has unescaped stand for escaped ones, so that every quote
    # begins or ends a string and the parts between strings can be told by their place
    marked = F.replace(F.replace(written, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))

    def plain(token: Column) -> Column:
        number = token.try_cast("double")
        large, small = token.try_cast("decimal(38,0)"), token.try_cast("decimal(38,9)")
        digits = F.regexp_replace(F.when(F.abs(number) >= 1e15, large.cast("string")).otherwise(small.cast("string")), r"\.?0+$", "")
        trimmed = F.when(F.abs(number) >= 1e15, large.cast("string")).when(number == 0, "0").otherwise(digits)
        odd = token.rlike(r"^-?[0-9]+\.0$|[eE]")
        return F.when(odd & ((F.abs(number) >= 1e-3) | (number == 0)), F.coalesce(trimmed, token)).otherwise(token)

    def outside(part: Column) -> Column:
        tokens = F.split(part, r"(?<=[,:\[\]{}])|(?=[,:\[\]{}])", -1)
        return F.when(part.rlike(r"\.0(?![0-9])|[0-9][eE]"), F.array_join(F.transform(tokens, plain), "")).otherwise(part)

    parts = F.transform(F.split(marked, '"', -1), lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def levels(calls: DataFrame, key: str = "call_id", uses: str = "uses") -> DataFrame:
    """(key, level): how many calls must come before, along the names in ``uses``. A name that no
    call has ends the chain; level is null for calls that use one another in a circle.

    Each round doubles the steps that are known, so a chain of n calls takes log2(n) rounds."""
    ids = calls.select(F.col(key).alias("at")).distinct()
    steps = calls.select(F.col(key).alias("at"), F.col(uses).alias("to")).join(ids.withColumnRenamed("at", "to"), "to", "left_semi")
    now = written(ids.join(steps.groupBy("at").agg(F.min("to").alias("to")), "at", "left").select("at", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    rounds = max(1, int(now.count()).bit_length() + 1)
    for _ in range(rounds):
        if now.where("to is not null").isEmpty():
            break
        done, open_ = now.where("to is null"), now.where("to is not null")
        ahead = now.select(F.col("at").alias("to"), F.col("to").alias("then"), F.col("level").alias("more"))
        moved = open_.join(ahead, "to").select("at", F.col("then").alias("to"), (F.col("level") + F.col("more")).alias("level"))
        after = written(done.unionByName(moved), "levels")
        discard(now)
        now = after
    return now.select(F.col("at").alias(key), F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict] = TOOLS) -> DataFrame:
    """One row for each call and for each result without a call.

    ``calls``: call_id, conv_id, turn, name, arguments (JSON text), uses (a call_id or null).
    ``results``: call_id, turn, content, and conv_id if known. Result: these, and status (linked, no_result, no_call),
    n_results, level, valid, errors and message (canonical JSON of the call with its result).

    Sorting a conversation by level, turn and call_id is a topological order; level is null in a
    circle and for results without a call. Of several calls of one id the first stays (by turn,
    then by name and arguments), of several results the first by turn and content; n_results
    tells. Rows without an id link with nothing, and each keeps its row.
    Arguments that are null or no JSON object are invalid; what is no JSON stands in the message as
    a string. A result without a call keeps its own conv_id, so that it can be put back into its
    conversation by result_turn. Texts of any length are whole in arguments and messages. Empty
    tables give no rows; further columns are left out, whatever their names."""
    fields = ("turn", "conv_id", "name", "arguments", "uses")
    first = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(*fields)).alias("c"), F.count("*").alias("n")).select("call_id", "c.*")
    lone = calls.where("call_id is null").select("call_id", *fields)
    if "conv_id" not in results.columns:
        results = results.withColumn("conv_id", F.lit(None).cast(calls.schema["conv_id"].dataType))
    answer = F.struct("turn", "content", "conv_id")
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min(answer).alias("r"), F.count("*").alias("n_results"))
    known = first.join(levels(first), "call_id").unionByName(lone.withColumn("level", F.lit(0).cast("long")))
    stray = results.where("call_id is null").select(F.lit(None).cast("string").alias("call_id"), answer.alias("r"), F.lit(1).cast("long").alias("n_results"))
    both = known.withColumn("is_call", F.lit(True)).join(answers, "call_id", "full_outer").unionByName(stray, allowMissingColumns=True)
    status = F.when(F.col("is_call").isNull(), "no_call").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    errors = F.when(status != "no_call", errors_of(F.col("arguments"), F.col("name"), tools))
    out = both.withColumns({"status": status, "errors": errors, "conv_id": F.coalesce("conv_id", "r.conv_id"), "result_turn": F.col("r.turn"), "content": F.col("r.content"), "n_results": F.coalesce("n_results", F.lit(0)).cast("long")})
    call = F.struct(F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.struct("content", F.col("result_turn").alias("turn")).alias("result"))
    message = F.when(status != "no_call", one_number_form(F.to_json(call, {"ignoreNullFields": "false"})))
    return out.select("conv_id", "turn", "call_id", "name", "uses", "level", "status", "n_results", "result_turn", "content", (F.size("errors") == 0).alias("valid"), "errors", message.alias("message"))


def calls_in(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from plain conversations, for tables that hold no tool calls of their
    own: each assistant turn is taken as a call, with its whole text in the arguments, and every
    other turn as a result, of the turn before it or, where that is no call, of none. The tool and
    its arguments follow from the turn's words, and some are wrong on purpose of the checks.

    Further rows of one conversation and turn have identifiers that end in #2, #3 and so on, by
    text; rows without a conv_id or a turn have none, so that nothing links them or merges them.
    Texts of any length are taken whole, a null one as an empty one; an empty table gives empty
    ones, and further columns are left out."""
    place = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat_ws(":", "conv_id", "turn"))
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), place.alias("place"), is_call.alias("is_call"))
    # rows without a place are numbered by text, to be in no one group
    same = Window.partitionBy("place", "is_call", F.when(F.col("place").isNull(), F.xxhash64("text"))).orderBy("text")
    turns = turns.withColumn("k", F.row_number().over(same))
    # concat is null where the conversation or the turn is
    name_of = lambda turn: F.concat(F.lit("call:"), F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    further = F.when(F.col("k") > 1, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise(F.lit(""))
    call = turns.where("is_call").withColumns({"words": F.size(F.split("text", " ")), "call_id": F.concat(name_of(F.col("turn")), further)})
    whole = F.col("text")
    n = F.col("words")
    lookup = F.to_json(F.struct(F.when(n % 7 != 0, whole).alias("query"), F.when(n % 7 == 0, whole).alias("text"), (n % 50).alias("limit")))
    count = F.to_json(F.struct(F.when(n % 11 == 0, F.lit("lines")).otherwise(F.lit("words")).alias("unit"), whole.alias("text")))
    score = F.to_json(F.struct((n % 13 - 1).alias("value"), (n % 2 == 0).alias("strict"), F.struct(n.alias("words"), F.lit(1).alias("at"), whole.alias("text")).alias("extra")))
    call = call.withColumns({"name": F.element_at(F.array(F.lit("lookup"), F.lit("count"), F.lit("score")), n % 3 + 1), "arguments": F.when(n % 17 == 0, whole).otherwise(F.element_at(F.array(lookup, count, score), n % 3 + 1)), "uses": name_of(F.col("turn") - 2)})
    result = turns.where("not is_call").select(F.concat(name_of(F.col("turn") - 1), further).alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    return call.select("call_id", "conv_id", "turn", "name", "arguments", "uses"), result
