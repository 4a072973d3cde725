"""Chat formatting: link tool calls with their results, order them, validate their arguments, write canonical JSON.

DataFrame functions only. A conversation is rows (conversation, turn, role, text) in three forms:

* an assistant's text that is a JSON object with ``tool_calls``: an array of {id, name, arguments, depends_on};
* a tool's text that is a JSON object {tool_call_id, content}: the result of that call;
* plain exchanges: a user's message is a call of ``respond`` with the text as its ``prompt`` and id ``turn-N``, and an
  assistant's message at turn N + 1 is its result.

Messages are parsed once and written to the shared folder as items (a call, a result or a context message each); texts
stay there, under an item number, until calls and results are linked. Calls and results meet in one hash join on
(conversation, form, call id, number), of which neither side has more than one row a key: equal repeats within a turn are
brought down map-side and counted, and what is left of an id is numbered by (turn, place, tool, content: its first 64
characters, then its digest). Form tells ids that were given from those that plain exchanges get here, so an id
``turn-1`` in a JSON message is another one. Nothing gathers a conversation, so one may hold a third of all rows.

With ``each``, every numbered call and result stays one row; a reused id's k-th result belongs to its k-th call. Without
it, only the first call and the first result of an id stay, with the number of all. A reused id in ``depends_on`` means
its first call.

Order: a call with ``depends_on`` must come after those calls. Where every such call stands earlier, the order by
(turn, place) is topological already and layer is 0 for all calls of the conversation. Only in conversations where one
does not, layer is the length of the longest path of dependencies below a call. Sorted by (layer, turn, place), each
conversation is in topological order; calls on a cycle, or after one, have no layer. Layers take one round for each
doubling of a chain's length, as a call with one open dependency is skipped over; calls with several open ones wait.

Arguments are checked against a schema a tool: {"properties": {name: type}, "required": [...], "additional": bool},
with JSON types (string, integer, number, boolean, array, object; a boolean is not a number). Canonical JSON has
sorted keys at every depth and no spaces. A record has no member for a missing id, name or result; nulls inside arguments
stay as they are.

Defined results: a call or result without id (or with a null conversation) links with nothing and stays, one row each;
a result without call and a call without result stay; other messages are context, one row each; JSON may follow white
space; text that is no such JSON is plain, also an object with an empty ``tool_calls``; null or broken arguments count as
missing all properties; a null turn comes last; an empty table gives no rows. Columns of the input with names of the
output do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import cut, store

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: The one tool of plain exchanges.
SCHEMAS = {"respond": {"properties": {"prompt": "string"}, "required": ["prompt"], "additional": False}}
#: More steps than any path has.
ON_CYCLE = 1 << 40
_KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$|^DECIMAL\\(\\d+,0\\)$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY.*$",
    "object": "^OBJECT.*$",
}


def items_of(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per call, result and context message: conv_id, turn, place, role, side, plain, call_id, tool, body, depends_on.

    body is a call's arguments, a result's content or a context's text.
    """
    text = F.col(text_col).cast("string")
    role = F.lower(F.col(role_col).cast("string"))
    json = F.when(text.rlike(r"^[ \t\r\n]*\{"), text)
    m = chats.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.from_json(F.when(role == "assistant", json), CALLS)["tool_calls"].alias("calls"),
        F.from_json(F.when(role == "tool", json), RESULT).alias("answer"),
    )
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")

    def item(side: str, plain: bool, place: Column, call_id: Column, tool: Column, body: Column, needs: Column = nothing) -> Column:
        return F.struct(F.lit(side).alias("side"), F.lit(plain).alias("plain"), place.cast("int").alias("place"), call_id.alias("call_id"), tool.alias("tool"), body.alias("body"), needs.alias("depends_on"))

    named = lambda turn: F.concat(F.lit("turn-"), turn)
    zero = F.lit(0)
    prompt = F.to_json(F.struct(F.col("text").alias("prompt")))
    items = (
        F.when(F.size("calls") > 0, F.transform("calls", lambda c, i: item("call", False, i, c["id"], c["name"], c["arguments"], F.coalesce(c["depends_on"], nothing))))
        .when(F.col("role") == "tool", F.array(item("result", False, zero, F.col("answer.tool_call_id"), none, F.coalesce("answer.content", "text"))))
        .when(F.col("role") == "user", F.array(item("call", True, zero, named(F.col("turn")), F.lit("respond"), prompt)))
        .when(F.col("role") == "assistant", F.array(item("result", True, zero, named(F.col("turn") - 1), none, F.col("text"))))
        .otherwise(F.array(item("context", True, zero, none, none, F.col("text"))))
    )
    return m.select("conv_id", "turn", "role", F.explode(items).alias("x")).select("conv_id", "turn", "role", "x.*")


KEY = ["conv_id", "plain", "call_id"]


def _numbered(rows: DataFrame, count: str) -> DataFrame:
    """Distinct rows of each key with their numbers, how many rows each stands for, and the item that holds its text."""
    one = rows.groupBy(*KEY, "turn", "tool", "depends_on", "head", "digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias(count), F.min("item").alias("item"))
    order = [F.col(c).asc_nulls_last() for c in ("turn", "place", "tool", "head", "digest", "depends_on")]
    return one.withColumn("number", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).drop("head", "digest")


def _first(numbered: DataFrame, count: str) -> DataFrame:
    """The first row of each key, with the number of all."""
    total = numbered.groupBy(*KEY).agg(F.sum(count).alias(count), F.min_by("item", "number").alias("item"))
    return numbered.where("number = 1").drop(count, "item").join(total, KEY)


def schema_errors(tool: Column, arguments: Column, schemas: dict) -> Column:
    """Sorted array of errors: unknown_tool, missing:x, type:x, unknown:x."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, schema in sorted(schemas.items()):
        found = []
        for prop, kind in sorted(schema["properties"].items()):
            # A JSON null is a value of no type.
            of_kind = F.coalesce(F.schema_of_variant(F.try_variant_get(value, f'$["{prop}"]', "variant")).rlike(_KINDS[kind]), F.lit(False))
            has = F.array_contains(keys, prop)
            if prop in schema.get("required", []):
                found.append(F.when(~has, F.lit(f"missing:{prop}")))
            found.append(F.when(has & ~of_kind, F.lit(f"type:{prop}")))
        errors = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        if not schema.get("additional", True):
            known = F.array(*[F.lit(p) for p in sorted(schema["properties"])]).cast("array<string>")
            errors = F.concat(errors, F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k)))
        out = out.when(tool == name, F.sort_array(errors))
    return out.otherwise(F.array(F.lit("unknown_tool")))


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no spaces; what is not JSON becomes a JSON string."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))


def layers(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, number, layer) of the calls of conversations that are not in topological order as they stand.

    calls: conv_id, call_id, number, turn, place, depends_on. layer is null on a cycle or after one. An id in depends_on
    that no call has is no constraint; one that several have means the first.

    The state has, for each call, a row with the longest path known so far (``needs`` null) and one for each open
    dependency with the steps to it. In a round, a dependency whose layer is known becomes a path, and one on a call with
    a single open dependency is moved on to that, so steps double along chains. More steps than a conversation has
    calls mean a cycle.
    """
    slim = calls.select("conv_id", "call_id", "number", "turn", "place", "depends_on")
    wants = slim.select("conv_id", "call_id", "number", "turn", "place", F.explode("depends_on").alias("needs"))
    target = slim.where("number = 1").select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("t"), F.col("place").alias("p"))
    edges = cut(wants.join(target, ["conv_id", "needs"]))
    early = (F.col("t") < F.col("turn")) | ((F.col("t") == F.col("turn")) & (F.col("p") < F.col("place")))
    wrong = cut(edges.where(~F.coalesce(early, F.lit(False))).select("conv_id").distinct())
    name = lambda call, number: F.struct(F.col(call).alias("id"), number.cast("int").alias("number"))
    todo = edges.join(wrong, "conv_id", "left_semi").select("conv_id", name("call_id", F.col("number")).alias("call"), name("needs", F.lit(1)).alias("needs"), F.lit(1).cast("long").alias("steps"))
    every = slim.join(wrong, "conv_id", "left_semi").select("conv_id", name("call_id", F.col("number")).alias("call"))
    most = every.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    state = cut(todo.distinct().unionByName(every.withColumn("needs", F.lit(None).cast(todo.schema["needs"].dataType)).withColumn("steps", F.lit(0).cast("long"))))
    before = None
    while True:
        open_ = state.where("needs IS NOT NULL").agg(F.count(F.lit(1)), F.sum(F.xxhash64("conv_id", "call", "needs", "steps").cast("decimal(38,0)"))).first()
        if not open_[0] or tuple(open_) == before:
            break
        before = tuple(open_)
        known = state.groupBy("conv_id", F.col("call").alias("needs")).agg(
            F.count("needs").alias("open"), F.max(F.when(F.col("needs").isNull(), F.col("steps"))).alias("path"), F.max("needs").alias("next"), F.max(F.when(F.col("needs").isNotNull(), F.col("steps"))).alias("way")
        )
        moved = state.where("needs IS NOT NULL").join(known.where("open < 2"), ["conv_id", "needs"], "left")
        on = F.when(F.col("open").isNull(), F.array(F.struct("needs", "steps"))).otherwise(
            F.concat(
                F.array(F.struct(F.lit(None).cast(todo.schema["needs"].dataType).alias("needs"), (F.col("path") + F.col("steps")).alias("steps"))),
                F.when(F.col("open") == 1, F.array(F.struct(F.col("next").alias("needs"), (F.col("way") + F.col("steps")).alias("steps")))).otherwise(F.array().cast("array<struct<needs:struct<id:string,number:int>,steps:bigint>>")),
            )
        )
        rows = moved.select("conv_id", "call", F.explode(on).alias("x")).select("conv_id", "call", "x.needs", "x.steps").unionByName(state.where("needs IS NULL"))
        round_ = F.when(F.col("steps") > most, F.lit(ON_CYCLE)).otherwise(F.col("steps"))
        rows = rows.select("conv_id", "call", F.when(F.col("steps") <= most, F.col("needs")).alias("needs"), round_.alias("steps"))
        state = cut(rows.groupBy("conv_id", "call", "needs").agg(F.max("steps").alias("steps")))
    done = state.groupBy("conv_id", "call").agg(F.count("needs").alias("open"), F.max("steps").alias("steps"))
    layer = F.when((F.col("open") == 0) & (F.col("steps") <= most), F.col("steps").cast("int"))
    return done.select("conv_id", F.col("call.id").alias("call_id"), F.col("call.number").alias("number"), layer.alias("layer"))


def link(
    chats: DataFrame,
    schemas: dict | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    each: bool = False,
) -> DataFrame:
    """One row per call (with ``each``, also of those that reuse an id), unlinked result and context message: conv_id, turn, place, layer, status, call_id, tool,
    n_calls, n_results, valid, errors, record (canonical JSON)."""
    schemas = SCHEMAS if schemas is None else schemas
    items = items_of(chats, conv_col, turn_col, role_col, text_col)
    body = F.col("body")
    items = store(items.select("*", F.monotonically_increasing_id().alias("item"), F.substring(body, 1, 64).alias("head"), F.sha2(body, 256).alias("digest")))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls, results = (_numbered(items.where((F.col("side") == side) & named), count) for side, count in (("call", "n_calls"), ("result", "n_results")))
    calls = cut(calls)
    if not each:
        calls, results = _first(calls, "n_calls"), _first(results, "n_results")
    order = layers(calls.where("NOT plain")).withColumn("plain", F.lit(False)).withColumn("out_of_order", F.lit(True))
    calls = calls.join(order, [*KEY, "number"], "left").withColumnRenamed("item", "call_item")
    results = results.select(*KEY, "number", F.col("turn").alias("result_turn"), "n_results", F.col("item").alias("result_item"))
    linked = calls.drop("depends_on").join(results, [*KEY, "number"], "full_outer").drop("number")
    alone = items.where((F.col("side") != "context") & ~named).select(
        *KEY, "tool", F.when(F.col("side") == "call", F.struct("turn", "place", "item")).alias("c"), F.when(F.col("side") == "result", F.struct("turn", "item")).alias("r")
    )
    one = F.lit(1).cast("long")
    alone = alone.select(*KEY, "tool", "c.turn", "c.place", F.col("c.item").alias("call_item"), F.when(F.col("c").isNotNull(), one).alias("n_calls"), F.col("r.turn").alias("result_turn"), F.col("r.item").alias("result_item"), F.when(F.col("r").isNotNull(), one).alias("n_results"))
    rows = linked.unionByName(alone, allowMissingColumns=True)
    # Texts come back by item number: each is sent once.
    texts = lambda side, item, out: items.where(F.col("side") == side).select(F.col("item").alias(item), F.col("body").alias(out))
    rows = rows.join(texts("call", "call_item", "arguments"), "call_item", "left").join(texts("result", "result_item", "content"), "result_item", "left")
    is_call = F.col("n_calls").isNotNull()
    errors = F.when(is_call, schema_errors(F.col("tool"), F.col("arguments"), schemas))
    status = (
        F.when(is_call & F.col("n_results").isNotNull(), "linked")
        .when(is_call & ~named, "call_without_id")
        .when(is_call, "call_without_result")
        .when(~named, "result_without_id")
        .otherwise("result_without_call")
    )
    rows = rows.select(
        "conv_id",
        F.coalesce("turn", "result_turn").alias("turn"),
        F.coalesce("place", F.lit(0)).alias("place"),
        F.when(F.col("out_of_order"), F.col("layer")).otherwise(F.lit(0)).alias("layer"),
        status.alias("status"),
        "call_id",
        "tool",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        (F.size(errors) == 0).alias("valid"),
        errors.alias("errors"),
        _record(is_call),
    )
    context = items.where("side = 'context'").select(
        "conv_id",
        "turn",
        F.lit(0).alias("place"),
        F.lit(0).alias("layer"),
        F.lit("context").alias("status"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(0).cast("long").alias("n_calls"),
        F.lit(0).cast("long").alias("n_results"),
        F.lit(None).cast("boolean").alias("valid"),
        F.lit(None).cast("array<string>").alias("errors"),
        F.to_json(F.struct(body.alias("content"), "role")).alias("record"),
    )
    return rows.unionByName(context)


def _member(name: str, value: Column) -> Column:
    """"name":value for an object, or null where the value is."""
    return F.concat(F.lit(f'"{name}":'), value)


def _record(is_call: Column) -> Column:
    """{"arguments":...,"id":...,"name":...,"result":...}: keys in order, values canonical, null values left out."""
    plain = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    parts = [
        F.when(is_call, _member("arguments", F.coalesce(canonical(F.col("arguments")), F.lit("{}")))),
        F.when(F.col("call_id").isNotNull(), _member("id", plain("call_id"))),
        F.when(is_call & F.col("tool").isNotNull(), _member("name", plain("tool"))),
        F.when(F.col("content").isNotNull(), _member("result", plain("content"))),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("record")
