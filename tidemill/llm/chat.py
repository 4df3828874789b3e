"""Chat formatting with tool-call linking, in DataFrame functions only.

An assistant turn may be JSON with ``tool_calls`` ([{id, name, arguments}]), a
tool turn JSON with ``tool_call_id``, a system turn JSON with ``tools`` ([{name,
required, properties}]). Calls and results are hash-joined by conversation and
call id; calls' arguments are checked against the conversation's schemas; turns
are put in topological order (a result after its call) and each message is
serialised as canonical JSON, arguments included: keys in alphabetical order at
every level, no spaces, numbers as a variant writes them.

A call is valid when its arguments are one JSON object, hold what the schema
requires and nothing it doesn't know, and each has the JSON type that its property
declares (a type's name, or a JSON schema with ``type``: one name or a list).
Properties' own inner schemas are not looked into; a type's name that JSON doesn't
know allows any value.

A turn is one message, which holds all its calls in their order; ``calls`` tells of each
its id, whether it is answered and whether it is valid. Calls are checked a row each and
gathered by turn, so a task holds a turn's calls and never a conversation.
``order_key`` sorts a conversation's messages: turns in their order, a result that stands
before its call right behind it. Calls whose arguments depend on other calls' results are
ordered by their turns alone.

Defined results. Arguments given as a string that holds JSON count as that JSON;
other text (objects that repeat a key as well) is a JSON string and not valid.
A text that is not such JSON is plain content; null is empty.
Null roles count as ``user``. Of calls that repeat an id in one conversation, the
first turn's (then the first in its list) is linked. A result whose call is
missing keeps its own place and is counted as unlinked. A null ``conv_id`` is one
conversation. Of tools of one name in a conversation the first declared counts.
Repeated rows stay repeated: their calls are checked once and the message is copied in
pieces of ``COPIES``, dealt over tasks. Turns may be negative; a null one sorts first. Texts of
any length are kept whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,content:string>"
RESULT = "struct<tool_call_id:string,content:string>"
TOOLS = "struct<tools:array<struct<name:string,required:array<string>,properties:map<string,string>>>>"

#: copies of one repeated turn that a task makes at a time
COPIES = 1024

#: JSON type -> names that schemas use for it
TYPES = {
    "string": "string str text",
    "integer": "integer int long bigint",
    "number": "number float double decimal numeric",
    "boolean": "boolean bool",
    "array": "array list",
    "object": "object dict map struct",
    "null": "null none",
}


def _quoted(c):
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def _parsed(c):
    """``{"x": <c>}`` as a variant, null unless ``c`` is one JSON value.

    The parser stops after a value, so text behind it shows only where two different
    brackets must close and a list holds one part.
    """
    boxed = F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}")))
    alone = F.size(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).try_cast("array<variant>")) == 1
    return F.when(alone, boxed)


def _canonical(boxed, c):
    """The value as canonical JSON; text that isn't JSON as a JSON string."""
    whole = F.to_json(boxed)
    return F.coalesce(F.substring(whole, F.lit(6), F.length(whole) - 6), _quoted(c))


def _declared(schema):
    """The JSON types that a property's schema names; null for one that JSON doesn't know."""
    names = F.create_map(*[F.lit(x) for kind, known in TYPES.items() for n in known.split() for x in (n, kind)])
    name = F.when(F.ltrim(schema).startswith("{"), F.get_json_object(schema, "$.type")).otherwise(schema)
    return F.transform(F.when(name.startswith("["), F.from_json(name, "array<string>")).otherwise(F.array(name)), lambda n: F.try_element_at(names, F.lower(n)))


def _fits(value, types):
    """Whether a variant is of one of ``types``."""
    kind = F.schema_of_variant(value)
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$") | ((kind == "DOUBLE") & (value.try_cast("double") % 1 == 0))
    named = F.when(kind == "VOID", "null").when(kind.isin("BOOLEAN", "STRING"), F.lower(kind)).when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    return types.isNull() | F.exists(types, lambda t: t.isNull() | (t == named) | ((t == "integer") & whole))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, order_key, call_id, linked, valid, calls (call_id, linked, valid), message.

    A result has the ``call_id`` it answers; it is ``linked`` if its call is there and
    ``valid`` if that call is. A message with calls is either if all its calls are.
    """
    text = F.coalesce("text", F.lit(""))
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
    asks = lambda said: F.coalesce(F.size(said["tool_calls"]) > 0, F.lit(False))
    looks = F.ltrim(F.col("text")).startswith("{")
    t = t.withColumns(
        {
            "said": F.when((F.col("role") == "assistant") & looks, F.from_json("text", CALLS)),
            "got": F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT)),
            "kit": F.when((F.col("role") == "system") & looks, F.from_json("text", TOOLS)),
        }
    )
    # Rows alike are one turn here; its content stands beside its first call, so that no text is copied to each call.
    turns = t.where(asks(F.col("said"))).groupBy("conv_id", "turn", "text").agg(F.count("*").alias("copies"))
    turns = turns.withColumns({"said": F.from_json("text", CALLS), "key": F.sha2("text", 256)})
    calls = turns.select("conv_id", "turn", "key", "copies", "said.content", F.posexplode("said.tool_calls").alias("at", "call"))
    calls = calls.select("conv_id", "turn", "key", "copies", "at", F.when(F.col("at") == 0, F.col("content")).alias("content"), F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    # Of a tool declared more than once in a conversation, the first declaration counts.
    kits = t.where("size(kit.tools) > 0").select("conv_id", "turn", F.posexplode("kit.tools").alias("at", "tool"))
    known = F.transform_values("tool.properties", lambda _, v: _declared(v))
    when = F.struct("turn", "at", F.to_json("tool"))
    schemas = kits.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min_by(F.struct(F.col("tool.required").alias("required"), known.alias("known")), when).alias("s"))
    schemas = schemas.select("conv_id", "name", "s.required", "s.known")
    checked = calls.join(schemas.withColumnRenamed("conv_id", "c2").withColumnRenamed("name", "n2"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("name") == F.col("n2")), "left")
    checked = checked.withColumn("boxed", _parsed(F.col("arguments")))
    given = F.try_variant_get("boxed", "$.x", "map<string,variant>")
    keys = F.map_keys(given)
    valid = F.when(F.col("n2").isNull(), F.lit(False)).otherwise(
        keys.isNotNull()
        & (F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), keys)) == 0)
        & (F.col("known").isNull() | (F.size(F.array_except(keys, F.map_keys("known"))) == 0))
        & (F.col("known").isNull() | F.forall(F.map_entries(given), lambda e: _fits(e["value"], F.try_element_at("known", e["key"]))))
    )
    checked = checked.withColumn("valid", F.coalesce(valid, F.lit(False)))
    first = checked.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at")).alias("p"), F.min_by("valid", F.struct("turn", "at")).alias("call_valid"))
    first = first.select(F.col("conv_id").alias("c1"), F.col("call_id").alias("i1"), F.col("p.turn").alias("call_turn"), F.col("p.at").alias("call_at"), "call_valid")
    results = t.where("role = 'tool'").withColumn("call_id", F.col("got.tool_call_id"))
    linked = results.join(first, F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("call_id") == F.col("i1")), "left")
    # Shifted into the positive numbers, so that text sorts as the numbers do; a null turn comes first.
    pad = lambda c: F.lpad(F.coalesce((F.col(c).cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), F.lit("")), 20, "0")
    nothing = F.lit(None)
    # A result follows its call: it sorts by the call's turn and place, then by its own.
    tools = linked.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("i1").isNull() | (F.col("call_turn") < F.col("turn")), F.concat(pad("turn"), F.lit("/0/"))).otherwise(F.concat(pad("call_turn"), F.lit("/1/"), pad("call_at"), pad("turn"))).alias("order_key"),
        "call_id",
        F.col("i1").isNotNull().alias("linked"),
        F.col("call_valid").alias("valid"),
        F.concat(F.lit('{"content":'), _quoted(F.coalesce("got.content", "text")), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("call_id")), F.lit("}")).alias("message"),
    )
    one = F.concat(F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), "null").otherwise(_canonical(F.col("boxed"), F.col("arguments"))), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit("}"))
    answered = results.where("call_id is not null").select(F.col("conv_id").alias("c3"), F.col("call_id").alias("i3")).distinct()
    met = first.join(answered, F.col("c1").eqNullSafe(F.col("c3")) & (F.col("i1") == F.col("i3")), "left_semi").drop("call_valid")
    # Only the first call of an id is linked.
    same = F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("call_id") == F.col("i1")) & F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("at") == F.col("call_at"))
    asked = checked.join(met, same, "left")
    call = F.struct("at", "call_id", F.col("i1").isNotNull().alias("linked"), "valid", one.alias("json"))
    asked = asked.groupBy("conv_id", "turn", "key").agg(F.max("copies").alias("copies"), F.max("content").alias("content"), F.array_sort(F.collect_list(call)).alias("asked"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("piece")).repartition("conv_id", "turn", "key", "piece")
    here = F.least(F.col("copies") - F.col("piece") * COPIES, F.lit(COPIES))
    asked = asked.withColumn("copy", F.explode(F.sequence(F.lit(1), here)))
    asked = asked.select(
        "conv_id",
        "turn",
        F.lit("assistant").alias("role"),
        F.concat(pad("turn"), F.lit("/0/")).alias("order_key"),
        nothing.cast("string").alias("call_id"),
        F.forall("asked", lambda c: c["linked"]).alias("linked"),
        F.forall("asked", lambda c: c["valid"]).alias("valid"),
        F.transform("asked", lambda c: F.struct(c["call_id"].alias("call_id"), c["linked"].alias("linked"), c["valid"].alias("valid"))).alias("calls"),
        F.concat(F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":"assistant","tool_calls":['), F.array_join(F.transform("asked", lambda c: c["json"]), ","), F.lit("]}")).alias("message"),
    )
    plain = t.where((F.col("role") != "tool") & ~asks(F.col("said"))).select(
        "conv_id",
        "turn",
        "role",
        F.concat(pad("turn"), F.lit("/0/")).alias("order_key"),
        nothing.cast("string").alias("call_id"),
        nothing.cast("boolean").alias("linked"),
        nothing.cast("boolean").alias("valid"),
        F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")).alias("message"),
    )
    columns = ["conv_id", "turn", "role", "order_key", "call_id", "linked", "valid", "calls", "message"]
    return asked.unionByName(plain.unionByName(tools), allowMissingColumns=True).select(columns)
