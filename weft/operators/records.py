"""Training-record preparation: shape detection (P1), text rendering
(P2-P5), alias mapping (P6), CSV-row to instruction record (P7), blank-line
and unmapped-row filters (F1, F2), counters (A1), messages collection (A6) and
the written-row limit (L1).

Record shapes (fixed values, in detection order):
  chat               {"messages": [{"role", "content"}, ...]}
  alpaca             {"instruction", "input"?, "output"}
  prompt_completion  {"prompt", "completion"}
  text               {"text"}
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.chat import CHATML, ChatTemplate, render_chat
from weft.functions.text import col_, is_blank, py_strip, truthy_str
from weft.operators.ordering import nth_key

# Fixed values.
FORMATS = ("chat", "alpaca", "prompt_completion", "text")
REQUIRED_KEYS = {
    "chat": ("messages",),
    "alpaca": ("instruction", "output"),
    "prompt_completion": ("prompt", "completion"),
    "text": ("text",),
}
KNOWN_TEXT_FIELDS = ("text", "content", "body", "completion", "response", "answer")
DEFAULT_INSTRUCTION = "Analyze this record and produce the appropriate label."
# Instruction-record layout: headers in order, blocks joined by a blank line.
INSTRUCTION_HEADER = "### Instruction:\n"
INPUT_HEADER = "### Input:\n"
RESPONSE_HEADER = "### Response:\n"
BLOCK_SEP = "\n\n"

MESSAGE = T.StructType([T.StructField("role", T.StringType()),
                        T.StructField("content", T.StringType())])
#: The whole source record as VARIANT, carried to the canonical line and the quarantine.
SOURCE = "source_record"


# ---------------------------------------------------------------- F1

def drop_blank(df: DataFrame, line_col: str = "value") -> DataFrame:
    """drop lines that are empty after Python's ``strip()``."""
    return df.where(~is_blank(line_col))


# ---------------------------------------------------------------- P1

def json_keys(line) -> Column:
    """Top-level keys of a JSON object line (null for arrays / broken JSON)."""
    return F.json_object_keys(py_strip(line))


def detect_format(keys) -> Column:
    """Ordered key-presence test; null when no shape fits.

    Key presence, not value: ``{"text": null}`` is a text record.
    """
    k = col_(keys)
    has = lambda name: F.coalesce(F.array_contains(k, F.lit(name)), F.lit(False))
    return (F.when(has("messages"), "chat")
            .when(has("instruction") & has("output"), "alpaca")
            .when(has("prompt") & has("completion"), "prompt_completion")
            .when(has("text"), "text"))


def sealed_json(line) -> Column:
    """The line inside ``[[line], seal]`` as VARIANT (null if that is not JSON).

    Spark's JSON parsers stop behind the first value, so text after it would go
    unnoticed.  Here a line that closes the inner list itself must also hold the
    seal, a hash of the whole line; single quotes, comments and control
    characters in strings are errors anyway."""
    s = py_strip(line)
    return F.try_parse_json(F.concat(F.lit("[["), s, F.lit("],"), F.xxhash64(s).cast("string"), F.lit("]")))


def open_sealed(line, sealed) -> Column:
    """SRC1's strict parse: the record as VARIANT, null unless the line is exactly
    one JSON object (duplicate keys, NaN and records over Spark's VARIANT size
    limit count as malformed)."""
    v = col_(sealed)
    whole = F.try_variant_get(v, "$[1]", "bigint") == F.xxhash64(py_strip(line))
    single = F.try_variant_get(v, "$[0][1]", "variant").isNull()
    rec = F.try_variant_get(v, "$[0][0]", "variant")
    is_object = F.schema_of_variant(rec).startswith("OBJECT")
    return F.when(whole & single & is_object, rec)


def has_key(record, name: str) -> Column:
    """Key presence, whatever the value (a JSON null is a VARIANT null, not SQL NULL)."""
    return F.try_variant_get(col_(record), f"$.{name}", "variant").isNotNull()


def record_format(record) -> Column:
    """P1 on a VARIANT record: the ordered key-presence test."""
    out = F.lit(None).cast("string")
    for fmt in reversed(FORMATS):
        out = F.when(record_fits(record, fmt), F.lit(fmt)).otherwise(out)
    return out


def record_fits(record, fmt: str) -> Column:
    ok = F.lit(True)
    for name in REQUIRED_KEYS[fmt]:
        ok = ok & has_key(record, name)
    return ok


def record_field(record, name: str) -> Column:
    """The string form of a field: strings as they are, true / false as ``True`` /
    ``False``, numbers in shortest form, lists and objects as JSON, null as null."""
    v = F.try_variant_get(col_(record), f"$.{name}", "variant")
    s = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(s)).otherwise(s)


def record_messages(record) -> Column:
    """Role and content of a chat record's turns (null if ``messages`` is no list)."""
    turns = F.try_variant_get(col_(record), "$.messages", "array<variant>")
    return F.transform(turns, lambda m: F.struct(
        F.try_variant_get(m, "$.role", "string").alias("role"),
        F.try_variant_get(m, "$.content", "string").alias("content")))


def record_json(fmt, record) -> Column:
    """The canonical JSONL line of a VARIANT record: its shape's keys with their whole
    values (all keys of messages, numbers as numbers); a missing ``input`` is ``""``.
    VARIANT orders the keys of an object by name."""
    f, r = col_(fmt), col_(record)

    def line(*names: str) -> Column:
        parts: list[Column] = []
        for i, n in enumerate(names):
            value = F.to_json(F.try_variant_get(r, f"$.{n}", "variant"))
            parts += [F.lit(("{" if i == 0 else ",") + f'"{n}":'), F.coalesce(value, F.lit('""'))]
        return F.concat(*parts, F.lit("}"))

    return (F.when(f == "chat", line("messages"))
            .when(f == "alpaca", line("instruction", "input", "output"))
            .when(f == "prompt_completion", line("prompt", "completion"))
            .when(f == "text", line("text")))


# ---------------------------------------------------------------- P2-P5

def alpaca_to_text(instruction, inp, output) -> Column:
    """The Input block is dropped when input is missing, null or ''."""
    i, x, o = col_(instruction), col_(inp), col_(output)
    head, sep = F.lit(INSTRUCTION_HEADER), F.lit(BLOCK_SEP)
    with_input = F.concat(head, i, sep, F.lit(INPUT_HEADER), x, sep, F.lit(RESPONSE_HEADER), o)
    without = F.concat(head, i, sep, F.lit(RESPONSE_HEADER), o)
    return F.when(truthy_str(x), with_input).otherwise(without)


def prompt_completion_to_text(prompt, completion) -> Column:
    """Plain concatenation, no separator."""
    return F.concat(col_(prompt), col_(completion))


def normalize_lines(lines: DataFrame, line_col: str = "value", policy: str = "per_row",
                    order: list | None = None, template: ChatTemplate = CHATML) -> DataFrame:
    """SRC1 -> P1 -> P2..P5 over JSONL lines.

    Adds ``shape`` (the detected key shape), ``format`` (the shape when a
    text could be rendered, else null), ``text``, the shape's fields and
    ``source_record``, the whole record as VARIANT.  The parse is strict: a line
    that is not exactly one JSON object has no record.  ``policy="per_row"``: each
    line is judged alone; lines that fit no shape get ``format`` null (quarantine, F2).
    ``policy="first_record"``: the first line in ``order`` decides the shape of
    every line and a line lacking its keys fails the job, as the trainer does.
    """
    df = drop_blank(lines, line_col).withColumn("_sealed", sealed_json(line_col))
    df = df.withColumn(SOURCE, open_sealed(line_col, "_sealed")).drop("_sealed")
    if policy == "per_row":
        df = df.withColumn("format", record_format(SOURCE))
    elif policy == "first_record":
        if not order:
            raise ValueError("policy='first_record' needs an explicit order")
        first = (df.select(F.min_by(record_format(SOURCE), F.struct(*order)).alias("f"),
                           F.count(F.lit(1)).alias("n")).first())
        if first is None or first["n"] == 0:
            raise ValueError("no records")
        if first["f"] is None:
            raise ValueError("unrecognized record shape in the first record")
        fmt0 = first["f"]
        fits = F.coalesce(record_fits(SOURCE, fmt0), F.lit(False))
        df = df.withColumn("format", F.when(fits, F.lit(fmt0)).otherwise(
            F.raise_error(F.concat(F.lit(f"record lacks the keys of format {fmt0}: "),
                                   F.coalesce(F.array_join(json_keys(line_col), ","), F.lit("")))).cast("string")))
    else:
        raise ValueError(f"unknown policy {policy}")
    f = F.col("format")
    fields = {"messages": F.when(f == "chat", record_messages(SOURCE)),
              **{n: record_field(SOURCE, n) for n in ("instruction", "input", "output", "prompt", "completion")}}
    df = df.withColumns({**fields, "_text": F.when(f == "text", record_field(SOURCE, "text"))})
    text = (F.when(f == "chat", render_chat(F.col("messages"), template))
            .when(f == "alpaca", alpaca_to_text("instruction", "input", "output"))
            .when(f == "prompt_completion", prompt_completion_to_text("prompt", "completion"))
            .when(f == "text", F.col("_text")))
    df = df.withColumn("text", text).drop("_text")
    # A record whose shape fits but whose required field is null (or whose
    # messages do not parse) renders no text: it goes to the quarantine
    # (format null) with its detected shape kept in ``shape``.
    return (df.withColumnRenamed("format", "shape")
            .withColumn("format", F.when(F.col("text").isNotNull(), F.col("shape"))))


# ---------------------------------------------------------------- P6

def _truthy(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return truthy_str(c)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def _py_str(c: Column, dtype: T.DataType) -> Column:
    """``str()`` of a value: booleans are ``True`` and ``False``."""
    return F.initcap(c.cast("string")) if isinstance(dtype, T.BooleanType) else c.cast("string")


def _in_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) and _in_variant(dtype.valueType)
    if isinstance(dtype, T.ArrayType):
        return _in_variant(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_in_variant(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType))


def _for_variant(c: Column, dtype: T.DataType) -> Column:
    """Types that VARIANT cannot hold (intervals, maps with other keys) go as strings."""
    return c if _in_variant(dtype) else c.cast("string")


def _messages(element: T.DataType) -> Column:
    """The list with role and content first, by field name; further fields
    (name, tool calls, ...) are kept as they are."""
    if not isinstance(element, T.StructType):
        return F.col("messages").cast(T.ArrayType(MESSAGE))
    names = element.fieldNames()
    known = [f.name for f in MESSAGE.fields]
    more = [n for n in names if n not in known]
    return F.transform("messages", lambda m: F.struct(
        *[(m[n] if n in names else F.lit(None)).cast("string").alias(n) for n in known],
        *[m[n].alias(n) for n in more]))


def to_record(df: DataFrame, text_field: str | None = None) -> DataFrame:
    """Map a typed table's columns onto one record shape per row.

    Key presence in a typed table is a property of the schema, so branches
    (b) and (c) resolve at plan time; list-ness and truthiness are per row.
    Adds ``format`` (null = unmapped), the canonical fields ``messages,
    instruction, input, output, prompt, completion, text`` and ``source_record``, the
    row as it came (VARIANT; built only where it is used, i.e. for the quarantine).
    """
    types = {f.name: f.dataType for f in df.schema.fields if f.name != SOURCE}
    cols = set(types)
    s = lambda c: _py_str(F.col(c), types[c])
    fmt = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    # (e) then (d): built from the lowest precedence up.
    for cand in reversed(KNOWN_TEXT_FIELDS):
        if cand in cols:
            hit = _truthy(F.col(cand), types[cand])
            fmt = F.when(hit, F.lit("text")).otherwise(fmt)
            text = F.when(hit, s(cand)).otherwise(text)
    if text_field and text_field in cols:
        hit = _truthy(F.col(text_field), types[text_field])
        fmt = F.when(hit, F.lit("text")).otherwise(fmt)
        text = F.when(hit, s(text_field)).otherwise(text)
    instruction = inp = output = prompt = completion = F.lit(None).cast("string")
    if "prompt" in cols and ("completion" in cols or "response" in cols):
        fmt = F.lit("prompt_completion")
        prompt = s("prompt")
        resp = s("response") if "response" in cols else F.lit("")
        completion = (F.when(_truthy(F.col("completion"), types["completion"]), s("completion"))
                      .otherwise(resp)) if "completion" in cols else resp
    if "instruction" in cols and ("output" in cols or "response" in cols):
        fmt = F.lit("alpaca")
        instruction = s("instruction")
        inp = s("input") if "input" in cols else F.lit("")
        resp = s("response") if "response" in cols else F.lit("")
        output = (F.when(_truthy(F.col("output"), types["output"]), s("output"))
                  .otherwise(resp)) if "output" in cols else resp
    messages = F.lit(None).cast(T.ArrayType(MESSAGE))
    if "messages" in cols and isinstance(types["messages"], T.ArrayType):
        is_list = F.col("messages").isNotNull()
        fmt = F.when(is_list, F.lit("chat")).otherwise(fmt)
        messages = F.when(is_list, _messages(types["messages"].elementType))
    # One projection: every canonical field is computed from the *input*
    # columns (sequential withColumn calls would let an overwritten field,
    # e.g. ``completion``, feed a later one, e.g. ``text``).
    f = F.col("_fmt")
    canon = {
        "messages": F.when(f == "chat", messages),
        "instruction": F.when(f == "alpaca", instruction),
        "input": F.when(f == "alpaca", inp),
        "output": F.when(f == "alpaca", output),
        "prompt": F.when(f == "prompt_completion", prompt),
        "completion": F.when(f == "prompt_completion", completion),
        "text": F.when(f == "text", text),
    }
    keep = [F.col(c) for c in df.columns if c not in canon and c not in ("format", SOURCE)]
    row = F.to_variant_object(F.struct(*[_for_variant(F.col(c), t).alias(c) for c, t in types.items()]))
    return (df.withColumn("_fmt", fmt)
            .select(*keep, f.alias("format"), *[e.alias(n) for n, e in canon.items()], row.alias(SOURCE)))


def canonical_json(fmt="format") -> Column:
    """The JSONL line of a mapped row of a typed table: only its shape's keys, nulls
    kept, non-ASCII kept."""
    f = col_(fmt)
    opts = {"ignoreNullFields": "false"}
    return (F.when(f == "chat", F.to_json(F.struct("messages"), opts))
            .when(f == "alpaca", F.to_json(F.struct("instruction", "input", "output"), opts))
            .when(f == "prompt_completion", F.to_json(F.struct("prompt", "completion"), opts))
            .when(f == "text", F.to_json(F.struct("text"), opts)))


# ---------------------------------------------------------------- P7

def row_to_alpaca(df: DataFrame, label_col: str, feature_cols: list[str] | None = None,
                  instruction: str = DEFAULT_INSTRUCTION, keep: list[str] | None = None) -> DataFrame:
    """``input = "c1=v1 | c2=v2"``, ``output`` = stripped label.

    Features default to all non-label columns in order; a requested feature
    that is not a column gives ``c=``.  A null value also gives ``c=`` (the
    CSV reader cannot tell a short row from an empty field).
    """
    if label_col not in df.columns:
        raise ValueError(f"label column {label_col!r} not in {df.columns}")
    cols = list(feature_cols or [c for c in df.columns if c != label_col])
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")))
             if c in df.columns else F.lit(f"{c}=") for c in cols]
    features = F.concat_ws(" | ", *parts) if parts else F.lit("")
    return df.select(
        *(keep or []),
        F.lit(instruction).alias("instruction"),
        features.alias("input"),
        py_strip(F.coalesce(F.col(label_col).cast("string"), F.lit(""))).alias("output"),
    )


# ---------------------------------------------------------------- F2 / A1 / L1

def split_mapped(df: DataFrame, fmt: str = "format") -> tuple[DataFrame, DataFrame]:
    """(mapped rows, quarantine rows)."""
    return df.where(F.col(fmt).isNotNull()), df.where(F.col(fmt).isNull())


def observe_counters(df: DataFrame, name: str = "prep_counters",
                     fmt: str = "format") -> tuple[DataFrame, Observation]:
    """A1 on the write path: counts ride along the action, no second pass."""
    obs = Observation(name)
    out = df.observe(obs,
                     F.count(F.lit(1)).alias("n_read"),
                     F.count_if(F.col(fmt).isNotNull()).alias("n_written"),
                     F.count_if(F.col(fmt).isNull()).alias("n_skipped"))
    return out, obs


def prep_counters(df: DataFrame, fmt: str = "format") -> DataFrame:
    """A1 as a query: read / written / skipped per call."""
    return df.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(F.col(fmt).isNotNull()).cast("long").alias("n_written"),
        F.count_if(F.col(fmt).isNull()).cast("long").alias("n_skipped"),
    )


def limit_written(df: DataFrame, n: int | None, order: list, fmt: str = "format") -> DataFrame:
    """L1: the first ``n`` *mapped* rows in ``order``; 0 / None = no limit.

    ``order`` is any list of sortable expressions, ascending; rows that tie on it are taken by
    a hash of the whole row, so only rows that agree in everything are interchangeable.
    One path for every ``n`` and key type: the n-th key is found by a distributed sort of the
    keys alone (:func:`ordering.nth_key`), and the wide rows are then only filtered by it.
    """
    mapped = df.where(F.col(fmt).isNotNull())
    if not n:
        return mapped
    row = F.xxhash64(*[_hashable(F.col(c), t.dataType) for c, t in zip(mapped.columns, mapped.schema, strict=True)])
    key = F.struct(*[c.alias(f"k{i}") if isinstance(c, Column) else F.col(c).alias(f"k{i}") for i, c in enumerate(order)],
                   row.alias("row"))
    cut = nth_key(mapped.select(key.alias("k")).select("k.*"), int(n))
    if cut is None:
        return mapped
    last, before, schema = cut
    lit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, schema.fields, strict=True)])
    # equal rows that end the cut: as many of them as are missing
    return mapped.where(key < lit).unionByName(mapped.where(key == lit).limit(int(n) - before))


def _hashable(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if "map<" in dtype.simpleString() or "variant" in dtype.simpleString():
        return F.to_json(F.struct(c))
    return c


# ---------------------------------------------------------------- A6

def collect_messages(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Flat turns -> one ordered ``messages`` array per conversation.

    One shuffle on the conversation key; the array is the conversation, so
    the group is as large as the output row it makes.
    """
    msgs = F.sort_array(F.collect_list(F.struct(
        F.col(order_col).alias("o"), F.col(role_col).alias("role"),
        F.col(text_col).alias("content"))))
    return turns.groupBy(conv_col).agg(
        F.transform(msgs, lambda m: F.struct(m["role"].alias("role"),
                                             m["content"].alias("content"))).alias("messages"))
