"""Records of several shapes in one schema, and the texts that operators look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_or_empty

#: Roles that ask and roles that answer.
ASKING, ANSWERING = ("user", "human"), ("assistant", "gpt", "model")


def record_format(columns: list[str], messages_is_list: bool = True) -> str:
    """The format that the presence of columns gives."""
    have = set(columns)
    if "messages" in have and messages_is_list:
        return "chat"
    if {"chosen", "rejected"} <= have:
        return "dpo"
    if have & {"instruction", "output"}:
        return "alpaca"
    return "raw" if "text" in have else "custom"


def turns(messages: Column, roles: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: text_or_empty(m["content"])), "\n\n")


def _first_truthy(df: DataFrame, names: tuple[str, ...], blank_counts: bool = True) -> Column:
    found = [F.col(c).cast("string") for c in names if c in df.columns]
    keep = [F.when((c if blank_counts else strip(c)) != "", c) for c in found]
    return F.coalesce(*keep, F.lit(""))


def to_records(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """df with the columns id, fmt, prompt, response, classify_text and content (what duplicates are judged by)."""
    fmt = record_format(df.columns)
    empty = F.lit("")
    if fmt == "alpaca":
        have = {c: text_or_empty(F.col(c)) if c in df.columns else empty for c in ("instruction", "input", "output")}
        both = F.concat(have["instruction"], F.lit("\n\nContext / Input:\n"), have["input"])
        prompt = F.when(have["input"] == "", have["instruction"]).when(have["instruction"] == "", have["input"]).otherwise(both)
        response, classify = have["output"], F.array_join(F.filter(F.array(have["instruction"], have["input"]), lambda x: x != ""), "\n\n")
    elif fmt == "chat":
        prompt, response = turns(F.col("messages"), ASKING), turns(F.col("messages"), ANSWERING)
        classify = prompt
    elif fmt == "dpo":
        prompt, response = text_or_empty(F.col("prompt")), text_or_empty(F.col("chosen"))
        classify = prompt
    elif fmt == "raw":
        prompt, response = empty, text_or_empty(F.col("text"))
        classify = response
    else:
        prompt = _first_truthy(df, ("prompt", "instruction", "input"))
        response = _first_truthy(df, ("response", "output", "text"))
        classify = _first_truthy(df, ("text", "content", "query", "prompt", "instruction", "input"), blank_counts=False)
    key = F.col(id_col).cast("string") if id_col else F.sha2(F.to_json(F.struct(*df.columns)), 256)
    out = df.withColumns({"id": key, "fmt": F.lit(fmt), "prompt": prompt, "response": response, "classify_text": classify})
    return with_content(out.withMetadata("fmt", {"constant": fmt}))


def with_content(rows: DataFrame) -> DataFrame:
    """rows with content: prompt and response, stripped, or classify_text if that is empty."""
    rows = rows.withColumn("_joined", strip(F.concat_ws(" ", "prompt", "response")))
    return rows.withColumn("content", F.when(F.col("_joined") != "", F.col("_joined")).otherwise(F.col("classify_text"))).drop("_joined")


def assemble_chats(rows: DataFrame) -> DataFrame:
    """conv_id and messages in the order of turns."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def validation_errors(fmt: str) -> Column:
    """Structural errors of a record; an empty list if it is usable."""
    checks = [F.when((F.col("prompt") == "") & (F.col("response") == "") & (F.col("classify_text") == ""), F.lit("no usable text"))]
    if fmt == "alpaca":
        checks.append(F.when((F.col("prompt") != "") & (F.col("response") == ""), F.lit("instruction without output")))
    if fmt == "chat":
        checks.append(F.when(F.size("messages") <= 0, F.lit("empty messages")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def sharegpt(chats: DataFrame) -> DataFrame:
    """conv_id and conversations [{from, value}] of chats that have both sides."""
    rows = chats.withColumns({"human": turns(F.col("messages"), ASKING), "gpt": turns(F.col("messages"), ANSWERING)}).where("human <> '' and gpt <> ''")
    side = lambda who: F.struct(F.lit(who).alias("from"), F.col(who).alias("value"))
    return rows.select("conv_id", F.to_json(F.array(side("human"), side("gpt"))).alias("conversations"))


#: Columns that may hold labels; the first that a record has counts.
LABEL_KEYS = ("labels", "label", "category", "target")
#: Columns that hold a line's text fields; the last three, of which the first is the line's content, are
#: those of no known format.
FIELDS = ("instruction", "input", "output", "text", "prompt", "chosen", "rejected", "content_field", "query", "response")
MESSAGES = "array<struct<role:string,content:string>>"


def from_lines(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines as records of one schema, the format told for each line by the keys it has (a null counts as present).

    Columns: id, fmt, instruction, input, output, messages, text, prompt, chosen, rejected, labels, label_kind (none,
    scalar, list), label_is_int, raw (the line), and then those of with_views. id is the line's id or _id in text; an
    absent, null or empty one is made from the line's digest. A label that is null shadows the keys after it.
    """
    v = lines.select(*keep, F.col(value).alias("raw"), F.try_parse_json(value).alias("_v"), F.json_object_keys(value).alias("_k"))
    has = lambda *names: F.arrays_overlap(F.coalesce("_k", F.array()), F.array(*map(F.lit, names)))
    get = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    kind_of = lambda name: F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
    listed = has("messages") & F.coalesce(F.startswith(kind_of("messages"), F.lit("ARRAY")), F.lit(False))
    fmt = F.when(listed, "chat").when(has("chosen") & has("rejected"), "dpo").when(has("instruction", "output"), "alpaca").when(has("text"), "raw").otherwise("custom")
    given = F.coalesce(F.nullif(get("id"), F.lit("")), F.nullif(get("_id"), F.lit("")), F.substring(F.sha2("raw", 256), 1, 16))
    which = F.coalesce(*(F.when(has(k), F.lit(k)) for k in LABEL_KEYS))
    label = F.coalesce(*(F.when(has(k) & (which == k), F.try_variant_get("_v", f"$.{k}", "variant")) for k in LABEL_KEYS))
    rows = v.withColumns({"fmt": fmt, "_l": label, **{f: get(f.removesuffix("_field")) for f in FIELDS}})
    kind = F.schema_of_variant("_l")
    is_list = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    none = F.col("_l").isNull() | F.is_variant_null("_l")
    values = F.when(none, F.lit(None)).when(is_list, F.try_variant_get("_l", "$", "array<string>")).otherwise(F.array(F.try_variant_get("_l", "$", "string")))
    is_int = ~none & (kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | kind.isin("ARRAY<BIGINT>", "ARRAY<TINYINT>"))
    rows = rows.withColumns({"id": given, "labels": values, "label_kind": F.when(none, "none").when(is_list, "list").otherwise("scalar"), "label_is_int": F.coalesce(is_int, F.lit(False)), "messages": F.when(F.col("fmt") == "chat", F.try_variant_get("_v", "$.messages", MESSAGES))})
    return with_views(rows.drop("_v", "_k", "_l"))


def with_views(rows: DataFrame) -> DataFrame:
    """rows of the record schema with prompt_text, response_text, classify_text and content, each by its row's format."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = lambda *names: F.coalesce(*(F.when(t(n) != "", F.col(n)) for n in names), F.lit(""))
    filled = lambda *names: F.coalesce(*(F.when(strip(t(n)) != "", F.col(n)) for n in names), F.lit(""))
    ask = F.when(t("input") == "", t("instruction")).when(t("instruction") == "", t("input")).otherwise(F.concat(t("instruction"), F.lit("\n\nContext / Input:\n"), t("input")))
    said = lambda roles: F.coalesce(turns(F.col("messages"), roles), F.lit(""))
    fmt = F.col("fmt")
    prompt = F.when(fmt == "alpaca", ask).when(fmt == "chat", said(ASKING)).when(fmt == "dpo", t("prompt")).when(fmt == "raw", "").otherwise(first("prompt", "instruction", "input"))
    response = F.when(fmt == "alpaca", t("output")).when(fmt == "chat", said(ANSWERING)).when(fmt == "dpo", t("chosen")).when(fmt == "raw", t("text")).otherwise(first("response", "output", "text"))
    both = F.array_join(F.filter(F.array(t("instruction"), t("input")), lambda x: x != ""), "\n\n")
    classify = F.when(fmt == "alpaca", both).when(fmt == "chat", said(ASKING)).when(fmt == "dpo", t("prompt")).when(fmt == "raw", t("text")).otherwise(filled("text", "content_field", "query", "prompt", "instruction", "input"))
    rows = rows.withColumns({"prompt_text": prompt, "response_text": response, "classify_text": classify})
    rows = rows.withColumn("_joined", strip(F.concat_ws(" ", "prompt_text", "response_text")))
    return rows.withColumn("content", F.when(F.col("_joined") != "", F.col("_joined")).otherwise(F.col("classify_text"))).drop("_joined")


def row_errors() -> Column:
    """Structural errors of a row of the record schema, by its format; truthiness only, blank text counts as text."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        F.when(empty("prompt_text") & empty("response_text") & empty("classify_text"), F.lit("no usable text")),
        F.when((F.col("fmt") == "alpaca") & ~empty("instruction") & empty("output"), F.lit("instruction without output")),
        F.when((F.col("fmt") == "chat") & (F.size(F.coalesce("messages", F.array().cast(MESSAGES))) == 0), F.lit("empty messages")),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def update_content(rows: DataFrame, prompt: str, response: str) -> DataFrame:
    """rows with a new prompt and response written to the fields of each row's format.

    Chats: the first asking message and the last answering one change; a missing one is put at the start or the end.
    """
    fmt, p, r = F.col("fmt"), F.col(prompt), F.col(response)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    ms = F.coalesce("messages", F.array().cast(MESSAGES))
    at = F.array_position(F.transform(ms, lambda m: m["role"].isin(*ASKING).cast("int")), 1)
    back = F.array_position(F.reverse(F.transform(ms, lambda m: m["role"].isin(*ANSWERING).cast("int"))), 1)
    rows = rows.withColumns({"_ms": ms, "_at": at, "_back": back})
    last = F.size("_ms") - F.col("_back")
    edited = F.transform("_ms", lambda m, k: F.when(k == F.col("_at") - 1, F.struct(m["role"].alias("role"), p.alias("content"))).when((F.col("_back") > 0) & (k == last), F.struct(m["role"].alias("role"), r.alias("content"))).otherwise(m))
    edited = F.when(F.col("_at") == 0, F.concat(F.array(message("user", p)), edited)).otherwise(edited)
    edited = F.when(F.col("_back") == 0, F.concat(edited, F.array(message("assistant", r)))).otherwise(edited)
    put = lambda c, when, value: F.when(when, value).otherwise(F.col(c))
    return rows.withColumns({
        "instruction": put("instruction", fmt == "alpaca", p),
        "input": put("input", fmt == "alpaca", F.lit("")),
        "output": put("output", fmt == "alpaca", r),
        "prompt": put("prompt", fmt == "dpo", p),
        "chosen": put("chosen", fmt == "dpo", r),
        "text": put("text", fmt.isin("raw", "custom"), r),
        "messages": F.when(fmt == "chat", edited).otherwise(F.col("messages")),
    }).drop("_ms", "_at", "_back")
