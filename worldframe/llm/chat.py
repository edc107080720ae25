"""Chat formatting with a grammar round trip, in DataFrame functions only.

    text   := level turn*
    level  := "<|raw|>" | "<|esc|>"
    turn   := "<|turn|>" role "<|text|>" body "<|end|>"

A conversation is rendered raw, parsed again by splitting at the control strings, and compared turn by turn
with its source. Where a text or role holds something that the parser takes for a control string, the
recovered turns differ; such a conversation is rendered again with `~`, `<` and `|` of roles and texts
escaped as `~0`, `~1` and `~2`, after which none of the controls can occur inside. A rendering that still
differs is an error. The loss mask covers the bodies of assistant turns.

Null texts and roles are empty. Turns are ordered by turn (null first), then role, then text; repeated rows
are turns of their own. Rows without a conversation id form one conversation without an id. An empty table
gives an empty result. Texts of any length are rendered whole. Extra columns are not read, whatever their names. A conversation is one output string, so its turns must
meet in one row; that is the only group that is gathered.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW, ESC, TURN, TEXT, END = "<|raw|>", "<|esc|>", "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("|"), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("|")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _same(text: Column) -> Column:
    return text


def render(turns: Column, level: str) -> Column:
    """The formatted string of an array of (role, text)."""
    put = escape if level == ESC else _same
    return F.concat(F.lit(level), F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), put(t["role"]), F.lit(TEXT), put(t["text"]), F.lit(END))), ""))


def parse(formatted: Column, body_only: bool = False) -> Column:
    """The turns of a formatted string: array of (role, text). Everything is read from the string, its level too."""
    escaped = formatted.startswith(ESC)
    rest = F.substring(formatted, F.lit(len(RAW) + 1), F.length(formatted))
    parts = F.split(rest, _quoted(END), -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(TURN) + 1), F.length(part))
        role = F.substring_index(inner, TEXT, 1)
        text = F.substring(inner, F.length(role) + len(TEXT) + 1, F.length(inner))
        return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(parts, turn)


def _quoted(control: str) -> str:
    return "".join("\\" + c if c in "|" else c for c in control)


def format_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id_col, formatted, escaped, turns: one row per conversation; turns are those parsed from formatted."""
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.select(id_col, row.alias("t")).groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = grouped.select(id_col, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    raw = source.withColumn("raw", render(F.col("source"), RAW))
    tried = raw.withColumn("escaped", ~parse(F.col("raw")).eqNullSafe(F.col("source")))
    shown = tried.select(id_col, "source", "escaped", F.when(F.col("escaped"), render(F.col("source"), ESC)).otherwise(F.col("raw")).alias("formatted"))
    read = shown.withColumn("turns", parse(F.col("formatted")))
    fails = F.raise_error(F.concat(F.lit("round trip fails for conversation "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    safe = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(fails.cast(read.schema["turns"].dataType))
    return read.select(id_col, "formatted", "escaped", safe.alias("turns"))


def loss_spans(formatted: Column, turns: Column) -> Column:
    """array of (start, end) code points of the assistant bodies in the formatted string, in order."""
    escaped = formatted.startswith(ESC)
    size = lambda x: F.length(F.when(escaped, escape(x)).otherwise(x))
    first = F.struct(F.lit(len(RAW)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(TURN) + size(t["role"]) + len(TEXT)
        end = start + size(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, first, step)["spans"]


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the formatted string."""
    escaped = F.col("formatted").startswith(ESC)
    spans = formatted.withColumn("spans", loss_spans(F.col("formatted"), F.col("turns")))
    cut = F.transform("spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    masked = spans.withColumn("loss", F.array_join(F.transform(cut, lambda x: F.when(escaped, unescape(x)).otherwise(x)), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return masked.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
