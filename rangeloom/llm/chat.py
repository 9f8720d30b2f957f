"""Chat formatting with typed content parts.

A message holds ordered parts of kind text, image, audio or document. A visitor (one expression for each kind) turns
every part into template text: texts are escaped, the others become numbered placeholders, their references are listed
as attachments, and each part reports how many tokens it expands to in the model's context.

Template: ``<|im_start|>role\\nbody<|im_end|>\\n`` for each turn, in turn order. Escaping puts a backslash before every
backslash and inside every control string of this and of other common templates, so none of them can occur in a body;
unescaping drops one backslash before any character. A role also has its line ends escaped.

Results for odd input: a null text or null parts are empty; a null role is an empty role; turns that tie are ordered by
role, then by body; a null conversation id is a conversation of its own; a part of an unknown kind is formatted as a
document; an empty table gives an empty result (the report's: the probe alone); a very long text is formatted whole; other
columns are ignored. One output row is one whole conversation, as the format requires: rows
are formatted before the shuffle, and the shuffle moves each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates, and what stands for them in a text.
ESCAPES = [
    ("\\", "\\\\"),
    ("<|", "<\\|"),
    ("<s>", "<\\s>"),
    ("</s>", "<\\/s>"),
    ("[INST]", "[\\INST]"),
    ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<\\<SYS>>"),
    ("<</SYS>>", "<\\</SYS>>"),
]
PART = "struct<kind:string,text:string,ref:string,size:bigint>"
#: Context tokens for each unit of a part's size: image tiles, seconds of audio, document pages; texts take characters / 4.
TOKENS = {"image": 170, "audio": 25, "document": 600}


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(part: Column, number: Column) -> tuple[Column, Column, Column]:
    """Template text, attachment (null for a text) and expanded tokens of the part with this 1-based number in its message."""
    kind = F.coalesce(part["kind"], F.lit("document"))
    kind = F.when(kind.isin("text", "image", "audio"), kind).otherwise(F.lit("document"))
    text, size = F.coalesce(part["text"], F.lit("")), F.coalesce(part["size"], F.lit(1).cast("long"))
    placeholder = F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))
    tokens = F.when(kind == "text", F.ceil(F.char_length(text) / 4))
    for name, per in TOKENS.items():
        tokens = tokens.when(kind == name, size * per)
    shown = F.when(kind == "text", escape(text)).otherwise(placeholder)
    attached = F.when(kind != "text", F.struct(placeholder.alias("placeholder"), kind.alias("kind"), F.coalesce(part["ref"], F.lit("")).alias("ref")))
    return shown, attached, tokens


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row a conversation: conv_id, formatted, attachments, n_tokens and loss_mask, an array of (piece, start, length).

    A mask entry covers ``length`` code points from the 1-based ``start`` of the piece-th part of ``formatted`` when that
    is split at the turn start marks (0 is what precedes the first, so empty); together they are all assistant bodies.
    """
    given = F.coalesce(F.col(parts), F.expr(f"cast(array() as array<{PART}>)"))
    rows = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), given.alias("_parts"))
    seen = rows.select(
        "_conv", "_turn", "_role",
        F.transform("_parts", lambda p, i: F.struct(*(c.alias(n) for c, n in zip(visit(p, i + 1), ("shown", "attached", "tokens"))))).alias("_seen"),
    )
    seen = seen.select(
        "_conv", "_turn", "_role",
        F.array_join(F.transform("_seen", lambda x: x["shown"]), "").alias("_body"),
        F.filter(F.transform("_seen", lambda x: x["attached"]), lambda x: x.isNotNull()).alias("_attached"),
        F.aggregate("_seen", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("_tokens"),
    )
    head = F.concat(escape_role(F.col("_role")), F.lit("\n"))
    turns = seen.groupBy("_conv").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_body").alias("body"), head.alias("head"),
                    F.char_length(head).alias("skip"), F.char_length("_body").alias("length"), F.col("_attached").alias("attached"), F.col("_tokens").alias("tokens"),
                )
            )
        ).alias("_turns")
    )
    mask = F.transform("_turns", lambda t, i: F.struct(t["role"].alias("role"), (i + 1).alias("piece"), (t["skip"] + 1).alias("start"), t["length"].alias("length")))
    return turns.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_turns", lambda t: F.concat(F.lit(START), t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.flatten(F.transform("_turns", lambda t: t["attached"])).alias("attachments"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.transform(F.filter(mask, lambda m: m["role"] == "assistant"), lambda m: F.struct(m["piece"], m["start"], m["length"])).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the unescaped text under the loss mask, from the formatted output alone: adds turns and loss."""
    role = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    rows = formatted.withColumn("_pieces", F.split(F.col("formatted"), r"<\|im_start\|>"))
    body = lambda p: F.substring_index(p, END, 1)
    turns = F.transform(
        F.slice("_pieces", F.lit(2), F.size("_pieces")),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, role, 1)).alias("role"),
            unescape(F.regexp_replace(body(p), role, "")).alias("text"),
        ),
    )
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.get("_pieces", m["piece"]), m["start"], m["length"])))
    return rows.withColumns({"turns": turns, "loss": F.array_join(loss, "")}).drop("_pieces")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of another template."""
    text = "</s>[INST] ok [/INST]"
    rows = ", ".join(f"(-7L, {i}L, '{role}', '{text}')" for i, role in enumerate(("user", "assistant")))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")


def as_parts(messages: DataFrame, text: str = "text") -> DataFrame:
    """Plain messages as messages of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size"))
    return messages.withColumn("parts", F.array(part))


def report(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe(conversations.sparkSession))
    back = read_back(format_chats(as_parts(rows)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
