"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

#: Roles that speak to all and are no participants.
CONTEXT_ROLES = ("system",)
#: Name of a speaker whose role is null.
UNNAMED = "unknown"
#: Ends a turn.
END = "<|im_end|>\n"
#: Stretches of turn numbers that a conversation is split into for its running sums.
STRETCHES = 1024
#: Characters of a rendering that rendered() puts into one row, but for the last segment of each.
PART_CHARS = 1 << 20


def escaped(text: Column) -> Column:
    """text without marks of its own: one more backslash in each `<|im_` (with or without backslashes), so taking one off gives the text back."""
    return F.regexp_replace(text, r"<\|(\\*)im_", r"<|\\$1im_")


def shown_name(name: Column) -> Column:
    """name as it stands in a header: white space, controls, <, > and | become underscores."""
    return F.regexp_replace(name, r"[\x00-\x20<>|]", "_")


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """Renders every conversation once for each participant: that speaker's turns as assistant, the others' as users with their names.

    turns: conv_id, turn (an integer), role, text. Participants of a conversation are its distinct roles but the context roles; those keep the
    role `system` in every rendering. A conversation of context turns alone has no participant and no rows.

    Returns the segments of each (conv_id, speaker): conv_id, speaker, turn, role, name, segment, at, mask_start, mask_end, trained. A
    segment is `<|im_start|>role [name=...]\\ntext<|im_end|>\\n`; `at` is where it starts in the whole dialogue, in characters. Segments
    follow each other by turn (null first), then MD5 of the text, then role. The loss covers [mask_start, mask_end) of the dialogue: the
    assistant's text and end mark; elsewhere it is empty, at the segment's start, and trained is false. rendered() puts segments together.

    Texts and names can't forge a turn: see escaped() and shown_name(). A null role is named `unknown`; a null text is empty; null conv_ids
    form one conversation. Turns with the same number, or repeated rows, are all rendered. Only distinct (conv_id, role) pairs meet the turns,
    and positions are summed up by stretches of turns, so a conversation of any length stays spread over tasks. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    turns = turns.select("conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNNAMED)).alias("said_by"), escaped(text).alias("body"), F.md5(text).alias("digest"))
    turns = turns.withColumn("body_length", F.length("body"))  # the sums need no more of the text
    talks = F.col("said_by").isin(*context_roles)
    number = F.col("turn").cast("double")
    ends = turns.groupBy(F.col("key").alias("e")).agg(F.min(number).alias("first"), (F.max(number) - F.min(number) + 1).alias("span"))
    speakers = turns.where(~talks).select(F.col("key").alias("c"), F.col("said_by").alias("speaker")).distinct()
    speakers = speakers.join(ends, F.col("c") == F.col("e")).drop("e")
    rows = turns.join(speakers, F.col("key") == F.col("c"))
    role = F.when(talks, F.lit("system")).when(F.col("said_by") == F.col("speaker"), F.lit("assistant")).otherwise(F.lit("user"))
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", shown_name(F.col("said_by"))))
    header = F.concat(F.lit("<|im_start|>"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("header", header).withColumn("head", F.length("header"))
    # a stretch holds one turn number or several; where it holds one, digests split it further
    stretch = F.coalesce(F.floor((number - F.col("first")) / F.col("span") * STRETCHES), F.lit(-1))
    block = stretch * 256 + F.when(F.col("span") < STRETCHES, F.conv(F.substring("digest", 1, 2), 16, 10).cast("long")).otherwise(F.lit(0))
    rows = rows.select("conv_id", "key", "speaker", "turn", "said_by", "role", "name", "header", "body", "head", "digest", block.alias("block"), (F.col("head") + F.col("body_length") + len(END)).alias("length"))
    rows = running(rows, ["key", "speaker"], F.col("block"), ["turn", "digest", "said_by"], F.col("length"), "at", nullable=False)
    rows = rows.withColumn("segment", F.concat("header", "body", F.lit(END)))
    trained = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "speaker", "turn", "role", "name", "segment", "at",
        F.when(trained, F.col("at") + F.col("head")).otherwise(F.col("at")).alias("mask_start"),
        F.when(trained, F.col("at") + F.col("length") - 1).otherwise(F.col("at")).alias("mask_end"),
        trained.alias("trained"),
    )


def rendered(segments: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The dialogues of rotate_perspectives(): conv_id, speaker, part, at, text, masks (start and end in the whole dialogue).

    A dialogue of up to part_chars characters is one row. Longer ones are several: a segment belongs to the part that its start lies in, and
    the parts follow each other, so no row grows with a conversation beyond part_chars and a segment.
    """
    segment = F.struct("at", "turn", "segment", "trained", "mask_start", "mask_end")
    parts = segments.groupBy("conv_id", "speaker", F.expr(f"at div {part_chars}").alias("part")).agg(F.min("at").alias("at"), F.array_sort(F.collect_list(segment)).alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["trained"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return parts.select("conv_id", "speaker", "part", "at", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))
