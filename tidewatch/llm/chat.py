"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log of events per conversation is folded into final messages, which are then
rendered with a turn template and a loss mask.

Events have columns ``conv_id, turn, part, seq, op, role, text``:
``message`` sets role and text of a message, ``edit`` replaces its text,
``regenerate`` throws its text away, ``delta`` appends to it.  A message is named by
(conv_id, turn, part); its final text is the last setting event's text with the
deltas after it, in ``seq`` order (ties by op, then text).  The conversations table
holds only finished rows: ``conversation_events`` writes the log such a row could have come from.  By a
hash of the row it is a finished message, one streamed in pieces, one edited, or one begun, thrown away and
streamed again.

Template, per message: ``<|role:ROLE|>\\nTEXT<|end|>\\n``.  In ROLE and TEXT the
characters ``& < [ |`` are written as character references, so no control string
(of this or another common template) can appear inside a text, and reading back is exact.

No window or group holds more than one message, or one block of
``TURNS_PER_BLOCK`` turns, until the finished blocks of a conversation are
joined to its one output string.

Defined results: null text or role is empty; a null conv_id or turn is a value
of its own, null turns first; rows that share a turn are separate messages ordered by role
and text; an empty log gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import running

TURNS_PER_BLOCK = 512
# Characters of a streamed piece.
PIECE = 200
# Order matters: the reference character itself is escaped first and restored last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
HEAD, HEAD_END, TAIL = "<|role:", "|>\n", "<|end|>\n"
TURN_RE = r"<\|role:([^|]*)\|>\n([^<]*)<\|end\|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for raw, ref in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def unescape(text: Column) -> Column:
    for raw, ref in reversed(ESCAPES):
        text = F.replace(text, F.lit(ref), F.lit(raw))
    return text


def conversation_events(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The conversations table as a log of events."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.row_number().over(same).alias("part"), "role", "text")
    whole, none = F.coalesce("text", F.lit("")), F.lit(None).cast("string")

    def event(seq, op: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))

    def streamed(first: int) -> Column:
        at = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.char_length(whole) - 1, F.lit(0)) / piece).cast("long"))
        return F.transform(at, lambda i: F.struct((i + first).alias("seq"), F.lit("delta").alias("op"), none.alias("role"),
                                                  F.substring(whole, (i * piece + 1).cast("int"), F.lit(piece)).alias("text")))

    role = F.col("role")
    draft = F.concat(F.substring(whole, 1, piece), F.lit(" ..."))
    kind = F.crc32(F.concat_ws(":", F.lit("log"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("part").cast("string")).cast("binary")) % 4
    log = (F.when(kind == 0, F.array(event(0, "message", role, F.col("text"))))
            .when(kind == 1, F.concat(F.array(event(0, "message", role, none)), streamed(1)))
            .when(kind == 2, F.array(event(0, "message", role, draft), event(1, "delta", none, draft), event(2, "edit", none, F.col("text"))))
            .otherwise(F.concat(F.array(event(0, "message", role, none), event(1, "delta", none, draft), event(2, "regenerate", none, none)), streamed(3))))
    return rows.select("conv_id", "turn", "part", F.explode(log).alias("e")).select("conv_id", "turn", "part", "e.*")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, part, role, text."""
    key = ["conv_id", "turn", "part"]
    log = Window.partitionBy(*key).orderBy("seq", "op", "text").rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("op").isin("message", "edit", "regenerate")
    e = events.select(*key, "seq", "op", "role", "text")
    e = e.withColumn("__version", F.sum(sets.cast("int")).over(log))
    e = e.withColumn("__last", F.max("__version").over(Window.partitionBy(*key)))
    live = (F.col("__version") == F.col("__last")) & (F.col("op") != "regenerate")
    pieces = F.sort_array(F.collect_list(F.when(live, F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text")))))
    # A message and its deltas share the order of the window: by seq, then op, then text.
    role = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"]
    return e.groupBy(*key).agg(
        F.coalesce(role, F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start,
    length in code points of ``formatted``, one per assistant message in order)."""
    m = messages.select("conv_id", "turn", "part", escape(F.col("role")).alias("__role"), escape(F.col("text")).alias("__text"),
                        (F.col("role") == LOSS_ROLE).alias("__loss"))
    m = (m.withColumn("__conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
          .withColumn("__block", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(1 << 62))))
          .withColumn("__head", F.concat(F.lit(HEAD), "__role", F.lit(HEAD_END)))
          .withColumn("__turn", F.concat("__head", "__text", F.lit(TAIL)))
          .withColumn("__len", F.char_length("__turn").cast("long")))
    m = running(m, "__conv", "__block", ["turn", "part"], "__len")
    span = F.struct((F.col("__before") + F.char_length("__head")).alias("start"), F.char_length("__text").cast("long").alias("length"))
    blocks = m.groupBy("__conv", "__block").agg(
        F.first("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list(F.struct("__rank", "__turn"))).alias("__turns"),
        F.sort_array(F.collect_list(F.when(F.col("__loss"), span))).alias("__spans"))
    blocks = blocks.withColumn("__turns", F.array_join(F.transform("__turns", lambda t: t["__turn"]), ""))
    whole = blocks.groupBy("__conv").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("__block", "__turns", "__spans"))).alias("__blocks"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("__blocks", lambda b: b["__turns"]), "").alias("formatted"),
        F.flatten(F.transform("__blocks", lambda b: b["__spans"])).alias("loss_spans"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    return render(fold_events(conversation_events(conversations)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests parsed from the output of ``render`` alone."""
    f = formatted.withColumn("__roles", F.regexp_extract_all("formatted", F.lit(TURN_RE), F.lit(1)))
    f = f.withColumn("__texts", F.regexp_extract_all("formatted", F.lit(TURN_RE), F.lit(2)))
    f = f.withColumn("__said", F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), ""))
    turns = F.array_join(F.zip_with("__roles", "__texts", lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("__texts").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("__said").cast("long").alias("loss_chars"), F.sha2(F.col("__said").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
