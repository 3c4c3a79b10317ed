r"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>[INST] role [/INST] text</s>``. A deterministic parser reads a rendered turn back: it must hold
exactly the four marks of the grammar, the role ends at the first `` [/INST] ``, and backslash escapes are undone. A turn
whose parse differs from its source (control strings or escape look-alikes inside it) is rendered escaped (``\`` as ``\e``,
``<`` as ``\l``, ``[`` as ``\b``), which leaves no mark inside. The whole conversation is then parsed again and compared with
its source; one that still differs has all its turns escaped, and one that then differs stops the job.

Defined results: null role or text counts as empty; turns go by turn number (null first), then role, then text; repeated
turns all stay; an empty table gives no rows. A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm.common import read

OPEN, MID, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
MARKS = r"</?s>|\[/?INST\]"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def parse_turn(body: Column) -> Column:
    """struct(role, text) of a rendered turn without its closing mark, or null where it breaks the grammar."""
    rest = F.substr(body, F.lit(len(OPEN) + 1))
    at = F.instr(rest, MID)
    fits = F.startswith(body, F.lit(OPEN)) & (at > 0) & (F.regexp_count(body, F.lit(MARKS)) == 3)
    role, text = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(MID))
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """array of struct(role, text) of a formatted conversation."""
    bodies = F.split(formatted, CLOSE)
    return F.transform(F.slice(bodies, F.lit(1), F.size(bodies) - 1), parse_turn)


def format_chat(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start from 0 and length, code points, of each trained text in formatted), n_turns and
    escaped_turns of every conversation."""
    t = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    plain = render(F.col("role"), F.col("text"))
    body = F.substr(plain, F.lit(1), F.char_length(plain) - len(CLOSE))
    same = parse_turn(body).eqNullSafe(F.struct("role", "text"))
    t = t.withColumn("raw", ~same)
    chats = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", F.col("raw").alias("escaped")))).alias("turns"))

    def laid(turns: Column) -> Column:
        return F.transform(
            turns,
            lambda x: F.struct(
                F.when(x["escaped"], escape(x["role"])).otherwise(x["role"]).alias("role"),
                F.when(x["escaped"], escape(x["text"])).otherwise(x["text"]).alias("text"),
                (x["role"] == trained_role).alias("trained"),
            ),
        )

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda x: render(x["role"], x["text"])), "")

    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    harder = F.transform("turns", lambda x: x.withField("escaped", F.lit(True)))
    chats = chats.withColumn("parts", laid(F.col("turns"))).withColumn("formatted", joined(F.col("parts")))
    chats = chats.withColumn("ok", parse(F.col("formatted")).eqNullSafe(source))
    chats = chats.withColumn("turns", F.when(F.col("ok"), F.col("turns")).otherwise(harder))
    chats = chats.withColumn("parts", F.when(F.col("ok"), F.col("parts")).otherwise(laid(F.col("turns"))))
    chats = chats.withColumn("formatted", F.when(F.col("ok"), F.col("formatted")).otherwise(joined(F.col("parts"))))
    lost = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    chats = chats.withColumn("formatted", F.when(F.col("ok") | parse(F.col("formatted")).eqNullSafe(source), F.col("formatted")).otherwise(lost.cast("string")))
    # the end of each turn in formatted is a running sum of lengths
    frame = len(OPEN) + len(MID) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        text_at = acc["at"] + len(OPEN) + F.char_length(x["role"]) + len(MID)
        span = F.array(F.struct(text_at.alias("start"), F.char_length(x["text"]).alias("length")))
        return F.struct(
            (acc["at"] + frame + F.char_length(x["role"]) + F.char_length(x["text"])).alias("at"),
            F.when(x["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return chats.select(
        "conv_id", "formatted", F.aggregate("parts", start, step, lambda a: a["spans"]).alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("turns", lambda x: x["escaped"])).alias("escaped_turns"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text and its loss spans alone."""
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("told", told).withColumn("loss", loss).select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    hard = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    return digests(format_chat(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_matches(role || ' ' || text, '</?s>|\[/?INST\]|\\[elb]') AS esc FROM c
), f AS (
  SELECT *, 23 + length(role) + length(text) + CASE WHEN esc THEN
    length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) ELSE 0 END AS chars FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
