"""Chat formatting as a grammar round trip, with DataFrame functions only.

Grammar::

    conversation := turn*
    turn         := "[INST]" role flag "[/INST]" body "</s>"
    flag         := "" | "!"            # "!": the body is escaped

The parser splits at ``</s>``; a piece is a turn only if it starts with ``[INST]`` and holds exactly one ``[INST]`` and
one ``[/INST]``. A turn is first rendered as it is and parsed again; where the recovered turns differ from the source,
the body is escaped (backslash, ``<`` and ``[``), and where a conversation as a whole still differs, all of its bodies
are. Roles are always escaped.

Defined results: a null text or role counts as empty; turns sort by (turn, role, text), null turns first; repeated rows
are turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, EOS = "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\i"))


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("!"), F.lit("\\x"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\x"), F.lit("!")))


def render(role: Column, text: Column, escaped: Column) -> Column:
    return F.concat(
        F.lit(OPEN), escape_role(role), F.when(escaped, "!").otherwise(""), F.lit(CLOSE), F.when(escaped, escape(text)).otherwise(text), F.lit(EOS)
    )


def parse(formatted: Column) -> Column:
    """The turns that a rendered text holds, as array<struct<role, text>>; null where it doesn't follow the grammar."""
    count = lambda x, mark: (F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / len(mark)

    def turn(piece: Column) -> Column:
        at = F.locate(CLOSE, piece)
        head = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        body = F.substring(piece, at + len(CLOSE), F.length(piece))
        marked = F.endswith(head, F.lit("!"))
        role = unescape_role(F.when(marked, F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(head))
        good = F.startswith(piece, F.lit(OPEN)) & (at > 0) & (count(piece, OPEN) == 1) & (count(piece, CLOSE) == 1)
        return F.when(good, F.struct(role.alias("role"), F.when(marked, unescape(body)).otherwise(body).alias("text")))

    pieces = F.split(formatted, EOS, -1)
    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    whole = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, an array of (start, length, escaped) in code
    points of formatted that marks the bodies of assistant turns."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = parse(render(F.col("role"), F.col("text"), F.lit(False)))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("esc", ~F.coalesce(alone == source, F.lit(False)))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "esc"))).alias("turns"))

    def rendered(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: render(t["role"], t["text"], t["esc"])), "")

    same = parse(rendered(F.col("turns"))) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    forced = F.transform("turns", lambda t: t.withField("esc", F.lit(True)))
    convs = convs.withColumn("turns", F.when(F.coalesce(same, F.lit(False)), F.col("turns")).otherwise(forced))
    pieces = convs.select("conv_id", F.posexplode("turns").alias("pos", "t")).select(
        "conv_id",
        "pos",
        render(F.col("t.role"), F.col("t.text"), F.col("t.esc")).alias("piece"),
        F.when(F.col("t.role") == "assistant", F.length(F.when(F.col("t.esc"), escape(F.col("t.text"))).otherwise(F.col("t.text")))).alias("loss_len"),
        F.col("t.esc").alias("esc"),
    )
    # the length of a piece up to its body is that of the piece without body and end mark
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("pos")
    pieces = pieces.withColumn("before", F.sum(F.length("piece")).over(w) - F.length("piece"))
    start = F.col("before") + F.length("piece") - len(EOS) - F.col("loss_len")
    span = F.when(F.col("loss_len").isNotNull(), F.struct(start.alias("start"), F.col("loss_len").cast("long").alias("length"), F.col("esc").alias("escaped")))
    packed = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", span.alias("span")))).alias("p"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of a formatted table, from its rendered text and loss mask alone."""
    turns = parse(F.col("formatted"))
    lost = F.transform(
        "loss_spans",
        lambda s: F.when(s["escaped"], unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).otherwise(
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(lost, "").alias("lost"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_chats(rows.unionByName(probe)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN contains(text, '[INST]') OR contains(text, '[/INST]') OR contains(text, '</s>')
    THEN 1 + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\i')) ELSE length(text) END AS body,
    length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\i'), '!', '\x')) AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + head + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
