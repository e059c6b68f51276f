"""Chat formatting by a grammar round trip. DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line end. The parser is
deterministic: ``</turn>`` ends a turn, ``### `` begins one, the first ``: ``
ends its role, and escapes are undone. Each rendered turn is parsed again and
compared to its source; where they differ, first the text is escaped and then
the role as well, until the recovered turn is identical. No control string can
begin in one rendered turn and end in the next, so a conversation parses as its
turns do; the whole is still parsed and compared, and a difference is an error.

The loss mask holds the texts of assistant turns as spans of code points: of
each its turn (from 0), where that turn begins in the conversation, and its
start and length inside the turn.

Results: turns go by ``turn`` (nulls first), then role, then text; null roles and
texts are empty; repeated rows are turns of their own; rows with a null conv_id
are one conversation; an empty table gives an empty one; columns besides the
four named are not read. A conversation is one value of the result, and with
its turns has to fit a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import bound

HEAD, MIDDLE, END = "### ", ": ", "</turn>"
#: What stands for each control string in escaped content; the backslash comes first, and last on the way back.
ESCAPES = {"\\": "\\-", END: "\\t", HEAD: "\\h"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}
LOSS_ROLE = "assistant"


def escape(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), escapes.items(), text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ROLE_ESCAPES.items()), text)


def head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MIDDLE))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(head(role), text, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """The turns of formatted text; text outside of a turn is one without a role."""

    def turn(part: Column, i: Column) -> Column:
        role = F.substring_index(part, MIDDLE, 1)
        text = F.substr(part, F.length(role) + len(MIDDLE) + 1)
        inside = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        outside = F.struct(F.lit(None).cast("string").alias("role"), part.alias("text"))
        return F.when(i > 0, inside).when(part != "", outside)

    pieces = F.split(formatted, END + "\n?")
    return F.filter(F.flatten(F.transform(pieces, lambda p: F.transform(F.split(p, HEAD), turn))), lambda t: t.isNotNull())


def survives(role: Column, text: Column, source: Column) -> Column:
    return parsed(rendered(role, text)) == source


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, mask): each conversation's text and its loss mask of (turn, offset, start, length)."""
    empty = F.lit("")
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    role, text = F.col("role"), F.col("text")
    source = F.array(F.struct("role", "text"))
    # The content that is written: as it is, with the text escaped, or with both.
    plain, half, full = F.struct("role", "text"), F.struct("role", escape(text).alias("text")), F.struct(escape(role, ROLE_ESCAPES).alias("role"), escape(text).alias("text"))
    written = F.when(survives(role, text, source), plain).when(survives(role, half["text"], source), half).otherwise(full)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.repartition("conv_id").withColumn("written", written).withColumn("chars", F.length(rendered(F.col("written.role"), F.col("written.text"))))
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "offset", "role", "text", "written"))).alias("turns"))
    made = F.array_join(F.transform("turns", lambda t: rendered(t["written"]["role"], t["written"]["text"])), "")
    sources = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = bound(made, lambda f: F.when(parsed(f) == sources, f).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string")))
    own = F.filter("turns", lambda t: t["role"] == LOSS_ROLE)
    mask = F.transform(own, lambda t: F.struct(t["place"].alias("turn"), t["offset"].alias("offset"), F.length(head(t["written"]["role"])).alias("start"), F.length(t["written"]["text"]).alias("length")))
    return turns.select("conv_id", checked.alias("formatted"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss): turns parsed from the formatted text, and all text under its loss mask, unescaped."""
    each = F.split("formatted", f"(?<={END}\n)")
    loss = bound(each, lambda e: F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.get(e, m["turn"]), m["start"] + 1, m["length"]))), ""))
    return chats.select("conv_id", parsed(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A conversation whose texts hold all control strings.
PROBE = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of the probe, read back from their formatted texts."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_chats(rows)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def _sql_holds(column: str, escapes: dict[str, str], *more: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{s}')" for s in [*list(escapes)[1:], *escapes.values(), "\\c", *more]) + ")"


def _sql_escape(column: str, escapes: dict[str, str]) -> str:
    return reduce(lambda c, e: f"replace({c}, '{e[0]}', '{e[1]}')", escapes.items(), column)


ORACLE_SQL = {
    "op13_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE}'),
e AS (SELECT *, CASE WHEN {_sql_holds("role", ESCAPES, MIDDLE)} THEN length({_sql_escape("role", ROLE_ESCAPES)}) + length({_sql_escape("text", ESCAPES)})
  WHEN {_sql_holds("text", ESCAPES)} THEN length(role) + length({_sql_escape("text", ESCAPES)}) ELSE length(role) + length(text) END + {len(HEAD + MIDDLE + END) + 1} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
}
