"""Chat formatting: typed content parts flattened into one string per conversation, and read back. DataFrame only.

A message is a list of parts ``struct<kind, text, ref, units>`` with kind text, image, audio or document. A visitor renders
the parts of a message in order: text is escaped and kept; any other part becomes a placeholder ``[|kind n|]`` whose number
counts the attachments of the conversation, and is recorded with its reference and its expanded token count. Every step is
a map over an array, so the work is linear in the length of a conversation.

Template: ``<s>`` + turns + nothing, a turn being ``<|role|>`` + content + ``</s>``. Control strings inside a role or a
text get a backslash after their first character, and a backslash is doubled; dropping the backslashes restores the text.
A text part that follows another one begins with a backslash too (unless it begins with one), so that no control string
arises where the two meet; so do a role and a kind that begin with ``]`` or ``>``, as they follow a bar. :func:`read_back` gives turns and parts again: adjacent text parts as one, empty ones left out.

Defined cases: null text is empty; a null role is empty; a null kind is text; a part that is null is an empty text; rows of
one conversation that share a turn are ordered by role, then content; null turns come first; rows with a null conversation
form one conversation; other columns are ignored. A conversation is one row of the result, so it must fit in one row (2 GB);
its turns are gathered map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import table

#: Control strings; the last two mark a placeholder.
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "[|", "|]"]

#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PART = "struct<kind:string,text:string,ref:string,units:bigint>"
_QUOTED = "|".join("".join("\\" + c if not c.isalnum() and c not in "<>/" else c for c in s) for s in CONTROLS)


def escape(col: Column) -> Column:
    doubled = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?={_QUOTED})(.)", "$1\\\\")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def _after_bar(said: Column) -> Column:
    """Escaped text that follows a bar."""
    return F.when(said.startswith("]") | said.startswith(">"), F.concat(F.lit("\\"), said)).otherwise(said)


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _visit(part: Column, before: Column) -> Column:
    """The visitor: what a part becomes, given the one before. A placeholder's number is put in when all are known."""
    said = escape(F.coalesce(part["text"], F.lit("")))
    border = (_kind(before) == "text") & (said != "") & ~said.startswith("\\")
    return F.when(_kind(part) == "text", F.concat(F.when(border, F.lit("\\")).otherwise(F.lit("")), said)).otherwise(F.concat(F.lit("[|"), _after_bar(escape(_kind(part))), F.lit("|]")))


def _numbered(content: Column) -> Column:
    """Each placeholder's end, of which there are no others as they are escaped elsewhere, with its number before it."""
    pieces = F.split(content, r"\|\]", -1)
    return F.array_join(F.transform(pieces, lambda x, k: F.when(k < F.size(pieces) - 1, F.concat(x, F.lit(" "), (k + 1).cast("string"))).otherwise(x)), "|]")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, attachments, attachment_tokens."""
    own = F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), own.alias("parts")).alias("message"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))

    def rendered(m: Column) -> Column:
        first = F.struct(F.lit("none").alias("kind"), F.lit("").alias("text"), F.lit("").alias("ref"), F.lit(0).cast("bigint").alias("units"))
        before = F.slice(F.concat(F.array(first), m["parts"]), F.lit(1), F.size(m["parts"]))
        return F.concat(F.lit("<|"), _after_bar(escape(m["role"])), F.lit("|>"), F.array_join(F.zip_with(m["parts"], before, _visit), ""), F.lit("</s>"))

    def attachment(part: Column, k: Column) -> Column:
        cost = F.coalesce(*(F.when(_kind(part) == name, F.lit(v)) for name, v in TOKENS_PER_UNIT.items()), F.lit(1))
        tokens = (cost * F.coalesce(part["units"], F.lit(1))).cast("bigint")
        return F.struct((k + 1).cast("int").alias("ordinal"), _kind(part).alias("kind"), part["ref"].alias("ref"), tokens.alias("n_tokens"))

    content = F.concat(F.lit("<s>"), F.array_join(F.transform("messages", rendered), ""))
    others = F.filter(F.flatten(F.transform("messages", lambda m: m["parts"])), lambda p: _kind(p) != "text")
    out = gathered.select("conv_id", _numbered(content).alias("formatted"), F.transform(others, attachment).alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["n_tokens"]))


def _part(kind: Column, text: Column | None = None, ordinal: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(kind.alias("kind"), (none.cast("string") if text is None else text).alias("text"), (none.cast("int") if ordinal is None else ordinal).alias("ordinal"))


def _read_parts(content: Column) -> Column:
    """Content cut where placeholders begin: what comes before the first is text; each other piece is a placeholder's inside, its end, and text."""

    def text_of(said: Column) -> Column:
        return F.when(said != "", F.array(_part(F.lit("text"), unescape(said)))).otherwise(F.array().cast("array<struct<kind:string,text:string,ordinal:int>>"))

    def read(piece: Column, k: Column) -> Column:
        inside = F.substring_index(piece, "|]", 1)
        number = F.substring_index(inside, " ", -1)
        kind = F.substr(inside, F.lit(1), F.length(inside) - F.length(number) - 1)
        mark = F.array(_part(unescape(kind), ordinal=number.cast("int")))
        return F.when(k == 0, text_of(piece)).otherwise(F.concat(mark, text_of(F.substr(piece, F.length(inside) + 3))))

    return F.flatten(F.transform(F.split(content, r"\[\|", -1), read))


def read_back(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds ``turns``: array of struct<role, text, parts>, parsed from the formatted string.

    ``parts`` are struct<kind, text, ordinal>, the ordinal being that of the attachment; ``text`` is the text among them,
    without any mark of attachments.
    """
    pieces = F.split(F.expr(f"substring(`{formatted}`, {len('<s>') + 1})"), "</s>", -1)
    opened = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, 3, 1 << 30))  # without <|

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "|>", 1)
        content = F.substr(p, F.length(role) + 3)
        parts = _read_parts(content)
        return F.struct(unescape(role).alias("role"), F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"), parts.alias("parts"))

    return df.withColumn("turns", F.transform(opened, turn))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units"))
    back = read_back(format_conversations(rows.withColumn("parts", F.array(part))))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(log, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *,
    replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>'), '<s>', '<\s>'), '</s>', '<\/s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[|', '[\|'), '|]', '|\]') AS safe
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(safe) + length(role) + 8))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
