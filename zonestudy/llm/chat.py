"""Conversations as one training text with a loss mask, from a declarative template and a turn-order machine."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonestudy.llm.shared import written


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks for each role, and the machine over roles: ``allowed`` maps a state (``start`` or the last role) to the roles
    that may follow; a conversation is complete when it ends in one of ``final``.

    Every mark must start with ``<`` or ``[``. Texts are escaped so that they hold neither, hence no mark can appear inside a
    text or across its edges. Roles without marks of their own are written as ``[ROLE]name[TEXT]text</s>``."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("[ANSWER]", "</s>", loss=True),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "</s>")
    allowed: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)

    def pattern(self) -> str:
        """Groups: 1 the opening marks, 2 the name of a role without marks of its own, 3 the text."""
        body = r"([^<\[]*)"
        opening = "|".join(re.escape(t.opening) for t in self.turns.values())
        closing = "|".join(re.escape(x) for x in dict.fromkeys([*(t.closing for t in self.turns.values()), self.other[2]]))
        return f"({opening}|{re.escape(self.other[0])}{body}{re.escape(self.other[1])}){body}(?:{closing})"


def escape(text: Column) -> Column:
    """``\\``, ``<`` and ``[`` as two characters each, so that no control string is left."""
    for plain, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for plain, code in (("[", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, ``segments`` (array of text and loss flag, in order) and ``valid`` of every conversation.

    Joined, the segments are the formatted text. ``valid`` says whether the turns' order is one that the machine accepts;
    conversations that break it are formatted all the same. Null texts and roles are empty; each row without a conv_id
    is a conversation by itself; turns are ordered by turn (nulls first), role and text, and repeated rows stay. A conversation
    is one row of output, so it must fit a row; many equal conversations are separate groups. Other columns are
    ignored. No rows give no rows."""
    template = template or ChatTemplate()
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.unionByName(rows.filter("conv_id is null").select("conv_id", F.array("t").alias("turns")))

    def segment(x: Column, loss: bool = False) -> Column:
        return F.struct(x.alias("text"), F.lit(loss).alias("loss"))

    def rendered(t: Column) -> Column:
        a, b, c = template.other
        out = F.array(segment(F.concat(F.lit(a), escape(t.role), F.lit(b))), segment(escape(t.text)), segment(F.lit(c)))
        for name, marks in template.turns.items():
            own = F.array(segment(F.lit(marks.opening)), segment(escape(t.text), marks.loss), segment(F.lit(marks.closing)))
            out = F.when(t.role == name, own).otherwise(out)
        return out

    steps = F.create_map(*[F.lit(x) for state, roles in template.allowed.items() for role in roles for x in (f"{state}>{role}", role)])
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(">"), t.role)), F.lit("none")))
    return grouped.select("conv_id", F.flatten(F.transform("turns", rendered)).alias("segments"), state.isin(*template.final).alias("valid"))


def parse_conversations(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The inverse of ``format_conversations``: ``turns`` (array of role and text) from the joined segments, and ``loss_text``,
    the unescaped text under the loss mask."""
    template = template or ChatTemplate()
    whole = F.array_join("segments.text", "")
    found = F.arrays_zip(*[F.regexp_extract_all(whole, F.lit(template.pattern()), F.lit(k)).alias(n) for k, n in ((1, "mark"), (2, "name"), (3, "body"))])

    def turn(x: Column) -> Column:
        role = unescape(x["name"])
        for name, marks in template.turns.items():
            role = F.when(x["mark"] == marks.opening, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(x["body"]).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    named = formatted.withColumn("formatted", whole).withColumn("_found", found)
    return named.withColumn("turns", F.transform("_found", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("_found")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') AS t(conv_id, turn, role, text)")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Formats all conversations and conversation -7, writes them, and derives digests from what it reads back."""
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(control_conversation(turns.sparkSession))
    back = parse_conversations(written(format_conversations(rows), "chat"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS escaped
  FROM c WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 12
    ELSE 16 + 2 * length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) END) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' END, false)
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id, alone
"""
