"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

A conversation becomes segments (text, loss). Control strings inside texts are escaped with a backslash, so the
formatted text can be read back: ``read_turns`` and ``loss_text`` invert the template.

Defined results: turns are taken by (turn, role, text), so ties and repeated rows have one order; null texts and
roles are empty; an unknown role, of any length, gets a header of its own, is never under the loss mask and fails the
machine; rows with a null conv_id form one conversation; empty tables give empty results; other columns are ignored.
A conversation is the unit of the result, one formatted text and its digests, so one task holds one conversation at a
time; it may have up to 2^31 bytes, the limit of a string. Conversations are independent and dealt out by conv_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """headers: the name shown for each role. moves: state -> {role: next state}. All states but accepting ones
    and any role without a move end in "rejected"."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    open_turn: str = "### "
    after_role: str = ": "
    close_turn: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)
    #: What a text may not hold bare. Each starts with another character than the escape's and has no line end.
    controls: tuple[str, ...] = ("###", "</turn>")


DEFAULT = ChatTemplate()
REJECTED = "rejected"


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    """A backslash before each backslash and each control string."""
    return F.regexp_replace(text, "(" + "|".join([r"\\", *map(_literal, template.controls)]) + ")", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column, template: ChatTemplate) -> Column:
    """Known roles show their names; others show = and the role with a backslash before each special character."""
    shown = F.concat(F.lit("="), F.regexp_replace(role, r"(?s)([\\:<#=\n])", r"\\$1"))
    for known, name in template.headers.items():
        shown = F.when(role == known, F.lit(name)).otherwise(shown)
    return F.concat(F.lit(template.open_turn), shown, F.lit(template.after_role))


def format_conversations(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, valid, final_state, segments array<struct<text, loss>>, formatted."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    table_of = F.create_map(*[F.lit(x) for state, to in template.moves.items() for role, nxt in to.items() for x in (f"{state}>{role}", nxt)])
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.element_at(table_of, F.concat(s, F.lit(">"), t["role"])), F.lit(REJECTED)))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(_header(t["role"], template), F.lit(False)),
                segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.close_turn), F.lit(False)),
            ),
        )
    )
    return (
        convs.select("conv_id", state.alias("final_state"), segments.alias("segments"))
        .select("conv_id", F.col("final_state").isin(*template.accepting).alias("valid"), "final_state", "segments",
                F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_turns(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """array<struct<role, text>> from a formatted text. An escaped text never holds the end of a turn, as its
    control string always follows a backslash there and a space here."""
    parts = F.split(formatted, _literal(template.close_turn))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # Possessive, so that the engine loops instead of recursing: a role may be as long as a text.
    head = rf"(?s)^{_literal(template.open_turn)}((?:[^\\:]++|\\.)*+){_literal(template.after_role)}(.*)$"

    def role(part: Column) -> Column:
        shown = F.regexp_extract(part, head, 1)
        got = unescape(F.substring(shown, 2, 2**31 - 1))
        for known, name in template.headers.items():
            got = F.when(shown == name, F.lit(known)).otherwise(got)
        return got

    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = format_conversations(rows.unionByName(extra))
    back = out.select("conv_id", "valid", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss_text"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt,
  length('### : ' || ' </turn>' || chr(10)) + length(CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '=' || regexp_replace(role, '([\\:<#=\n])', '\\\1', 'g') END)
  + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS chars FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN role = 'system' THEN was IS NULL WHEN role = 'user' THEN was IS NULL OR was IN ('system', 'assistant') ELSE role = 'assistant' AND coalesce(was, '') = 'user' END AND (nxt IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""
