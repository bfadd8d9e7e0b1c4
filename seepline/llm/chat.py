"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

The machine's states are named by the role just heard, so each turn's step needs the turn before it alone,
however long a conversation is. A turn that the table of steps doesn't allow, or a last turn that may
not be last, makes the conversation invalid; it is formatted all the same, with the place of the first fault.

A template maps a role to its segments, each a piece of text with `{role}` or `{text}` and a loss flag; `*`
stands for all other roles. Inside roles and texts the backslash and the opening angle bracket are
written as `\\s` and `\\l` (and a role's line feed as `\\n`), so no text can look like a mark, and `unescape` brings them back.

Null text and null role are empty. Turns are ordered by turn (null first), then role and text; equal rows
stay beside each other. A null conversation id is a conversation of its own. An empty table gives no rows;
extra columns are not read. All of it runs as DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """segments: by role. steps: allowed (role before, role); `start` stands before the first. last: roles that may end."""

    segments: dict[str, tuple[Segment, ...]]
    steps: tuple[tuple[str, str], ...]
    last: tuple[str, ...]
    unknown: tuple[Segment, ...] = field(default=())


_MARKED = (Segment(OPEN + "{role}\n"), Segment("{text}"), Segment(CLOSE))

DEFAULT = Template(
    segments={"assistant": (Segment(OPEN + "{role}\n"), Segment("{text}", loss=True), Segment(CLOSE))},
    unknown=_MARKED,
    steps=(("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", "tool"), ("tool", "assistant")),
    last=("assistant",),
)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """After escaping, a backslash always stands before s, l or n, so the order of these steps is safe."""
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _segments(template: tuple[Segment, ...], role: Column, text: Column) -> Column:
    """The role's segments as an array of (text, loss)."""
    made = []
    for s in template:
        parts, rest = [], s.text
        while rest:
            at = min((p for p in (rest.find("{role}"), rest.find("{text}")) if p >= 0), default=len(rest))
            if at:
                parts.append(F.lit(rest[:at]))
            if at < len(rest):
                parts.append(escape_role(role) if rest.startswith("{role}", at) else escape(text))
            rest = rest[at + 6 :]
        made.append(F.struct(F.concat(F.lit(""), *parts).alias("text"), F.lit(s.loss).alias("loss")))
    return F.array(*made)


def turns(conversations: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, place (from 1), role, segments (array of text and loss), fault (the machine refuses this turn)."""
    given = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before, after = F.coalesce(F.lag("role").over(own), F.lit("start")), F.lead("role").over(own)
    allowed = F.lit(False)
    for a, b in template.steps:
        allowed = allowed | ((before == a) & (F.col("role") == b))
    ends = after.isNull() & ~F.col("role").isin(*template.last)
    made = _segments(template.unknown, F.col("role"), F.col("text"))
    for name, segments in template.segments.items():
        made = F.when(F.col("role") == name, _segments(segments, F.col("role"), F.col("text"))).otherwise(made)
    return given.select("conv_id", F.row_number().over(own).alias("place"), "role", made.alias("segments"), (~allowed | ends).alias("fault"))


def conversations(formatted_turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (in order), valid, first_fault (a place, null if valid)."""
    in_order = F.array_sort(F.collect_list(F.struct("place", "segments")))
    return (
        formatted_turns.groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), in_order.alias("t"), F.min(F.when(F.col("fault"), F.col("place"))).alias("first_fault"))
        .select("conv_id", "n_turns", F.flatten("t.segments").alias("segments"), F.col("first_fault").isNull().alias("valid"), "first_fault")
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def under_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a text formatted with the default marks."""
    parts = F.split(text, CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        role = F.substring(part, F.lit(len(OPEN) + 1), line - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, line + 1, F.length(part))).alias("text"))

    return F.transform(parts, turn)


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(15 + length(role) + length(replace(replace(text, '\', '..'), '<', '..'))
           + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), chr(10), '')))::bigint as formatted_chars
from c group by conv_id
"""
