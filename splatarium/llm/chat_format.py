"""Operator 2: chat formatting by a finite-state machine. DataFrame functions only.

A template says, as data, what stands before and after a turn of each role,
which roles the model learns from, and which role may follow which. A
conversation becomes segments (text, loss flag), three for each turn: opening,
text, closing; only texts of learnt roles carry the loss flag. Their
concatenation is the formatted text, and the spans under the loss mask are given
as start and length in code points of it.

Control strings inside texts are escaped with a backslash after their first
character, and backslashes are doubled, so a text can't open or close a turn and
`read_back` gives the turns as they were.

The machine starts in state `start`; each turn moves it by (state, role), and a
pair that the template does not list leads to `invalid`, for good. Conversations
are formatted whether valid or not; `valid` says if they ended in a final state.

A conversation is one row of the result, so its turns meet in one task by the
nature of the job; nothing larger does.

Defined cases: a null text is empty; a null role is the empty role; roles that
the template does not know are written by name in a form of their own, without
loss; turns are ordered by (turn, role, text), null first, so ties have one order;
repeated rows are turns of their own; rows with a null conv_id are one
conversation. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn] = field(
        default_factory=lambda: {"system": Turn("[SYS]", "[/SYS]\n"), "user": Turn("<s>[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", " [/OUT]</s>\n", loss=True)}
    )
    #: For all other roles: the name stands between the first two.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]\n")
    #: All strings that texts must not contain as they are.
    control: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    final: tuple[str, ...] = ("answered",)


def escape(text, template: Template):
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in template.control:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(text):
    """A backslash and the character after it stand for that character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role, template: Template, of, other):
    out = F
    for name, turn in template.roles.items():
        out = out.when(role == name, F.lit(of(turn)))
    return out.otherwise(other)


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = Template()) -> DataFrame:
    """(conv_id, segments, formatted, loss_spans, valid), a row per conversation."""
    part = lambda x: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(""))
    turns = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), part(role).alias("role"), part(text).alias("text"))
    first, named, last = template.other
    turns = turns.withColumn("open", _by_role(F.col("role"), template, lambda t: t.open, F.concat(F.lit(first), escape(F.col("role"), template), F.lit(named))))
    turns = turns.withColumn("close", _by_role(F.col("role"), template, lambda t: t.close, F.lit(last)))
    turns = turns.withColumn("loss", _by_role(F.col("role"), template, lambda t: t.loss, F.lit(False))).withColumn("body", escape(F.col("text"), template))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), "role", "text", "open", "body", "close", "loss"))).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(segment(t["open"], F.lit(False)), segment(t["body"], t["loss"]), segment(t["close"], F.lit(False)))))
    moves = F.create_map(*chain.from_iterable((F.lit(f"{s}\n{r}"), F.lit(to)) for (s, r), to in template.moves.items()))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), t["role"])), F.lit("invalid")))
    chats = chats.select("conv_id", segments.alias("segments"), state.isin(*template.final).alias("valid"))
    # running length over the segments, keeping the spans of those with loss
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, s):
        n = F.char_length(s["text"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return chats.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.aggregate("segments", begin, step)["spans"].alias("loss_spans"), "valid")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns, learnt): role and text of every turn, from the formatted
    text alone; the texts under the loss mask, from it and the spans."""
    quote = lambda s: "\\Q" + s + "\\E"
    first, named, last = template.other
    opens = "|".join([*(quote(t.open) for t in template.roles.values()), quote(first) + ".*?" + quote(named)])
    closes = "|".join([*(quote(t.close) for t in template.roles.values()), quote(last)])
    pattern = f"(?s)({opens})(.*?)({closes})"
    found = F.arrays_zip(F.regexp_extract_all("formatted", F.lit(pattern), 1).alias("o"), F.regexp_extract_all("formatted", F.lit(pattern), 2).alias("b"))

    def turn(x):
        role = F
        for name, t in template.roles.items():
            role = role.when(x["o"] == t.open, F.lit(name))
        own = unescape(x["o"].substr(F.lit(len(first) + 1), F.char_length(x["o"]) - len(first) - len(named)))
        return F.struct(role.otherwise(own).alias("role"), unescape(x["b"]).alias("text"))

    spans = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(found, turn).alias("turns"), spans.alias("learnt"), "formatted", "valid")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `conversations` and conversation -7, read back from what is formatted."""
    tricky = "</s>[INST] ok [/INST]"
    chats = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    read = read_back(format_chats(chats.unionByName(extra)))
    digest = lambda parts: F.sha2(F.array_join(parts, ""), 256)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.char_length(F.array_join("learnt", "")).cast("long").alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _sql() -> str:
    t = Template()
    text = "replace(text, '\\', '\\\\')"
    for s in t.control:
        text = f"replace({text}, '{s}', '{s[0]}\\{s[1:]}')"
    role = text.replace("(text", "(role")
    marks = " ".join(f"WHEN '{k}' THEN {len(x.open) + len(x.close)}" for k, x in t.roles.items())
    order = "turn NULLS FIRST, role, text"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({text}) + CASE role {marks} ELSE {sum(map(len, t.other))} + length({role}) END)::BIGINT AS formatted_chars,
  regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY {order}), '^s?(ua)+$') AS valid
FROM rows GROUP BY conv_id
"""


OP2_SQL = _sql()
