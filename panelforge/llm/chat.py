"""Chat formatting by grammar round trip, with DataFrame expressions only.

A conversation is rendered with plain texts, read back by a deterministic parser and compared with its turns. Where they
differ, some text conflicts with the template: its control strings are escaped, and the rendering is parsed and compared
again. A control string is escaped by one backslash after its first character, and one that already carries backslashes
by one more, so that taking one backslash from each gives every text back and no control string is left inside a text;
the second comparison therefore holds, and a row for which it does not is refused.

    conversation := turn*
    turn := "[SYS]" text "[/SYS]" | "[INST]" text "[/INST]" | "<s>" text "</s>" | "[ROLE]" text "[/ROLE][TURN]" text "[/TURN]"

for the roles system, user, assistant and any other. The parser cuts at control strings, each of which begins and ends
with characters that stand nowhere else in it, so that none can straddle a text and a mark: the grammar is regular and
each cut has one reading.

Defined results: a null text or role is empty; turns stand by turn (null first), then role and text; repeated rows are
turns of their own; the rows of a null conv_id are one conversation; an empty table gives no row; extra columns are
not read. A conversation is one row of the result, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import only, table

MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TURN = ("[ROLE]", "[/ROLE]"), ("[TURN]", "[/TURN]")
LEARNED = "assistant"
CONTROL = r"</?s>|\[/?(?:SYS|INST|ROLE|TURN)\]"
#: A control string with any number of backslashes after its first character.
ESCAPABLE = r"([<\[])(\\*/?(?:s>|(?:SYS|INST|ROLE|TURN)\]))"
ESCAPED = r"([<\[])\\(\\*/?(?:s>|(?:SYS|INST|ROLE|TURN)\]))"
_PARTS = "array<struct<open: string, close: string, before: string, text: string, last_open: string, last_text: string>>"
#: The added conversation: both texts are made of control strings.
HARD_ID, HARD_TEXT = -1, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _let(value: Column, then) -> Column:
    """then(value), the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _head(turn: Column) -> Column:
    """What stands before a turn's text; an unknown role is written out."""
    other = F.concat(F.lit(ROLE[0]), turn["role"], F.lit(ROLE[1] + TURN[0]))
    head = None
    for role, (mark, _) in MARKS.items():
        known = turn["role"] == role
        head = F.when(known, F.lit(mark)) if head is None else head.when(known, F.lit(mark))
    return head.otherwise(other)


def _tail(turn: Column) -> Column:
    tail = None
    for role, (_, mark) in MARKS.items():
        known = turn["role"] == role
        tail = F.when(known, F.lit(mark)) if tail is None else tail.when(known, F.lit(mark))
    return tail.otherwise(F.lit(TURN[1]))


def render(turns: Column) -> Column:
    """The text of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], _tail(t))), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a text of the grammar, unescaped; null where the text is none."""
    tokens = F.struct(F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)).alias("marks"), F.split(formatted, CONTROL, -1).alias("texts"))
    return _let(tokens, _turns)


def _turns(tokens: Column) -> Column:
    marks, texts = tokens["marks"], tokens["texts"]
    count = F.size(marks)

    def part(i: Column) -> Column:
        at = 2 * i
        return F.struct(
            F.get(marks, at).alias("open"), F.get(marks, at + 1).alias("close"), F.get(texts, at).alias("before"), F.get(texts, at + 1).alias("text"),
            F.when(i > 0, F.get(marks, at - 2)).otherwise(F.lit("")).alias("last_open"), F.when(i > 0, F.get(texts, at - 1)).alias("last_text"),
        )

    parts = F.when(count > 1, F.transform(F.sequence(F.lit(0), F.floor(count / 2).cast("int") - 1), part)).otherwise(F.array().cast(_PARTS))

    def proper(p: Column) -> Column:
        pairs = [*MARKS.values(), ROLE, TURN]
        paired = F.lit(False)
        for mark, end in pairs:
            paired = paired | ((p["open"] == mark) & (p["close"] == end))
        return paired & (p["before"] == "") & ((p["open"] == TURN[0]) == (p["last_open"] == ROLE[0]))

    def turn(p: Column) -> Column:
        role = unescape(p["last_text"])
        for name, (mark, _) in MARKS.items():
            role = F.when(p["open"] == mark, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(p["text"]).alias("text"))

    whole = (count % 2 == 0) & (F.element_at(texts, -1) == "") & (F.coalesce(F.get(marks, count - 2), F.lit("")) != ROLE[0])
    return _let(parts, lambda ps: F.when(whole & F.forall(ps, proper), F.transform(F.filter(ps, lambda p: p["open"] != ROLE[0]), turn)))


def _escaped(turns: Column) -> Column:
    known = lambda t: t["role"].isin(*MARKS)
    role = lambda t: F.when(known(t), t["role"]).otherwise(escape(t["role"]))
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), escape(t["text"]).alias("text")))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array of (start, length)): spans are the places of the assistant texts in
    formatted, in code points from 0."""
    rows = only(conversations, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = F.col("turns")
    same = lambda written: parse(render(written)).eqNullSafe(plain)
    refused = F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("array<struct<role: string, text: string>>")
    escaped = _let(_escaped(plain), lambda ts: F.when(same(ts), ts).otherwise(refused))
    written = grouped.select("conv_id", F.when(same(plain), plain).otherwise(escaped).alias("written"))
    # places are running sums over the rows of a conversation, which stay where the grouping has put them
    each = written.select("conv_id", F.posexplode("written").alias("place", "t"))
    each = each.select("conv_id", "place", _head(F.col("t")).alias("head"), F.col("t.text").alias("text"), _tail(F.col("t")).alias("tail"), (F.col("t.role") == LEARNED).alias("learned"))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("head") + F.length("text") + F.length("tail")
    before = F.sum(size).over(so_far) - size + F.length("head")
    each = each.select("conv_id", F.struct("place", F.concat("head", "text", "tail").alias("piece"), "learned", before.alias("start"), F.length("text").cast("long").alias("length")).alias("p"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    spans = F.transform(F.filter("ps", lambda p: p["learned"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.col("ps.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = [F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(HARD_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))]
    hard = spark.range(1).select(F.lit(HARD_ID).alias("conv_id"), F.inline(F.array(*said)))
    made = formatted_conversations(rows.unionByName(hard.select(*[F.col(c).cast(t) for c, t in rows.dtypes])))
    read = made.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_marks(place: int) -> str:
    known = " ".join(f"WHEN '{role}' THEN {len(marks[place])}" for role, marks in MARKS.items())
    other = f"{len(''.join(ROLE)) + len(TURN[0])} + length(regexp_replace(role, '{ESCAPABLE}', '\\1\\\\\\2', 'g'))" if place == 0 else str(len(TURN[1]))
    return f"CASE role {known} ELSE {other} END"


ORACLE = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {HARD_ID}, unnest([0, 1]), unnest(['user', 'assistant']), '{HARD_TEXT}'),
e AS (SELECT *, length(regexp_replace(text, '{ESCAPABLE}', '\\1\\\\\\2', 'g')) + {_sql_marks(0)} + {_sql_marks(1)} AS size FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '') AS learned, sum(size) AS size FROM e GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, size::BIGINT AS formatted_chars FROM g"""
