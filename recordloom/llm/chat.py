"""Conversations from event logs to marked-up training text, in SQL functions only.

Events of a conversation, ordered by sequence number (ties by turn, kind, role,
text), are folded into messages:

* ``message`` opens a message with its text,
* ``delta`` adds its text to the message of its turn (opened if need be),
* ``edit`` replaces the text of its turn and drops all later messages,
* ``regenerate`` empties the message of its turn and drops all later ones, so
  that new deltas fill it.

An edit or a regeneration of a turn that has no message opens one; events of
other kinds, or of none, change nothing.

Template: ``<|turn|>role<|says|>text<|end|>\\n`` for each message. Control
strings of this and of other common templates are escaped inside roles and
texts by a backslash after their first character; backslashes that stand there
already get one more, so unescaping gives back every text exactly. The output is
an array of segments with a loss mark; the formatted text is the segments joined,
and only assistant texts are under the mask.

Edge cases: null texts and roles are empty; conversations keep rows with equal
turns as messages of their own (ordered by role and text); a null conversation id
is a conversation; an empty table gives an empty result. A conversation is one
row of output, so it has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
# What may follow the first character of a control string, and the escapes before it.
_TAILS = r"(\||/?s>|/?INST\]|</?SYS>>)"
_PLAIN = r"([<\[])(\\*)" + _TAILS
_ESCAPED = r"([<\[])(\\*)\\" + _TAILS
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _cut(rows: DataFrame, name: str, into: str, starts: str) -> DataFrame:
    """Cut the array ``name`` into arrays that start where ``starts`` holds for element i; one pass over it."""
    marked = rows.withColumn("_at", F.expr(f"filter(sequence(0, size({name}) - 1), i -> CASE WHEN i = 0 THEN true ELSE {starts} END)"))
    part = f"slice({name}, s + 1, coalesce(get(_at, r + 1), size({name})) - s)"
    return marked.select("conv_id", F.expr(f"transform(_at, (s, r) -> {part})").alias(into))


def fold(events: DataFrame) -> DataFrame:
    """conv_id and messages (turn, role, text) from events (conv_id, seq, kind, turn, role, text).

    Sorted events are first brought together, so that a step of the fold is more
    than an event: messages one after another, or deltas of one turn, are a run;
    a run of messages and the changes of its last one that follow at once are a
    chapter; chapters one after another are a block. A block of new turns is
    appended as it is; any other goes through the fold run by run.
    """
    turn = events.schema["turn"].dataType.simpleString()
    kind = f"struct<turn:{turn},role:string,text:string>"
    log = events.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "turn", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("log")
    )
    runs = _cut(log, "log", "runs", "NOT (log[i].kind = log[i - 1].kind AND (log[i].kind = 'message' OR log[i].kind = 'delta' AND log[i].turn <=> log[i - 1].turn))")
    own = "transform(x, e -> named_struct('turn', e.turn, 'role', e.role, 'text', e.text))"
    joined = "CASE WHEN x[0].kind = 'regenerate' THEN '' ELSE array_join(transform(x, e -> e.text), '') END"
    run = f"named_struct('kind', x[0].kind, 'turn', element_at(x, -1).turn, 'own', {own}, 'text', {joined})"
    runs = runs.select("conv_id", F.expr(f"transform(runs, x -> {run})").alias("runs"))
    chapters = _cut(runs, "runs", "chapters", "NOT (runs[i].kind IN ('delta', 'edit', 'regenerate') AND runs[i].turn <=> runs[i - 1].turn)")
    blocks = _cut(chapters, "chapters", "blocks", "NOT (chapters[i][0].kind = 'message' AND chapters[i - 1][0].kind = 'message')")
    said = "aggregate(slice(x, 2, size(x)), element_at(x[0].own, -1).text, (t, e) -> CASE WHEN e.kind = 'delta' THEN concat(t, e.text) ELSE e.text END)"
    told = f"concat(slice(x[0].own, 1, size(x[0].own) - 1), array(named_struct('turn', x[0].turn, 'role', element_at(x[0].own, -1).role, 'text', {said})))"
    block = f"named_struct('own', CASE WHEN b[0][0].kind = 'message' THEN flatten(transform(b, x -> {told})) ELSE cast(array() AS array<{kind}>) END, 'runs', flatten(b))"
    blocks = blocks.select("conv_id", F.expr(f"transform(blocks, b -> {block})").alias("blocks"))

    # The last message stands by itself: most changes concern no other.
    state = "named_struct('turns', {turns}, 'messages', {messages}, 'last', {last})"
    so_far = "concat(acc.messages, filter(array(acc.last), m -> m IS NOT NULL))"

    def opened(own: str) -> str:
        return state.format(turns=f"concat(acc.turns, transform({own}, x -> x.turn))", messages=f"concat({so_far}, slice({own}, 1, size({own}) - 1))", last=f"element_at({own}, -1)")

    def changed(held: str) -> str:
        text = f"CASE WHEN e.kind = 'delta' THEN concat({held}.text, e.text) ELSE e.text END"
        return f"named_struct('turn', {held}.turn, 'role', {held}.role, 'text', {text})"

    inner = "acc.messages[p - 1]"
    added = state.format(turns="concat(acc.turns, array(e.turn))", messages=so_far, last="named_struct('turn', e.turn, 'role', e.own[0].role, 'text', e.text)")
    streamed = f"concat(slice(acc.messages, 1, p - 1), array({changed(inner)}), slice(acc.messages, p + 1, size(acc.messages)))"
    # p is where the turn of the run is among the messages, 0 if it is not.
    step = f"""element_at(transform(array(cast(coalesce(array_position(acc.turns, e.turn), 0) AS int)), p -> CASE
        WHEN e.kind = 'message' THEN {opened("e.own")}
        WHEN e.kind NOT IN ('delta', 'edit', 'regenerate') THEN acc
        WHEN p = 0 THEN {added}
        WHEN p = size(acc.turns) THEN {state.format(turns="acc.turns", messages="acc.messages", last=changed("acc.last"))}
        WHEN e.kind = 'delta' THEN {state.format(turns="acc.turns", messages=streamed, last="acc.last")}
        ELSE {state.format(turns="slice(acc.turns, 1, p)", messages="slice(acc.messages, 1, p - 1)", last=changed(inner))} END), 1)"""
    turns = "transform(b.own, x -> x.turn)"
    new = f"size(b.own) > 0 AND size(array_distinct({turns})) = size(b.own) AND NOT coalesce(arrays_overlap(acc.turns, {turns}), true)"
    stepped = f"CASE WHEN {new} THEN {opened('b.own')} ELSE aggregate(b.runs, acc, (acc, e) -> {step}) END"
    start = state.format(turns=f"cast(array() AS array<{turn}>)", messages=f"cast(array() AS array<{kind}>)", last=f"cast(NULL AS {kind})")
    return blocks.select("conv_id", F.expr(f"aggregate(blocks, {start}, (acc, b) -> {stepped}, acc -> {so_far})").alias("messages"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, segments (text, loss) and formatted from conv_id and messages."""

    def pieces(m: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(TURN), escape(m["role"]), F.lit(SAYS)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(m["text"]).alias("text"), (m["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    out = conversations.withColumn("segments", F.flatten(F.transform("messages", pieces)))
    return out.select("conv_id", "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, segments and the messages (role, text) that the formatted text holds."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.size(F.split("formatted", r"<\|turn\|>")))

    def message(part: Column) -> Column:
        role = F.substring_index(part, SAYS, 1)
        said = F.substring(part, F.length(role) + len(SAYS) + 1, F.length(part) - F.length(role) - len(SAYS) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(said).alias("text"))

    return rendered.withColumn("messages", F.transform(parts, message))


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    back = read_back(rendered)
    turns = F.concat_ws("", F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    back = back.select("conv_id", "messages", "formatted", turns.alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as events: every row is a message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
