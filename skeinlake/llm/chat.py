"""Chat formatting with a grammar that is read back.

A conversation becomes one text: each turn stands between the marks of its role. Texts may
hold such marks themselves, so every turn is rendered, parsed again and compared to its
source, and is escaped a step further until both are identical; the whole conversation is
parsed and compared once more before it leaves. All of it is column expressions.

Grammar: ``turn*``, a turn is ``<<SYS>>text<</SYS>>`` (system), ``[INST]text[/INST]`` (user),
``<s>text</s>`` (assistant) or ``<turn>n:role text</turn>`` (any other role, n characters
long, directly followed by the text). Escaping puts one backslash behind the first character
of each mark and of each mark that already has some there; unescaping takes one away, so
the two are inverse and a text without any is left as it is. No mark ends in another one, so
a mark cannot arise across the border of a text and its marks.

Defined cases: a null role or text is empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have one order and all stay; rows without a conversation id
form one conversation whose id is null; an empty table has no conversations; other columns
are not read. A conversation is one row of the result, which bounds its length to what a
row may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks by role; the last pair is for every other role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), None: ("<turn>", "</turn>")}
_OPEN = r"(?:<<SYS>>|\[INST\]|<s>|<turn>)"
_TURN = rf"(?s){_OPEN}.*?(?:<</SYS>>|\[/INST\]|</s>|</turn>)"
#: A mark, possibly escaped: its first character, backslashes, the rest.
_MARK = r"([<\[])(\\*)(</?SYS>>|/?INST\]|/?s>|/?turn>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\" + _MARK.removeprefix(r"([<\[])"), "$1$2$3")


#: Tried in this order for each turn.
LEVELS = (lambda text: text, escaped)


def _by_role(role: Column, pick) -> Column:
    out = F.when(F.lit(False), "")
    for name, value in MARKS.items():
        out = out.otherwise(pick(None, value)) if name is None else out.when(role == name, pick(name, value))
    return out


def _body(role: Column, text: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant"), text).otherwise(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def rendered(role: Column, text: Column, level: int) -> Column:
    """One turn at a level of escaping."""
    mark = lambda k: _by_role(role, lambda _, m: F.lit(m[k]))
    return F.concat(mark(0), LEVELS[level](_body(role, text)), mark(1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def parsed(formatted: Column) -> Column:
    """Array of (role, text) of a formatted text; null if it isn't a sequence of whole turns with nothing between and no marks inside."""

    def one(turn: Column) -> Column:
        inside, role = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (start, end) in MARKS.items():
            fits = turn.startswith(start) & turn.endswith(end)
            inside = F.when(fits, F.substring(turn, F.lit(len(start) + 1), F.char_length(turn) - len(start) - len(end))).otherwise(inside)
            role = F.when(fits, name or "").otherwise(role)
        return _let(F.struct(role.alias("role"), inside.alias("text")), read)

    def read(x: Column) -> Column:
        plain = F.struct(x["role"].alias("role"), unescaped(x["text"]).alias("text"))
        size = F.regexp_extract(x["text"], "^([0-9]{1,9}):", 1)
        return F.when(~x["text"].rlike(_OPEN), F.when(x["role"] != "", plain).when(size != "", _let(plain, named)))

    def named(x: Column) -> Column:
        size = F.regexp_extract(x["text"], "^([0-9]{1,9}):", 1)
        after, n = F.length(size) + 2, size.cast("int")
        return F.struct(F.substring(x["text"], after, n).alias("role"), F.substring(x["text"], after + n, F.length(x["text"])).alias("text"))

    whole = lambda turns: F.when(F.array_join(turns, "") == formatted, _let(F.transform(turns, one), lambda t: F.when(F.forall(t, lambda x: x.isNotNull()), t)))
    return _let(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), whole)


def _chosen(role: Column, text: Column) -> Column:
    """The turn at the first level from which it is read back as it was."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    out = F.raise_error(F.lit("a turn cannot be rendered so that it is read back"))
    for level in reversed(range(len(LEVELS))):
        out = _let(rendered(role, text, level), lambda form, rest=out: F.when(F.coalesce(parsed(form) == source, F.lit(False)), form).otherwise(rest))
    return out


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: the text of each conversation and the byte spans (start, bytes) of what is learnt from.

    The spans cover what stands between the marks of assistants, in order, as bytes of the
    UTF-8 text. The one shuffle brings the turns of a conversation together; a window gives
    each turn its place before they are joined.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    turns = turns.withColumn("form", _chosen(F.col("role"), F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda k: _by_role(F.col("role"), lambda _, m: F.lit(len(m[k])))
    start = F.coalesce(F.sum(F.octet_length("form").cast("long")).over(before), F.lit(0).cast("long"))
    placed = turns.withColumn("k", F.coalesce(F.sum(F.lit(1).cast("long")).over(before), F.lit(0).cast("long"))).withColumn("start", start + mark(0)).withColumn("bytes", F.octet_length("form") - mark(0) - mark(1))
    met = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "form", "start", "bytes"))).alias("t"))
    whole = met.select(
        "conv_id",
        F.array_join(F.col("t.form"), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["bytes"].alias("bytes"))).alias("loss_spans"),
    )
    same = F.coalesce(parsed(F.col("formatted")) == F.col("source"), F.lit(False))
    return whole.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was"))).alias("formatted"), "loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped; the bytes are taken once, so that each span costs its own length."""
    return F.element_at(F.transform(F.array(formatted.cast("binary")), lambda b: F.array_join(F.transform(spans, lambda s: unescaped(F.substring(b, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")), 1)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text and its spans."""
    read = formatted.select("conv_id", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
