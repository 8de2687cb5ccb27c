"""Chat formatting: layouts found by schema fingerprints, one template, and a loss mask (operator 6).

Records of many layouts share one DataFrame whose schema is the union of theirs, as a reader with an explicit schema
gives it.  A row's fingerprint is the hash of the nested field paths that it fills; a table of fingerprints selects
the declarative mapping that turns the row into canonical turns.  All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout: the paths that identify it, and how its turns come about.

    Either ``turns`` names an array of structs with ``role`` and ``text`` fields, or ``fields`` lists (role, paths):
    the filled ones among the paths, joined by a blank line, are that turn's text.  ``order`` names a field by which
    an array is sorted, if its own order isn't to be kept; equal ones are ordered by role and text.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = "role"
    text: str = "text"
    order: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("turns", ("turns[].role", "turns[].text", "turns[].turn"), "turns", order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), "messages", text="content"),
    Layout("speakers", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=SPEAKERS),
    Layout("prompt_completion", ("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("instruction", "input", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", ("system", "instruction", "output"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("question_answer", ("question", "answer"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def paths(schema: StructType, skip: Sequence[str] = ()) -> Iterator[tuple[str, Column]]:
    """(path, is it filled) of every leaf; an array's fields are filled if its elements have them, were they null or not."""

    def walk(kind, path: str, at: Column, filled: Column):
        if isinstance(kind, StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{path}.{f.name}", at[f.name], filled & at[f.name].isNotNull())
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            for f in kind.elementType.fields:
                yield f"{path}[].{f.name}", filled & (F.size(at) > 0)
        else:
            yield path, filled

    for f in schema.fields:
        if f.name not in skip:
            yield from walk(f.dataType, f.name, F.col(f"`{f.name}`"), F.col(f"`{f.name}`").isNotNull())


def fingerprint(schema: StructType, skip: Sequence[str] = ()) -> Column:
    """The hash of a row's filled paths, in alphabetical order."""
    found = sorted(paths(schema, skip), key=lambda x: x[0])
    return F.xxhash64(F.concat_ws("\n", *[F.when(filled, F.lit(path)) for path, filled in found]))


def stated(layout: Layout) -> Column:
    """The fingerprint that a layout states."""
    return F.xxhash64(F.lit("\n".join(sorted(layout.paths))))


def canonical(layout: Layout, schema: StructType) -> Column:
    """A layout's turns as array<struct<role, text>>; null roles and texts become empty."""
    if layout.turns:
        at = F.col(layout.turns)
        if layout.order:
            at = F.array_sort(F.transform(at, lambda x: F.struct(x[layout.order].alias("k"), x[layout.role].alias(layout.role), x[layout.text].alias(layout.text))))

        def turn(x: Column) -> Column:
            role = F.coalesce(x[layout.role].cast("string"), F.lit(""))
            for theirs, ours in layout.roles.items():
                role = F.when(x[layout.role] == theirs, F.lit(ours)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[layout.text].cast("string"), F.lit("")).alias("text"))

        return F.transform(at, turn)
    turns = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.col(p).cast("string") for p in given]).alias("text")) for role, given in layout.fields]
    return F.array(*turns)


def to_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, keep: Sequence[str] = ("conv_id",)) -> DataFrame:
    """``keep``, layout, turns: every record's canonical turns by the mapping that its fingerprint selects.

    Records whose fingerprint no layout states have null for both, so that nothing is guessed or dropped.
    """
    names = set(records.columns)
    own = [x for x in layouts if {p.split("[")[0].split(".")[0] for p in x.paths} <= names]
    seen = records.withColumn("_print", fingerprint(records.schema, keep))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in own:
        layout = F.when(F.col("_print") == stated(x), F.lit(x.name)).otherwise(layout)
        turns = F.when(F.col("_print") == stated(x), canonical(x, records.schema)).otherwise(turns)
    return seen.select(*keep, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """One backslash more in every ``<``, backslashes, ``|``: no control string is left, and nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``mask``.

    ``formatted`` has ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline for each turn, escaped.
    ``mask`` has a (skip, take) for each turn, in code points from the turn's mark on: ``take`` code points of text
    are learned after ``skip`` others; it is 0 for turns of other roles than ``learn``.
    """
    parts = F.transform("turns", lambda t: F.struct(_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == learn).alias("learn")))
    body = F.transform("_parts", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    skip = lambda t: F.length(t["role"]) + (len(START) + 1)
    mask = F.transform("_parts", lambda t: F.struct(skip(t).alias("skip"), F.when(t["learn"], F.length(t["text"])).otherwise(0).alias("take"), t["learn"].alias("learn")))
    return turns.withColumn("_parts", parts).withColumn("formatted", F.array_join(body, "")).withColumn("mask", mask).drop("_parts")


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``back`` (turns) and ``learned`` (texts under the mask, unescaped), from ``formatted`` and ``mask`` alone.

    A turn runs from one mark to the next, as no text holds a mark, so one pass of :func:`split` finds them all.
    """
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    whole = rendered.withColumn("_p", F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - (2 + len(END)))
        return F.struct(_unrole(role).alias("role"), unescape(text).alias("text"))

    under = F.filter(F.zip_with("_p", "mask", lambda p, m: F.when(m["learn"], F.substring(p, m["skip"] - len(START) + 1, m["take"]))), lambda x: x.isNotNull())
    return whole.withColumn("back", F.transform("_p", turn)).withColumn("learned", F.transform(under, unescape)).drop("_p")


def digests(read: DataFrame, keep: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Counts and SHA-256 digests of what :func:`read_back` found."""
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        *keep,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def gather(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows by turn to records ``key, turns`` of the layout "turns".

    Null texts and roles become empty, null turns come first, rows of equal turn are ordered by role and text and all
    kept; rows without a key form one record.  A record is one row, as its one formatted text is.
    """
    item = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(key).agg(F.collect_list(item).alias("turns"))
