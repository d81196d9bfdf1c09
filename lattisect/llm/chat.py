"""Chat formatting as relational algebra: turns are collected and sorted, neighbours of one role merged,
and everything concatenated by Spark expressions.

The output marks each block of turns by control strings. Inside texts, a control string gets a
backslash after its first character (one more where backslashes stand there already), so no text can
pass for a mark, and taking one backslash away again gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Control strings: what opens and closes a block of each role, what parts the turns merged in a block.
OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
OTHER_OPEN, OTHER_CLOSE = "[ROLE]", "[/ROLE]"
NEXT = "[NEXT]"

_TAIL = r"(/?INST\]|/?ROLE\]|NEXT\]|/?s>|</?SYS>>)"
_ESCAPE = r"([\[<])(\\*)" + _TAIL
_UNESCAPE = r"([\[<])\\(\\*)" + _TAIL
_BLOCK = r"(?s)(\[INST\]|<s>|<<SYS>>|\[ROLE\])(.*?)(\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _by_role(role: Column, marks: dict[str, str], other: str | Column) -> Column:
    out = None
    for name, mark in marks.items():
        out = F.when(role == name, mark) if out is None else out.when(role == name, mark)
    return out.otherwise(other)


def formatted(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    out: str = "formatted",
) -> DataFrame:
    """One row per conversation: ``id_col`` and ``out``, the conversation as one string.

    Turns are ordered by ``turn_col`` (nulls first); equal ones by role, then by text. Null texts and
    null roles count as empty. Rows with a null id make one conversation of their own, and an empty
    table gives an empty table. Other columns are left out, whatever their names. A conversation becomes one
    string, so its turns meet in one row: that is the unit of the output and must fit in one.
    """
    rows = turns.select(
        F.col(id_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("__turn"),
    )
    sorted_turns = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))

    def merged(all_turns: Column) -> Column:
        """The runs of turns of one role, in order, each as an array: what stands between two starts."""
        n = F.size(all_turns)
        places = F.sequence(F.lit(0), n - 1)
        begins = F.filter(places, lambda i: F.when(i == 0, True).otherwise(all_turns[F.greatest(i - 1, F.lit(0))]["role"] != all_turns[i]["role"]))
        return let(begins, lambda at: F.transform(at, lambda i, k: F.slice(all_turns, i + 1, F.when(k + 1 < F.size(at), at[F.least(k + 1, F.size(at) - 1)]).otherwise(n) - i)))

    def told(block: Column) -> Column:
        """A run as one text: its marks, and its turns with a mark between them."""
        role = block[0]["role"]
        head = _by_role(role, OPEN, F.concat(F.lit(OTHER_OPEN), escaped(role), F.lit(NEXT)))
        return F.concat(head, F.array_join(F.transform(block, lambda t: escaped(t["text"])), NEXT), _by_role(role, CLOSE, OTHER_CLOSE))

    return sorted_turns.select(F.col(id_col), F.array_join(F.transform(let(F.col("__turns"), merged), told), "").alias(out))


def parsed(chats: DataFrame, id_col: str = "conv_id", out: str = "formatted", into: str = "turns") -> DataFrame:
    """``formatted`` undone: ``id_col``, ``out`` and ``into``, array<struct<role, text>> in order."""
    text = F.col(out)
    role_of = {mark: role for role, mark in OPEN.items()}
    blocks = F.zip_with(
        F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(2)),
        lambda mark, body: F.struct(mark.alias("mark"), F.split(body, r"\[NEXT\]", -1).alias("parts")),
    )

    def turns_of(b: Column) -> Column:
        other = b["mark"] == OTHER_OPEN
        role = F.when(other, unescaped(b["parts"][0])).otherwise(_by_role(b["mark"], role_of, ""))
        texts = F.when(other, F.slice(b["parts"], 2, F.size(b["parts"]))).otherwise(b["parts"])
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return chats.select(F.col(id_col), text, F.flatten(F.transform(blocks, turns_of)).alias(into))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant's, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digest(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What is read back from ``formatted``'s output, as counts and digests."""
    read = parsed(chats, id_col)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss_text(F.col("turns"))).cast("long").alias("loss_chars"),
        F.sha2(loss_text(F.col("turns")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
