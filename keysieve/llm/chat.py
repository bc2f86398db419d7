"""Chat conversations as marked text segments with loss flags.

A template declares, as data, how a turn is marked, which roles carry loss and which
role may follow which. The last relation is a finite-state machine whose states are the
roles (and a start): turns move it, and a move that the template lacks marks the turn.
Because the state after a turn is its role, a turn needs only the role before it;
conversations are cut into blocks of turns, and a block's first turn looks up the last
role of the block before, so a conversation of any length spreads over tasks.

Control strings inside texts are escaped: a ``<`` that backslashes or nothing part from
a ``|`` gets one more backslash. Taking one away again restores the text exactly.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles with loss, and for each state the roles that may come next."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })


CHATML = Template()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes double and line feeds become ``\\n`` before control strings are escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text): place, segments with loss flags, validity.

    ``segments`` is an array of (text, loss); joined over the rows of a conversation in the
    order of ``block`` and ``place`` it is the formatted conversation. Null roles and texts
    are empty. Null turns come first, equal turns are ordered by role and text. A null
    conv_id is a conversation like any other. ``valid`` says whether the turn may stand
    where it does; invalid turns are formatted all the same.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("long").alias("block"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    placed = rows.withColumns({"place": F.row_number().over(inside), "before": F.lag("role").over(inside)})
    last = rows.groupBy("conv_id", "block").agg(F.max_by("role", F.struct("turn", "role")).alias("role"))
    carried = last.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        F.lag("role").over(Window.partitionBy("conv_id").orderBy("block")).alias("_carried"),
    )
    joined = placed.join(
        carried, placed["conv_id"].eqNullSafe(carried["_conv"]) & (placed["block"] == carried["_block"]), "left"
    )
    state = F.coalesce("before", "_carried", F.lit(""))
    allowed = F.create_map(*(x for a, b in template.moves.items() for x in (F.lit(a), F.array(*map(F.lit, b)))))
    valid = F.coalesce(F.array_contains(F.element_at(allowed, state), F.col("role")), F.lit(False))

    def segment(value: Column, loss) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    head = F.concat(F.lit(template.begin), escaped_role(F.col("role")), F.lit(template.after_role))
    segments = F.array(
        segment(head, F.lit(False)), segment(escaped(F.col("text")), F.col("role").isin(*template.loss_roles)),
        segment(F.lit(template.end), F.lit(False)),
    )
    return joined.select("conv_id", "block", "place", segments.alias("segments"), valid.alias("valid"))


def read_turn(formatted: str, template: Template = CHATML) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (formatted.startswith(template.begin) and formatted.endswith(template.end)):
        raise ValueError(f"not a turn: {formatted[:40]!r}")
    role, _, text = formatted[len(template.begin) : len(formatted) - len(template.end)].partition(template.after_role)
    return unescaped_role(role), unescaped(text)


def conversation_digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation, read back from its segments: turns, digests of all text and of text under loss.

    Digests are streamed over the sorted rows of a task; no conversation is held whole.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []

        def ended() -> None:
            if now is not None:
                out.append((now["id"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["valid"]))

        for frame in frames:
            for conv, segments, valid in zip(frame["conv_id"], frame["segments"], frame["valid"]):
                conv = None if pd.isna(conv) else conv
                if now is None or conv != now["id"]:
                    ended()
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True}
                whole = "".join(s["text"] for s in segments)
                role, text = read_turn(whole, template)
                now["turns"] += 1
                now["chars"] += len(whole)
                now["valid"] = now["valid"] and bool(valid)
                now["all"].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = unescaped(s["text"])
                        now["loss_chars"] += len(plain)
                        now["loss"].update(plain.encode())
            if out:
                yield pd.DataFrame(out, columns=_DIGESTS)
                out = []
        ended()
        if out:
            yield pd.DataFrame(out, columns=_DIGESTS)

    # Ids travel as text, so that a null among them turns no other into a float.
    rows = (
        formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
        .select(F.col("conv_id").cast("string").alias("conv_id"), "segments", "valid")
    )
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return rows.mapInPandas(read, schema).withColumn("conv_id", F.col("conv_id").cast(id_type))


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
