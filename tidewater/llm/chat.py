"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<s>" role "\\n" text "</s>\\n"

role and text hold no control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``,
``<</SYS>>``); a backslash makes the next character plain. A conversation is rendered as it is, read back
by the grammar and compared with its turns; turns that do not come back are escaped, then all turns,
until source and reading are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_PLAIN = r"(?:\\.|(?!" + _CONTROL.pattern + r")[^\\])"
_TURN = re.compile(rf"<s>((?:(?!\n){_PLAIN})*)\n({_PLAIN}*)</s>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_QUICK = re.compile(r"<s>([^\\\n<\[]*)\n([^\\<\[]*)</s>\n")


def escape(text: str, role: bool = False) -> str:
    """Reversible: no control string is left, and no newline in a role."""
    text = text.replace("\\", "\\\\")
    while m := _CONTROL.search(text):
        text = text[: m.start() + 1] + "\\" + text[m.start() + 1 :]
    return text.replace("\n", "\\\n") if role else text


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation, or None where the grammar does not fit."""
    turns, at = [], 0
    while at < len(rendered):
        m = _QUICK.match(rendered, at) or _TURN.match(rendered, at)
        if not m:
            return None
        turns.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """(text, turns read back from it); the reading equals the source."""
    raw = ["<s>" + role + "\n" + text + "</s>\n" for role, text in turns]
    safe = [f"<s>{escape(role, True)}\n{escape(text)}</s>\n" for role, text in turns]
    if parse(out := "".join(raw)) != turns:
        single = [r if parse(r) == [t] else s for r, s, t in zip(raw, safe, turns, strict=True)]
        if parse(out := "".join(single)) != turns:
            out = "".join(safe)
    if (found := parse(out)) != turns:
        raise ValueError("a conversation does not survive its own template")
    return out, found


def loss_spans(rendered: str) -> list[tuple[int, int]]:
    """Offsets of the (escaped) text of assistant turns in a rendered conversation."""
    return [m.span(2) for m in _TURN.finditer(rendered) if _ESCAPED.sub(r"\1", m[1]) == "assistant"]


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_starts, loss_ends): one row a conversation, turns in order.

    Null texts and roles are empty; rows with a null conversation id make one conversation of their own
    with a null id; null turns come first; ties of turn are ordered by role, then text, and repeated rows
    are repeated turns. Ids may be of any type that is printed and read back, such as text. An empty table gives an empty result; other columns are not read. Rows arrive
    sorted and stream through the task, so that only the conversation at hand is held.
    """

    def done(key, turns):
        out, _ = render(turns)
        spans = loss_spans(out)
        return key, len(turns), out, [a for a, _ in spans], [b for _, b in spans]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"]
        key, turns, out = None, [], []
        for batch in batches:
            for c, r, t in zip(batch["k"], batch["r"], batch["t"], strict=True):
                if c != key and turns:
                    out.append(done(key, turns))
                    turns = []
                key = c
                turns.append((r, t))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if turns:
            yield pd.DataFrame([done(key, turns)], columns=names)

    own = rows.select(F.coalesce(F.concat(F.lit(":"), F.col(conv).cast("string")), F.lit("")).alias("k"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    dealt = own.repartition("k").sortWithinPartitions("k", "n", "r", "t")
    out = dealt.select("k", "r", "t").mapInPandas(run, "conv_id string, n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>")
    return out.withColumn("conv_id", F.when(F.col("conv_id") != "", F.substring("conv_id", 2, 1 << 30)).cast(rows.schema[conv].dataType))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, text, starts, ends in zip(batch["conv_id"], batch["formatted"], batch["loss_starts"], batch["loss_ends"], strict=True):
                turns = parse(text)
                loss = "".join(_ESCAPED.sub(r"\1", text[a:b]) for a, b in zip(starts, ends, strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    own = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    return own.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.col("conv_id").cast(formatted.schema["conv_id"].dataType))
