"""Chat formatting of typed content parts.

Each turn is a row. A visitor walks the parts of the turn and flattens them, in order, into text:
text parts are escaped, and an image, audio or document part becomes a placeholder with a reference
into the turn's attachment list and the number of tokens it expands to. Turns are marked by control
strings; a control string, or a backslash, inside a text is escaped by a backslash, so the formatted
text can be read back exactly. Neighbouring text parts are escaped as one, so that none can complete a
control string that another begins. The loss mask covers the text of assistant turns.

Formatting works row by row, so a conversation of any length needs no group. Reading back sorts the
rows by conversation and turn in each partition and streams them through running digests; a digest
needs all turns of its conversation in order, so one conversation is read by one task, turn by turn.

Defined results: a null text is empty, a null role is the empty role; rows with equal conversation
and turn follow in order of role and text, and each counts as a turn; null conversations form one
conversation; an empty table gives no rows; extra columns are ignored. A null part is left out; a part
of another or no type becomes a placeholder that keeps its type and reference and stands for 0 tokens
unless it says more; negative token counts are 0. Very long texts are formatted like any others.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import map_texts

LOSS_ROLE = "assistant"
#: Tokens that a part of a kind stands for when it doesn't say.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"

# Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<|image|>", "<|audio|>", "<|document|>", "<|other|>", "<|/part|>")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_PART = re.compile(r"<\|(image|audio|document|other)\|>(\d+):(\d+)<\|/part\|>")
_ESCAPED = re.compile(r"\\(\\?)")

SEGMENTS = (
    "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<kind:string,ref:string,tokens:int>>, part_tokens bigint"
)


def escape(text: str) -> str:
    """Break every control string behind its first character; double every backslash."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visitor over the parts of a turn."""

    def __init__(self):
        self.out: list[str] = []
        self.texts: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            {"text": self.visit_text, "image": self.visit_known, "audio": self.visit_known, "document": self.visit_known}.get(part["type"], self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_known(self, part: dict) -> None:
        self._attach(part["type"], part, PART_TOKENS[part["type"]])

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, mark: str, part: dict, tokens: int) -> None:
        self._end_text()
        given = part.get("tokens")
        tokens = tokens if given is None else max(0, given)
        self.out.append(f"<|{mark}|>{len(self.attachments)}:{tokens}<|/part|>")
        self.attachments.append({"kind": part["type"], "ref": part.get("ref"), "tokens": tokens})

    def _end_text(self) -> None:
        self.out.append(escape("".join(self.texts)))
        self.texts = []

    def body(self) -> str:
        self._end_text()
        return "".join(self.out)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The turn's formatted text, the start and end of its loss span (0, 0 without), its attachments."""
    flat = Flatten()
    for part in parts:
        flat.visit(part)
    body = flat.body()
    if role == LOSS_ROLE:
        return f" {body} </s>", 1, 1 + len(body), flat.attachments
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 0, 0, flat.attachments
    return f"<s>[ROLE]{escape(role)}[/ROLE] {body} </s>", 0, 0, flat.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and body (still escaped) of a formatted turn."""
    if formatted.startswith("<s>[INST] "):
        return "user", formatted[10:-8]
    if formatted.startswith("<s>[ROLE]"):
        role, _, body = formatted[9:].partition("[/ROLE] ")
        return unescape(role), body[:-5]
    return LOSS_ROLE, formatted[1:-5]


def read_parts(body: str, attachments: list[dict]) -> list[dict]:
    """The parts of a turn, from its body and attachments; adjacent text parts come back as one, empty ones not."""
    parts, at = [], 0
    for m in _PART.finditer(body):
        if m.start() > at:
            parts.append({"type": "text", "text": unescape(body[at : m.start()])})
        found = attachments[int(m[2])]
        parts.append({"type": found["kind"], "ref": found["ref"], "tokens": int(m[3])})
        at = m.end()
    if at < len(body) or not parts:
        parts.append({"type": "text", "text": unescape(body[at:])})
    return parts


def format_turns(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """SEGMENTS, a row for each turn. Content is ``parts_col`` (type PARTS), or else the column text."""
    parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "") if parts_col else F.coalesce("text", F.lit(""))
    attachment = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))

    def work(batches):
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            rows = [format_turn(r, p or []) for r, p in zip(roles, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(roles, pa.string()),
                    batch.column(3),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], attachment),
                    pa.array([sum(a["tokens"] for a in r[3]) for r in rows], pa.int64()),
                ],
                names=[x.split()[0] for x in re.sub(r"<.*?>>", "", SEGMENTS).split(", ")],
            )

    return map_texts(turns.select("conv_id", "turn", "role", text.alias("text"), parts.cast(PARTS).alias("parts")), work, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, and its attachments and their tokens, computed from the formatted text alone."""

    def work(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "part_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        none = object()

        def row(conv, s):
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]

        conv, state = none, None
        for batch in batches:
            done = []
            for c, formatted, start, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append(row(conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, body = read_turn(formatted)
                for m in _PART.finditer(body):
                    state[5] += 1
                    state[6] += int(m[3])
                state[0] += 1
                state[1].update(f"{role}\n{unescape(_PART.sub('', body))}\n".encode())
                loss = unescape(_PART.sub("", formatted[start:end]))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if conv is not none:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(conv, state), kinds)], names=names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    return map_texts(ordered, work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, part_tokens bigint")
