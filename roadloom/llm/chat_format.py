"""Chat formatting of typed content parts.

A turn's content is text, or a list of parts: text, image, audio, document. A visitor flattens
them in order: texts as they are, each attachment as a placeholder, with a reference (kind, uri, place) and the number of
tokens that it expands to. The template is

    <|im_start|>role NEWLINE content<|im_end|> NEWLINE

Control strings all begin with "<|". Inside texts and roles a "<", any backslashes and a "|" get one backslash
more, so that no text can hold a control string, and reading back takes it away. The loss mask covers the
escaped texts of assistant turns (no marks, no placeholders).

One output row is one formatted turn; a conversation is the concatenation of its rows in order. So
a conversation of any length never is one value, and reading back streams over sorted rows.

Defined results: null text is empty; a null role is the empty role; turns are ordered by turn (null first), ties by role and formatted text; repeated rows are
repeated turns; a part without a type is text, a null list of parts stands for the text column and an empty one for no content; rows without conv_id form one conversation. Unknown kinds of part raise an error. Columns named like a result
are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from roadloom.llm.common import append_struct

RESULTS = ["formatted", "loss", "attachments", "expanded_tokens"]
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Type of the optional column `parts`.
PARTS = "array<struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>>"
_KIND = "formatted string, loss array<struct<start:long,length:long>>, attachments array<struct<kind:string,uri:string,start:long,tokens:long>>, expanded_tokens long"
_TURN = re.compile(r"<\|im_start\|>(.*)\n((?s:.)*?)<\|im_end\|>\n")
_PLACED = re.compile("|".join(re.escape(p) for p in PLACEHOLDERS.values()))


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens a turn's parts; expansion of attachments by the stated sizes."""

    patch, audio_rate, page_tokens = 14, 25.0, 256

    def __init__(self, offset: int):
        self.out: list[str] = []
        self.at, self.texts, self.attachments, self.tokens = offset, [], [], 0
        self.pending = ""

    def visit(self, part: dict) -> None:
        visit = getattr(self, f"visit_{part['type'] or 'text'}", None)
        if visit is None:
            raise ValueError(f"unknown kind of part: {part['type']}")
        visit(part)

    def visit_text(self, part: dict) -> None:
        self.pending += part["text"] or ""  # neighbouring texts are escaped as one

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part[k] or 0) / self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close_text()
        self.attachments.append({"kind": kind, "uri": part["uri"], "start": self.at, "tokens": tokens})
        self.tokens += tokens
        self._put(PLACEHOLDERS[kind])

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def close_text(self) -> None:
        if self.pending:
            text = escape(self.pending)
            self.texts.append({"start": self.at, "length": len(text)})
            self._put(text)
            self.pending = ""


def format_turn(role: str | None, text: str | None, parts: list[dict] | None, learn: tuple[str, ...]) -> dict:
    head = f"{START}{_role(role or '')}\n"
    visitor = PartVisitor(len(head))
    for part in parts if parts is not None else [{"type": "text", "text": text}]:
        visitor.visit(part)
    visitor.close_text()
    return {"formatted": head + "".join(visitor.out) + END + "\n", "loss": visitor.texts if role in learn else [], "attachments": visitor.attachments, "expanded_tokens": visitor.tokens}


def format_turns(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conversations (conv_id, turn, role, text, and parts if there) plus formatted, loss (spans in code points), attachments
    and expanded_tokens. Offsets are within the row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kind = pa.struct([("formatted", pa.string()), ("loss", span), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])

    @F.arrow_udf(_KIND)
    def formatted(role: pa.Array, text: pa.Array, parts: pa.Array) -> pa.Array:
        return pa.array([format_turn(a.as_py(), b.as_py(), c.as_py(), learn) for a, b, c in zip(role, text, parts, strict=True)], kind)

    parts = F.col("parts") if "parts" in conversations.columns else F.lit(None)
    return append_struct(conversations, formatted.asNondeterministic()(F.col("role").cast("string"), F.col("text").cast("string"), parts.cast(PARTS)), RESULTS)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders stay where they were."""
    return [(_role_back(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted turns.

    Rows stream through in order, and only a conversation's running digests are held.
    """

    def digest(batches):
        now, first, d = None, True, None

        def row():
            return [now, d["n"], d["turns"].hexdigest(), d["chars"], d["loss"].hexdigest(), d["formatted"]]

        for b in batches:
            out = []
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if first or conv != now:
                    if not first:
                        out.append(row())
                    now, first, d = conv, False, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
                for role, content in read_back(text):
                    d["n"] += 1
                    d["turns"].update(f"{role}\n{content}\n".encode())
                for span in loss:
                    under = unescape(text[span["start"] : span["start"] + span["length"]])
                    d["loss"].update(under.encode())
                    d["chars"] += len(under)
                d["formatted"] += len(text)
            if out:
                yield _batch(out)
        if not first:
            yield _batch([row()])

    key = turns.schema["conv_id"].dataType
    kinds = [to_arrow_type(key), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # The formatted turn itself breaks ties, so no text moves twice.
    ordered = turns.select("conv_id", "formatted", "loss", "turn", "role").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(digest, f"conv_id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
