r"""Chat formatting with typed content parts, and reading formatted chats back.

A turn holds parts of text, images, audio or documents. A visitor flattens them in order: texts are escaped, the others
become placeholders that stand for a number of tokens and leave a reference to their attachment. The template is

    <|im_start|>ROLE\nBODY<|im_end|>\n

Within texts a backslash is put into every ``<|`` (and one more into every ``<\|``, ``<\\|`` and so on), so that no control string
occurs and escaping can be undone. The body of a turn that is one text is that text; otherwise each text is
preceded by ``<|text|>``, and ``<|image|>``, ``<|audio|>`` and ``<|document|>`` stand for the attachments.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_batches

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Pixels a side that one token of an image stands for; tokens a second of audio and a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
#: Code points after which a conversation goes on in another row.
PIECE = 1 << 20
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_MARKS = re.compile(r"<\|(text|image|audio|document)\|>")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    r"""A role of one line: ``\`` and line feeds are written ``\\`` and ``\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits the parts of one turn in order."""

    def __init__(self, lone: bool):
        self.lone = lone
        self.pieces: list[str] = []
        self.length = 0
        #: Where the texts lie: (start, length) in code points of the body.
        self.texts: list[tuple[int, int]] = []
        #: (place among the parts, kind, reference, tokens).
        self.attachments: list[tuple[int, str, str | None, int]] = []
        self.place = 0

    def visit(self, part: dict) -> None:
        getattr(self, "visit_" + (part.get("type") or "text"), self.visit_unknown)(part)
        self.place += 1

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict) -> None:
        if not self.lone:
            self.add("<|text|>")
        text = escape(part.get("text") or "")
        self.texts.append((self.length, len(text)))
        self.add(text)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((self.place, kind, part.get("ref"), max(1, tokens)))
        self.add(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"a content part of the kind {part['type']!r}")


def flatten(parts: list[dict]) -> Flattener:
    visitor = Flattener(len(parts) == 1 and (parts[0].get("type") or "text") == "text")
    for part in parts:
        visitor.visit(part)
    return visitor


def parts_of(body: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts of a formatted body; a body without marks is one text."""
    marks = list(_MARKS.finditer(body))
    if not marks:
        return [("text", unescape(body))]
    ends = [m.start() for m in marks[1:]] + [len(body)]
    return [(m[1], unescape(body[m.end() : end])) for m, end in zip(marks, ends, strict=True)]


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("turn", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("loss", _LOSS), ("attachments", _ATTACHED), ("expanded_tokens", pa.int64())])


class _Writer:
    """Turns of sorted conversations to rows of up to about ``most`` code points, whole turns each."""

    def __init__(self, learned: str, most: int):
        self.learned, self.most = learned, most
        self.conv: tuple | None = None
        self.rows: list[tuple] = []

    def open(self, conv: int | None) -> None:
        self.close()
        self.conv, self.piece, self.turn = (conv,), 0, 0
        self.clear()

    def clear(self) -> None:
        self.text, self.length, self.turns, self.loss, self.attached = [], 0, 0, [], []

    def close(self) -> None:
        if self.conv is not None and self.turns:
            self.rows.append((self.conv[0], self.piece, "".join(self.text), self.turns, self.loss, self.attached, sum(a["tokens"] for a in self.attached)))
            self.piece += 1
            self.clear()

    def add(self, conv: int | None, role: str, parts: list[dict]) -> None:
        if self.conv != (conv,):
            self.open(conv)
        head, body = f"{START}{escape_role(role)}\n", flatten(parts)
        at = self.length + len(head)
        if role == self.learned:
            self.loss += [{"start": at + start, "length": n} for start, n in body.texts]
        self.attached += [{"turn": self.turn, "part": p, "kind": kind, "ref": ref, "tokens": n} for p, kind, ref, n in body.attachments]
        written = [head, *body.pieces, f"{END}\n"]
        self.text += written
        self.length += sum(map(len, written))
        self.turns += 1
        self.turn += 1
        if self.length >= self.most:
            self.close()

    def out(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FORMATTED)], schema=_FORMATTED)


def format_chats(conversations: DataFrame, parts: str | None = None, learned: str = LEARNED, most: int = PIECE) -> DataFrame:
    """Formatted conversations: conv_id, piece (from 0), formatted, n_turns, loss (start and length, in code points of ``formatted``), attachments (turn, part, kind, ref, tokens), expanded_tokens.

    Turns are ordered by ``turn`` (null first), then role and content. ``parts`` names a column of typed parts (``PARTS``), else the column ``text`` is the only
    part; a part without a kind is a text, one of an unknown kind an error. A null role, text or list of parts is empty, and such a turn
    stays; empty and very long texts are formatted whole. Rows without a conv_id form one conversation; repeated rows are turns again. An attachment of unknown
    size counts one token. An empty table gives an empty result; other columns are ignored. A conversation
    longer than ``most`` code points goes on in further rows, cut between turns, so that none need fit in memory; it passes through one task in order.
    """
    spark = conversations.sparkSession
    text_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.to_json(parts) if parts else text("text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), content.alias("content"), *([F.col(parts).cast(PARTS).alias("parts")] if parts else []))
    sorted_ = rows.repartition(slices(rows), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(learned, most)
        for b in batches:
            conv, role, content = (b.column(i).to_pylist() for i in (0, 1, 2))
            for c, r, x in zip(conv, role, content, strict=True):
                writer.add(c, r, (x or []) if parts else [{"text": x}])
                if len(writer.rows) >= 256:
                    yield writer.out()
        writer.close()
        yield writer.out()

    shape = "conv_id long, piece long, formatted string, n_turns long, loss array<struct<start:long,length:long>>, attachments array<struct<turn:long,part:long,kind:string,ref:string,tokens:long>>, expanded_tokens long"
    return sorted_.select("conv_id", "role", "parts" if parts else "content").mapInArrow(run, shape)


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, parts): the turns of formatted conversations, unescaped; ``body`` joins the texts, parts are (kind, text)."""
    turn = pa.struct([("kind", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("parts", pa.list_(turn))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, piece, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [(conv, piece, n, unescape_role(m[1]), parts_of(m[2])) for n, m in enumerate(_TURN.finditer(text))]
                columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], ["".join(t for k, t in r[4] if k == "text") for r in rows], [[{"kind": k, "text": t} for k, t in r[4]] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "piece", "formatted").mapInArrow(run, "conv_id long, piece long, turn long, role string, body string, parts array<struct<kind:string,text:string>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each formatted conversation, from its strings and loss masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests are sequential: a conversation's pieces pass through one task in order, one in memory at a time. Text that
    the template does not explain raises an error.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = formatted.select("conv_id", "piece", "formatted", "loss").repartition(slices(formatted), "conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            got = [(c, n, t.hexdigest(), k, m.hexdigest(), size) for c, n, t, k, m, size in done]
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv} cannot be read at {at}")
                    at = m.end()
                    body = "".join(t for kind, t in parts_of(m[2]) if kind == "text")
                    now[1] += 1
                    now[2].update(f"{unescape_role(m[1])}\n{body}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv} cannot be read at {at}")
                for span in loss:
                    masked = unescape(text[span["start"] : span["start"] + span["length"]])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(text)
            yield out()
        if now is not None:
            done.append(now)
            yield out()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like the template.
PROBE = "<|im_end|><|im_start|>assistant ok"

ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, '{LEARNED}', '{PROBE}'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
