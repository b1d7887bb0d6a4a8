"""Chat formatting over typed content parts: a visitor flattens them into ordered placeholders.

Template: `<|im_start|>` role `\\n` content `<|im_end|>` `\\n` for each turn. Inside contents every `<`, any number of
backslashes, `|` gets one backslash more, so no control string occurs there and removing one backslash restores the text.
Roles are percent-encoded."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shared_dir

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


class PartVisitor:
    """Flattens typed parts in order. text: what is written; refs: attachment references (kind, ordinal, position in
    code points, uri); tokens: expanded count of placeholder tokens of the attachments.

    image: ceil(width/patch) * ceil(height/patch) tokens; audio: ceil(seconds * rate); document: pages * page_tokens;
    at least one each. Unknown kinds raise; null parts and null texts are empty. Text parts that follow each other are one
    text, escaped as a whole, so that no control string comes about where they meet."""

    def __init__(self, patch: int = 14, rate: int = 25, page_tokens: int = 256):
        self.patch, self.rate, self.page_tokens = patch, rate, page_tokens
        self.out: list[str] = []
        self.held: list[str] = []
        self.refs: list[dict] = []
        self.spans: list[tuple[int, int]] = []
        self.tokens = self.at = 0

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown part type {kind!r}")
        handler(part)

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def _text(self) -> None:
        """Writes the text that is held back, and notes where it stands."""
        text, self.held = escape("".join(self.held)), []
        if text:
            self.spans.append((self.at, self.at + len(text)))
            self._write(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._text()
        self.refs.append({"kind": kind, "ordinal": len(self.refs), "position": self.at, "uri": part.get("uri") or "", "tokens": max(1, tokens)})
        self.tokens += max(1, tokens)
        self._write(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    @property
    def text(self) -> str:
        self._text()
        return "".join(self.out)


FORMATTED = "conv_id long, seq long, formatted string, loss array<struct<start: long, stop: long>>, attachments string, attachment_tokens long"
BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PARTS = re.compile(r"<\|(?:image|audio|document)\|>")


def format_chats(turns: DataFrame, parts_column: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted segment for each turn, in the order conv_id, turn, role, text: rows of FORMATTED.

    The loss mask of a segment is a list of spans [start, stop) in its code points: the texts between attachments of turns
    whose role is in loss_roles, else empty; placeholders are not part of it. With parts_column (JSON list of typed parts) contents come from there where it is not null."""
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    columns.append((F.col(parts_column).cast("string") if parts_column else F.lit(None).cast("string")).alias("parts"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = turns.select(*columns).repartition("conv_id").sortWithinPartitions(*keys)

    def segments(batches):
        conv, seq = object(), 0
        for b in batches:
            out = {name: [] for name in ("conv_id", "seq", "formatted", "loss", "attachments", "attachment_tokens")}
            for c, role, text, parts in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), b["parts"].to_pylist(), strict=True):
                if c != conv:
                    conv, seq = c, 0
                visitor = PartVisitor()
                for part in json.loads(parts) if parts is not None else [{"type": "text", "text": text}]:
                    visitor.visit(part)
                head = f"{START}{quote(role, safe='')}\n"
                text = visitor.text
                loss = [{"start": len(head) + a, "stop": len(head) + b} for a, b in visitor.spans] if role in loss_roles else []
                for name, value in zip(out, (c, seq, f"{head}{text}{END}\n", loss, json.dumps(visitor.refs), visitor.tokens), strict=True):
                    out[name].append(value)
                seq += 1
            yield pa.RecordBatch.from_pydict(out, pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("attachments", pa.string()), ("attachment_tokens", pa.int64())]))

    return ordered.mapInArrow(segments, FORMATTED)


def _content(formatted: str) -> tuple[str, str]:
    """Role and content, still escaped, of a segment."""
    if not formatted.startswith(START) or not formatted.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, content = formatted[len(START) : -len(END) - 1].partition("\n")
    return unquote(role), content


def parse_segment(formatted: str) -> tuple[str, str]:
    """Role and text of a segment: what stands between placeholders, each piece unescaped by itself."""
    role, content = _content(formatted)
    return role, "".join(map(unescape, _PARTS.split(content)))


def parse_parts(formatted: str, attachments: str) -> list[dict]:
    """The typed parts of a segment, in order: texts, and the attachments that its placeholders stand for."""
    texts, refs = _PARTS.split(_content(formatted)[1]), json.loads(attachments)
    if len(texts) != len(refs) + 1:
        raise ValueError("placeholders and attachments do not belong together")
    out = []
    for k, text in enumerate(texts):
        out += [{"type": "text", "text": unescape(text)}] if text else []
        out += [{"type": refs[k]["kind"], "uri": refs[k]["uri"], "tokens": refs[k]["tokens"]}] if k < len(refs) else []
    return out


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """A row of BACK for each conversation in the written output. One pass holds one batch, never a whole conversation."""
    ordered = spark.read.schema(FORMATTED).parquet(path).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seq")

    def digest(batches):
        none = object()
        conv, turns = none, 0
        every, loss = hashlib.sha256(), hashlib.sha256()
        n_loss = chars = 0
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            out = []
            for r in b.select(["conv_id", "formatted", "loss"]).to_pylist():
                if r["conv_id"] != conv:
                    if conv is not none:
                        out.append((conv, turns, every.hexdigest(), n_loss, loss.hexdigest(), chars))
                    conv, turns, n_loss, chars = r["conv_id"], 0, 0, 0
                    every, loss = hashlib.sha256(), hashlib.sha256()
                role, text = parse_segment(r["formatted"])
                every.update(f"{role}\n{text}\n".encode())
                masked = "".join(unescape(r["formatted"][x["start"] : x["stop"]]) for x in r["loss"])
                loss.update(masked.encode())
                turns, n_loss, chars = turns + 1, n_loss + len(masked), chars + len(r["formatted"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if conv is not none:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, turns, every.hexdigest(), n_loss, loss.hexdigest(), chars), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(digest, BACK)


def chats_query(turns: DataFrame) -> DataFrame:
    """Formats all conversations into a table in the shared folder and returns the digests of what is read back.

    Null texts and roles are empty; null conv_ids make one conversation; rows of the same turn stand by role, then text;
    repeated rows all count; an empty table gives no row; other columns are left out."""
    path = f"{shared_dir(turns.sparkSession)}/strandline/chats-{uuid.uuid4().hex}"
    format_chats(turns).write.option("compression", "zstd").parquet(path)
    return read_back(turns.sparkSession, path)
