"""Token ids of whole texts by the tokenizers library, with a cache of the pieces that cannot influence each other."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.llm.common import worker_state

#: A blank between two characters that are no white space: both known pre-tokenizers always cut there.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which a blank may stand beside other white space, by either library's view of white space.
ODD = r"^ | $|  |\n | \n|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PACK = [f"<{n}I" for n in range(24)]
HALF = 600_000
LONGEST = 48
#: Letters below it are the same after NFC, and their lower case is one letter (U+0130 is looked at apart).
LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> little-endian unsigned 32-bit ids. Two generations of `half` entries bound its memory."""

    def __init__(self, owner: FastEncoder, glue: str, half: int):
        self.owner, self.glue, self.half, self.old, self.marks = owner, glue, half, {}, {}

    def __missing__(self, piece: str) -> bytes:
        if "\n" in piece:  # only the byte kind has them: a line end between two other characters is a pre-token of its own
            left, _, right = piece.partition("\n")
            if left and right and not left[-1].isspace() and not right[0].isspace():
                return self[left] + self.owner.line_end + self.owner.first[right]
        ids = self.old.get(piece)
        if ids is None:
            ids = self._new(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _new(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) < LATIN_END):
            return self.owner.letters(self.glue, piece)
        if len(piece) > 1 and piece[-1] in ",." and piece[-2].lower().isalpha():
            mark = self.marks.get(piece[-1])
            if mark is None:
                mark = self.marks[piece[-1]] = self.owner.whole(piece[-1])
            base = self.get(piece[:-1]) or self.old.get(piece[:-1])
            return (base or self._new(piece[:-1])) + mark
        return self.owner.whole(self.glue + piece)


class FastEncoder:
    """encode(text) -> bytes of uint32 ids, equal to Tokenizer.encode(text, add_special_tokens=False).

    kind is read from the tokenizer's file: "byte" (byte-level pre-tokenizer with its own pattern) and "word" (white space
    collapsed and dropped) have pieces; any other file gets each text encoded as a whole."""

    def __init__(self, path: str, half: int = HALF):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        spec = json.loads(self.tok.to_str())
        pre, norm, self.kind = spec["pre_tokenizer"] or {}, spec["normalizer"], "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self.model, self.map = self.tok.model, _byte_letters()
        self.line_end = self.whole("\n")
        self.first = _Pieces(self, "", half)
        self.rest = _Pieces(self, " ", half) if self.kind == "byte" else self.first

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, glue: str, piece: str) -> bytes:
        """Ids of a run of Latin letters: one pre-token, so the merges alone decide."""
        if self.kind == "word":
            low = piece.lower()
            if len(low) != len(piece):
                return self.whole(piece)
            piece = low
        elif self.kind != "byte":
            return self.whole(glue + piece)
        if not piece.isascii():
            piece = "".join(map(self.map.__getitem__, piece.encode()))
        ids = [x.id for x in self.model.tokenize(self.map[32] + piece if glue else piece)]
        return struct.pack(_PACK[len(ids)], *ids) if len(ids) < len(_PACK) else np.asarray(ids, "<u4").tobytes()

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """encode() of each value; null: empty."""
        if self.kind != "byte":
            return [self.encode(x or "") for x in column.to_pylist()]
        odd = pc.match_substring_regex(column, ODD).to_pylist()
        first, rest = self.first.__getitem__, self.rest.__getitem__
        out = []
        for text, o in zip(column.to_pylist(), odd, strict=True):
            if o or not text:
                out.append(self.encode(text or ""))
            else:
                head, *pieces = text.split(" ")
                out.append(first(head) + b"".join(map(rest, pieces)))
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "word":
            return b"".join(map(self.first.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        if self.kind == "byte":
            pieces = SAFE.split(text)
            return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))
        return self.whole(text)


def encoder(path: str, half: int = HALF) -> FastEncoder:
    """One encoder for each file and Python worker."""
    held = worker_state().setdefault("encoders", {})
    if (path, half) not in held:
        held[path, half] = FastEncoder(path, half)
    return held[path, half]
