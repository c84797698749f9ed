"""Reads a SentencePiece model file (Protocol Buffers wire format) without the library."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

SPACE = "▁"
#: Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class ModelSpec:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""

    @property
    def is_bpe(self) -> bool:
        return self.model_type == BPE

    @property
    def is_identity(self) -> bool:
        return not self.charsmap

    @property
    def has_user_pieces(self) -> bool:
        return USER_DEFINED in self.types

    @property
    def normal_pieces(self) -> list[str]:
        return [p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER_DEFINED)]


def parse_model(data: bytes) -> ModelSpec:
    spec = ModelSpec()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            spec.pieces.append(x.get(1, b"").decode("utf-8"))
            spec.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            spec.types.append(x.get(3, NORMAL))
        elif number == 2:
            x = dict(_fields(value))
            spec.model_type, spec.byte_fallback = x.get(3, spec.model_type), bool(x.get(35, spec.byte_fallback))
        elif number == 3:
            x = dict(_fields(value))
            spec.charsmap = x.get(2, spec.charsmap)
            spec.add_dummy_prefix = bool(x.get(3, spec.add_dummy_prefix))
            spec.remove_extra_whitespaces = bool(x.get(4, spec.remove_extra_whitespaces))
            spec.escape_whitespaces = bool(x.get(5, spec.escape_whitespaces))
    return spec
