"""Cutting texts where no token can cross, so that a piece is encoded once for all the places where it stands; and
tokenizers made from the bytes of their files.

A byte-level BPE with its usual pattern ends a pre-token before white space that follows something else, and between an
ASCII letter and a digit. A sentence-piece vocabulary in which no piece holds a space after another character never
merges across a space. Cuts are made there alone; a run without such a place is one piece, however long.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common as C

#: Bytes of pieces that a tokenizer gets at a time; a longer piece comes alone.
BATCH_BYTES = 128 << 10

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True

# fixed values: white space outside ASCII, and the sign that stands for a space in sentence pieces
WIDE_SPACES = "\u0085\u00a0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\u2581"
_WIDE = np.array(sorted(int.from_bytes(c.encode(), "big") for c in WIDE_SPACES))


def _after_solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of places after the first: whether the character before is certainly no white space."""
    before = data[at - 1]
    solid = _SOLID[before]
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        p = at[wide]
        two = data[np.maximum(p - 2, 0)].astype(np.int64) << 8 | data[p - 1]
        three = data[np.maximum(p - 3, 0)].astype(np.int64) << 16 | two
        solid[wide] = ~(np.isin(two, _WIDE) | np.isin(three, _WIDE))
    return solid


def _places(data: np.ndarray, offsets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Candidates without those at the start of a text."""
    inner = np.ones(len(data) + 1, bool)
    inner[offsets] = False
    return candidates[inner[candidates]]


def byte_level_cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places inside of texts where a pre-token of a byte-level BPE ends."""
    space = _places(data, offsets, np.flatnonzero(_SPACES[data]))
    space = space[_after_solid(data, space)]
    letter, digit = _LETTERS[data], _DIGITS[data]
    change = np.flatnonzero((letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])) + 1
    return np.union1d(space, _places(data, offsets, change))


def space_cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places of spaces after something else, with something after them, inside of texts."""
    at = _places(data, offsets, np.flatnonzero(data == 0x20))
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    at = at[~last[at]]
    return at[_after_solid(data, at)]


def cut(offsets: np.ndarray, data: np.ndarray, cuts: np.ndarray, drop: bool) -> tuple[pa.Array, np.ndarray]:
    """(pieces, number of the first piece of each text and of all pieces). drop: the byte at a cut belongs to no piece."""
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], cuts)
    of_text = np.searchsorted(starts, offsets)
    ends = np.append(starts, len(data))
    if drop and len(cuts):
        gone = np.searchsorted(cuts, ends)
        kept = np.ones(len(data), bool)
        kept[cuts] = False
        data, ends = data[kept], ends - gone
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))), of_text


def by_bytes(words: pa.Array, most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive words with about that many bytes."""
    offsets, _ = C.string_buffers(words)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield words.slice(at, to - at).to_pylist()
        at = to


# -- tokenizers --------------------------------------------------------------------------------------------------------

_loaded: dict = {}


def read_file(path: str) -> bytes:
    """A vocabulary file, read where the job is planned; tasks get its bytes by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def json_tokenizer(blob: bytes, plain: bool):
    """plain: strings of special tokens inside texts are ordinary text."""
    if (key := (hash(blob), plain)) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(blob)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = plain
        _loaded[key] = t
    return _loaded[key]


def piece_tokenizer(blob: bytes):
    if (key := hash(blob)) not in _loaded:
        import sentencepiece

        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=blob)
    return _loaded[key]


def is_byte_level(blob: bytes) -> bool:
    """Whether byte_level_cuts holds for this tokenizer: nothing changes the text before its pattern, and no added token
    can lie across a cut or looks at what stands around it."""
    spec = json.loads(blob)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    odd = re.compile(r"\S\s|[A-Za-z][0-9]|[0-9][A-Za-z]")
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or odd.search(t["content"]) for t in added)


def is_spaced(blob: bytes) -> bool:
    """Whether space_cuts holds for this sentence-piece model: it adds a space in front, keeps all others, changes no
    character, and has no piece with a space after another character."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(blob)
    n = model.normalizer_spec
    plain = n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap
    return plain and model.trainer_spec.model_type == 2 and not any(re.search("[^\u2581]\u2581", p.piece) for p in model.pieces)
