"""Token ids of whole texts by a public byte-level BPE file of the tokenizers library.

The library encodes pieces independently, so texts of plain letters are cut into
their pieces here, in one pass over their bytes; pieces of at most 16 bytes are looked
up by those bytes, all at once, and only new ones go to the library, many in one call.  Any text with
another character, or with a special token in it, is encoded by the library as a
whole.  Ids are the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glucoflow.llm.common import encode

END_ID = 2
SPECIAL = "<|endoftext|>"
_MARK = SPECIAL.encode()
#: pieces that a task keeps
CACHED_PIECES = 600_000
#: bits of the places where short pieces are looked up
_SLOT_BITS = 20
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: the bytes of a piece among the eight from its start on
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: new pieces that the library gets in one text
_JOINED = 256

#: classes of a byte: white space but a space, a space, (part of) a letter, a digit, another sign, the end of a text
_WHITE, _BLANK, _LETTER, _DIGIT, _OTHER, _END = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"\t\n\r")] = _WHITE
_CLASS[32] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[0] = _END
#: bytes of plain characters: ASCII and the Latin-1 letters, whose class is known without a table
_PLAIN = bytes([9, 10, 13, *range(32, 127), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))])
#: what follows the apostrophe of a piece of its own
_SHORT = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Where the pieces begin in the bytes of plain texts, each text followed by a byte 0, a piece too.

    Fixed: the split of this public vocabulary over plain characters,
    ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+`` with letters L and digits N.
    """
    kind = _CLASS[raw]
    before = np.concatenate([np.array([_END], np.uint8), kind[:-1]])
    after = np.concatenate([kind[1:], np.array([_END], np.uint8)])
    white, white_before = kind <= _BLANK, before <= _BLANK
    # the last of some white space before a word starts anew: a space goes with the word
    start = np.where(white, ~white_before | ((after > _BLANK) & (after != _END)), (before != kind) & (before != _BLANK))
    start |= kind == _END
    short = np.flatnonzero(raw == 39)
    short = short[np.isin(before[short], (_WHITE, _LETTER, _DIGIT, _END))]
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    for letters in _SHORT:
        at = short
        for k, letter in enumerate(letters):
            at = at[padded[at + 1 + k] == letter]
        start[at + 1] = False
        if len(letters) == 2:
            start[at + 2] = False
        start[at + 1 + len(letters)] |= kind[at + 1 + len(letters)] == _LETTER
    return np.flatnonzero(start)


@lru_cache(maxsize=1)
def task_encoder(path: str) -> Encoder:
    """The encoder of this worker process; known pieces stay for its next task."""
    return Encoder(path)


class Encoder:
    """One per task; holds the library's tokenizer and the pieces seen so far.

    Piece k has the ids flat[first[k] : first[k + 1]].
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.line = words["Ċ"]
        self.spaced = np.zeros(max(words.values()) + 1, bool)
        self.spaced[[k for w, k in words.items() if w[0] == "Ġ"]] = True
        self.forget()

    def forget(self) -> None:
        # piece 0 is the end of a text, all zeros, as is an empty slot
        self.flat, self.first = np.array([END_ID], "<u4"), np.array([0, 1])
        self.bytes1, self.bytes2 = (np.zeros(1 << _SLOT_BITS, np.uint64) for _ in range(2))
        self.number = np.zeros(1 << _SLOT_BITS, np.int32)
        # the pieces without a slot
        self.others, self.other_numbers = pa.array([], pa.binary()), np.zeros(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str) -> np.ndarray:
        """The ids alone: places and words cost the library as much again."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str], raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encode new pieces, in raw from start on: runs of letters joined in one text, the rest one by one. Their numbers."""
        begin, letters = raw[start], _CLASS[raw[start + size - 1]] == _LETTER
        spaced = np.flatnonzero(letters & (begin == 32)).tolist()
        bare = np.flatnonzero(letters & (_CLASS[begin] == _LETTER)).tolist()
        rest = np.flatnonzero(~letters | (_CLASS[begin] == _OTHER)).tolist()
        ids, sizes = [self.flat], []
        for k in range(0, len(spaced), _JOINED):
            got = self._ids("".join([pieces[j] for j in spaced[k : k + _JOINED]]))
            # the space of a piece is the first byte of its first id
            sizes.append(np.diff(np.flatnonzero(self.spaced[got]), append=len(got)))
            ids.append(got)
        for k in range(0, len(bare), _JOINED):
            got = self._ids("\n".join([pieces[j] for j in bare[k : k + _JOINED]]))
            line = got == self.line
            sizes.append(np.diff(np.flatnonzero(line), prepend=-1, append=len(got)) - 1)
            ids.append(got[~line])
        for found in self.tokenizer.encode_batch_fast([pieces[j] for j in rest], add_special_tokens=False):
            ids.append(np.array(found.ids, "<u4"))
            sizes.append(np.array([len(ids[-1])]))
        numbers = np.empty(len(pieces), np.int64)
        numbers[[*spaced, *bare, *rest]] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(pieces))
        self.flat = np.concatenate(ids)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        return numbers

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text its ids as little-endian unsigned 32-bit integers, the end id last; null is empty."""
        coded = [encode(t) for t in texts]
        plain = [not c.translate(None, _PLAIN) and _MARK not in c for c in coded]
        found = self._plain([c for c, p in zip(coded, plain, strict=True) if p])
        return [next(found) if p else np.array([*self.whole(t), END_ID], "<u4") for t, p in zip(texts, plain, strict=True)]

    def _plain(self, coded: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each plain text, the end id last."""
        if not coded:
            return
        data = b"\0".join([*coded, b""])
        raw = np.frombuffer(data + bytes(16), np.uint8)
        place = piece_starts(raw[: len(data)])
        at = self._numbers(data, raw, place, np.diff(place, append=len(data)))
        first = self.first[at]
        size = self.first[at + 1] - first
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1])]
        cuts = ends[at == 0]
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            yield ids[lo:hi]

    def _numbers(self, data: bytes, raw: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of every piece; new ones are learned. raw: data with 16 zeros more."""
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        bytes1 = eight[place] & _BYTES[np.minimum(size, 8)]
        bytes2 = eight[place + 8 * (size > 8)] & _BYTES[np.clip(size - 8, 0, 8)]
        slot = ((bytes1 * _MIX1 + bytes2 * _MIX2) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)
        short = size <= 16
        numbers = self.number[slot].astype(np.int64)
        left = np.flatnonzero(~(short & (self.bytes1[slot] == bytes1) & (self.bytes2[slot] == bytes2)))
        if not len(left):
            return numbers
        bounds = pa.py_buffer(np.append(place, len(data)).astype(np.int32))
        parts = pa.Array.from_buffers(pa.binary(), len(place), [None, bounds, pa.py_buffer(data)]).take(pa.array(left)).dictionary_encode()
        index = parts.indices.to_numpy()
        found = np.full(len(parts.dictionary), -1)
        if len(self.others):
            among = pc.index_in(self.others, value_set=parts.dictionary)
            found[among.drop_null().to_numpy()] = self.other_numbers[among.is_valid().to_numpy(zero_copy_only=False)]
        new = np.flatnonzero(found < 0)
        if len(self.first) > 2 and len(self.first) + len(new) > CACHED_PIECES:
            self.forget()
            return self._numbers(data, raw, place, size)
        if len(new):
            one = np.empty(len(found), np.int64)
            one[index] = left
            one = one[new]
            pieces = parts.dictionary.take(pa.array(new))
            found[new] = self._learn([p.decode() for p in pieces.to_pylist()], raw, place[one], size[one])
            # a slot is for the first short piece that comes, and the one of no bytes for the end of a text
            free, which = np.unique(slot[one], return_index=True)
            fits = short[one[which]] & (self.number[free] == 0) & (free > 0)
            free, which = free[fits], which[fits]
            self.bytes1[free], self.bytes2[free], self.number[free] = bytes1[one[which]], bytes2[one[which]], found[new[which]]
            other = np.ones(len(new), bool)
            other[which] = False
            self.others = pa.concat_arrays([self.others, pieces.filter(pa.array(other))])
            self.other_numbers = np.concatenate([self.other_numbers, found[new[other]]])
        numbers[left] = found[index]
        return numbers
