"""Texts cut into pieces and pre-tokens, as the tokenizers library cuts them for a byte-level vocabulary file."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .arrays import flat_bytes

KNOWN_PIECES = 500_000  # pieces that a Python worker keeps; beyond, it starts anew
KNOWN_IDS = 8_000_000  # and their ids
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

SOLID, LETTER, PLAIN = np.ones(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SOLID[:0x21] = SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = PLAIN[0x21:0x7F] = True
# a piece begins before a space and a solid byte, and between a letter and a comma or stop
BEFORE_PAIR, INSIDE_PAIR = np.uint8(1), np.uint8(2)
_BYTE = np.arange(256)
FIRST_OF_PAIR = (BEFORE_PAIR * (_BYTE == 0x20) + INSIDE_PAIR * LETTER).astype(np.uint8).tobytes()
SECOND_OF_PAIR = (BEFORE_PAIR * SOLID + INSIDE_PAIR * np.isin(_BYTE, (0x2C, 0x2E))).astype(np.uint8).tobytes()


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts cut into pieces that are encoded alike alone and in their text: the number of each piece, the different
    pieces, and the first piece of each text (one more entry than texts).

    A pre-token always begins at a space that a character other than white space follows, whatever stands before it (of
    a run of white space the pattern leaves the last to what follows); at a comma or stop after an ASCII letter; and at
    an ASCII letter after a line end that is the only white space there. After a space only bytes count that surely
    begin no white space: those from 0x21 on, but for the first bytes of white space beyond ASCII.
    """
    data, rows = flat_bytes(texts)
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        raw = data.tobytes()
        pair = np.frombuffer(raw.translate(FIRST_OF_PAIR), np.uint8)[:-1] & np.frombuffer(raw.translate(SECOND_OF_PAIR), np.uint8)[1:]
        cut[: len(pair)] = pair & BEFORE_PAIR
        cut[1 : len(data)] |= (pair & INSIDE_PAIR) != 0
        line = np.flatnonzero(data[1:-1] == 0x0A) + 1
        cut[line[PLAIN[data[line - 1]] & LETTER[data[line + 1]]] + 1] = True
        cut[rows] = True
    at = np.flatnonzero(cut)
    column = pa.Array.from_buffers(pa.large_string(), max(0, len(at) - 1), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return column.indices.to_numpy(), column.dictionary.to_pylist(), np.searchsorted(at, rows) if len(at) else np.zeros(len(rows), np.int64)


class Splitter:
    """Pre-tokens by the pattern. The pattern's library may hold another Unicode version than the tokenizers', so each
    character beyond ASCII is compared once per worker; a text with one that they class differently is cut by
    the tokenizers library. A special string inside a text is a pre-token of its own."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.special = {token.content: i for i, token in self.library.get_added_tokens_decoder().items()}
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._words = regex.compile(public_tokenizers.PATTERN)
        self._same = {chr(i) for i in range(128)}
        self._other: set[str] = set()

    def _library_split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _odd(self, text: str) -> bool:
        if text.isascii():
            return False
        found = set(text)
        for c in found - self._same - self._other:
            probe = f"a{c}a 1{c}1 !{c}! {c}"
            (self._same if self._library_split(probe) == self._words.findall(probe) else self._other).add(c)
        return not found.isdisjoint(self._other)

    def _plain(self, text: str) -> list[str]:
        return self._library_split(text) if self._odd(text) else self._words.findall(text)

    def split(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out: list[str] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])


class TokenIds:
    """Ids by the library, which encodes each different piece once."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        letters = byte_letters()
        self._bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self._bytes_of[i] = sum(c in letters for c in token)
        for i, token in self.library.get_added_tokens_decoder().items():
            self._bytes_of[i] = len(token.content.encode())
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.empty(0, np.uint32)
        self._begin = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The numbers that pieces get. Those with a space and something after it are encoded as one text, as a pre-token
        begins at each, and its ids dealt out by their bytes; the others one by one."""
        apart = [len(p) > 1 and p[0] == " " and ("!" <= p[1] <= "~" or p[1].isalnum()) for p in pieces]
        spaced = [p for p, a in zip(pieces, apart, strict=True) if a]
        (joined,) = self._encode(["".join(spaced)])
        joined = np.array(joined, np.uint32)
        ends = np.cumsum([len(p.encode()) for p in spaced], dtype=np.int64)
        sizes = [np.diff(np.searchsorted(np.cumsum(self._bytes_of[joined]), ends, "right"), prepend=0)]
        others = [p for p, a in zip(pieces, apart, strict=True) if not a]
        found = self._encode(others)
        sizes.append(np.array([len(x) for x in found], np.int64))
        order = np.argsort(~np.array(apart), kind="stable")
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(self._known), len(self._known) + len(pieces))
        self._known.update(zip(pieces, place.tolist(), strict=True))
        self._ids = np.concatenate([self._ids, joined, np.fromiter(chain.from_iterable(found), np.uint32)])
        self._begin = np.append(self._begin, self._begin[-1] + np.cumsum(np.concatenate(sizes)))
        return place

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each begins (one more entry than texts). Null is empty."""
        number, pieces, first = pieces_of(texts)
        place = np.fromiter(map(self._known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(place < 0)
        if len(new) and (len(self._known) + len(new) > KNOWN_PIECES or len(self._ids) > KNOWN_IDS):
            self._clear()
            new = np.arange(len(pieces))
        if len(new):
            place[new] = self._learn([pieces[i] for i in new.tolist()])
        which = place[number]
        begin, length = self._begin[which], np.diff(self._begin)[which]
        ends = np.append(0, np.cumsum(length))
        return self._ids[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])], ends[first]


@lru_cache(4)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(4)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)
