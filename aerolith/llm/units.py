"""Texts as units that a byte-level tokenizer encodes independently of each other.

The tokenizers used here split text before they merge, and no piece of that split goes
from other characters on into white space.  A text can therefore be cut wherever white
space begins: the ids of the text are the ids of its units, one after the other.  Most
units occur again and again, so that each is encoded once while it is in the cache.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import regex
from tokenizers import Tokenizer

#: Characters with the Unicode property White_Space (fixed; ``\s`` of the split pattern).
WHITE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
WHITE_CHARS = "".join(chr(code) for code in range(0x3001) if re.match(f"[{WHITE}]", chr(code)))
_WHITE_SET = frozenset(WHITE_CHARS)

#: Longer units are not kept: they are junk, and rarely seen twice.
LONGEST_KEPT = 64
SLICE = 1 << 20


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A very long text in parts, cut where a unit ends, so that its units are never all in memory."""
    start = 0
    while len(text) - start > size:
        edge = _EDGE.search(text, start + size)
        if edge is None:
            break
        yield text[start:edge.start()]
        start = edge.start()
    yield text[start:] if start else text


def groups(texts: Iterable[str | None], size: int = 1 << 21) -> Iterator[list[str]]:
    """Texts in groups of about ``size`` characters, a very long one alone; null counts as empty."""
    held, n = [], 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def keys(text: str) -> list[str]:
    """The units of a text under short names: ``unit_of`` gives the unit back.

    Words after one space or one line feed, by far the most, are split off by ``str.split``.
    Whether a key stands for a whole unit is seen when it is first met, in ``all_plain``.
    """
    if not text:
        return []
    split = text.replace("\n", " \n").split(" ")
    split[0] = " " + split[0]
    return split


def all_plain(found: Iterable[str]) -> bool:
    """Whether all keys from ``keys`` start and end as units do."""
    for key in found:
        if not key or key[-1] in _WHITE_SET:
            return False
        if key[0] in _WHITE_SET and (key[0] not in "\n " or key[1] in _WHITE_SET):
            return False
    return True


def exact_keys(text: str) -> list[str]:
    """As ``keys``, for any white space."""
    out = []
    for unit in _UNIT.findall(text):
        plain = len(unit) > 1 and unit[1] not in _WHITE_SET
        out.append(unit[1:] if plain and unit[0] == " " else unit if plain and unit[0] == "\n" else " " + unit)
    return out


def unit_of(key: str) -> str:
    return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key


class UnitCache:
    """What is known of each unit, kept for the units seen lately.

    ``fill`` works out the value of new units.  At most twice ``limit`` values are held;
    units that come back are kept when the rest is dropped.
    """

    def __init__(self, fill: Callable[[list[str]], list], limit: int = 250_000):
        self.fill, self.limit = fill, limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def _learn(self, found: Iterable[str]) -> None:
        old, young, new = self.old, self.young, []
        for key in found:
            value = old.get(key)
            if value is None:
                new.append(key)
            else:
                young[key] = value
        for start in range(0, len(new), 10_000):
            part = new[start:start + 10_000]
            young.update(zip(part, self.fill([unit_of(key) for key in part])))

    def learn(self, texts: Iterable[str]) -> None:
        """Works out the new units of several texts at once and in order, for a ``fill`` that gains by it."""
        self._age()
        missing = set()
        for text in texts:
            new = set(keys(text)).difference(self.young)
            missing |= new if all_plain(new) else set(exact_keys(text)).difference(self.young)
        self._learn(sorted(missing))

    def _age(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def values(self, text: str) -> list:
        """The values of the units of one text, in order."""
        self._age()
        found = keys(text)
        out = list(map(self.young.get, found))
        missing = set(compress(found, map(is_, out, repeat(None))))
        if not missing:
            return out
        if not all_plain(missing):
            found = exact_keys(text)
            out = list(map(self.young.get, found))
            missing = set(compress(found, map(is_, out, repeat(None))))
        self._learn(missing)
        young = self.young
        out = [young[key] if value is None else value for key, value in zip(found, out)]
        for key in missing:
            if len(key) > LONGEST_KEPT:
                del young[key]
        return out


@lru_cache(1)
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: its own where it has one, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (byte for byte in range(256) if byte not in printable)
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + n) for n, byte in enumerate(others)}


_CHARS = "".join(byte_chars()[byte] for byte in range(256))


def as_chars(raw: bytes) -> str:
    return charmap_decode(raw, "strict", _CHARS)[0]


class UnitEncoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library.

    Units are cut into the pieces of the split pattern, and the library's BPE model merges
    each distinct piece.  Pieces are found by ``pattern`` itself where all characters are below
    U+0250, whose classes are the same in all Unicode versions, and else by the library.
    Units with one of the tokenizer's special strings go through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, limit: int = 300_000):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.findall = regex.compile(pattern).findall
        self.space = byte_chars()[ord(" ")]
        self.special = [added.content for added in tokenizer.get_added_tokens_decoder().values()]
        self.units = UnitCache(self._fill, limit)
        self.pieces: dict[str, bytes] = {}
        self.limit = limit
        self.packed = [id.to_bytes(4, "little") for id in range(1 + max(tokenizer.get_vocab().values()))]

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit; the commonest kinds, a word and a word before one sign, without the pattern."""
        if unit.isascii() or max(unit) < "\u0250":
            if unit[0] == " ":
                # Letters below U+0250 are those of the pattern.
                if unit[1:].isalpha():
                    return [unit]
                if unit[-1] in ",.;!?" and unit[1:-1].isalpha():
                    return [unit[:-1], unit[-1]]
            return self.findall(unit)
        return [unit[start:end] for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def _piece(self, piece: str) -> bytes:
        # Of printable ASCII only the space is written otherwise.
        chars = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else as_chars(piece.encode())
        packed = self.packed
        ids = b"".join([packed[token.id] for token in self.model.tokenize(chars)])
        if len(piece) <= LONGEST_KEPT:
            self.pieces[piece] = ids
        return ids

    def _fill(self, units: list[str]) -> list[bytes]:
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        out, known, split, new = [], self.pieces.get, self.split, self._piece
        special = any(map("\n".join(units).__contains__, self.special))
        for unit in units:
            if special and any(text in unit for text in self.special):
                out.append(array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes())
                continue
            ids = known(unit)
            if ids is None:
                if unit[0] == " " and unit[1:].isalpha() and (unit.isascii() or max(unit) < "\u0250"):
                    out.append(new(unit))
                    continue
                pieces = split(unit)
                if len(pieces) == 1:
                    ids = new(unit)
                else:
                    ids = b"".join([known(piece) or new(piece) for piece in pieces])
            out.append(ids)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([b"".join(self.units.values(part)) for part in slices(text or "")])
