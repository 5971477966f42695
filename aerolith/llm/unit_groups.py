"""Ids of many texts at once by a byte-level tokenizer of the tokenizers library.

The texts of a group are laid end to end as bytes and cut into units (see ``units``) where
they lie.  Equal units are found by Arrow, so that Python sees each distinct unit of a
group once: it is cut into pieces of the split pattern, the library's model merges the
pieces not met before, and the ids of all units are put in the texts' order by numpy.
"""

from __future__ import annotations

from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from aerolith.llm.common import SPACES
from aerolith.llm.units import LONGEST_KEPT, UnitEncoder, byte_chars, slices

#: Bytes of a group.
GROUP = 1 << 22
#: Pieces the library is given at a time.
MERGED = 100


def _table(chosen: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


_SPACE = _table(SPACES.encode())
_SIGN = _table(b",.;!?")
_LETTER = _table([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
#: No UTF-8 text has the byte 0xFF: it stands between pieces and becomes a space.
_CHARS = "".join(byte_chars()[byte] for byte in range(255)) + " "


def _strings(data, starts: np.ndarray, end: int) -> pa.Array:
    """``data`` cut at ``starts`` and at ``end``, not copied."""
    offsets = np.append(starts, end).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _distinct(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each string's place among the distinct ones, and these."""
    found = strings.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _laid_out(values: np.ndarray, counts: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs of ``values``, of ``counts`` values each, in the order ``pick`` names them."""
    first = np.cumsum(counts) - counts
    lengths = counts[pick]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first[pick] - ends + lengths, lengths) + np.arange(total)]


def unit_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where units start in UTF-8 texts that lie end to end and start at ``texts``.

    A unit starts at an ASCII space after a character that is none of the white ones; other
    white space starts none, which makes units longer and changes no id.
    """
    space = _SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[1:] &= ~_ends_white(data, np.flatnonzero(start[1:] & (data[:-1] >= 0x80)))
    start[texts[texts < len(data)]] = True
    return np.flatnonzero(start)


def _ends_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks those of the places ``at`` where a white character beyond ASCII ends."""
    third, second, last = data[at - 2], data[at - 1], data[at]
    white = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    white |= (third == 0xE1) & (second == 0x9A) & (last == 0x80)
    white |= (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    white |= (third == 0xE2) & (second == 0x81) & (last == 0x9F)
    white |= (third == 0xE3) & (second == 0x80) & (last == 0x80)
    out = np.zeros(max(len(data) - 1, 0), bool)
    out[at[white]] = True
    return out


class GroupEncoder:
    """Ids of texts, and of each distinct piece while it is among those seen lately.

    At most twice ``limit`` pieces are held, and those of one group beside them; those that
    come back are kept when the rest is dropped.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, limit: int = 600_000, group: int = GROUP):
        self.single = UnitEncoder(tokenizer, pattern, 0)
        self.special = [text.encode() for text in self.single.special]
        self.merge = Tokenizer(tokenizer.model)
        self.merge.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.limit, self.group = limit, group
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        for _, parts in groupby(self._parts(texts), lambda part: part[0]):
            ids = [part for _, part in parts]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)

    def _parts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Texts with their numbers, very long ones in parts, encoded a group at a time."""
        numbers, held, n = [], [], 0
        for number, text in enumerate(texts):
            for part in slices(text or ""):
                numbers.append(number)
                held.append(part.encode())
                n += len(held[-1])
                if n >= self.group:
                    yield from zip(numbers, self._group(held))
                    numbers, held, n = [], [], 0
        yield from zip(numbers, self._group(held))

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        if not any(texts):
            return [np.zeros(0, "<u4")] * len(texts)
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
        starts = unit_starts(data, bounds[:-1])
        order, units = _distinct(_strings(joined, starts, len(joined)))
        ids, counts = self._units(units, any(text in joined for text in self.special))
        ends = np.concatenate([[0], np.cumsum(counts[order])])[np.searchsorted(starts, bounds)]
        ids = _laid_out(ids, counts, order)
        return [ids[start:end] for start, end in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _units(self, units: pa.Array, special: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, one after the other, and how many each has."""
        _, offsets, raw = units.buffers()
        offsets = np.frombuffer(offsets, "<i8", len(units) + 1)
        data = np.frombuffer(raw, np.uint8, offsets[-1])
        starts, ends = offsets[:-1], offsets[1:]
        feed, sign = data[starts] == ord("\n"), _SIGN[data[ends - 1]]
        # A unit is plain if it is one Latin word, after a space or a line feed or neither, and before one sign or none.
        first, last = starts + (feed | (data[starts] == ord(" "))), ends - sign
        other = ~_LETTER[data]
        other[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of times and divided by
        others = np.concatenate([[0], np.cumsum(other)])
        plain = (first < last) & (others[np.maximum(first, last)] == others[first]) & (not special)
        # Plain units are cut into pieces here, others stay whole.
        feed &= plain
        sign &= plain
        cut = np.zeros(len(data), bool)
        cut[starts] = True
        cut[first[feed]] = True
        cut[last[sign]] = True
        cuts = np.flatnonzero(cut)
        order, pieces = _distinct(_strings(raw, cuts, len(data)))
        whole = np.zeros(len(pieces), bool)
        whole[order[np.searchsorted(cuts, starts[~plain])]] = True
        known = self._known(pieces.to_numpy(zero_copy_only=False).tolist(), whole)
        counts = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        ids = _laid_out(np.frombuffer(b"".join(known), "<u4"), counts, order)
        return ids, np.add.reduceat(counts[order], np.searchsorted(cuts, starts))

    def _known(self, keys: list[bytes], whole: np.ndarray) -> list[bytes]:
        """Packed ids of distinct pieces, and of units marked as ``whole``."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        out = list(map(young.get, keys))
        missing = [n for n, ids in enumerate(out) if ids is None]
        if self.old:
            for n in missing:
                if (ids := self.old.get(keys[n])) is not None:
                    out[n] = young[keys[n]] = ids
            missing = [n for n in missing if out[n] is None]
        found, split = {}, {}
        for n, apart in zip(missing, whole[missing].tolist()):
            if not apart:
                found[keys[n]] = None
            elif any(text in keys[n] for text in self.special):
                ids = self.single.tokenizer.encode(keys[n].decode(), add_special_tokens=False).ids
                found[keys[n]] = np.array(ids, "<u4").tobytes()
            else:
                split[keys[n]] = self.single.split(keys[n].decode())
        pieces = {piece: piece.encode() for piece in set().union(*split.values())}
        found.update((key, young.get(key)) for key in pieces.values())
        found.update(self._merged([key for key, ids in found.items() if ids is None]))
        ids_of = {piece: found[key] for piece, key in pieces.items()}
        found.update((unit, b"".join(map(ids_of.__getitem__, cut))) for unit, cut in split.items())
        young.update((key, ids) for key, ids in found.items() if len(key) <= LONGEST_KEPT)
        for n in missing:
            out[n] = found[keys[n]]
        return out

    def _merged(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Pieces with their packed ids, by the library's model."""
        for start in range(0, len(pieces), MERGED):
            some = pieces[start:start + MERGED]
            encoded = self.merge.encode(charmap_decode(b"\xff".join(some), "strict", _CHARS)[0], add_special_tokens=False)
            packed = np.array(encoded.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(encoded.word_ids, minlength=len(some)))).tolist()
            yield from zip(some, [packed[begin:end] for begin, end in zip([0, *ends], ends)])
