"""Encoding whole texts with a public tokenizer, piece by piece through a bounded cache.

A text is cut only where the tokenizer itself cannot join the two sides, so the ids are those of encoding it at once:

* ``words``: the tokenizer lowers letters, drops white space and never looks across it: pieces are runs without ASCII white space;
* ``spaced``: white space belongs to what follows it: a piece is a run of ASCII white space and the run up to the next.

Both also cut between a Latin letter and an ASCII mark or digit, where the tokenizers' runs of letters end: fewer pieces
differ.  Texts that hold the spelling of a special token, and ``spaced`` texts with other white space (it could join a
run), are encoded at once.

The work goes by columns: cuts are found in the bytes of many texts together, equal pieces are numbered by Arrow, only the
distinct ones are looked up, and gathering their ids by number writes the texts' ids one behind the other.  New pieces are
encoded many at a time, joined by what keeps them apart, and told apart by their tokens' widths in bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa

from quarry.llm.common import env_single_thread, slices

_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -     　]")
_BLANK = " \t\n\r\x0b\x0c"
#: Pieces in each of the cache's two generations.
CACHE = 300_000
#: Bytes of text whose pieces are numbered together.
SLICE = 4 << 20
#: New pieces that are encoded as one text.
JOINED = 256
#: Bits of a byte's class.
BLANK, LETTER, MARK, HIGH, SUSPECT = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        table[b] = (
            BLANK * (c in _BLANK) | LETTER * (b < 128 and c.isalpha()) | MARK * (32 < b < 127 and not c.isalpha()) | HIGH * (b >= 128)
            # Bytes that other white space begins with.
            | SUSPECT * (0x1C <= b <= 0x1F or b in (0xC2, 0xE1, 0xE2, 0xE3))
        )
    return table


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class CachedEncoder:
    """ids(texts): the little-endian unsigned 16-bit (32-bit for larger vocabularies) ids of each text as bytes."""

    def __init__(self, path: str, style: str):
        env_single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.style = style
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of text that a token stands for: byte-level vocabularies spell each byte as one character.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>")) if style == "words" else len(token)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        if self.style == "words":
            sizes = [len(t) if t.isascii() else len(normalize("NFC", t).lower().encode()) for t in texts]
            together, glue = list(range(len(pieces))), " "
        else:
            sizes, glue = [len(p) for p in pieces], ""
            # Pieces that begin with white space and end without it stay apart when they are joined.
            together = [i for i, t in enumerate(texts) if t[0] in _BLANK and t[-1] not in _BLANK]
            joined = set(together)
            self._alone(pieces, texts, [i for i in range(len(texts)) if i not in joined])
        for k in range(0, len(together), JOINED):
            part = together[k : k + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([glue.join([texts[i] for i in part])], add_special_tokens=False)[0].ids, self.dtype)
            reached = np.concatenate(([0], np.cumsum(self.width[ids])))
            ends = np.cumsum([sizes[i] for i in part])
            # A piece's tokens end where its bytes end; an id of no width could stand on either side.
            at = np.searchsorted(reached, ends)
            if at[-1] != len(ids) or (reached[at] != ends).any() or (self.width[ids] == 0).any():
                self._alone(pieces, texts, part)
                continue
            raw, step = ids.tobytes(), self.dtype.itemsize
            cuts = [0, *(at * step).tolist()]
            self.young.update(zip([pieces[i] for i in part], [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _alone(self, pieces: list[bytes], texts: list[str], which: list[int]) -> None:
        for k in range(0, len(which), 4096):
            part = which[k : k + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                self.young[pieces[i]] = np.array(e.ids, self.dtype).tobytes()

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, pieces))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            new = []
            for i in gaps:
                if (v := self.old.get(pieces[i])) is None:
                    new.append(pieces[i])
                else:
                    self.young[pieces[i]] = v
            if new:
                self._learn(new)
            for i in gaps:
                found[i] = self.young[pieces[i]]
        return found

    def ids(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        return self.column(pa.array(texts, pa.string()), end).to_pylist()

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text of a string column (null counts as empty), and ``end``, as a binary column."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        parts = [self._slice(texts.slice(a, b - a), end) for a, b in slices(np.diff(offsets).tolist(), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _slice(self, texts: pa.Array, end: bytes) -> pa.Array:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data, pieces, first, whole = self._cut(data, offsets, texts)
        numbered = pa.Array.from_buffers(pa.large_binary(), len(pieces) - 1, [None, pa.py_buffer(pieces), pa.py_buffer(data)]).dictionary_encode()
        found = self._look_up(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        # Behind the distinct pieces: the end, and the texts that are encoded at once.
        found.append(end)
        found += [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype).tobytes() for i in whole]
        index = numbered.indices.to_numpy()
        at = np.concatenate((first[1:], first[1:][whole]))
        what = np.concatenate((np.full(len(texts), len(found) - 1 - len(whole)), len(found) - len(whole) + np.arange(len(whole))))
        # At one place a text's own ids come before the end of it: ``order`` puts them by place, then whole texts first.
        order = np.lexsort((np.concatenate((np.ones(len(texts)), np.zeros(len(whole)))), np.concatenate((np.arange(len(texts)), whole))))
        index = np.insert(index, at[order], what[order])
        values = pa.array(found, pa.large_binary()).take(pa.array(index))
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        last = np.flatnonzero(index == len(found) - 1 - len(whole)) + 1
        bounds = ends[np.concatenate(([0], last))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds - bounds[0]).astype(np.int32)), values.buffers()[2].slice(int(bounds[0]))])

    def _cut(self, data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the pieces, their offsets, the first piece of each text and of what would follow, texts that are encoded at once)."""
        kind = _CLASS[data]
        blank = (kind & BLANK) != 0
        begins = np.zeros(len(data) + 1, bool)
        starts = offsets[:-1][np.diff(offsets) > 0]
        # A Latin letter and an ASCII mark or digit behind it.
        mark = np.flatnonzero((kind[1:] & MARK) != 0) + 1
        before = kind[mark - 1]
        begins[mark[(before & LETTER) != 0]] = True
        high = mark[(before & HIGH) != 0]
        high = high[high > 1]
        lead, last = data[high - 2], data[high - 1]
        begins[high[(lead >= 0xC3) & ((lead < 0xCA) | (lead == 0xCA) & (last <= 0xAF)) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))]] = True
        whole = self._at_once(data, kind, offsets, texts)
        if self.style == "words":
            begins[1:-1] |= blank[:-1] & ~blank[1:]
            begins[starts] = True
            keep = ~blank
            begins[:-1] &= keep
        else:
            begins[1:-1] |= blank[1:] & ~blank[:-1]
            begins[starts] = True
            keep = np.ones(len(data), bool)
        for i in whole:
            keep[offsets[i] : offsets[i + 1]] = begins[offsets[i] : offsets[i + 1]] = False
        place = np.concatenate(([0], np.cumsum(keep)))
        where = np.flatnonzero(begins[:-1])
        pieces = np.append(place[where], place[-1]).astype(np.int64)
        first = np.searchsorted(where, offsets)
        data = data[keep]
        return _LOWER[data] if self.style == "words" else data, pieces, first, whole

    def _at_once(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Numbers of the texts that must not be cut."""
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        found = set((np.searchsorted(offsets, special, side="right") - 1).tolist())
        if self.style != "words":
            odd = np.unique(np.searchsorted(offsets, np.flatnonzero(kind & SUSPECT), side="right") - 1)
            found.update(i for i in odd.tolist() if _OTHER_SPACE.search(texts[i].as_py()))
        return np.array(sorted(found), np.int64)


@lru_cache(4)
def encoder(path: str, style: str) -> CachedEncoder:
    """The process's encoder for a vocabulary file."""
    return CachedEncoder(path, style)
