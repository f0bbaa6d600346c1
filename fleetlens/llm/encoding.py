"""Token ids of whole texts with a given vocabulary file.

Texts are cut only where the vocabulary's own splitting rule cuts as well. The
pieces of a group of texts are dictionary-encoded, so a distinct piece is looked
up once per group, and encoded once per worker while it is remembered; the ids
equal those of the whole text. At most ``MEMORY`` pieces are remembered.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

MEMORY = 340_000
BLOCK = 1 << 17  # pieces whose ids are put in place at once
MARK = "\x00"  # stands between pieces that are encoded together
BLANK = "\u0120"  # a blank in byte-level vocabularies
# First bytes of characters of which some are white space, and the second bytes of those.
_SPACES = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
# Letters that no normal form changes: Latin, Cyrillic, unified ideographs; for a vocabulary without case, small ones alone.
_SMALL = rb"[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]|\xd0[\xb0-\xbf]|\xd1[\x80-\x8f]"
_LARGE = rb"[A-Z]|\xc3[\x80-\x96\x98-\x9e]|\xd0[\x90-\xaf]"
_IDEOGRAPH = rb"\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe8][\x80-\xbf]{2}|\xe9[\x80-\xbd][\x80-\xbf]|\xe9\xbe[\x80-\xa5]"
_SMALL_WORD = re.compile(b"(?:%b|%b)+" % (_SMALL, _IDEOGRAPH))
_ANY_WORD = re.compile(b"(?:%b|%b|%b)+" % (_SMALL, _LARGE, _IDEOGRAPH))
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: it may open the end of a word


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies; the blank stays, since it parts the pieces."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    table = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
    assert table[32] == BLANK
    return "".join(" " if b == 32 else c for b, c in enumerate(table))


_BYTES = _byte_characters()


class Encoder:
    """``leading``: a piece keeps the blank before it (byte-level vocabularies); else case and blanks vanish."""

    def __init__(self, path: str, leading: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.leading = leading
        self.kind, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        self.known: dict[bytes, bytes] = {}
        self.mark = self._ids(MARK)[0]
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode()
        self.is_mark = np.isin(np.arange(256), [m for m in _MARKS if m not in added])
        self.is_letter = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        self.is_blank = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
        self.letters = (_ANY_WORD if leading else _SMALL_WORD).fullmatch
        # Pieces of letters alone need no normalizer and no splitting rule: the same model takes them as they are.
        # The byte-level blank opens a piece, the suffix closes it; ``edge`` marks the ids that hold it.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t[:1] == BLANK if leading else suffix and t.endswith(suffix))]] = True

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where both vocabularies cut: between a letter and a mark after it, whatever follows."""
        at = np.flatnonzero(self.is_mark[data])
        at = at[at > 1]
        before, second = data[at - 1], data[at - 2]
        return at[self.is_letter[before] | (second == 0xC3) & (before != 0x97) & (before != 0xB7)]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts without blanks, in lower case; where the pieces start (and the end); the pieces before the end of each text."""
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        blank = self.is_blank[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:] = blank
        cut[self._cuts(data)] = True
        starts = np.flatnonzero(cut)
        ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]), "right")
        # Counted without the blanks, after each of which a piece starts; empty pieces between blanks have no ids.
        return data[~blank], np.concatenate(([0], starts - np.cumsum(blank[starts - 1]))), ends

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts; where the pieces start (and the end), a blank before a piece belongs to it; the pieces before the end of each text."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.cumsum([0, *map(len, raw)])
        seen = (data > 32) & (data < 127)
        # A blank goes with what it precedes, unless that is white space; where this is not plain there is no cut.
        blank = np.flatnonzero(data[:-2] == 32)
        following, second = data[blank + 1], data[blank + 2]
        plain = seen[blank + 1] | (following > 0xC1)
        for first, seconds in _SPACES.items():
            plain &= (following != first) | ~np.isin(second, seconds)
        line = np.flatnonzero((data[1:-1] == 10) & seen[:-2] & seen[2:]) + 1
        cut = np.zeros(len(data) + 1, bool)
        for at in blank[plain], line, line + 1, self._cuts(data), bounds:
            cut[at] = True
        starts = np.flatnonzero(cut)
        return data, starts, np.searchsorted(starts, bounds[1:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        data, cuts, ends = (self._runs if self.leading else self._words)([t or "" for t in texts])
        buffers = [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
        kinds, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = self._of(kinds)
        flat = np.frombuffer(b"".join(ids), self.kind)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        starts = np.cumsum(sizes) - sizes
        counts = sizes[at]
        stops = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(stops[-1], self.kind)
        for a in range(0, len(at), BLOCK):
            own, n = at[a : a + BLOCK], counts[a : a + BLOCK]
            first, last = stops[a], stops[min(a + BLOCK, len(at))]
            out[first:last] = flat[np.arange(first, last) + np.repeat(starts[own] - stops[a : a + len(own)], n)]
        bounds = stops[np.concatenate(([0], ends))].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def _of(self, kinds: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces; new ones are remembered."""
        ids = list(map(self.known.get, kinds))
        wanted = [k for k, v in zip(kinds, ids, strict=True) if v is None]
        if not wanted:
            return ids
        fresh = self._fresh(wanted)
        ids = [fresh[k] if v is None else v for k, v in zip(kinds, ids, strict=True)]
        if len(self.known) + len(fresh) > MEMORY:
            # The pieces met first are the frequent ones; the last quarter goes.
            self.known = dict(islice(self.known.items(), MEMORY - MEMORY // 4))
        # Pieces that span a line's end hardly ever come again.
        self.known.update(islice(((k, v) for k, v in fresh.items() if b"\n" not in k or len(k) < 3), MEMORY - len(self.known)))
        return ids

    def _fresh(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces not met before."""
        kinds: dict[object, list[bytes]] = {self._letters: [], self._bare_letters: [], self._together: []}
        put, put_bare, put_other = (keys.append for keys in kinds.values())
        letters, leading = self.letters, self.leading
        for k in wanted:
            if leading and k[:1] == b" ":
                (put if k[1:].isalpha() or letters(k, 1) else put_other)(k)
            else:
                ((put_bare if leading else put) if k.isalpha() or letters(k) else put_other)(k)
        found: dict[bytes, bytes] = {}
        for encoded, keys in kinds.items():
            for at in range(0, len(keys), 20_000):
                found.update(zip(keys[at : at + 20_000], encoded(keys[at : at + 20_000]), strict=True))
        return found

    def _modelled(self, text: bytes, blank: str = " ") -> np.ndarray:
        """Ids the model gives to pieces of letters, in one call."""
        shown = text.decode("latin-1")
        shown = (shown if shown.isascii() else shown.translate(_BYTES)).replace(" ", blank)
        return np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.kind)

    def _letters(self, keys: list[bytes]) -> list[bytes]:
        """Pieces of letters; the usual way if the model does not give each its own ids."""
        flat = self._modelled(b"".join(keys), f" {BLANK}") if self.leading else self._modelled(b" ".join(keys))
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(keys):
            return self._together(keys)
        raw, width = flat.tobytes(), flat.itemsize
        starts = width * edges if self.leading else np.concatenate(([0], width * (edges[:-1] + 1)))
        bounds = [*starts.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _bare_letters(self, keys: list[bytes]) -> list[bytes]:
        """Pieces of letters without a blank before them: a lone blank stands between each two."""
        flat = self._modelled(b" ".join(keys), f" {BLANK} ")
        return self._between(flat, np.flatnonzero(self.edge[flat]), len(keys)) or self._together(keys)

    @staticmethod
    def _between(flat: np.ndarray, marks: np.ndarray, n: int) -> list[bytes] | None:
        """What stands between the marks, if they part n pieces."""
        if len(marks) != n - 1:
            return None
        raw, width = flat.tobytes(), flat.itemsize
        starts, stops = [0, *(width * (marks + 1)).tolist()], [*(width * marks).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(starts, stops, strict=True)]

    def _together(self, keys: list[bytes]) -> list[bytes]:
        """One call over all pieces with a mark between each two; one by one where the mark's own id occurs in a piece."""
        texts = [k.decode() for k in keys]
        flat = np.array(self._ids((MARK if self.leading else f" {MARK} ").join(texts)), self.kind)
        parted = self._between(flat, np.flatnonzero(flat == self.mark), len(keys))
        if parted and not any(MARK in t for t in texts):
            return parted
        return [array(self.code, self._ids(t)).tobytes() for t in texts]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, leading: bool) -> Encoder:
    """One encoder per worker and file, kept between tasks."""
    if (path, leading) not in _ENCODERS:
        _ENCODERS[path, leading] = Encoder(path, leading)
    return _ENCODERS[path, leading]
