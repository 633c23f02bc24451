"""Encoding whole texts with a tokenizer file, each distinct piece once.

A byte-level BPE that splits by its usual pattern never lets a token cross from a character that is no white space to one that
is, nor from an ASCII letter or digit to a punctuation mark. So a text is the sequence of its pieces, cut
there, and encoding the pieces one by one gives the ids of the whole text. Words repeat, so a task encodes
each distinct piece once and keeps a bounded number of them. Most pieces begin with white space and end without it: no
token crosses from one such piece to the next in any order, so the tokenizer gets them strung together, and the lengths of
the tokens tell whose they are. A text with white space beyond ASCII, or with
the string of a special token, is one piece. With a tokenizer file of another kind, each text is one piece, and nothing
is remembered.
"""

import functools
import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import hashing as H

#: Pieces that a task remembers.
REMEMBERED = 500_000
#: Bytes of text that are cut and encoded at once.
SLICE = 4 << 20
#: Pieces that are strung together for the tokenizer.
STRUNG = 200
#: Lead bytes of white space beyond ASCII: U+0085 and U+00A0, U+1680, U+2000-205F, U+3000.
_LEADS = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
#: Kinds of bytes; marks are those that no special form of the tokenizer begins with (the apostrophe is left out).
_SPACE, _WORD, _MARK, _LEAD = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _WORD
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;=?@[]^_`{|}~']] = _MARK
_KIND[list(_LEADS)] = _LEAD
_KINDS = _KIND.tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> "Encoder":
    """The encoder of this Python worker: what one task has learnt serves the worker's next tasks."""
    return Encoder(path)


def splits_as_known(spec: dict) -> bool:
    """Is this a byte-level BPE without normalizer that splits by its usual pattern?"""
    split = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", False)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return plain and added and spec["model"]["type"] == "BPE"


class Encoder:
    """Ids of whole texts. Remembered pieces lie one after another in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_piece = splits_as_known(json.loads(self.tok.to_str()))
        self.size = self.tok.get_vocab_size()
        special = {i: t.content.encode() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = list(special.values())
        # white space in the string of a special token might be that between two pieces
        self.strings = self.by_piece and not any((_KIND[list(t)] == _SPACE).any() for t in self.special)
        # the vocabulary writes each byte as one character
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.n_bytes[i] = len(special[i]) if i in special else len(token)
        self.known: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _can_string(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pieces, data[at[i]:at[i + 1]], begin with white space and surely end without it."""
        if not self.strings:
            return np.zeros(len(at) - 1, dtype=bool)
        end = at[1:]
        beyond = (data[end - 1] >= 0x80) & ((_KIND[data[end - 2]] == _LEAD) | (_KIND[data[end - 3]] == _LEAD))
        return (_KIND[data[at[:-1]]] == _SPACE) & (_KIND[data[end - 1]] != _SPACE) & ~beyond

    def _each(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), the texts taken one by one."""
        ids, sizes = [], []
        for i in range(0, len(texts), 20_000):
            for e in self.tok.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False):
                own = e.ids
                ids += own
                sizes.append(len(own))
        return np.array(ids, np.int32), np.array(sizes, np.int64)

    def _encoded(self, strung: list, single: list, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of the pieces that can be strung together and then of the others, whose
        lengths are n_bytes."""
        if not strung:
            return self._each(single)
        ids, _ = self._each(["".join(strung[i : i + STRUNG]) for i in range(0, len(strung), STRUNG)] + single)
        to, ends = np.cumsum(self.n_bytes[ids]), np.cumsum(n_bytes)
        last = np.searchsorted(to, ends)
        if len(to) and last[-1] == len(to) - 1 and np.array_equal(to[last], ends):
            return ids, np.diff(np.append(-1, last))
        # a vocabulary without some bytes has ids of other lengths
        return self._each(strung + single)

    def _lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, first, size): the ids of pieces[i] are size[i] values of flat from first[i] on."""
        texts = pieces.to_numpy(zero_copy_only=False)
        which = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(which < 0)
        data, offsets = H.utf8(pieces)
        can = self._can_string(data, offsets)[new]
        new = np.concatenate([new[can], new[~can]])
        k = int(can.sum())
        parts, sizes = self._encoded(texts[new[:k]].tolist(), texts[new[k:]].tolist(), np.diff(offsets)[new])
        flat = np.concatenate([self.flat, parts])
        at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        n = len(self.at) - 1
        which[new] = n + np.arange(len(new))
        keep = min(len(new), REMEMBERED - n) if self.by_piece else 0
        if keep > 0:
            self.known.update(zip(texts[new[:keep]].tolist(), range(n, n + keep), strict=True))
            self.flat, self.at = flat[: at[n + keep]], at[: n + keep + 1]
        return flat, at[which], (at[1:] - at[:-1])[which]

    def batch(self, column: pa.Array, spans: bool = False):
        """For runs of rows: (first row, ids, first id of each row and the end). With spans also the start and
        end character of each id in its row; an id that holds part of a character's bytes has all of it."""
        data, offsets = H.utf8(column)
        if spans and not self.by_piece:
            raise ValueError("spans need a byte-level BPE without normalizer")
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
            yield (i, *self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], spans))
            i = j

    def _special(self, data: np.ndarray) -> np.ndarray:
        """Where the string of a special token stands."""
        raw, at = data.tobytes(), []
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                at.append(i)
                i = raw.find(s, i + 1)
        return np.array(at, dtype=np.int64)

    def _slice(self, data: np.ndarray, rows: np.ndarray, spans: bool):
        if not len(data):
            none = np.zeros(0, np.int64)
            return (none, np.zeros(len(rows), np.int64)) + ((none, none) if spans else ())
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        first = kind == _SPACE
        first[1:] &= ~first[:-1]
        first[1:] |= (kind[:-1] == _WORD) & (kind[1:] == _MARK)
        whole = [self._special(data)]
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            lead = lead[lead + 1 < len(data)]
            after = data[lead + 1]
            odd = np.zeros(len(lead), dtype=bool)
            for b, seconds in _LEADS.items():
                for x in seconds:
                    odd |= (data[lead] == b) & (after == x)
            whole.append(lead[odd])
        for r in np.unique(np.searchsorted(rows, np.concatenate(whole), side="right") - 1):
            first[rows[r] : rows[r + 1]] = False
        if not self.by_piece:
            first[:] = False
        first[rows[:-1][rows[1:] > rows[:-1]]] = True
        cut = np.append(np.flatnonzero(first), len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_utf8(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        flat, start, size = self._lookup(coded.dictionary)
        each = size[which]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1]) + np.repeat(start[which] - (ends - each), each)]
        first_id = np.append(0, ends)[np.searchsorted(cut, rows)]
        if not spans:
            return ids, first_id
        to = np.cumsum(self.n_bytes[ids])
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1  # the character that a byte is part of
        base = np.repeat(np.append(char, char[-1] + 1)[rows[:-1]], np.diff(first_id))
        return ids, first_id, char[to - self.n_bytes[ids]] - base, char[to - 1] + 1 - base
