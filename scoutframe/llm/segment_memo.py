"""Token counts and ids of many texts, encoding each distinct stretch of a slice once.

Both vocabularies in use split text before any merge, and never join what stands on the two sides of a *stable
boundary*: an ASCII white-space character after a character that is no white space. (Byte-level: every alternative of
the split pattern that takes white space starts with it; a look-ahead at the end of a run of white space sees the run's
own following character, which lies in the same stretch. Word-level: white space is removed. Special strings contain
no white space.) So the tokens of a text are those of its stretches, one after the other.
"""

from __future__ import annotations

import os

import numpy as np

from .textbytes import WHITE, Slice

MEMO_ENTRIES = 400_000  # remembered stretches per worker; beyond it rare ones are forgotten, which only costs time
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def stretches(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all stretches (white space, then a word), and where each document's begin (n + 1 numbers)."""
    data = s.data
    white = WHITE[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = white[1:] & ~white[:-1]
    at = np.flatnonzero(cut)
    # a white-space character beyond ASCII before the place: C2 85, C2 A0, or three bytes led by E1, E2 or E3
    two = (data[np.maximum(at - 2, 0)] == 0xC2) & ((data[at - 1] == 0x85) | (data[at - 1] == 0xA0))
    lead = data[np.maximum(at - 3, 0)]
    three = (lead >= 0xE1) & (lead <= 0xE3) & (data[at - 1] >= 0x80)
    cut[at[two | three]] = False
    cut[s.offsets[:-1][np.diff(s.offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, s.offsets)


class Separator:
    """A control character that stands between stretches when many are encoded in one call.

    No token but its own holds it, so nothing merges with it. Stretches that could be split otherwise beside it
    (see ``fits``) are encoded by themselves.
    """

    def __init__(self, library, spaced: bool):
        self.text = None
        for code in range(1, 9):
            ids = library.encode(chr(code), add_special_tokens=False).ids
            if len(ids) == 1:
                mark = library.id_to_token(ids[0])[0]
                if sum(mark in t for t in library.get_vocab()) <= 1 + spaced:  # alone, and alone at the end of a word
                    self.char, self.id = chr(code), ids[0]
                    self.text = f" {self.char} " if spaced else self.char
                    return

    def fits(self, s: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Word-level: words without the character. Byte-level: also, white space first and none at the end."""
        if self.text is None:
            return np.zeros(len(starts), dtype=bool)
        held = np.concatenate([[0], np.cumsum(s.data == ord(self.char))])
        free = held[ends] == held[starts]
        if len(self.text) > 1:
            return free
        last = s.data[ends - 1]
        return free & WHITE[s.data[starts]] & ~WHITE[last] & (last < 128)


class Memo:
    """Distinct stretches and their encodings, one per worker and vocabulary.

    A stretch is known by two fingerprints, 128 bits; all look-ups of a slice are one search in a sorted array. When the
    memo is full, what was met in one slice only is forgotten.
    """

    def __init__(self, path: str, spaced: bool):
        self.library = tokenizer(path)
        self.separator = Separator(self.library, spaced)
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths, self.begins, self.met = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.flat, self.used, self.count, self.end_id = np.zeros(1 << 18, dtype=np.uint32), 0, 0, None

    def reserve(self, end_id: int) -> None:
        """Number 0 stands for the end of a document."""
        if self.end_id != end_id:
            self.clear()
            self._add(np.array([1]), np.array([end_id], dtype=np.uint32), keep_ids=True)
            self.end_id = end_id

    def _add(self, lengths: np.ndarray, ids: np.ndarray, keep_ids: bool) -> np.ndarray:
        base, self.count = self.count, self.count + len(lengths)
        while self.count > len(self.lengths):
            self.lengths, self.begins, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.begins, self.met))
        self.lengths[base : self.count], self.met[base : self.count] = lengths, 0
        if keep_ids:
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.begins[base : self.count] = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return np.arange(base, self.count)

    def _forget(self) -> None:
        """Keep what several slices held, at most half of the entries, and number it anew."""
        least = 2
        while (self.met[: self.count] >= least).sum() > MEMO_ENTRIES // 2:
            least *= 2
        keep = self.met[: self.count] >= least
        keep[: self.end_id is not None] = True
        number = np.cumsum(keep) - 1
        lengths, begins = self.lengths[: self.count][keep], self.begins[: self.count][keep]
        place = np.cumsum(lengths) - lengths
        if self.used:
            ids = self.flat[np.repeat(begins - place, lengths) + np.arange(lengths.sum())]
            self.flat[: len(ids)], self.used = ids, len(ids)
        self.count = len(lengths)
        self.lengths[: self.count], self.begins[: self.count], self.met[: self.count] = lengths, place, 0
        stays = keep[self.at]
        self.keys, self.checks, self.at = self.keys[stays], self.checks[stays], number[self.at[stays]]

    def _encode_one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        return np.array([len(x) for x in ids], dtype=np.int64), np.array([y for x in ids for y in x], dtype=np.uint32)

    def _encode_together(self, s: Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of some stretches, with a separator between each two, in one call."""
        mark = np.frombuffer(self.separator.text.encode(), dtype=np.uint8)
        sizes = ends - starts + len(mark)
        place = np.cumsum(sizes) - sizes
        text = s.data[np.minimum(np.repeat(starts - place, sizes) + np.arange(sizes.sum()), len(s.data) - 1)]
        for i, byte in enumerate(mark):
            text[place + sizes - len(mark) + i] = byte
        joined = text[: -len(mark)].tobytes().decode()
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
        between = ids == self.separator.id
        lengths = np.diff(np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])) - 1
        assert len(lengths) == len(starts)
        return lengths, ids[~between]

    def numbers(self, s: Slice, starts: np.ndarray, ends: np.ndarray, keep_ids: bool) -> np.ndarray:
        """For each stretch of a slice its number in the memo."""
        if self.count > MEMO_ENTRIES:
            self._forget()
        check = s.fingerprints(starts, ends, seed=1)
        keys, first, back = np.unique(s.fingerprints(starts, ends), return_index=True, return_inverse=True)
        checks = check[first]
        place = np.searchsorted(self.keys, keys)
        found = np.full(len(keys), -1, dtype=np.int64)
        inside = np.flatnonzero(place < len(self.keys))
        same = inside[(self.keys[place[inside]] == keys[inside]) & (self.checks[place[inside]] == checks[inside])]
        found[same] = self.at[place[same]]
        fresh = np.flatnonzero(found < 0)
        starts, ends = starts[first], ends[first]
        fits = self.separator.fits(s, starts[fresh], ends[fresh])
        some = fresh[fits]
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            found[part] = self._add(*self._encode_together(s, starts[part], ends[part]), keep_ids)
        alone = fresh[~fits]
        for i in range(0, len(alone), 256):
            part = alone[i : i + 256]
            pieces = [s.data[a:b].tobytes() for a, b in zip(starts[part].tolist(), ends[part].tolist())]
            found[part] = self._add(*self._encode_one_by_one(pieces), keep_ids)
        self.met[found] += 1
        if len(fresh):
            self.keys, self.checks, self.at = (np.insert(old, place[fresh], new[fresh]) for old, new in ((self.keys, keys), (self.checks, checks), (self.at, found)))
        return found[back]


_MEMOS: dict = {}


def memo(path: str, spaced: bool) -> Memo:
    """The worker's memo for stretches that white space parts (spaced, without it) or that begin with white space."""
    if (path, spaced) not in _MEMOS:
        _MEMOS[path, spaced] = Memo(path, spaced)
    return _MEMOS[path, spaced]


def token_counts(s: Slice, path: str) -> np.ndarray:
    """Tokens of each document of a slice."""
    starts, first = stretches(s)
    if not len(starts):
        return np.zeros(s.n, dtype=np.int64)
    m = memo(path, spaced=False)
    numbers = m.numbers(s, starts, np.append(starts[1:], len(s.data)), keep_ids=False)
    total = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(m.lengths[numbers], out=total[1:])
    return np.diff(total[first])


def token_ids(s: Slice, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a slice, each followed by end_id, and where each document's begin (n + 1 numbers)."""
    starts, ends, first = s.words()
    m = memo(path, spaced=True)
    m.reserve(end_id)
    numbers = m.numbers(s, starts, ends, keep_ids=True) if len(starts) else np.zeros(0, np.int64)
    numbers = np.insert(numbers, first[1:], 0)
    lengths = m.lengths[numbers]
    place = np.concatenate([[0], np.cumsum(lengths)])
    out = m.flat[np.repeat(m.begins[numbers] - place[:-1], lengths) + np.arange(place[-1])]
    return out, place[np.append(first[:-1] + np.arange(s.n), len(numbers))]
