"""Token ids of whole texts, by a public word-level BPE tokenizer, with caches of what repeats.

The tokenizer lower-cases, treats all white space alike and never joins across it, so the ids of a text are
those of its parts between white space, in order. A part is cut into pieces (letters, a digit, signs) as the
tokenizer's own rule does, and a piece is encoded once per worker while the caches have room. Texts with
characters beyond Latin, where lower case or composition follow wider rules, and texts that hold the name of a
special token go through the whole tokenizer. A cache is two generations: a full one waits until the next is full,
and what is met again moves on, so the words that recur stay and the many that come once do not pile up. Parts are looked up many at a time, as arrays, by a
hash of 64 bits.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

# Names and the cutting rule of the tokenizer, the latter written out for Latin letters and digits.
SPECIAL_NAMES = ("<|startoftext|>", "<|endoftext|>")
LETTERS, DIGITS = "a-zªµºß-öø-ž", "0-9²³¹¼½¾"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
END = "</w>"
#: Printable ASCII, the usual white space, and Latin letters that have one lower-case form and no marks to compose.
PLAIN = re.compile("[\t\n\r -~¡-įı-ňŊ-ž]*")

CACHED_BYTES = 32 << 20  # of each generation of a cache, entries counted with what they hold
ENTRY_BYTES = 16  # of a part beside its hash and ids
PIECE_BYTES = 200  # of a piece beside its text and ids
TOGETHER = 1 << 20  # characters of texts whose parts are looked up at once
BLANK = re.compile("[\t\n\r ]")

MULTIPLIER = 0x9E3779B97F4A7C15  # of the parts' hash, a sum of a random number for each byte times a power of the multiplier
RANDOM = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Recent:
    """Ids of what was met lately: ``young`` and the generation before it."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def add(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.size += PIECE_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def missing(self, names: set[str]) -> set[str]:
        """The names in neither generation; those in the old one become young."""
        names = names.difference(self.young)
        if self.old and (again := names.intersection(self.old)):
            self.add({name: self.old[name] for name in again})
            names -= again
        return names

    def turn(self) -> None:
        if self.size > CACHED_BYTES:
            self.young, self.old, self.size = {}, self.young, 0


class Generation:
    """Ids by hash: sorted hashes, and where each one's ids start in one array and how many they are."""

    def __init__(self):
        self.keys, self.start, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at all these places, end to end, and their numbers."""
        n = self.n[at]
        past = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat(self.start[at] - past + n, n) + np.arange(past[-1] if len(past) else 0)], n

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New keys in order, with their ids end to end."""
        place = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, place, len(self.ids) + np.cumsum(n, dtype=np.int64) - n)
        self.keys, self.n, self.ids = np.insert(self.keys, place, keys), np.insert(self.n, place, n), np.concatenate([self.ids, ids])

    def size(self) -> int:
        return (ENTRY_BYTES + 8) * len(self.keys) + 4 * len(self.ids)

    def items(self):
        for key, start, n in zip(self.keys, self.start.tolist(), self.n.tolist(), strict=True):
            yield key.tobytes(), self.ids[start : start + n].tobytes()


class Parts:
    """Ids of parts met lately: ``young`` and the generation before it."""

    def __init__(self):
        self.young, self.old = Generation(), Generation()

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys (in order) in neither generation; those in the old one become young."""
        new = np.flatnonzero(self.young.find(keys) < 0)
        at = self.old.find(keys[new])
        again = at >= 0
        self.young.add(keys[new[again]], *self.old.take(at[again]))
        return new[~again]

    def turn(self) -> None:
        if self.young.size() > CACHED_BYTES:
            self.young, self.old = Generation(), self.young


_POWERS: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least so many."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            factors = np.full(max(size, TOGETHER), base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
    return _POWERS[0], _POWERS[1]


def hashed_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each stretch between white space; ``data`` starts and ends with such."""
    blank = data <= 32
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    power, back = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(RANDOM[data] * power[: len(data)], out=total[1:])
    return (total[end] - total[start]) * back[start], start, end


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces_only = Tokenizer.from_file(path)  # for pieces that are lower-cased and cut already
        self.pieces_only.normalizer, self.pieces_only.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(END)]] = True
        self.letters = byte_letters()
        self.parts, self.pieces = Parts(), Recent()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What is new in about ``TOGETHER`` characters of texts is learnt at once; longer texts are cut at white space."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, of, size = [], [], 0

        def finish():
            for i, ids in zip(of, self._encode_some(held), strict=True):
                out[i].append(ids)
            held.clear()
            of.clear()

        for i, text in enumerate(texts):
            if not PLAIN.fullmatch(text) or any(name in text for name in SPECIAL_NAMES):
                out[i] = self.whole([text])
                continue
            at = 0
            while at < len(text):
                cut = BLANK.search(text, at + TOGETHER) if len(text) - at > TOGETHER else None
                past = cut.start() if cut else len(text)
                held.append(text[at:past])
                of.append(i)
                size, at = size + past - at, past
                if size >= TOGETHER:
                    finish()
                    size = 0
        if held:
            finish()
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        raw = f"\n{'\n'.join(texts)}\n".encode()
        keys, start, end = hashed_parts(np.frombuffer(raw, np.uint8))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = self.parts.missing(distinct)
        if len(new):
            at = first[new]
            words = b"\n".join([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            self.parts.young.add(distinct[new], *self._learn(words.decode().lower().split("\n")))
        ids, n = self.parts.young.take(self.parts.young.find(distinct)[inverse])
        size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts)) + 1
        past = np.r_[0, np.cumsum(n, dtype=np.int64)][np.searchsorted(start, 1 + np.cumsum(size))].tolist()
        self.parts.turn()
        self.pieces.turn()
        return [ids[a:b].tobytes() for a, b in zip([0, *past[:-1]], past, strict=True)]

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case parts, end to end, and their numbers; new pieces go through the model together, and each ends at its end-of-word id."""
        cut = list(map(PIECE.findall, parts))
        new = list(self.pieces.missing(set(chain.from_iterable(cut))))
        if new:
            text = " ".join(new)
            if not text.isascii():
                text = " ".join([p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in new])
            ids = np.array(self.pieces_only.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            past = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            self.pieces.add({piece: data[at:end] for piece, at, end in zip(new, [0, *past[:-1]], past, strict=True)})
        found = list(map(self.pieces.young.__getitem__, chain.from_iterable(cut)))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        past = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        n = np.diff(np.r_[0, np.r_[0, np.cumsum(size)][past]])
        return np.frombuffer(b"".join(found), "<u4"), n.astype(np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
