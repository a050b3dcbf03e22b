"""Language-model scores: logistic mixing of hashed-context bit predictors, and a smoothed unigram base.

The model reads a text's UTF-8 bytes and an end mark, and predicts them a bit at a time, the highest first. For each of
the orders 1 to 5 the last bytes are hashed to a context; its counts of zeros and ones at this bit give a probability.
The probabilities are stretched (log odds) and added with weights that a gate selects: the place of the bit, and the
longest context that has been seen. The mix is then refined by a table over the bits so far and the mixed log odds.

Counts come from all training texts, as one aggregation over (context, byte); the counts of a bit are sums over ranges of
bytes. Weights and the refinement are learnt online, window after window, in each task over its share of the training
texts, and tasks are averaged by the bits they have seen; an occurrence never counts as evidence for itself. Scoring
changes nothing, so a text's score depends neither on its neighbours nor on a lost task. A window (five bytes and the
next) always costs the same, so each task computes it once and then looks it up.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import fold, stored, whole_text

WORD = 0  # the context of the word so far, in place of an order
ORDERS = (1, 2, 3, 4, 5, WORD)
WINDOW = max(ORDERS) + 1
HASH_BITS = {1: 8, 2: 14, 3: 15, 4: 16, 5: 16, WORD: 16}  # contexts per order, as a power of two: the bound of the model's size
END = 0xFF  # never part of UTF-8
STEPS = {3: (3.0,), 5: (1.0, 4.0, 30.0), WORD: (1.0, 3.0, 10.0, 60.0)}  # the gate: how often these contexts have been seen
PRIOR = 0.05  # added to the count of either bit
CELLS, REACH = 33, 8.0  # of the refinement, over log odds from -REACH to REACH
CACHE_BITS = 22  # windows whose cost a task remembers
FREQUENT = 200_000  # the most frequent words, at most so many, are broadcast with their counts
LONGEST_FREQUENT = 64  # bytes of a broadcast word

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = 39  # of 63 for the place of a window; a slot needs the others
TIMES_BITS = 40  # of 64 for how often a task sees a window; a slot needs the others


BLOCK = 1 << 17  # bytes of texts turned to windows at once, at least one text
SCORED = 1 << 19  # bytes of texts scored at once, at least one text
CHUNK = 1 << 21  # windows sorted at once
MERGED = 1 << 21  # distinct windows that are held between chunks
AT_ONCE = 2_000  # windows or slots computed at once, so that they stay in a core's cache
GROUP = 16 * 2 * AT_ONCE  # windows whose slots are looked up together

_POWERS: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, from the zeroth to the ``size``-th."""
    if not _POWERS or len(_POWERS[0]) <= size:
        _POWERS[:] = []
        for base in (int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64)):
            factors = np.full(max(size, 2 * BLOCK) + 1, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
    return _POWERS[0], _POWERS[1]


#: Per byte: lower-cased and one more; 255, which is never part of a word, stays.
FOLDED = bytes(min((c + 32 if 65 <= c <= 90 else c) + 1, 255) for c in range(256))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per byte (texts end to end, each with its end mark) the byte, the five before it and a hash of the word so far, as one number; and where texts start."""
    gap = bytes([END]) * 8
    raw = np.frombuffer(b"".join([gap[:7], gap.join(texts), gap]), np.uint8)  # after its end mark, a text is followed by seven more
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 8
    data = raw[7:]
    last_eight = np.ndarray(len(data), ">u8", raw, strides=(1,))
    keys = last_eight.astype(np.uint64)
    keys &= np.uint64((1 << (8 * WINDOW)) - 1)
    keys |= word_hashes(data) << np.uint64(8 * WINDOW)
    past = np.cumsum(size)
    keep = np.ones(len(data), bool)
    for i in range(1, 8):
        keep[past - i] = False
    return keys[keep], np.r_[0, np.cumsum(size - 7)]


def blocks(texts: list[bytes], size: int = BLOCK):
    """The texts in runs of about so many bytes."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def counted(texts: list[bytes]):
    """Distinct windows and their numbers, in chunks of about ``CHUNK`` windows."""
    held, size = [], 0
    for part in blocks(texts):
        held.append(windows(part)[0])
        size += len(held[-1])
        if size >= CHUNK:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of several such lists, each ascending, and the sums of their numbers."""
    keys, times = parts[0][0], parts[0][1].copy()
    for more, n in parts[1:]:
        at = np.searchsorted(keys, more)
        here = keys.take(at, mode="clip") == more
        times[at[here]] += n[here]
        here = ~here
        keys, times = np.insert(keys, at[here], more[here]), np.insert(times, at[here], n[here])
    return keys, times


def distinct_windows(batches):
    """Distinct windows of all texts of a task and their numbers, in as few lists as ``MERGED`` allows."""
    held, size, parts = [], 0, []
    for batch in batches:
        for texts in texts_of(batch):
            held += texts
            size += sum(map(len, texts))
            if size >= CHUNK:
                parts = [merge([*parts, *counted(held)])]
                held, size = [], 0
                if len(parts[0][0]) > MERGED:
                    yield parts.pop()
    if held:
        parts = [merge([*parts, *counted(held)])]
    yield from parts


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Per byte a hash of the letters between the last blank or mark and it; A-Z count as a-z.

    A sum of byte times power, of which a stretch is the difference of two sums, divided by the power at its start.
    """
    size = len(data)
    power, back = powers(size)
    total = np.zeros(size + 1, np.uint64)
    np.multiply(np.frombuffer(data.tobytes().translate(FOLDED), np.uint8), power[:size], out=total[1:])
    np.cumsum(total, out=total)
    start = np.r_[0, np.flatnonzero((data <= 32) | (data == END)) + 1]  # of each stretch
    length = np.diff(start, append=size)
    stretch = total[:-1]
    stretch -= np.repeat(total[start], length)
    stretch *= np.repeat(back[start] * np.uint64(0xD6E8FEB86659FD93), length)
    stretch >>= np.uint64(64 - HASH_BITS[WORD])
    return stretch


def context(keys: np.ndarray, order: int) -> np.ndarray:
    """Hashed context of each window: the ``order`` bytes before the last."""
    if order == WORD:
        return (keys >> np.uint64(8 * WINDOW)).astype(np.int64)
    before = (keys >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    if order == 1:
        return before.astype(np.int64)
    return ((before * MULTIPLIER) >> np.uint64(64 - HASH_BITS[order])).astype(np.int64)


def slot_counts(keys: np.ndarray, times: np.ndarray):
    """(order, slots, numbers): how often each byte followed each hashed context, of distinct windows and their numbers."""
    byte, times = (keys & np.uint64(255)).astype(np.int64), times.astype(np.uint64)
    for k in ORDERS:
        both = (context(keys, k) << 8 | byte).astype(np.uint64) << np.uint64(TIMES_BITS) | times  # sorted as one number, which is much faster than by place
        both.sort()
        slot = both >> np.uint64(TIMES_BITS)
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        n = np.add.reduceat(both & np.uint64((1 << TIMES_BITS) - 1), first).astype(np.int64)
        slot = slot[first].astype(np.int64)
        for at in range(0, len(slot), 200_000):
            yield k, slot[at : at + 200_000], n[at : at + 200_000]


MOST = 60_000  # a context seen more often has its counts scaled down to about this many, none below one


#: Per byte and place of a bit: the bit; the bits before it, with a leading one.
BITS_OF = np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1
NODES = (np.arange(256)[:, None] | 256) >> np.arange(8, 0, -1)
ONES = BITS_OF.astype(np.float32)
SIGNS = 2 * ONES - 1
_MASKS = np.ascontiguousarray(np.negative(BITS_OF.astype(np.uint16)).T)  # 65535 where the bit is a one
_NODES = np.ascontiguousarray(NODES.T)


def trees(counts: np.ndarray, rows: int = 4096) -> None:
    """Turns each row's 256 counts of bytes, in place, to their sum and then, per node, the sum of the bytes that go on with a zero."""
    for at in range(0, len(counts), rows):
        out = counts[at : at + rows]
        level, width = out.copy(), 128
        while width:
            out[:, width : 2 * width] = level[:, 0::2]
            level = level[:, 0::2] + level[:, 1::2]
            width //= 2
        out[:, 0] = level[:, 0]


class Predictors:
    """Counts of bytes as trees over their bits, two bytes of memory each."""

    def __init__(self, entries: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.tree, self.scale = {}, {}
        for k in ORDERS:
            size = 1 << HASH_BITS[k]
            table = np.zeros((size, 256), np.uint16)
            slot, n = entries.get(k, (np.zeros(0, np.int64), np.zeros(0)))
            row = slot >> 8
            excess = np.maximum(np.bincount(row, n, size) / MOST, 1)
            table[row, slot & 255] = np.maximum(n / excess[row], 1)
            trees(table)
            self.tree[k] = table.reshape(-1)
            self.scale[k] = (1 / excess).astype(np.float32)  # what one occurrence counts

    def slot_odds(self, k: int, slots: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Log odds (slots, 8 bits) of an order's slots and, where the gate asks, how many of its steps are reached."""
        x, reached = np.empty((len(slots), 8), np.float32), np.zeros((len(slots), 8), np.int16) if k in STEPS else None
        seen = np.empty((9, AT_ONCE), np.uint16)  # of the bytes that share the first 0 to 8 bits
        prior = np.float32(PRIOR)
        for at in range(0, len(slots), AT_ONCE):
            slot = slots[at : at + AT_ONCE]
            byte, row = slot & 255, slot & ~255
            ones = _MASKS.take(byte, 1)
            node = _NODES.take(byte, 1)
            node += row
            zeros = self.tree[k].take(node)
            seen = seen[:, : len(slot)]
            seen[0] = self.tree[k].take(row)
            zeros ^= ones
            zeros -= ones
            for d in range(8):  # its zeros, or what is left without them
                np.bitwise_and(seen[d], ones[d], out=seen[d + 1])
                seen[d + 1] += zeros[d]
            other = (seen[:8] - seen[1:]).astype(np.float32)
            same = seen[1:].astype(np.float32)
            if own:
                same -= self.scale[k].take(row >> 8) * np.float32(own)
            if reached is not None:
                total, steps = same + other, np.zeros(same.shape, np.int16)
                for step in STEPS[k]:
                    steps += total >= np.float32(step)
                reached[at : at + AT_ONCE] = steps.T
            same += prior
            other += prior
            same /= other
            np.log(same, out=same)
            x[at : at + AT_ONCE] = same.T
        x *= SIGNS.take(slots & 255, 0)
        return x, reached

    def odds(self, keys: np.ndarray, own: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per order log odds (windows, 8 bits), gates (windows, 8) and bytes; ``own`` occurrences are left out of the counts.

        Windows that share an order's slot share its odds, and slots are looked up in ascending order.
        """
        byte, place = (keys & np.uint64(255)).astype(np.int64), np.arange(len(keys))
        x, gates, within = [], np.zeros((len(keys), 8), np.int16), np.empty(len(keys), np.int64)
        for k in ORDERS:
            both = (context(keys, k) << 8 | byte) << PLACE_BITS | place
            both.sort()
            slot = both >> PLACE_BITS
            first = np.r_[True, slot[1:] != slot[:-1]][: len(slot)]
            within[both & ((1 << PLACE_BITS) - 1)] = np.cumsum(first) - 1
            odds, reached = self.slot_odds(k, slot[first], own)
            x.append(odds.take(within, 0))
            if reached is not None:
                gates *= len(STEPS[k]) + 1
                gates += reached.take(within, 0)
        gates *= 8
        gates += np.arange(8, dtype=np.int16)
        return x, gates, byte


def one_of(mixed: np.ndarray) -> np.ndarray:
    """Probability of a one at these log odds."""
    out = np.negative(mixed)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


STATES = math.prod(len(s) + 1 for s in STEPS.values())
GATES = STATES * 8


class Mixer:
    """Gated weights and the refinement table, both learnt online."""

    def __init__(self):
        self.weights = np.full((len(ORDERS), GATES), 0.3)
        self.squares = np.full((len(ORDERS), GATES), 1e-2)
        self.cells = np.zeros(256 * CELLS * 2)  # by node, cell and bit
        self.gradient, self.total = np.zeros((len(ORDERS), GATES)), np.zeros(GATES)  # of what was seen since the last step
        self.bits = 0.0

    def mix(self, x: list[np.ndarray], gates: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        mixed = weights[0][gates]
        mixed *= x[0]
        for i in range(1, len(ORDERS)):
            part = weights[i][gates]
            part *= x[i]
            mixed += part
        return mixed

    def learn(self, x, gates, byte, times) -> None:
        """A step of learning for each 4,000 windows."""
        for start in range(0, len(byte), 2 * AT_ONCE):
            for at in (start, start + AT_ONCE):
                some = slice(at, at + AT_ONCE)
                self.see([odds[some] for odds in x], gates[some], byte[some], times[some])
            self.step()

    def see(self, x, gates, byte, times) -> None:
        """Adds these windows to what the next step learns from."""
        gates = gates.astype(np.int64)
        mixed = self.mix(x, gates)
        cell, share = self._cell(mixed)
        cell += NODES.take(byte, 0) * CELLS
        at = (cell << 1 | BITS_OF.take(byte, 0)).ravel()
        heavy = np.repeat(times.astype(np.float32), 8)
        upper = heavy * share.ravel()
        self.cells += np.bincount(at, heavy - upper, len(self.cells))
        self.cells += np.bincount(at + 2, upper, len(self.cells))
        error = ONES.take(byte, 0)
        error -= one_of(mixed)
        error *= heavy.reshape(error.shape)
        flat = gates.ravel()
        self.total += np.bincount(flat, heavy, GATES)
        for i in range(len(ORDERS)):
            self.gradient[i] += np.bincount(flat, (error * x[i]).ravel(), GATES)

    def step(self, rate: float = 0.05) -> None:
        gradient = self.gradient / np.maximum(self.total, 1)
        self.squares += gradient**2
        self.weights += rate * gradient / np.sqrt(self.squares)
        self.bits += self.total.sum()
        self.gradient[:], self.total[:] = 0, 0

    @staticmethod
    def _cell(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.clip((mixed + REACH) * ((CELLS - 1) / (2 * REACH)), 0, CELLS - 1.001)
        cell = place.astype(np.int64)
        return cell, place - cell

    def refinement(self) -> np.ndarray:
        """Probability of a one per node and cell; where little was seen, that of the cell's log odds."""
        middle = np.tile(1 / (1 + np.exp(-(np.arange(CELLS) * (2 * REACH / (CELLS - 1)) - REACH))), 256)
        zeros, ones = self.cells[0::2], self.cells[1::2]
        return ((ones + 8 * middle) / (zeros + ones + 8)).astype(np.float32)

    def cost(self, x, gates, byte, table: np.ndarray) -> np.ndarray:
        """Bits that each window's last byte costs."""
        parts = (slice(at, at + AT_ONCE) for at in range(0, len(byte), AT_ONCE))
        return np.concatenate([self._cost([odds[some] for odds in x], gates[some], byte[some], table) for some in parts])

    def _cost(self, x, gates, byte, table: np.ndarray) -> np.ndarray:
        mixed = self.mix(x, gates.astype(np.int64))
        cell, share = self._cell(mixed)
        cell += NODES.take(byte, 0) * CELLS
        low, p = table[cell], table[1:][cell]
        p -= low
        p *= share
        p += low
        p += one_of(mixed)
        p *= np.float32(0.5)
        np.clip(p, 1e-6, 1 - 1e-6, out=p)
        p *= SIGNS.take(byte, 0)  # of a one, to that of the bit
        p += 1 - ONES.take(byte, 0)
        return -np.log2(p, out=p).sum(axis=1)


class Scorer:
    """Total bits of texts; windows are computed once and remembered."""

    def __init__(self, predictors: Predictors, mixer: Mixer):
        self.predictors, self.mixer, self.table = predictors, mixer, mixer.refinement()
        self.known = np.zeros(1 << CACHE_BITS, [("window", np.uint64), ("cost", np.float32)])
        self.known["window"] = 0xFFFFFFFFFFFFFFFF

    def bits(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self._bits(part) for part in blocks(texts, SCORED)]) if texts else np.zeros(0)

    @staticmethod
    def _places(keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        keys, starts = zip(*map(windows, blocks(texts)), strict=True)
        keys, lengths = np.concatenate(keys), np.concatenate([np.diff(s) for s in starts])
        places = self._places(keys)
        found = self.known.take(places)
        new = np.flatnonzero(found["window"] != keys)
        cost = found["cost"].astype(np.float64)
        if len(new):
            wanted = keys[new]
            distinct = np.sort(wanted)
            distinct = distinct[np.r_[True, distinct[1:] != distinct[:-1]]]
            fresh = np.concatenate([self.mixer.cost(*self.predictors.odds(distinct[a : a + GROUP]), self.table) for a in range(0, len(distinct), GROUP)])
            place = self._places(distinct)
            self.known["window"][place], self.known["cost"][place] = distinct, fresh  # of windows in one place the last stays, in both
            found = self.known.take(places[new])
            cost[new] = found["cost"]
            other = np.flatnonzero(found["window"] != wanted)
            cost[new[other]] = fresh[np.searchsorted(distinct, wanted[other])]
        return np.add.reduceat(cost, np.cumsum(lengths) - lengths)


WORDS, TEXTS = -1, -2  # kinds of partial counts beside the orders
COUNTS = {"word": pa.binary(), "n": pa.int64(), "block": pa.int32(), "slots": pa.binary(), "times": pa.binary()}


def packed(slot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Blocks of 2^16 slots, and for each the ascending slots in it (two bytes each) and their numbers (eight)."""
    block = slot >> 16
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
    ends = [*first[1:], len(slot)]
    low, n = slot.astype("<u2"), n.astype("<i8")
    return block[first], [low[a:b].tobytes() for a, b in zip(first, ends, strict=True)], [n[a:b].tobytes() for a, b in zip(first, ends, strict=True)]


def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a block's counts, of all its rows."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for slots, times in zip(batch["slots"], batch["times"], strict=True):
            total[np.frombuffer(slots.as_buffer(), "<u2")] += np.frombuffer(times.as_buffer(), "<i8")
    found = np.flatnonzero(total)
    out = [key[0], key[1], found.astype("<u2").tobytes(), total[found].astype("<f4").tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], t) for x, t in zip(out, kinds, strict=True)], names=["kind", "block", "slots", "times"])


def training(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id, as text, leaves another remainder by 7 than 2 (a null id trains)."""
    return docs.filter(~fold("doc_id", 7, 2)).select(whole_text().alias("text"))


def texts_of(batch: pa.RecordBatch, rows: int = 500):
    for at in range(0, batch.num_rows, rows):
        yield batch["text"].slice(at, rows).cast(pa.binary()).to_pylist()


def partial_counts(docs: DataFrame) -> DataFrame:
    """(kind, word, n, block, slots, times): counts of each task over its training texts; kinds are orders, words and texts.

    An order's counts are a row for each block of contexts, with its slots and their numbers as arrays.
    """
    def rows(kind: int, word=None, n=None, blocks=None):
        size = len(blocks[0] if blocks else n)
        given = {"word": word, "n": n} | dict(zip(("block", "slots", "times"), blocks or (), strict=False))
        columns = [pa.array(given[c], t) if given.get(c) is not None else pa.nulls(size, t) for c, t in COUNTS.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *columns], names=["kind", *COUNTS])

    def words_out(words: Counter):
        items = list(words.items())
        for at in range(0, len(items), 100_000):
            word, n = zip(*items[at : at + 100_000], strict=True)
            yield rows(WORDS, word=word, n=n)

    def count(batches):
        words, total, ready = Counter(), 0, []

        def tapped():
            nonlocal total
            for batch in batches:
                for texts in texts_of(batch):
                    total += len(texts)
                    for text in texts:
                        words.update(text.lower().split())
                    if len(words) > 400_000:
                        ready.extend(words_out(words))
                        words.clear()
                yield batch

        for keys, times in distinct_windows(tapped()):
            yield from ready
            ready.clear()
            for kind, slot, n in slot_counts(keys, times):
                yield rows(kind, blocks=packed(slot, n))
        yield from ready
        yield from words_out(words)
        if total:
            yield rows(TEXTS, n=[total])

    return stored(training(docs).mapInArrow(count, "kind int, word binary, n long, block int, slots binary, times binary"), "lm-counts")


class Model:
    """What a task needs: context counts and, to score, mixer and frequent words. Sent as arrays, which are dropped when a worker unfolds them."""

    def __init__(self, entries: dict[int, tuple[np.ndarray, np.ndarray]], mixer: Mixer | None = None, words: dict[bytes, float] | None = None):
        self.entries, self.mixer, self.words = entries, mixer, words

    def unfolded(self) -> Predictors | Scorer:
        """The model's predictors, or with a mixer its scorer; they live as long as the broadcast they came with."""
        if not hasattr(self, "_unfolded"):
            predictors = Predictors(self.entries)
            self._unfolded = Scorer(predictors, self.mixer) if self.mixer else predictors
            self.entries = None
        return self._unfolded


def context_counts(partials: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts per order; at most 256 slots per context, and contexts are bounded by ``HASH_BITS``."""
    sums = partials.filter("kind >= 0").select("kind", "block", "slots", "times").groupBy("kind", "block")
    found = sums.applyInArrow(summed, "kind int, block int, slots binary, times binary").toArrow().to_pylist()
    entries = {}
    for k in ORDERS:
        some = [r for r in found if r["kind"] == k]
        slots = [np.frombuffer(r["slots"], "<u2").astype(np.int32) | r["block"] << 16 for r in some]
        entries[k] = np.concatenate([np.zeros(0, np.int32), *slots]), np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["times"], "<f4") for r in some)])
    return entries


def fitted_mixer(docs: DataFrame, entries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Mixer:
    """Each task learns over its training texts; weights are averaged by bits and refinement counts added, place by place."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(entries))

    def learn(batches):
        predictors, mixer = shared.value.unfolded(), Mixer()
        for keys, times in distinct_windows(batches):
            order = np.random.default_rng(len(keys)).permutation(len(keys))
            for start in range(0, len(keys), GROUP):
                group = order[start : start + GROUP]
                mixer.learn(*predictors.odds(keys[group], 1), times[group])
        if mixer.bits:
            values = np.concatenate([mixer.weights.ravel() * mixer.bits, mixer.cells.ravel(), [mixer.bits]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    sums = training(docs).mapInArrow(learn, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    shared.unpersist()
    mixer = Mixer()
    if sums:
        values = np.array([r["value"] for r in sorted(sums)])
        cut = mixer.weights.size
        mixer.weights = (values[:cut] / values[-1]).reshape(mixer.weights.shape)
        mixer.cells = values[cut:-1].reshape(mixer.cells.shape)
    return mixer


def frequent_words(vocabulary: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """Words above a count that at most ``most`` words reach, and of bounded length."""
    step = F.floor(F.log2("c") * 4)
    sizes = sorted((r["step"], r["n"]) for r in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())  # a row per quarter of an octave
    least, total = None, 0
    for at, n in reversed(sizes):
        total += n
        if total > most:
            break
        least = at
    if least is None:
        return {}
    chosen = vocabulary.filter((step >= least) & (F.octet_length("word") <= LONGEST_FREQUENT)).toArrow()
    return dict(zip(chosen["word"].to_pylist(), chosen["c"].to_pylist(), strict=True))


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``base_score`` is the unigram score with one added to every count; ``score`` is the mixing model's log10 probability
    of the whole text and its end. A null text is empty: its one token is the end. Rows with the same id are scored each.
    Without training texts, the base counts are zero and the model knows nothing but its prior.
    """
    partials = partial_counts(docs)
    vocabulary = stored(partials.filter(F.col("kind") == WORDS).groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    ends = partials.filter(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    total, distinct = total + ends, distinct + (ends > 0)
    entries = context_counts(partials)
    below = total + distinct + 1
    known = {w: math.log10((c + 1) / below) for w, c in frequent_words(vocabulary).items()}
    shared = docs.sparkSession.sparkContext.broadcast(Model(entries, fitted_mixer(docs, entries), known))

    def score(batches):
        from pyspark import TaskContext

        scorer, known = shared.value.unfolded(), shared.value.words
        end_score = math.log10((ends + 1) / below)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for texts in texts_of(batch):
                bits = scorer.bits(texts)
                out = []
                for text in texts:
                    words = text.lower().split()
                    scores = list(map(known.get, words))
                    rare = Counter([w for w, s in zip(words, scores, strict=True) if s is None])
                    base = math.fsum(filter(None, scores)) + end_score  # no score of a word is zero
                    out.append((row, len(words) + 1, len(words) - sum(rare.values()) + (ends > 0), base, list(rare), list(rare.values()), len(text)))
                    row += 1
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, len(texts)), batch["held_out"].slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(bits)],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_top", "base_top", "rare", "times", "bytes", "bits"],
                )
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", fold("doc_id", 7, 2).alias("held_out"), whole_text().alias("text")).mapInArrow(
        score, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_top long, base_top double, rare array<binary>, times array<long>, bytes long, bits double"
    )
    rows = stored(rows, "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(vocabulary, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(below)))).alias("base_rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_rare")
    )
    return rows.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), (F.col("bits") * -math.log10(2)).alias("score"),
        (F.col("bits") / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
