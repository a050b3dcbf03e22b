"""Best-fit packing of documents into token sequences, by bin completion over the histogram of lengths.

Packing only depends on how many pieces there are of each length, and there are no more lengths than a sequence
has tokens. So the whole corpus is one histogram of at most ``size`` counts; that, and nothing else, goes to the
driver, which returns a plan: fillings (lengths side by side) and how many sequences follow each. Pieces then take
the places of their length by number, in parallel.

The plan is a branch-and-bound search. Best-fit decreasing gives the incumbent. Then the longest remaining length is
completed: some fillings of the rest of its sequence are made greedily and tried first, then all undominated ones, each
from as often as its lengths last down to once. A branch ends when the waste so far leaves no room for fewer sequences
than the incumbent has. The search stops at the lower bound, when nothing is left to try (the plan is then an optimum),
or with the best plan found after ``search_nodes`` nodes or ``search_steps`` steps of listing fillings.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.llm.common import stored, whole_text
from fraudspark.llm.tokens import encoder

SIZE = 2048
END_ID = 0
TEXTS = 500  # held as Python strings at once

Run = tuple[tuple[int, ...], int]  # lengths of a filling, longest first; number of sequences


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences needed for the tokens, and for the lengths that cannot share one (two of them exceed the size)."""
    lengths = np.arange(len(counts))
    best = max(-(-int(counts @ lengths) // size), int(counts[lengths > size // 2].sum()))
    for small in range(1, size // 2 + 1, max(1, size // 256)):
        # pieces above size - small stand alone; pieces in the middle fill what those above the half leave
        alone = int(counts[size - small + 1 :].sum())
        halves = slice(size // 2 + 1, size - small + 1)
        middle = slice(small, size // 2 + 1)
        open_ = int(counts[halves].sum())
        room = open_ * size - int(counts[halves] @ lengths[halves])
        extra = int(counts[middle] @ lengths[middle]) - room
        best = max(best, alone + open_ + max(0, -(-extra // size)))
    return best


def best_fit(counts: np.ndarray, size: int) -> list[Run]:
    """Best-fit decreasing, equal bins and equal lengths taken together."""
    open_: list[list[list]] = [[] for _ in range(size + 1)]  # by room left: [lengths, bins]
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        room = length
        while left:
            while room < size and not open_[room]:
                room += 1
            filled, bins = open_[room].pop() if open_[room] else ((), left)
            each = room // length  # further pieces of this length fit best where the last one went
            full = min(bins, left // each)
            if full:
                open_[room - each * length].append([filled + (length,) * each, full])
            left -= full * each
            if bins > full and filled:
                if left and left < each:
                    open_[room - left * length].append([filled + (length,) * left, 1])
                    left, full = 0, full + 1
                if bins > full:
                    open_[room].append([filled, bins - full])
            elif left and left < each and not filled:
                open_[size - left * length].append([(length,) * left, 1])
                left = 0
    return [(tuple(f), n) for groups in open_ for f, n in groups if f]


def fillings(counts: np.ndarray, room: int, choices: int) -> list[tuple[int, ...]]:
    """Greedy ways to fill ``room``, least waste first, at most ``choices``: what is tried before ``completions``.

    Each starts with one available length and goes on with the longest that fits. A filling goes if another one
    has at each place a length as long or longer.
    """
    found: dict[tuple[int, ...], int] = {}
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    for first in have[::-1].tolist():
        rest, chosen, limit = room - first, [first], first
        while rest:
            at = int(np.searchsorted(have, min(rest, limit), side="right")) - 1
            while at >= 0 and chosen.count(have[at]) >= counts[have[at]]:
                at -= 1
            if at < 0:
                break
            limit = int(have[at])
            chosen.append(limit)
            rest -= limit
        found[tuple(chosen)] = rest
        if rest == 0 and sum(not w for w in found.values()) >= choices:
            break
    ranked = sorted(found, key=lambda f: (found[f], [-x for x in f]))
    kept: list[tuple[int, ...]] = []
    for filling in ranked:
        if len(kept) == choices:
            break
        if not any(len(filling) <= len(k) and all(a <= b for a, b in zip(filling, k, strict=False)) for k in kept):
            kept.append(filling)
    return kept


def completions(counts: np.ndarray, room: int, spare: Callable[[], int], steps: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill ``room`` with a waste of ``spare()`` at most, longest lengths first.

    A filling is dominated if a length that is left fits in, or fits in place of a shorter one: whatever has at each place
    a length as long or longer is reached by one such exchange. ``steps`` counts down; at zero the list ends early.
    """
    have = np.flatnonzero(counts[: room + 1]).tolist()
    number = [int(counts[x]) for x in have]
    upto = np.r_[0, np.cumsum(np.array(have, np.int64) * np.array(number, np.int64))].tolist()  # tokens of the shortest lengths

    def dominated(chosen: list[tuple[int, int]], rest: int) -> bool:
        used = dict(chosen)
        for a in (0, *used):
            at = bisect_right(have, a)
            while at < len(have) and have[at] <= a + rest:
                if used.get(have[at], 0) < number[at]:
                    return True
                at += 1
        return False

    def fill(past: int, rest: int, chosen: list[tuple[int, int]]) -> Iterator[tuple[int, ...]]:
        for at in range(min(past, bisect_right(have, rest)) - 1, -1, -1):
            if rest - upto[at + 1] > spare() or steps[0] <= 0:
                break
            for n in range(min(number[at], rest // have[at]), 0, -1):
                steps[0] -= 1
                yield from fill(at, rest - n * have[at], [*chosen, (have[at], n)])
        if rest <= spare() and not dominated(chosen, rest):
            yield tuple(x for x, n in chosen for _ in range(n))

    yield from fill(len(have), room, [])


def plan_bins(counts: np.ndarray, size: int, search_nodes: int = 4000, choices: int = 4, search_steps: int = 1_000_000) -> list[Run]:
    """Fillings and their numbers for all pieces; ``counts`` is indexed by length, 0 to ``size``."""
    counts = counts.astype(np.int64)
    best = best_fit(counts, size)
    fewest, least = sum(n for _, n in best), lower_bound(counts, size)
    total = int(counts @ np.arange(size + 1))
    steps = [search_steps]

    def branches(left: np.ndarray, path: tuple | None, used: int, waste: int, longest: int):
        """What the longest length's sequences can be; each filling as often as it can, then less often."""
        spare = lambda: (fewest - 1) * size - total - waste
        rest = left.copy()
        rest[longest] -= 1
        greedy = fillings(rest, size - longest, choices)

        def ways():
            yield from greedy
            yield from (way for way in completions(rest, size - longest, spare, steps) if way not in greedy)

        for way in ways():
            filling = (longest, *way)
            lengths, each = np.unique(filling, return_counts=True)
            over = size - sum(filling)
            for times in range(int((left[lengths] // each).min()), 0, -1):
                if times * over > spare():
                    continue
                after = left.copy()
                after[lengths] -= each * times
                yield after, (path, (filling, times)), used + times, waste + times * over

    stack = [iter([(counts, None, 0, 0)])]
    nodes = 0
    while stack and fewest > least and nodes < search_nodes and steps[0] > 0:
        state = next(stack[-1], None)
        if state is None:
            stack.pop()
            continue
        left, path, used, waste = state
        nodes += 1
        if waste > (fewest - 1) * size - total:
            continue
        longest = int(np.flatnonzero(left)[-1]) if left.any() else 0
        if longest:
            stack.append(branches(left, path, used, waste, longest))
        elif used < fewest:
            best, fewest, at = [], used, path
            while at:
                best.append(at[1])
                at = at[0]
    return best


class Places:
    """Place of the n-th piece of a length: sequence and offset."""

    def __init__(self, runs: list[Run]):
        by_length: dict[int, list[tuple[int, int, list[int]]]] = {}
        sequence = 0
        for filling, times in sorted(runs, reverse=True):
            ordered = sorted(filling, reverse=True)
            starts = np.r_[0, np.cumsum(ordered)].tolist()
            for length in dict.fromkeys(ordered):
                offsets = [starts[i] for i, x in enumerate(ordered) if x == length]
                by_length.setdefault(length, []).append((times * len(offsets), sequence, offsets))
            sequence += times
        self.sequences = sequence
        self.by_length = {}
        for length, slots in by_length.items():
            first = np.r_[0, np.cumsum([s[0] for s in slots])]
            each = np.array([len(s[2]) for s in slots])
            at = np.r_[0, np.cumsum(each)][:-1]
            self.by_length[length] = (first, np.array([s[1] for s in slots]), each, at, np.array([o for s in slots for o in s[2]]))

    def take(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            first, start, each, at, offsets = self.by_length[size]
            slot = np.searchsorted(first, number[rows], side="right") - 1
            within = number[rows] - first[slot]
            sequence[rows] = start[slot] + within // each[slot]
            offset[rows] = offsets[at[slot] + within % each[slot]]
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids, each with its task and its number among the task's pieces of that length.

    A document is its ids, then ``END_ID``; only those longer than ``size`` are cut. A null text is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        task, encode_all, seen = TaskContext.get().partitionId(), encoder(tokenizer).encode_all, {}
        end = END_ID.to_bytes(4, "little")
        for batch in (some.slice(at, TEXTS) for some in batches for at in range(0, some.num_rows, TEXTS)):
            rows, of, blobs = [], [], []
            for i, ids in enumerate(encode_all(batch["text"].to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, size)):
                    data = ids[4 * start : 4 * (start + size)]
                    length = len(data) // 4
                    seen[length] = number = seen.get(length, -1) + 1
                    of.append(i)
                    rows.append((piece, start, length, zlib.crc32(data), number))
                    blobs.append(data if with_ids else None)
            if not rows:
                continue
            table = np.array(rows, np.int64)
            columns = [batch["doc_id"].take(pa.array(of)), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, i]) for i in (1, 2, 3, 4))]
            columns += [pa.array(np.full(len(rows), task, np.int64)), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "number", "task", "ids"])

    out = docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long, task long, ids binary"
    )
    return stored(out if with_ids else out.drop("ids"), "pieces")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False, search_nodes: int = 4000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Sequences are gapless from offset 0 and hold at most ``size`` tokens. Every row of ``docs`` is packed, repeated
    ones too; an empty document is one piece with the end id. An empty table gives no rows.
    """
    cut = pieces(docs, tokenizer, size, with_ids)
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))), "piece-counts")
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[row["length"]] = row["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_bins(histogram, size, search_nodes)))
    # the counts grow with the tasks, so they are never broadcast
    numbered = cut.join(counts.select("task", "length", "before").hint("merge"), ["task", "length"])
    numbered = numbered.select(
        *[c for c in cut.columns if c not in ("number", "task")], (F.col("number") + F.col("before")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.value.take(batch["length"].to_numpy(), batch["sequence_id"].to_numpy())
                names = batch.schema.names
                yield batch.set_column(names.index("sequence_id"), "sequence_id", pa.array(sequence)).set_column(names.index("offset"), "offset", pa.array(offset))

    return numbered.mapInArrow(place, numbered.schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the token sequences themselves, from pieces packed with their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("parts"))

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch["parts"].to_pylist()]
                n = [len(p) for p in batch["parts"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "n_pieces", "ids"])

    return rows.mapInArrow(read, "sequence_id long, n_pieces int, ids array<int>")
