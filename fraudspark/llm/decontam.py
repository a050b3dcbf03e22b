"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every word sequence of the items. A document's words run through it once; at each
word the length of the longest match that ends there is known, and a match of ``window`` words or more
is an occurrence. Its state also names the items that hold those words. An item of fewer words than the
window counts as one window of its own length.

The items are cut into shards of at most ``shard_words`` words (one item is never cut; it is the least a
shard can hold), so what a task holds is bounded however large the test sets are: with several shards the
documents pass through one automaton after the other in the same stage, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import UPPER, per_batch, set_apart, whole_text

#: Letters are lower-cased, and all other ASCII bytes than letters and digits become spaces.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARD_WORDS = 2_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split()


class SuffixAutomaton:
    """All substrings of several word sequences, with the items that hold those of ``window`` words or more."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        walks = []
        shorter: dict[int, set[int]] = {}
        self.least = window
        for item, words in items:
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            state = 0
            for symbol in ids:
                state = self._extend(state, symbol)
            walks.append((item, ids))
            self.least = min(self.least, len(ids))
        self._holders(walks, shorter)

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, symbol, known)
        state = self._new(self.length[last] + 1, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            target = self.next[at][symbol]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
        return state

    def _new(self, length: int, edges: dict[int, int], link: int = 0) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, symbol: int, target: int) -> int:
        """Parts the shorter strings of ``target``, those that end in a suffix of ``at``, into a state of their own."""
        part = self._new(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = part
            at = self.link[at]
        return part

    def _holders(self, walks: list[tuple[int, list[int]]], whole: dict[int, set[int]]) -> None:
        """Per state the items with its window, and the short items that end its strings."""
        size, window = len(self.next), self.window
        seen, items = [None] * size, {}
        for number, (item, ids) in enumerate(walks):
            state = 0
            for symbol in ids:
                state = self.next[state][symbol]
                at = state
                while at > 0 and seen[at] != number and self.length[at] >= window:
                    seen[at] = number
                    items.setdefault(at, set()).add(item)
                    at = self.link[at]
            if len(ids) < window:
                whole.setdefault(state, set()).add(item)
        #: State -> the state whose shortest string is of at most ``window`` words, which stands for the last window.
        self.top = list(range(size))
        self.short: list[list[tuple[int, frozenset[int]]]] = [[] for _ in range(size)]
        for state in sorted(range(1, size), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[up] >= window:
                self.top[state] = self.top[up]
            own = [(self.length[state], frozenset(whole[state]))] if state in whole else []
            self.short[state] = self.short[up] + own if own else self.short[up]
        self.items = {k: frozenset(v) for k, v in items.items()}

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans [first, past the last] of hit words, in order and apart, and the items that have occurring windows."""
        vocabulary, least, total = self.vocabulary, self.least, len(words)
        spans: list[list[int]] = []
        found: set[int] = set()
        past = 0
        for probe in range(least - 1, total, least):  # every window of known words holds one of these places
            if probe < past or words[probe] not in vocabulary:
                continue
            first = probe
            while first > past and words[first - 1] in vocabulary:
                first -= 1
            past = probe + 1
            while past < total and words[past] in vocabulary:
                past += 1
            if past - first >= least:
                self._match(words, first, past, spans, found)
        return spans, found

    def _match(self, words, first, past, spans, found) -> None:
        edges, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at in range(first, past):
            symbol = self.vocabulary[words[at]]
            while state and symbol not in edges[state]:
                state = link[state]
                matched = length[state]
            following = edges[state].get(symbol)
            if following is None:
                continue
            state, matched = following, matched + 1
            hit = 0
            if matched >= window:
                hit = window
                found |= self.items[self.top[state]]
            for size, items in self.short[state]:
                if size <= matched:
                    hit = max(hit, size)
                    found |= items
            if hit:
                start = at + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at + 1])


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return out


def shards_of(items: DataFrame, window: int, shard_words: int) -> list[SuffixAutomaton]:
    """One automaton per shard, read from the driver's local iterator so that only one partition of items is held at a time."""
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    shards, batch, held = [], [], 0
    for item, text in rows.distinct().toLocalIterator():
        words = words_of(text)
        if batch and held + len(words) > shard_words:
            shards.append(SuffixAutomaton(batch, window))
            batch, held = [], 0
        batch.append((item, words))
        held += len(words)
    return [*shards, SuffixAutomaton(batch, window)]


def scan_documents(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, finish=None) -> DataFrame:
    """``docs`` with ``_words`` (count), ``_spans`` (array of [first, past]) and ``_items`` (array), over whole texts.

    Null and empty texts have no words. Repeated rows stay. Other columns of ``docs`` are kept as they are.
    ``finish`` turns each batch of the last pass into what is returned, in the same stage.
    """
    context = docs.sparkSession.sparkContext
    out = docs.select("*", F.lit(0).cast("long").alias("_words"), F.lit(None).cast("array<array<long>>").alias("_spans"), F.lit(None).cast("array<long>").alias("_items"))
    schema = out.schema
    shards = shards_of(items, window, shard_words)
    for number, automaton in enumerate(shards, 1):
        out = out.mapInArrow(_scanner(context.broadcast(automaton), finish if number == len(shards) else None), schema)
    return out


def _scanner(shared, finish=None):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value
        counts, spans, items = [], [], []
        before = zip(batch["text"].to_pylist(), batch["_spans"].to_pylist(), batch["_items"].to_pylist(), strict=True)
        for text, old_spans, old_items in before:
            words = words_of(text or "")
            own, found = automaton.scan(words)
            counts.append(len(words))
            spans.append(merged(own + (old_spans or [])) or None)
            items.append(sorted(found.union(old_items or [])) or None)
        columns = {f.name: batch[f.name] for f in batch.schema}
        columns |= {
            "_words": pa.array(counts, pa.int64()), "_spans": pa.array(spans, batch.schema.field("_spans").type),
            "_items": pa.array(items, batch.schema.field("_items").type),
        }
        out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        return finish(out) if finish else out

    return per_batch(scan)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows and a digest of their ids.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the real ``items`` and ``spans``.
    An empty table gives no rows; without items nothing is hit.
    """
    found = scan_documents(docs.select("doc_id", "text"), items, window, shard_words)
    spans = F.coalesce("_spans", F.array().cast("array<array<long>>"))
    items_found = F.coalesce("_items", F.array().cast("array<long>"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_found.cast("array<string>")), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), items_found.alias("items"), spans.alias("spans"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, most_covered: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Documents without test passages: hit spans are cut out, and a document covered beyond ``most_covered`` goes.

    Same columns as ``docs``; ``n_chars``, where there, counts the new text. Documents without a hit, with null
    or without words stay as they are.
    """
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, texts = [], []
        for text, spans, words in zip(*(batch[c].to_pylist() for c in ("text", "_spans", "_words")), strict=True):
            hit = sum(past - first for first, past in spans or [])
            keep.append(hit <= most_covered * words)
            texts.append(without_spans(text, spans) if hit and keep[-1] else text)
        index = batch.schema.get_field_index("text")
        return batch.set_column(index, batch.schema.field(index), pa.array(texts, batch.schema.field(index).type)).filter(pa.array(keep, pa.bool_()))

    packed, restore = set_apart(docs, "text", "n_chars")
    hits = scan_documents(packed, items, window, shard_words, cut)
    if "n_chars" in docs.columns:
        hits = hits.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(whole_text()).cast(docs.schema["n_chars"].dataType)))
    return restore(hits)


def without_spans(text: str, spans: list[list[int]]) -> str:
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(data.translate(FOLDED))]
    out, at = [], 0
    for first, past in spans:
        out.append(data[at : places[first][0]])
        at = places[past - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


#: The characters that the contract's words are made of, written for RE2; A-Z are lower-cased before.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
who AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN who USING (rid)"""
