"""Source divergence audit: how far the words of each source of a language are from those of the others.

Two passes over the texts. The first counts in how many documents of a language each term is, exactly, and keeps the
frequent ones. They are dealt to shards, and a task per shard builds a minimal perfect hash: each kept term has a slot of
its own, without gaps, and stands there as a stored key. The second pass holds shards by broadcast, at most
``ROUND_BYTES`` of keys at once (more are taken in turn, with a scan each): a term counts in its slot of its source's
dense vector only if hash and stored key are its own.

Vectors are added over tasks in two steps, so that a large source is spread. Shares and divergences are whole numbers.
Pairs of sources meet in blocks of at most about ``BLOCK`` sources, a shard at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.llm.common import stored, whole_text

SHARD_TERMS = 12_000
ROUND_BYTES = 48 << 20
BLOCK = 40
HELD_TERMS, HELD_BYTES = 300_000, 16 << 20  # what a task counts before it passes the counts on
DENSE_BYTES = 64 << 20  # of the vectors that a task holds
TASKS_AT_ONCE = 64  # whose vectors are added in the first step

#: Letters of ASCII in lower case and all bytes beyond; the rest separates terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class PerfectHash:
    """A minimal perfect hash of byte strings, with the strings stored in their slots.

    Level after level, hashes that are alone at their place of a bit array set that bit, and the others go on to the next
    one; a key's slot is the number of bits set before its own. What is left after ``LEVELS`` (equal hashes) is listed.
    """

    LEVELS = 24
    STEP, FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def __init__(self, keys: list[bytes]):
        hashes = hashes_of(keys)
        order, left, base = [], np.arange(len(keys)), 0
        self.levels = []
        for level in range(self.LEVELS):
            if not len(left):
                break
            size = 2 * len(left) + 64
            at = self._place(hashes[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits) + base
            self.levels.append((size, bits, before))
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            base += int(placed.sum())
            left = left[~placed]
        self.rest = {keys[i]: base + n for n, i in enumerate(left)}
        order = np.concatenate([*order, left]) if len(keys) else np.zeros(0, np.int64)
        self.hashes = hashes[order]
        self.keys = b"".join(keys[i] for i in order)
        self.offsets = np.cumsum([0, *(len(keys[i]) for i in order)])

    @classmethod
    def _place(cls, hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = hashes + cls.STEP * np.uint64(level + 1)
            h = (h ^ (h >> np.uint64(30))) * cls.FIRST
            h = (h ^ (h >> np.uint64(27))) * cls.SECOND
            return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def key(self, slot: int) -> bytes:
        return self.keys[self.offsets[slot] : self.offsets[slot + 1]]

    def slots(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that is not stored."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            at = self._place(hashes[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        found = found[self.hashes[out[found]] == hashes[found]]  # most others end here
        exact = [i for i in found.tolist() if self.key(out[i]) == keys[i]]
        verified = np.full(len(keys), -1, np.int64)
        verified[exact] = out[exact]
        if self.rest:
            for i, key in enumerate(keys):
                verified[i] = self.rest.get(key, verified[i])
        return verified


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42, as Spark's own xxhash64 of a binary column."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text; nulls as empty texts."""
    return docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text().alias("text"))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of a language with a term."""
    def rows(held: dict[str, Counter]):
        for lang, counter in held.items():
            items = list(counter)
            for at in range(0, len(items), 50_000):
                some = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array([counter[t] for t in some], pa.int64())], names=["lang", "term", "n"]
                )

    def count(batches: Iterator[pa.RecordBatch]):
        held: dict[str, Counter] = {}
        size = new_bytes = 0
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for lang, text in zip(batch["lang"].to_pylist(), texts, strict=True):
                counter = held.setdefault(lang, Counter())
                own, before = set(terms(text.as_py())), len(counter)
                counter.update(own)
                size += len(counter) - before
                new_bytes += sum(map(len, own)) if len(own) < 200 else len(text.as_buffer())
                if size > HELD_TERMS or new_bytes > HELD_BYTES * 4:
                    yield from rows(held)
                    held, size, new_bytes = {}, 0, 0
        yield from rows(held)

    partial = named(docs).select("lang", "text").mapInArrow(count, "lang string, term binary, n long")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def perfect_hashes(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shard, shards, terms, size, hash): a perfect hash per shard of a language's kept terms."""
    shards = F.ceil(F.col("terms") / shard_terms).cast("int")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms")).withColumn("shards", shards)
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total, shards = [], 0, 0
        for batch in batches:
            keys += batch["term"].to_pylist()
            total, shards = batch["terms"][0].as_py(), batch["shards"][0].as_py()
        made = pack(PerfectHash(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([shards], pa.int32()), pa.array([total], pa.int64()), pa.array([len(made)], pa.int64()), pa.array([made], pa.binary())],
            names=["lang", "shard", "shards", "terms", "size", "hash"],
        )

    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, shards int, terms long, size long, hash binary")


def pack(value) -> bytes:
    import pickle

    return pickle.dumps(value.__dict__, protocol=5)


def unpack(data: bytes) -> PerfectHash:
    import pickle

    made = PerfectHash.__new__(PerfectHash)
    made.__dict__.update(pickle.loads(data))
    return made


def sparse(dense: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values other than zero, values in as few bytes as the largest needs."""
    at = np.flatnonzero(dense)
    values = dense[at]
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.uint8
    return at.astype(np.uint32).tobytes(), values.astype(kind).tobytes()


def add_to(dense: np.ndarray, slots: pa.Scalar, counts: pa.Scalar) -> None:
    at = np.frombuffer(slots.as_buffer(), np.uint32)
    if len(at):
        dense[at] += np.frombuffer(counts.as_buffer(), f"u{len(counts.as_buffer()) // len(at)}").astype(np.int64)


VECTOR = "slots binary, counts binary, length int, total long"
VECTOR_NAMES = ["slots", "counts", "length", "total"]


def vector_row(keys: list[pa.Array], names: list[str], dense: np.ndarray) -> pa.RecordBatch:
    slots, counts = sparse(dense)
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array([slots], pa.binary()), pa.array([counts], pa.binary()), pa.array([len(dense)], pa.int32()), pa.array([int(dense.sum())], pa.int64())],
        names=[*names, *VECTOR_NAMES],
    )


def summed(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors with the same keys added up: first those with the same ``salt``, then the sums."""
    kinds = dict(vectors.dtypes)

    def added(df: DataFrame, by: list[str]) -> DataFrame:
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dense = None
            for batch in batches:
                for slots, counts, length in zip(batch["slots"], batch["counts"], batch["length"], strict=True):
                    if dense is None:
                        dense = np.zeros(length.as_py(), np.int64)
                    add_to(dense, slots, counts)
            yield vector_row([pa.array([k.as_py()], k.type) for k in key], by, dense)

        return df.groupBy(*by).applyInArrow(add, ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + VECTOR)

    return added(added(vectors, [*keys, "salt"]), keys)


def slot_counts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lang, source, shard, slots, counts, length, total, salt) of each task, for all shards, in rounds of bounded size."""
    listed = sorted((r["lang"], r["shard"], r["size"]) for r in hashes.select("lang", "shard", "size").collect())  # a row per shard
    rounds, held = [], 0
    for lang, shard, size in listed:
        if not rounds or held + size > ROUND_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append((lang, shard))
        held += size
    out = None
    for n, chosen in enumerate(rounds):
        first, last = chosen[0], chosen[-1]
        at = F.struct("lang", "shard")
        within = (at >= F.struct(F.lit(first[0]), F.lit(first[1]))) & (at <= F.struct(F.lit(last[0]), F.lit(last[1])))
        counted = stored(_round_counts(docs, hashes.filter(within)), f"divergence-counts-{n}")
        out = counted if out is None else out.unionByName(counted)
    return out


def _round_counts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(r["lang"], r["shard"], r["shards"], r["hash"]) for r in hashes.collect()])  # at most ROUND_BYTES

    def count(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        by_lang: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
        for lang, shard, shards, data in shared.value:
            by_lang.setdefault(lang, (shards, {}))[1][shard] = unpack(data)
        salt = pa.array([TaskContext.get().partitionId() // TASKS_AT_ONCE], pa.int32())
        held: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str, int], np.ndarray] = {}
        size = new_bytes = 0

        def settle():
            for (lang, source), counter in held.items():
                shards, hashes = by_lang[lang]
                words, times = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                codes = hashes_of(words)
                shard_of = codes.view(np.int64) % shards
                for shard, made in hashes.items():
                    mine = np.flatnonzero(shard_of == shard)
                    slots = made.slots([words[i] for i in mine.tolist()], codes[mine])
                    known = slots >= 0
                    if known.any():
                        if (lang, source, shard) not in dense:
                            dense[lang, source, shard] = np.zeros(len(made), np.int64)
                        dense[lang, source, shard][slots[known]] += times[mine[known]]  # a slot is a word: no place comes twice
            held.clear()

        def emit():
            for (lang, source, shard), vector in dense.items():
                yield vector_row([pa.array([lang]), pa.array([source]), pa.array([shard], pa.int32()), salt], ["lang", "source", "shard", "salt"], vector)
            dense.clear()

        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts, strict=True):
                if lang not in by_lang:
                    continue
                counter = held.setdefault((lang, source), Counter())
                before = len(counter)
                counter.update(terms(text.as_py()))
                size += len(counter) - before
                new_bytes += len(text.as_buffer())
                if size > HELD_TERMS or new_bytes > HELD_BYTES * 4:
                    settle()
                    size = new_bytes = 0
                    if sum(v.nbytes for v in dense.values()) > DENSE_BYTES:
                        yield from emit()
        settle()
        yield from emit()

    return named(docs).mapInArrow(count, f"lang string, source string, shard int, salt int, {VECTOR}")


def shares(counts: np.ndarray, total: int, terms: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 2) / (total + 2 * terms)) without leaving 64 bits: long division, three digits at a time."""
    below = total + 2 * terms
    whole, rest = np.divmod(counts + 2, below)
    step = 1
    while step < scale:
        rest = rest * 1000
        whole = whole * 1000 + rest // below
        rest %= below
        step *= 1000
    return 1 + whole


def divergences(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    gap = own - other
    return gap * gap // (own + other)


SCALE = 10**9


def _audit_block(key, sources: pa.Table, facts: pa.Table, most: int) -> pa.Table:
    """Partial pair sums of a shard and two blocks of sources; for a block with itself also each source's first terms."""
    lang, _, low, high = (k.as_py() for k in key)
    rows = sources.drop_columns(["slots", "counts"]).to_pylist()
    length = max((r["length"] or 0 for r in rows), default=0)
    p = {}
    for i, r in enumerate(rows):
        dense = np.zeros(length, np.int64)
        if sources["slots"][i].is_valid:
            add_to(dense, sources["slots"][i], sources["counts"][i])
        p[r["source"]] = (r["block"], dense, shares(dense, r["source_total"], r["terms"], SCALE) if length else dense)
    out = []

    def put(source, part, item, value):
        out.append((lang, source, part, item, int(value)))

    first = sorted(s for s in p if p[s][0] == low)
    second = first if low == high else sorted(s for s in p if p[s][0] == high)
    for i, a in enumerate(first):
        for b in second[i + 1 :] if low == high else second:
            value = divergences(p[a][2], p[b][2]).sum()
            put(a, "pair", b.encode(), value)
            put(b, "pair", a.encode(), value)
    if facts.num_rows and first and low == high:
        made = unpack(facts["hash"][0].as_py())
        q = np.zeros(length, np.int64)
        add_to(q, facts["slots"][0], facts["counts"][0])
        q = shares(q, facts["lang_total"][0].as_py(), facts["terms"][0].as_py(), SCALE)
        for source in first:
            _, counts, own = p[source]
            at = np.flatnonzero((counts > 0) & (own > q))
            value = divergences(own[at], q[at])
            if len(at) > most:
                least = np.partition(value, -most)[-most]
                at, value = at[value >= least], value[value >= least]
            for v, term in sorted((-v, made.key(s)) for v, s in zip(value.tolist(), at.tolist(), strict=True))[:most]:
                put(source, "term", term, -v)
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least_documents: int = 10, most_terms: int = 10, shard_terms: int = SHARD_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources (``pair``) and each source's own terms (``term``).

    Null lang, source and text count as empty ones; an empty name is a name like any other. Repeated rows are documents
    of their own. A language without kept terms gives its pairs with value 0. Ties are ranked by item, in the order of its
    UTF-8 bytes. An empty table gives no rows. Other columns are not read.
    """
    groups = stored(named(docs).select("lang", "source").distinct(), "divergence-groups")
    kept = stored(document_counts(docs).filter(F.col("n") >= least_documents).select("lang", "term"), "divergence-terms")
    hashes = stored(perfect_hashes(kept, shard_terms), "divergence-hashes")
    partial = slot_counts(docs, hashes)
    if partial is None:
        partial = docs.sparkSession.createDataFrame([], f"lang string, source string, shard int, salt int, {VECTOR}")
    counts = stored(summed(partial, ["lang", "source", "shard"]), "divergence-vectors")

    blocks = F.ceil(F.col("sources") / block).cast("int")
    sources_per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).withColumn("blocks", blocks)
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("source_total"))
    terms_per_lang = hashes.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("shards").alias("shards"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    facts = (
        groups.join(sources_per_lang, "lang").join(totals, ["lang", "source"], "left").join(terms_per_lang, "lang", "left")
        .select(
            "lang", "source", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks",
            zero("source_total").alias("source_total"), zero("terms").alias("terms"), F.explode(F.sequence(F.lit(0), F.greatest("shards", F.lit(1)) - 1)).alias("shard"),
        )
    )

    lengths = hashes.select("lang", "shard", "hash", "terms")
    left = (
        facts.join(counts.drop("total", "length"), ["lang", "source", "shard"], "left")
        .join(counts.groupBy("lang", "shard").agg(F.max("length").alias("length")), ["lang", "shard"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    )
    lang_vectors = summed(counts.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(TASKS_AT_ONCE)).cast("int")), ["lang", "shard"])
    lang_totals = totals.groupBy("lang").agg(F.sum("source_total").alias("lang_total"))
    right = (
        lengths.join(lang_vectors.select("lang", "shard", "slots", "counts"), ["lang", "shard"]).join(lang_totals, "lang").join(sources_per_lang.select("lang", "blocks"), "lang")
        .withColumn("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("high", F.col("low")).drop("blocks")
    )
    by = ["lang", "shard", "low", "high"]

    def run(key, sources: pa.Table, facts: pa.Table) -> pa.Table:
        return _audit_block(key, sources, facts, most_terms)

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "lang string, source string, part string, item binary, value long")
    found = stored(found, "divergence-parts")
    values = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term stands in one shard, a pair in all
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = values.filter("part = 'pair'").withColumn("rank", rank)
    tops = values.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= most_terms)
    return pairs.unionByName(tops).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


ORACLE = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id FROM documents),
t AS MATERIALIZED (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
dense AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * CAST(coalesce(n, 0) + 2 AS HUGEINT)) // (coalesce(total, 0) + 2 * v) AS p
  FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN c USING (lang, source, term)
),
whole AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000 * CAST(sum(n) + 2 AS HUGEINT)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
  FROM dense JOIN sizes USING (lang) GROUP BY lang, term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q
),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
