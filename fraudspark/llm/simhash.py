"""SimHash near-duplicates: fingerprints of word shingles, and a self-join of binary tries for the links.

Two fingerprints that differ in at most ``budget`` of 64 bits agree in at least one of ``budget`` + 1 blocks
of bits. So there is one trie per block, with that block's bits on top, and only nodes that agree in all of
them are paired: the subtree below such a node is one group, and groups are spread over the cluster. Inside a
group, pairs of nodes go down together, a bit at a time; the differing bits add up and a pair is dropped as
soon as they exceed the budget. Equal fingerprints are one leaf, however many documents carry them.

Only reachability counts, so a group reports a spanning forest in place of all its links: the join runs with
budgets of 1, 2, ... in turn, and a pair of nodes whose leaves are all in one tree of the forest already is
dropped. A dense cloud of near copies then costs about as much as its links of one bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import per_batch, set_apart, stored, whole_text
from fraudspark.operators.components import connected_components

BITS = 64
BUDGET = 4
SEED = 42
DIRECT = 64  # node pairs with this many pairs of leaves at most are compared at once
DIRECT_AT_ONCE = 1 << 18
FRONTIER = 100_000  # node pairs held at once; the rest waits on a stack


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of the lower-cased (A-Z) text, repeats included; of the whole, if it has fewer words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: 1 - words_per_shingle].tolist() if words_per_shingle > 1 else (end - size).tolist()
    end = end[words_per_shingle - 1 :].tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)], np.uint64, len(start))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        rows = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str, words_per_shingle: int = 4) -> int:
    """SimHash of the text's word shingles; zero without words."""
    hashes = shingle_hashes(text, words_per_shingle)
    return int(majority(hashes)) if len(hashes) else 0


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long; ``text_key`` tells rows of one id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, words_per_shingle) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(fp)], names=["doc_id", "text_key", "fp"])

    text = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    return text.mapInArrow(per_batch(mark), f"doc_id {kind}, text_key long, fp long")


def block_masks(budget: int = BUDGET) -> list[int]:
    """The bits of each of ``budget`` + 1 blocks, highest bits first."""
    edges = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [((1 << (BITS - a)) - 1) ^ ((1 << (BITS - b)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Forest:
    """Union-find over the places of a sorted array of codes."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the trees of all pairs: roots hook on to smaller roots until every pair shares one."""
        while len(a):
            root = self.flatten()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``link``; returns those of the pairs that joined two trees, so pairs that are linked themselves."""
        chosen = []
        left = np.arange(len(a))
        while len(left):
            root = self.flatten()
            high, low = np.maximum(root[a[left]], root[b[left]]), np.minimum(root[a[left]], root[b[left]])
            apart = high != low
            left, high, low = left[apart], high[apart], low[apart]
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.r_[True, np.diff(high[order]) != 0])] if len(order) else order
            self.parent[high[first]] = low[first]
            chosen.append(left[first])
        chosen = np.concatenate(chosen) if chosen else left
        return a[chosen], b[chosen]


def trie_links(codes: np.ndarray, depth: int, budget: int = BUDGET, head: int = BITS, passes: tuple[int, ...] | None = None, near=None, start: np.ndarray | None = None, spanning: list | None = None) -> np.ndarray:
    """Per code (sorted uint64) a place in its tree of the forest of links.

    Codes that differ in their upper ``depth`` bits are never paired here. ``budget`` holds for the first ``head`` bits,
    and each of ``passes`` (1 to ``budget``) allows so many differing bits in all. Leaves link if ``near(a, b, allowed)``
    says so of their places; that is, if their codes differ in ``allowed`` bits at most. ``start`` has trees that are
    known before, as a place in its tree for each code; ``spanning`` gets the pairs of places that joined two trees.
    """
    near = near or (lambda a, b, allowed: np.bitwise_count(codes[a] ^ codes[b]) <= allowed)
    size = len(codes)
    forest = Forest(size)
    if start is not None:
        forest.parent = start.copy()
    top = codes >> np.uint64(BITS - depth)
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    past = np.r_[first[1:], size]
    more = past - first > 1
    first, past = first[more], past[more]
    ones: dict[int, np.ndarray] = {}
    for allowed in passes or range(1, budget + 1):
        label = forest.flatten()
        change = np.flatnonzero(label[1:] != label[:-1]) + 1  # where a run of one label ends
        run = np.r_[change, size][np.searchsorted(change, np.arange(size), side="right")]
        stack = [(depth, first, past, first, past, np.zeros(len(first), np.int8))]
        while stack:
            at, lo, hi, lo2, hi2, spent = stack.pop()
            settled = (run[lo] >= hi) & (run[lo2] >= hi2) & (label[lo] == label[lo2])
            small = (hi - lo) * (hi2 - lo2) <= DIRECT
            if at == BITS:
                small |= True
            _direct(forest, allowed, near, spanning, *(x[small & ~settled] for x in (lo, hi, lo2, hi2)))
            rest = ~small & ~settled
            lo, hi, lo2, hi2, spent = (x[rest] for x in (lo, hi, lo2, hi2, spent))
            if not len(lo):
                continue
            if at not in ones:
                ones[at] = np.r_[0, np.cumsum((codes >> np.uint64(BITS - 1 - at)) & np.uint64(1), dtype=np.int64)]
            s = ones[at]
            mid, mid2 = hi - (s[hi] - s[lo]), hi2 - (s[hi2] - s[lo2])
            own = lo == lo2
            parts = [(lo, mid, lo2, mid2, spent), (mid, hi, mid2, hi2, spent), (lo, mid, mid2, hi2, spent + 1)]
            parts.append(tuple(x[~own] for x in (mid, hi, lo2, mid2, spent + 1)))
            lo, hi, lo2, hi2, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = (hi > lo) & (hi2 > lo2) & (spent <= (min(allowed, budget) if at < head else allowed)) & ~((lo == lo2) & (hi - lo == 1))
            below = [x[keep] for x in (lo, hi, lo2, hi2, spent)]
            for cut in range(0, len(below[0]), FRONTIER):
                stack.append((at + 1, *(x[cut : cut + FRONTIER] for x in below)))
    return forest.flatten()


def _direct(forest, allowed, near, spanning, lo, hi, lo2, hi2) -> None:
    """Compares all leaves of small node pairs, some million at a time; of a node with itself each pair once."""
    area = (hi - lo) * (hi2 - lo2)
    past = np.cumsum(area)
    at = 0
    while at < len(area):
        end = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + DIRECT_AT_ONCE, side="right")))
        some = area[at:end]
        pair = np.repeat(np.arange(at, end), some)
        place = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        wide2 = (hi2 - lo2)[pair]
        a, b = lo[pair] + place // wide2, lo2[pair] + place % wide2
        once = a < b if np.array_equal(lo, lo2) else (a != b) & ((lo != lo2)[pair] | (a < b))
        a, b = a[once], b[once]
        close = near(a, b, allowed)
        if spanning is None:
            forest.link(a[close], b[close])
        else:
            spanning.append(forest.span(a[close], b[close]))
        at = end


def turn(codes: np.ndarray, mask: int) -> tuple[np.ndarray, int]:
    """Codes turned so that the bits of the block come first, and their number."""
    width = mask.bit_count()
    low = (mask & -mask).bit_length() - 1
    left = (BITS - low - width) % BITS
    if not left:
        return codes, width
    return (codes << np.uint64(left)) | (codes >> np.uint64(BITS - left)), width


def stars(names: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(a, b): each tree's members and its smallest name, as the edges of a star."""
    least = names.copy()
    np.minimum.at(least, root, names)
    least = least[root]
    apart = names != least
    return pa.RecordBatch.from_arrays([pa.array(names[apart]), pa.array(least[apart])], names=["a", "b"])


def links(distinct: DataFrame, budget: int = BUDGET, rows_at_once: int = 60_000) -> DataFrame:
    """(a, b): a forest that joins exactly the fingerprints joined by links, from distinct ``fp`` (long).

    Groups are streamed in order through each task, several small ones at a time. A group is held in one task
    as eight bytes for each of its different fingerprints.
    """
    masks = block_masks(budget)
    tries = F.array(*[F.struct(F.lit(i).alias("trie"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("top")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tries).alias("t")).select("fp", "t.*").repartition("trie", "top").sortWithinPartitions("trie", "top")

    def solve(parts: list[tuple[int, np.ndarray]]):
        for trie in {t for t, _ in parts}:
            codes = np.unique(np.concatenate([c for t, c in parts if t == trie]))
            turned, depth = turn(codes, masks[trie])
            order = np.argsort(turned)
            yield stars(codes[order].view(np.int64), trie_links(turned[order], depth, budget))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trie, top, fp = (batch[c].to_numpy() for c in ("trie", "top", "fp"))
            cuts = np.flatnonzero((trie[1:] != trie[:-1]) | (top[1:] != top[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fp)], strict=True):
                new = not parts or (trie[a], top[a]) != last
                if new and held >= rows_at_once:
                    yield from solve(parts)
                    parts, held = [], 0
                last = (trie[a], top[a])
                parts.append((int(trie[a]), fp[a:b].view(np.uint64)))
                held += b - a
        if parts:
            yield from solve(parts)

    return rows.mapInArrow(run, "a long, b long")


def classed(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """``marked`` (doc_id, text_key, fp) with component, component_id and n_documents; ``edges`` (a, b) join values of fp."""
    ids = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    labels = connected_components(stored(edges, "simhash-links"), "a", "b").withColumnRenamed("node", "fp")
    classes = ids.join(labels, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    named = stored(classes, "simhash-classes")
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_documents"))
    return marked.join(named.select("fp", "component").join(groups, "component"), "fp")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, words_per_shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, text_key, fingerprint, component_id and the rows of its component.

    Texts without words, null included, have fingerprint zero and link like any other. ``component_id`` is the
    smallest doc_id reachable over links; ``component`` is the component's smallest fingerprint, which tells
    components apart even where ids repeat. Columns of ``docs`` beyond doc_id and text are not read.
    """
    marked = stored(fingerprints(docs, words_per_shingle), "simhash")
    return classed(marked, links(marked.select("fp").distinct(), budget)).select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", "n_documents"
    )


# Similarity of 0.8 in shingles leaves a seventh of all fingerprint bits different, far beyond what a budget of a few
# bits in 64 can find. For that, a longer fingerprint of LANES x 63 bits is read as words of WORD_BITS, each with tries
# of its own: copies agree in some word but for one bit. What meets there is compared over the whole fingerprint, and is
# a candidate, whose shingle sets can then be compared exactly.
LANES, WORD_BITS, WORDS_PER_LANE = 8, 21, 3
WORD_BUDGET = 1
LANE_MASK = (1 << (WORD_BITS * WORDS_PER_LANE)) - 1
TAIL_BITS = BITS - WORD_BITS  # a word is followed by bits of the next lane, so that a crowded leaf goes on as a trie
TAIL_PASSES = (1, 3, TAIL_BITS + 1)
HALVES = ((WORD_BITS // 2 + 1, WORD_BITS // 2), (0, WORD_BITS // 2 + 1))  # (shift, width) of a word's two blocks
LIKELY, ESTIMATE, LOOSE = 0, 2, 4  # standard deviations beyond the expected bits: first candidates, an estimate alone, all candidates
SPANNING, MEMBERS, PAIRS = "spanning", "members", "pairs"  # what a group of a trie reports
ODD_WORDS = 8  # numbers of 64 bits in an odd sketch


def most_apart(similarity: float, deviations: float, lanes: int = LANES) -> int:
    """Differing bits up to which so many lanes of two long fingerprints are candidates.

    The expected number at this Jaccard similarity of equally long shingle sets, and ``deviations`` standard deviations.
    """
    bits = lanes * WORD_BITS * WORDS_PER_LANE
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def shingle_set(text: str, words_per_shingle: int) -> np.ndarray:
    """The different shingle hashes in order."""
    return np.unique(shingle_hashes(text, words_per_shingle))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES numbers of 63 bits of a shingle set; lane after lane from remixed shingle hashes. Zeros without shingles."""
    out = np.zeros(LANES, np.uint64)
    for lane in range(LANES if len(hashes) else 0):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        out[lane] = majority(mixed ^ (mixed >> np.uint64(32))) & np.uint64(LANE_MASK)
    return out


def long_fingerprints(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """(doc_id, text_key, fp, lanes): ``lanes`` is an array of longs, ``fp`` a hash of the whole shingle set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = [shingle_set(x, words_per_shingle) for x in batch["text"].to_pylist()]
        lanes = [long_fingerprint(x).view(np.int64) for x in sets]
        fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(fp), pa.array(lanes, pa.list_(pa.int64()))], names=["doc_id", "text_key", "fp", "lanes"])

    text = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    return text.mapInArrow(per_batch(mark), f"doc_id {kind}, text_key long, fp long, lanes array<long>")


def long_meetings(distinct: DataFrame, similarity: float, report: str, deviations: float, rows_at_once: int = 60_000) -> DataFrame:
    """What meets in a word and is as near as ``most_apart`` says of two lanes: (a, b), values of ``fp`` with a < b; or (fp).

    Of ``distinct`` (fp, lanes, tree), pairs of one ``tree`` are left out. Each group of a trie reports pairs that span its
    trees (``SPANNING``), the members of any pair (``MEMBERS``), or every pair (``PAIRS``). With ``PAIRS``, the columns
    ``slack`` and ``odd`` of ``slacks`` tell pairs that cannot be alike, and these are not reported. A trie gets the lane of
    its word and the next one only, and compares by these.
    """
    apart = most_apart(similarity, deviations, 2)
    extra = ["slack", "odd"] if report == PAIRS else []
    tries = []
    for lane in range(LANES):
        for word in range(WORDS_PER_LANE):
            for half, (shift, width) in enumerate(HALVES):
                top = F.shiftright(F.col("lanes")[lane], word * WORD_BITS + shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
                own, following = F.col("lanes")[lane].alias("own"), F.col("lanes")[(lane + 1) % LANES].alias("following")
                tries.append(F.struct(F.lit((lane * WORDS_PER_LANE + word) * 2 + half).alias("trie"), top.alias("top"), own, following))
    rows = distinct.select("fp", "tree", *extra, F.explode(F.array(*tries)).alias("t")).select("t.*", "fp", "tree", *extra).repartition("trie", "top").sortWithinPartitions("trie", "top")

    def solve(trie: int, fp: np.ndarray, lanes: np.ndarray, tree: np.ndarray, slack: np.ndarray | None = None, odd: np.ndarray | None = None):
        word, half = trie // 2 % WORDS_PER_LANE, trie % 2
        shift, width = HALVES[half]
        value = (lanes[:, 0] >> np.uint64(word * WORD_BITS)) & np.uint64((1 << WORD_BITS) - 1)
        turned = ((value << np.uint64(WORD_BITS - shift - width)) | (value >> np.uint64(shift + width))) & np.uint64((1 << WORD_BITS) - 1)
        code = turned << np.uint64(TAIL_BITS) | lanes[:, 1] & np.uint64((1 << TAIL_BITS) - 1)
        order = np.lexsort((tree, code))
        code, fp, tree, columns = code[order], fp[order], tree[order], np.ascontiguousarray(lanes[order].T)
        if slack is not None:
            slack, odd = slack[order], np.ascontiguousarray(odd[order].T)
        pairs, member = [], np.zeros(len(fp), bool)

        def near(a, b, _):
            skip = tree[a] == tree[b]
            if report == MEMBERS:
                skip |= member[a] & member[b]
            bits = np.where(skip, apart + 1, 0)
            left = np.flatnonzero(bits == 0)
            for column in columns:
                bits[left] += np.bitwise_count(column[a[left]] ^ column[b[left]])
            close = bits <= apart
            if report == SPANNING:
                return close
            a, b = a[close], b[close]
            if report == MEMBERS:
                member[a] = member[b] = True
            elif len(a):
                differing = sum(np.bitwise_count(word[a] ^ word[b]).astype(np.int64) for word in odd)
                alike = differing <= slack[a] + slack[b] + 1e-6
                pairs.append((a[alike], b[alike]))
            return np.zeros(len(close), bool)

        first = np.unique(tree, return_index=True, return_inverse=True)
        spanning = report == SPANNING
        trie_links(code, width, WORD_BUDGET, WORD_BITS, TAIL_PASSES if spanning else TAIL_PASSES[-1:], near, first[1][first[2]], pairs if spanning else None)
        if report == MEMBERS:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp[member]))], names=["fp"])
        for x, y in pairs:
            if len(x):
                x, y = fp[x], fp[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        parts, held, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            trie, top, fp, tree = (batch[c].to_numpy() for c in ("trie", "top", "fp", "tree"))
            lanes = np.stack([batch[c].to_numpy().view(np.uint64) for c in ("own", "following")], axis=1)
            columns = [fp, lanes, tree]
            if extra:
                columns += [batch["slack"].to_numpy(), batch["odd"].flatten().to_numpy().view(np.uint64).reshape(-1, ODD_WORDS)]
            cuts = np.flatnonzero((trie[1:] != trie[:-1]) | (top[1:] != top[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fp)], strict=True):
                if parts and (trie[a], top[a]) != last and (held >= rows_at_once or trie[a] != last[0]):
                    yield from solve(int(last[0]), *(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, held = [], 0
                last = (trie[a], top[a])
                parts.append(tuple(x[a:b] for x in columns))
                held += b - a
        if parts:
            yield from solve(int(last[0]), *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows.mapInArrow(run, "fp long" if report == MEMBERS else "a long, b long").distinct()


def long_candidates(distinct: DataFrame, similarity: float, deviations: float, met: DataFrame) -> DataFrame:
    """Those pairs (a, b) of ``met`` whose ``lanes`` are as near as ``most_apart`` says; they fetch all lanes, once for each pair."""
    side = lambda c: distinct.select(F.col("fp").alias(c), F.col("lanes").alias(f"lanes_{c}"))
    bits = sum((F.bit_count(F.col("lanes_a")[i].bitwiseXOR(F.col("lanes_b")[i])) for i in range(LANES)), F.lit(0))
    return met.join(side("a"), "a").join(side("b"), "b").filter(bits <= most_apart(similarity, deviations)).select("a", "b")


def shingle_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, words_per_shingle: int) -> DataFrame:
    """(fp, shingles): the shingle sets of ``wanted`` (fp), as bytes; one text stands for its fp."""
    named = marked.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    named = named.select("fp", F.col("row.doc_id").alias("id"), F.col("row.text_key").alias("text_key"))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    same = F.col("t.id").eqNullSafe(F.col("n.id")) & (F.col("t.text_key") == F.col("n.text_key"))
    texts = texts.alias("t").join(named.alias("n"), same).select("n.fp", "t.text").dropDuplicates(["fp"])

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, words_per_shingle).tobytes() for x in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["fp"], pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return stored(texts.mapInArrow(per_batch(hashed), "fp long, shingles binary"), "simhash-sets")


def slacks(sets: DataFrame, trees: DataFrame, similarity: float) -> DataFrame:
    """(fp, slack, odd): two sets of different trees can be this similar only if their ``odd`` differ in at most the sum of their ``slack`` bits.

    Sets of x and y shingles are similar if at most (x + y) (1 - similarity) / (1 + similarity) shingles are in one of them
    only. Shingles that no other tree has are such, whatever the partner: ``slack`` is what a set's share of the bound leaves
    besides them. Of the other shingles, ``odd`` has a bit for each place of the hash, set if an odd number fall there, so
    a differing bit is at least one shingle in one of the sets only. No similar pair is lost by that.
    """
    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
        at = np.repeat(np.arange(len(shingles)), [len(x) for x in shingles])
        return pa.RecordBatch.from_arrays([batch["fp"].take(pa.array(at)), batch["tree"].take(pa.array(at)), pa.array(np.concatenate(shingles))], names=["fp", "tree", "h"])

    flat = sets.join(trees.select("fp", "tree"), "fp").mapInArrow(per_batch(spread, 50), "fp long, tree long, h long")
    shared = flat.groupBy("h").agg(F.min("tree").alias("least"), F.max("tree").alias("most")).filter(F.col("least") != F.col("most"))
    bits = [F.expr(f"bit_xor(if((shiftright(h, 6) & {ODD_WORDS - 1}) = {i}, shiftleft(1L, cast(h & 63 as int)), 0L))") for i in range(ODD_WORDS)]
    found = flat.join(shared.select("h"), "h", "left_semi").groupBy("fp").agg(F.count("*").alias("n"), F.array(*bits).alias("odd"))
    size = (F.octet_length("shingles") / 8).cast("double")
    return sets.join(found, "fp", "left").select(
        "fp", (size * ((1 - similarity) / (1 + similarity)) - size + F.coalesce("n", F.lit(0))).alias("slack"),
        F.coalesce("odd", F.array(*[F.lit(0).cast("long")] * ODD_WORDS)).alias("odd"),
    )


def verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: values of fp) whose shingle sets have this Jaccard similarity."""
    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(met.select("a", "b", "x", "y").mapInArrow(per_batch(compared), "a long, b long"), "simhash-verified")


def similar_documents(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """As ``near_duplicates``, for documents whose shingle sets have about this Jaccard similarity, as long fingerprints tell.

    An estimate: it takes pairs below ``similarity`` too. ``verified_documents`` compares the sets themselves.
    """
    marked = stored(long_fingerprints(docs, words_per_shingle), "simhash-long")
    distinct = marked.select("fp", "lanes", F.col("fp").alias("tree")).dropDuplicates(["fp"])
    return classed(marked.drop("lanes"), long_candidates(distinct, similarity, ESTIMATE, long_meetings(distinct, similarity, SPANNING, ESTIMATE)))


def verified_documents(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """As ``near_duplicates``, for documents whose shingle sets have this Jaccard similarity or more.

    Long fingerprints give the candidates, and each is compared exactly. Likely pairs that span the groups come first, so
    that a dense group is one tree before pairs between different trees are looked for under the looser bound. Of these,
    first only the members are told; their shared shingles then rule out pairs before any is listed, so that a large group
    of texts that are not quite alike does not give all its pairs.
    """
    marked = stored(long_fingerprints(docs, words_per_shingle), "simhash-long")
    names = marked.drop("lanes")
    distinct = marked.select("fp", "lanes").dropDuplicates(["fp"])
    alone = distinct.withColumn("tree", F.col("fp"))
    pairs = stored(long_candidates(alone, similarity, LIKELY, long_meetings(alone, similarity, SPANNING, LIKELY)), "simhash-candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    likely = verified(shingle_sets(docs, names, wanted, words_per_shingle), pairs, similarity)

    trees = connected_components(likely, "a", "b").withColumnRenamed("node", "fp").withColumnRenamed("component", "tree")
    known = stored(distinct.join(trees, "fp", "left").withColumn("tree", F.coalesce("tree", "fp")), "simhash-trees")
    members = stored(long_meetings(known, similarity, MEMBERS, LOOSE), "simhash-members")
    sets = shingle_sets(docs, names, members, words_per_shingle)
    known = known.join(members, "fp", "left_semi")
    marks = stored(known.join(slacks(sets, known, similarity), "fp"), "simhash-slacks")
    pairs = stored(long_candidates(marks, similarity, LOOSE, long_meetings(marks, similarity, PAIRS, LOOSE)), "simhash-candidates")
    return classed(names, likely.unionByName(verified(sets, pairs, similarity)))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; columns of ``docs``, whatever their names.

    ``found`` is what ``near_duplicates``, ``similar_documents`` or ``verified_documents`` says of ``docs``. Rows that repeat the id within the
    component are copies too and go.
    """
    row = F.struct("doc_id", "text_key")
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(row).alias("_row"))
    packed, restore = set_apart(docs, "doc_id", "text")
    marked = packed.withColumn("_row", F.struct("doc_id", F.xxhash64(whole_text()).alias("text_key")))
    return restore(marked.join(chosen.select("_row").distinct(), "_row", "left_semi").dropDuplicates(["_row"]))
