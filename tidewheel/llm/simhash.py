"""Operator 6: near duplicates by SimHash, with pigeonring filtering of the candidates.

Words are runs of bytes other than the six ASCII blanks, after lower-casing A-Z; shingles are four
words, repeats included. A text of fewer words is one shingle; a text of none has fingerprint zero,
which links like any other.

Two fingerprints link at ``LIMIT`` or fewer differing bits. Cut a fingerprint into a ring of
``SEGMENTS`` segments: some start then exists from which, for every l, the first l segments together
differ in at most l * LIMIT / SEGMENTS bits. So the first segment of such a chain is equal and the
second differs in one bit at most, which leaves one of its halves equal: (start, half, first segment,
half of the second) is the key by which candidates meet. Of those that meet, the whole chain is
tested before a link is made.

Equal fingerprints are one class, handled once. A key that more than ``BLOCK`` classes share is made
longer by a part of the chain's third segment, of which one of three is equal, and if need be of the
fourth, one of four. Where a key is crowded still, its rows near its central one are linked to that and
are compared with the others alone, block by block, so a crowd of near copies costs its size and no
task holds more than two blocks. Within a unit a spanning forest of the links is made rather than all
of them, which leaves the components whole.

``drop_near_duplicates`` is the pipeline's stage, with a measure of its own: 128 bits over shingles of
five words without the punctuation around them, linked at ``WIDE_LIMIT`` or fewer differing bits, where
texts of a Jaccard similarity of 0.8 are 1.5 standard deviations inside (texts of fewer than ``FEWEST``
shingles, which no other text of 0.8 can be unless equal: at none). So wide a limit leaves no
segment equal. The ring then has seven segments, each with a number of bits of its own in which it may
differ (``WIDE_MOST``); these numbers and one for each segment add up to ``WIDE_LIMIT`` + 1, so some
start exists from which the first l segments together differ, for every l, in at most their numbers and l - 1
bits. Rows meet where the first segment differs in so few bits, by looking up every such value; of those that
meet the chain of three segments is tested, then the whole. No pair is missed. Rows are dealt in blocks,
each with each and a unit for each start, so a task holds two blocks; what is compared grows with the
square of the distinct fingerprints, of whose pairs about 1 in 50 have a first segment so near.

A row's fingerprint is of its whole text, however long. Null text counts as empty. Rows with equal ids
keep a row each; null ids are allowed (a component of null ids alone has a null id). Where copies are
dropped, one row of each component stays: that of the smallest id. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TASKS, fresh, slices, small, split_join, stage, table
from .components import components

SHINGLE, SEED, LIMIT, SEGMENTS, BLOCK = 4, 42, 4, 5, 2048
WIDE_SHINGLE, WIDE_LIMIT, FEWEST, FLIP, MEET = 5, 25, 9, 0.1514, 0.95
#: Characters that do not belong to the words they stand around.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Segments as (lowest bit, width), of 13, 13, 13, 13 and 12 bits.
RING = [(13 * k, 13) for k in range(4)] + [(52, 12)]
#: Groups up to this size are compared by shifts of the whole batch, up to ``MIDDLE`` pair by pair at once, larger ones row by row.
SMALL, WIDE_SMALL, MIDDLE = 12, 32, 512
#: Rows that are compared in one step at least.
STEP = 1 << 15
#: Of the pipeline's 128 bits: segments as (lowest bit, width), and the bits in which the first segment of a chain differs at most.
WIDE_RING = [(0, 18), (18, 18), (36, 18), (54, 19), (73, 18), (91, 18), (109, 19)]
WIDE_MOST = [3, 3, 3, 2, 3, 3, 2]
#: Segments of a chain that are tested at once, 64 bits at most; classes that a unit takes from each of two blocks, and pairs at once.
WIDE_CHAIN, WIDE_BLOCK, PAIRS = 3, 1 << 18, 1 << 19


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[size - 1 :], strict=False)]


def _majority(raw: bytes, width: int) -> bytes:
    """The bits that are set in more than half of the hashes of ``width`` bytes."""
    every = np.frombuffer(raw, np.uint8).reshape(-1, width)
    ones = np.zeros(8 * width, np.int64)
    for at in range(0, len(every), 1 << 16):
        ones += np.unpackbits(every[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(every), bitorder="little").tobytes()


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text, as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(s, SEED) for s in _shingles(words, SHINGLE)], "<u8")
    return int.from_bytes(_majority(hashes.tobytes(), 8), "little", signed=True)


def wide_fingerprint(text: bytes | None) -> tuple[int, int, int]:
    """(first half, second half, shingles) of the pipeline's SimHash."""
    words = [w for x in (text or b"").lower().split() if (w := x.strip(PUNCTUATION))]
    if not words:
        return 0, 0, 0
    shingles, hash_of = _shingles(words, WIDE_SHINGLE), xxhash.xxh3_128_digest
    raw = _majority(b"".join([hash_of(s, SEED) for s in shingles]), 16)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True), len(shingles)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, fp long"), "simhash")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, fp): ten keys a class. The key's bits from 32 up are 2 * start + half."""
    keys = []
    for start, (low, width) in enumerate(RING):
        first = f"(shiftrightunsigned(fp, {low}) & {(1 << width) - 1})"
        low, width = RING[(start + 1) % SEGMENTS]
        for half, (at, bits) in enumerate(((low, width // 2), (low + width // 2, width - width // 2))):
            second = f"(shiftrightunsigned(fp, {at}) & {(1 << bits) - 1})"
            keys.append(f"shiftleft(bigint({2 * start + half}), 32) | shiftleft({first}, 16) | {second}")
    return classes.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), "fp")


def _deepened(keys: DataFrame, depth: int) -> DataFrame:
    """Each row under longer keys: a part of the chain's ``depth + 1``-th segment, which differs in ``depth`` bits at most."""
    parts, bits, at = depth + 1, 12 // (depth + 1), 36 + 6 * (depth - 2)
    low = F.get(F.array(*[F.lit(x) for x, _ in RING]), F.pmod(F.shiftrightunsigned("key", 33).bitwiseAND(7) + depth, F.lit(SEGMENTS)).cast("int"))
    made = []
    for part in range(parts):
        own = F.call_function("shiftrightunsigned", F.col("fp"), (low + bits * part).cast("int")).bitwiseAND((1 << bits) - 1)
        made.append(F.col("key").bitwiseOR(F.shiftleft(own.bitwiseOR(part << 4).cast("long"), at)))
    return keys.select(F.explode(F.array(*made)).alias("key"), "fp")


def _chain(starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the chain from each start stays within its budgets; the last one is the whole distance."""
    differ, total = a ^ b, np.zeros(np.broadcast(a, b).shape, np.int64)
    ok = np.ones(total.shape, bool)
    for k in range(SEGMENTS):
        mask = _MASKS[(starts + k) % SEGMENTS]
        total += np.bitwise_count(differ & mask)
        ok &= total * SEGMENTS <= (k + 1) * LIMIT
    return ok


_MASKS = np.array([((1 << w) - 1) << low for low, w in RING], np.uint64)
#: By width and number: the values of so many bits at most that are not zero.
_MOST_BITS = {(w, m): [sum(1 << b for b in on) for k in range(1, m + 1) for on in combinations(range(w), k)] for (_, w), m in zip(WIDE_RING, WIDE_MOST, strict=True)}


Linked = Callable[[np.ndarray | int, np.ndarray | int], np.ndarray]


def _links_of(key: np.ndarray, unit: np.ndarray, linked: Linked, small: int = SMALL) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links, as places, within the groups (equal key and unit, adjacent) of a sorted batch: enough to connect what links."""
    edge = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
    first = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((first, [len(key)])))
    own, group = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
    left, right = [], []
    for shift in range(1, min(small, int(size.max()))):
        i = np.flatnonzero((group[shift:] == group[:-shift]) & (own[shift:] <= small))
        i = i[linked(i, i + shift)]
        left.append(i)
        right.append(i + shift)
    for g in np.flatnonzero(size > small):
        at, n = first[g], size[g]
        every = None
        if n <= MIDDLE:  # all pairs at once, then a walk over those that link
            i, j = np.triu_indices(n, 1)
            hit = linked(at + i, at + j)
            if not hit.any():
                continue
            every = np.zeros((n, n), bool)
            every[i[hit], j[hit]] = every[j[hit], i[hit]] = True
        todo = np.arange(n) if every is None else np.flatnonzero(every.any(0))
        while len(todo):
            front, todo = [todo[0]], todo[1:]
            while front and len(todo):
                one = front.pop()
                hit = linked(at + todo, at + one) if every is None else every[one, todo]
                if hit.any():
                    near = todo[hit]
                    left.append(np.full(len(near), at + one))
                    right.append(at + near)
                    front.extend(near)
                    todo = todo[~hit]
    return left, right


def _linked_groups(dealt: DataFrame, link: Callable, name: str, small: int = SMALL) -> DataFrame:
    """Links (a, b) of the column ``name`` in the groups of (key, unit, ...), which are dealt out whole and sorted.

    ``link``: the columns behind key and unit, and key, to a test of places.
    """
    place = dealt.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            held.append(cols)
            if sum(len(x[0]) for x in held) < STEP:
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            if len(last):  # all but the last group are whole
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = len(cols[0]) - (batch.num_rows - 1 - int(last[-1]))
                held = [[c[cut:] for c in cols]]
                yield from _sent([c[:cut] for c in cols])
        if held:
            yield from _sent([np.concatenate(x) for x in zip(*held, strict=True)])

    def _sent(cols):
        left, right = _links_of(cols[0], cols[1], link(*cols), small)
        if left:
            a, b = (cols[place][np.concatenate(x).astype(np.int64)] for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _central(crowded: DataFrame, wide: DataFrame, words: list[str], member: str) -> DataFrame:
    """(key, p, n) of each crowded key, staged: the row nearest to the bits that most of its rows have, and their number."""
    bits = [(w, b) for w in words for b in range(64)]
    ones = crowded.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(w, b).bitwiseAND(1)).alias(f"{w}{b}") for w, b in bits])
    middle = [reduce(Column.bitwiseOR, [F.when(2 * F.col(f"{w}{b}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]).alias(f"middle_{w}") for w in words]
    rows = split_join(crowded, stage(ones.select("key", "n", *middle), "middles"), ["key"])
    far = reduce(Column.__add__, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"middle_{w}"))) for w in words])
    return stage(rows.groupBy("key").agg(F.min_by(F.struct(*crowded.columns), F.struct(far, member)).alias("p"), F.count("*").alias("n")), "centres")


def _in_blocks(keys: DataFrame, words: list[str], member: str, near: Column) -> tuple[DataFrame, DataFrame | None]:
    """(``keys`` with ``unit``, links): a key that more than ``BLOCK`` rows share is not compared whole.

    Its rows that are ``near`` its central one, ``p``, are linked to that, and need no comparison among
    themselves; the others are dealt out in blocks, each with each block of all rows. So a crowd of near
    copies costs its size, and what a task holds is two blocks.
    """
    plain = keys.withColumn("unit", F.lit(0).cast("long"))
    wide = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "wide_keys")
    if wide.isEmpty():
        return plain, None
    crowded = stage(split_join(keys, wide, ["key"], "left_semi"), "crowded")
    judged = stage(split_join(crowded, _central(crowded, wide, words, member), ["key"]).withColumn("near", near), "judged")
    links = judged.filter("near").select(F.col("p")[member].alias("a"), F.col(member).alias("b")).filter("a <> b").distinct()
    rest = judged.filter("NOT near").select(*crowded.columns)
    blocks = judged.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("r")).filter("r > 0")
    blocks = stage(blocks.select("key", "n", "r", F.ceil(F.col("n") / BLOCK).alias("every"), F.ceil(F.col("r") / BLOCK).alias("others")), "blocks")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("with")
    one = split_join(crowded, blocks, ["key"]).select("*", upto("others"))
    one = one.withColumn("unit", F.col("with") * (1 << 31) + F.pmod(F.xxhash64(member), F.col("every")) + 1)
    two = split_join(rest, blocks.withColumn("n", F.col("r")), ["key"]).select("*", upto("every"))
    two = two.withColumn("unit", F.pmod(F.xxhash64(member, F.lit(1)), F.col("others")) * (1 << 31) + F.col("with") + 1)
    calm = split_join(keys, wide, ["key"], "left_anti").withColumn("unit", F.lit(0).cast("long"))
    return reduce(DataFrame.union, [x.select(*plain.columns) for x in (calm, one, two)]), links


def _dealt(keys: DataFrame, *columns: str) -> DataFrame:
    return keys.select("key", "unit", *columns).repartition("key", "unit").sortWithinPartitions("key", "unit", *columns)


def near_links(classes: DataFrame) -> DataFrame:
    """``classes``: distinct ``fp``. Links (a, b) that connect all fingerprints within the limit."""
    keys = _keys(classes)
    for depth in (2, 3):
        wide = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "crowded_keys")
        if wide.isEmpty():
            break
        longer = _deepened(split_join(keys, wide, ["key"], "left_semi"), depth)
        keys = stage(split_join(keys, wide, ["key"], "left_anti").unionByName(longer), "keys")

    def link(key: np.ndarray, unit: np.ndarray, fp: np.ndarray) -> Linked:
        start, fp = ((key >> 33) & 7).astype(np.int64), fp.view(np.uint64)
        return lambda i, j: _chain(start[i], fp[i], fp[j])

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= LIMIT
    keys, stars = _in_blocks(keys, ["fp"], "fp", near)
    found = _linked_groups(_dealt(keys, "fp"), link, "fp")
    return found if stars is None else found.union(stars)


def _tables(classes: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many classes: by chance some 256 classes share a key at most, which few tables allow.

    Of keys drawn at random, by which no stage looks for candidates any more; a test holds it.
    """
    bits = max(14, min(32, (max(classes, 1) - 1).bit_length() - 8))
    return bits, math.ceil(math.log(1 - MEET) / math.log(1 - (1 - FLIP) ** bits))


def _rotated(first: np.ndarray, second: np.ndarray, at: int) -> np.ndarray:
    """The 64 bits from ``at`` on of the ring of 128 that two words make."""
    if at >= 64:
        first, second, at = second, first, at - 64
    return first >> np.uint64(at) | second << np.uint64(64 - at) if at else first


class _Joined:
    """Which rows are joined, as a label a row; rows of one label need no comparison."""

    def __init__(self, n: int):
        self.label, self.left, self.right = np.arange(n), [], []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[a != b], axis=0)
        if not len(pairs):
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                root[x] = x = root.get(root[x], root[x])
            return x

        for x, y in pairs.tolist():
            x, y = sorted((find(x), find(y)))
            if x != y:
                root[y] = x
                self.left.append(x)
                self.right.append(y)
        to = np.arange(len(self.label))
        to[list(root)] = [find(x) for x in list(root)]
        self.label = to[self.label]


def _ring_links(start: int, other: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, that connect what lies within the wide limit by a chain from segment ``start``.

    ``other``: the side of each row; of two sides, pairs within one are left to other units.
    """
    low, width = WIDE_RING[start]
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    chain = [(start + k) % len(WIDE_RING) for k in range(WIDE_CHAIN)]
    bits, most = sum(WIDE_RING[k][1] for k in chain), sum(WIDE_MOST[k] + 1 for k in chain) - 1
    head = _rotated(hi, lo, low) & np.uint64((1 << bits) - 1)
    own = (head & np.uint64((1 << width) - 1)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    head, own, hi, lo, other = head[order], own[order], hi[order], lo[order], other[order]
    both, made = bool((other != other[0]).any()), _Joined(len(own))

    def linked(i, j):
        return np.bitwise_count(hi[i] ^ hi[j]).astype(np.int64) + np.bitwise_count(lo[i] ^ lo[j]) <= WIDE_LIMIT

    found = _links_of(own, np.zeros(len(own), np.int64), linked, WIDE_SMALL)  # rows whose segment is equal
    if found[0]:
        made.join(*(np.concatenate(x).astype(np.int64) for x in found))
    value, first, size = np.unique(own, return_index=True, return_counts=True)
    slot = np.full(1 << width, -1, np.int64)
    slot[value] = np.arange(len(value))
    least, largest = np.minimum.reduceat(made.label, first), np.maximum.reduceat(made.label, first)
    one = np.where(least == largest, least, -1)
    for mask in _MOST_BITS[width, WIDE_MOST[start]]:
        to = value ^ mask
        l = np.flatnonzero(to > value)
        r = slot[to[l]]
        l, r = l[r >= 0], r[r >= 0]
        some = (one[l] != one[r]) | (one[l] < 0)  # else all of both are joined: a crowd of near copies costs its size
        l, r = l[some], r[some]
        ends = np.cumsum(size[l] * size[r])
        at = 0
        while at < len(l):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            a, b = l[at:end], r[at:end]
            for i, j in _pairs(first[a], size[a], first[b], size[b]):
                hit = np.bitwise_count(head[i] ^ head[j]) <= most
                if both:
                    hit &= other[i] != other[j]
                i, j = i[hit], j[hit]
                hit = made.label[i] != made.label[j]
                i, j = i[hit], j[hit]
                hit = linked(i, j)
                made.join(i[hit], j[hit])
            at = end
    return order[np.array(made.left, np.int64)], order[np.array(made.right, np.int64)]


def _pairs(first: np.ndarray, size: np.ndarray, first_: np.ndarray, size_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the rows of two groups each; of large groups, some rows of one at a time."""
    if len(first) == 1 and size[0] * size_[0] > PAIRS:
        step = max(1, PAIRS // int(size_[0]))
        for at in range(0, int(size[0]), step):
            n = min(step, int(size[0]) - at)
            yield np.repeat(first[0] + at + np.arange(n), size_[0]), np.tile(first_[0] + np.arange(size_[0]), n)
        return
    single = (size == 1) & (size_ == 1)
    yield first[single], first_[single]
    first, size, first_, size_ = (x[~single] for x in (first, size, first_, size_))
    count = size * size_
    group = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    yield first[group] + k // size_[group], first_[group] + k % size_[group]


def wide_links(classes: DataFrame, n: int) -> DataFrame:
    """``classes``: ``n`` distinct rows (id, hi, lo, shingles). Links (a, b) of ids that connect all within the wide limit.

    A unit is two blocks of classes, or one with itself, and a segment to start from.
    """
    blocks = max(1, -(-n // WIDE_BLOCK), min(4, n >> 13))
    starts = len(WIDE_RING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            edge = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), len(cols[0])]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1][0][0] != cols[0][a]:
                    yield found([np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
                held.append([c[a:b] for c in cols])
        if held:
            yield found([np.concatenate(x) for x in zip(*held, strict=True)])

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        unit, block, ids, hi, lo = cols
        left, right = _ring_links(int(unit[0] % starts), block, hi, lo)
        return pa.RecordBatch.from_arrays([pa.array(ids[left], pa.int64()), pa.array(ids[right], pa.int64())], names=["a", "b"])

    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    # texts of fewer shingles link to equal ones alone, which are one class
    rows = classes.filter(F.col("shingles") >= FEWEST).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "hi", "lo")
    rows = rows.select("*", F.explode(upto(blocks)).alias("with"))
    pair = F.least("block", "with") * blocks + F.greatest("block", "with")
    rows = rows.select("block", "id", "hi", "lo", pair.alias("pair")).select("*", F.explode(upto(starts)).alias("start"))
    dealt = rows.select((F.col("pair") * starts + F.col("start")).alias("unit"), "block", "id", "hi", "lo")
    dealt = dealt.repartition(min(MOST_TASKS, 2 * blocks * (blocks + 1) * starts), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "a long, b long")


def _rooted(classes: DataFrame, node: str, stars: DataFrame) -> DataFrame:
    """(node, root, component_id, component_size) of the classes that link; ``classes``: (node, least, n)."""
    stars = stage(stars, "stars")
    members = stage(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "members")
    found = members.join(classes.select(F.col(node).alias("node"), "least", F.col("n").alias("rows")), "node")
    whole = found.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_size"), F.count("*").alias("n"))
    return split_join(members, stage(whole, "components"), ["root"])


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row and (fp, n, component_id, component_size) of each fingerprint, staged."""
    rows = fingerprints(docs, doc_id, text)
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    rooted = _rooted(classes, "fp", components(near_links(classes))).withColumnRenamed("node", "fp")
    of = classes.join(rooted, "fp", "left")
    own = F.col("root").isNull()
    return rows, stage(of.select("fp", "n", F.when(own, F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_size", "n").alias("component_size")), "near")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, component_size."""
    rows, of = near_components(docs, doc_id, text)
    found = split_join(rows, of, ["fp"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def wide_prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hi, lo, shingles) of every row, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [wide_fingerprint(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [()] * 3, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "hi", "lo", "shingles"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, hi long, lo long, shingles int"), "wide_prints")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, hi, lo) of every row and (hi, lo, n, root) of each fingerprint, staged: those of one root are near copies."""
    rows = wide_prints(docs, doc_id, text)
    classes = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("shingles").alias("shingles"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "wide_classes")
    rooted = _rooted(classes, "id", components(wide_links(classes, classes.count()))).select(F.col("node").alias("id"), "root")
    return rows, stage(classes.join(rooted, "id", "left").select("hi", "lo", "n", F.coalesce("root", "id").alias("root")), "wide_roots")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: of the smallest id (null last), then any one of the rows that share it."""
    rows, of = near_copies(docs, doc_id, text)
    copies = stage(split_join(rows.select("doc_id", "hi", "lo"), of, ["hi", "lo"]).select("doc_id", "root"), "near_copies")
    kept = copies.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("owner"))
    kept = stage(kept, "near_kept")
    other, number = fresh(docs, "__other"), fresh(docs, "__number")
    # an id goes if no row of it stays; where some rows of an id stay, each is looked at by itself
    many = copies.groupBy("doc_id").agg(F.count("*").alias("rows"))
    few = kept.groupBy("owner").agg(F.count("*").alias("stay"))
    ids = many.join(few, F.col("doc_id").eqNullSafe(F.col("owner")), "left").filter("stay IS NULL OR stay < rows")
    ids = stage(ids.select(F.col("doc_id").alias(other), F.col("stay").isNotNull().alias("some")), "near_gone")
    every, some = small(ids.select(other)), small(ids.filter("some").select(other))
    out = docs.join(every, F.col(doc_id).eqNullSafe(every[other]), "left_anti")
    if some.isEmpty():
        return out
    shared = docs.join(some, F.col(doc_id).eqNullSafe(some[other]), "left_semi")
    shared = stage(shared.withColumn(number, F.monotonically_increasing_id()), "near_shared")
    # a row's number takes the place of its id, and the id is found by it
    owners = shared.select(F.col(number).alias("number"), F.col(doc_id).cast("long").alias("row_owner"))
    prints = wide_prints(shared, number, text).withColumnRenamed("doc_id", "number").join(owners, "number").join(of.drop("n"), ["hi", "lo"])
    stay = prints.join(kept, "root").filter(F.col("row_owner").eqNullSafe(F.col("owner")))
    stay = small(stage(stay.groupBy("root").agg(F.min("number").alias("number")).select(F.col("number").alias(other)), "near_best"))
    return out.unionByName(shared.join(stay, shared[number] == stay[other], "left_semi").drop(number))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
