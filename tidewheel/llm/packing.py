"""Operator 5: best-fit packing of token sequences into bins of several permitted lengths.

A document is its tokens and an end token; one longer than the largest permitted length is cut into
full pieces of that length and a rest. Pieces are dealt by a hash of their content into groups of about
``GROUP_TOKENS`` tokens, which are packed apart: a group's size is bounded however long or frequent
documents are, and a piece's group does not depend on how files or partitions lie. Pieces that are
equal in document, place and tokens are shared out evenly over the groups.

In a group, pieces are taken from the longest down. Each goes to the open bin whose room is left the
smallest; where none has room a bin is opened, and of the permitted lengths that hold the piece the one
of least cost for each token is taken: a bin's cost is its length, downsized to its contents, and
``OVERHEAD``, its contents the piece and then, again and again, the longest piece left that fits. At
the end each bin is downsized to the least permitted length that holds what it got. The outcome is
held against those of opening one length throughout, and the cheapest is kept. ``least_cost`` is the
optimum by exhaustive search, for few pieces; tests compare the two.

A row of the result is a packed sequence: its tokens, and for each part its document, the place in it
and the place here. Null and empty texts are one piece, of the end token. Very long texts are cut
into pieces by the task that reads them. Rows repeated or with equal or null ids are packed each. An
empty table gives no bins. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TASKS, slices, stage, table
from .token_files import ChunkEncoder, _encoder, encoder_of

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD, GROUP_TOKENS = 16, 1 << 21
PIECES = "doc_id long, piece long, tie long, n long, ids binary"
PARTS = "doc_id long, piece long, doc_start long, start long, n long"
SEQUENCES = f"bin_id long, bin_length long, n_tokens long, parts array<struct<{PARTS.replace(' ', ':').replace(',:', ',')}>>, ids array<int>"


class Opening:
    """Chooses the length of each bin that is opened, by what is left to pack."""

    def __init__(self, sizes: list[int], lengths: tuple[int, ...], overhead: int):
        self.lengths, self.overhead = lengths, overhead
        self.left = Counter(sizes)
        self.sizes = sorted(self.left)

    def placed(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def length(self, size: int) -> int:
        """Of least cost for each token; of equal ones the largest."""
        return min((n for n in self.lengths if n >= size), key=lambda n: (self._rate(n, size), -n))

    def _rate(self, length: int, size: int) -> float:
        taken, room = {size: 1}, length - size
        at = bisect_right(self.sizes, room) - 1
        while at >= 0:
            one = self.sizes[at]
            n = min(room // one, self.left[one] - taken.get(one, 0))
            if n > 0:
                taken[one] = taken.get(one, 0) + n
                room -= n * one
            at = min(at, bisect_right(self.sizes, room)) - 1
        used = length - room
        return (self.lengths[bisect_left(self.lengths, used)] + self.overhead) / used


def best_fit(sizes: list[int], length: Callable[[int], int], placed: Callable[[int], None] = lambda size: None) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``, which descend; ``length``: what a piece that fits nowhere opens."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), sorted
    for k, size in enumerate(sizes):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(k)
        else:
            room, b = length(size), len(bins)
            bins.append([k])
        placed(size)
        if room > size:
            insort(rooms, (room - size, b))
    return bins


def downsized(bins: list[list[int]], sizes: list[int], lengths: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    return [(lengths[bisect_left(lengths, sum(sizes[k] for k in b))], b) for b in bins]


def cost_of(bins: list[tuple[int, list[int]]], overhead: int = OVERHEAD) -> int:
    return sum(n + overhead for n, _ in bins)


def pack_uniform(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """(bin length, positions) of the cheapest outcome that opens one length; longer pieces: the least that holds them."""
    made = (downsized(best_fit(sizes, lambda s, n=n: max(n, lengths[bisect_left(lengths, s)])), sizes, lengths) for n in lengths)
    return min(made, key=lambda bins: cost_of(bins, overhead))


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """(bin length, positions): each bin opened at the least cost; ``sizes`` descend, none above the last length."""
    opening = Opening(sizes, lengths, overhead)
    chosen = downsized(best_fit(sizes, opening.length, opening.placed), sizes, lengths)
    plain = pack_uniform(sizes, lengths, overhead)
    return chosen if cost_of(chosen, overhead) <= cost_of(plain, overhead) else plain


def least_cost(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> int:
    """The least cost of any packing, by dynamic programming over all subsets; for a dozen pieces."""
    best = [0] + [1 << 60] * ((1 << len(sizes)) - 1)
    total = [sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(len(best))]
    bin_cost = [lengths[bisect_left(lengths, t)] + overhead if 0 < t <= lengths[-1] else 1 << 60 for t in total]
    for m in range(1, len(best)):
        first, s = m & -m, m
        while s:  # the subsets that hold the first piece left
            if s & first:
                best[m] = min(best[m], bin_cost[s] + best[m ^ s])
            s = (s - 1) & m
    return best[-1]


def token_pieces(docs: DataFrame, encoder: Callable[[], ChunkEncoder], largest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, tie, n, ids) of every row's pieces, staged; ``tie``: a hash of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(encoder)
        for batch in slices(batches, 512):
            ids, counts = model.encode_all(batch.column(1).to_pylist())
            ends, rows = np.cumsum(counts).tolist(), []
            for key, a, b in zip(batch.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                for piece, at in enumerate(range(a, b, largest)):
                    raw = ids[at : min(at + largest, b)].tobytes()
                    rows.append((key, piece, xxhash.xxh64_intdigest(raw) - (1 << 63), len(raw) // model.width, raw))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["doc_id", "piece", "tie", "n", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(run, PIECES), "pieces", "zstd")


def _dealt(pieces: DataFrame, groups: int) -> DataFrame:
    """``pieces`` with the group of each and how often it is there; equal pieces are shared out over the groups."""
    key, number = ["doc_id", "piece", "tie"], F.lit(groups).cast("long")
    grp = F.pmod(F.xxhash64(*key), number)
    repeated = stage(pieces.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated_pieces")
    if repeated.isEmpty():
        return pieces.select("*", F.lit(1).cast("long").alias("copies"), grp.alias("grp"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    single = pieces.alias("p").join(repeated.alias("r"), same, "left_anti").select("*", F.lit(1).cast("long").alias("copies"), grp.alias("grp"))
    several = pieces.alias("p").join(repeated.alias("r"), same, "left_semi").groupBy(*key).agg(F.first("n").alias("n"), F.first("ids").alias("ids"), F.count("*").alias("all"))
    slots = F.least(F.col("all"), number)
    several = several.select("*", slots.alias("slots"), F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"))
    share = F.floor(F.col("all") / F.col("slots")) + F.when(F.col("slot") < F.pmod("all", "slots"), 1).otherwise(0)
    return single.unionByName(several.select(*key, "n", "ids", share.cast("long").alias("copies"), F.pmod(grp + F.col("slot"), number).alias("grp")))


def pack_pieces(pieces: DataFrame, lengths: tuple[int, ...] = LENGTHS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``pieces``: as ``token_pieces`` has them. One row a packed sequence: see ``SEQUENCES``."""
    groups = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // group_tokens))
    largest, tasks = lengths[-1], min(groups, MOST_TASKS)
    order = ["grp", F.desc("n"), "doc_id", "piece", "tie"]
    dealt = _dealt(pieces, groups).repartitionById(tasks, F.pmod("grp", F.lit(tasks)).cast("int")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in slices(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != at:
                    if held:
                        yield _packed(at, held)
                    at, held = row[0], []
                held += [row] * row[1]
        if held:
            yield _packed(at, held)

    def _packed(group: int, rows: list[tuple]) -> pa.RecordBatch:
        bins = pack([r[4] for r in rows], lengths)
        flat = [rows[k] for _, b in bins for k in b]
        many, n = np.array([len(b) for _, b in bins]), np.array([r[4] for r in flat], np.int64)
        ends = np.cumsum(many)
        after = np.cumsum(n)
        tokens = np.diff(np.concatenate(([0], after[ends - 1])))
        start = after - n - np.repeat(np.concatenate(([0], after[ends - 1][:-1])), many)
        piece = np.array([r[3] for r in flat], np.int64)
        parts = pa.StructArray.from_arrays([pa.array([r[2] for r in flat], pa.int64()), pa.array(piece), pa.array(piece * largest), pa.array(start), pa.array(n)], names=[c.split()[0] for c in PARTS.split(", ")])
        lists = lambda values, size: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), values)
        width = len(flat[0][5]) // flat[0][4]
        ids = pa.array(np.frombuffer(b"".join(r[5] for r in flat), f"<u{width}").astype(np.int32))
        cols = [pa.array((group << 32) + np.arange(len(bins))), pa.array([b for b, _ in bins], pa.int64()), pa.array(tokens), lists(parts, many), lists(ids, tokens)]
        return pa.RecordBatch.from_arrays(cols, names=["bin_id", "bin_length", "n_tokens", "parts", "ids"])

    return dealt.select("grp", "copies", "doc_id", "piece", "n", "ids").mapInArrow(run, SEQUENCES)


def pack_texts(docs: DataFrame, tokenizer: str | None = None, lengths: tuple[int, ...] = LENGTHS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The packed sequences of the tokens of ``docs``, by a ``tokenizers`` file."""
    import public_tokenizers

    encoder = encoder_of(tokenizer or public_tokenizers.path("word_bpe_49k.json"), 1)
    return pack_pieces(token_pieces(docs, encoder, lengths[-1]), lengths, group_tokens)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))
