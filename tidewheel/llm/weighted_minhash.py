"""Operator 7: document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words; a term that occurs n times weighs (1 + ln n) times its
letters, so that long words, which are rarer, tell more. For each of ``SAMPLES`` samples a term draws,
from a hash of itself, r and c from Gamma(2, 1) and b from the unit interval; with
t = floor(ln(weight) / r + b) its value is ln c - r (t - b) - r, and the sample is the (term, t) of the
least value. Two texts agree in a sample with the probability of their generalised Jaccard similarity,
the sum of the smaller over that of the larger weights. A fingerprint keeps 16 bits a sample, in hex.

A term's draws do not depend on the text, so each worker keeps those of many terms. A text without words has the fingerprint of one empty term. Null text counts
as empty; equal texts have equal fingerprints.

The documents' order is that of descending id (null ids last), then of a hash of the text. Rows are dealt
by ranges of both into buckets of about ``BUCKET_BYTES`` of text, a task each, and the first row of each
bucket also goes, as a look-ahead, to the one before it (from the first to the last), so a bucket has
all it needs: texts are shuffled once, none is sorted in one place. Rows of equal id follow one another
and are cut apart where they are many; rows repeated with their id and text are told apart by nothing
and share a task, which streams them. A single row is its own next one. Very long texts are taken
whole. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_bounds, shard_of, slices, stage, table, worker_model
from .units import WHOLE, Units, batches_of, grown

SAMPLES, SEED, ROWS_KEPT, ROWS, BUCKET_BYTES = 64, 7, 1 << 17, 128, 8 << 20
# White space beyond Latin-1.
WIDE_SPACE = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LOWEST = -(1 << 63)


def _gamma(steps: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of equal steps of probability, by bisection."""
    u, low, high = (np.arange(steps) + 0.5) / steps, np.zeros(steps), np.full(steps, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _random(keys: np.ndarray, n: int) -> np.ndarray:
    """(len(keys), n) 64-bit numbers from 64-bit keys, by splitmix64."""
    x = keys[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def draw(keys: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """For each key and weight, and each sample: its value, and the 16-bit sign of (term, t).

    A sample's r, c and b come from 16 bits each of one random number, r and c by the quantiles of
    their distribution.
    """
    if not _TABLES:
        r = _gamma()
        _TABLES.extend((r.astype(np.float32), np.log(r).astype(np.float32)))
    parts = _random(keys, samples).view(np.uint16).reshape(len(keys), samples, 4)
    r, log_c = _TABLES[0][parts[:, :, 0]], _TABLES[1][parts[:, :, 1]]
    b = (parts[:, :, 2] + np.float32(0.5)) * np.float32(2.0**-16)
    t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + b)
    signs = parts[:, :, 3] + t.astype(np.int32).astype(np.uint16) * np.uint16(40503)
    return log_c - r * (t - b + np.float32(1)), signs


_TABLES: list[np.ndarray] = []


def _mixed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = keys ^ (counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class Sampler:
    """Fingerprints of many texts at once.

    Words are numbered by arrays (``units``); a term is a word's 64-bit hash and how often it occurs. A
    term's samples are one row of 64-bit numbers, the value in order-preserving bits above the sign, so the
    least of a text's rows, column by column, is its fingerprint. Rows are kept in ``ROWS_KEPT`` slots, each
    for the last term that fell there.
    """

    CHUNK = 1 << 15

    def __init__(self):
        latin = [chr(c) for c in range(256)]
        kinds = np.array([0 if c.isspace() else 1 for c in latin], np.uint8)
        kinds[0] = WHOLE
        lower = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in latin], np.uint8)
        self.units = Units(kinds, self._learn, self._forget, lower, 1 << 20)
        self.tags, self.rows = np.zeros(ROWS_KEPT, np.uint64), np.zeros((ROWS_KEPT, SAMPLES), np.uint64)
        self.filled = np.zeros(ROWS_KEPT, bool)

    def _forget(self) -> None:
        self.keys, self.letters, self.n = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        words, size = [w.lower() for w in words], self.n + len(words)
        self.keys, self.letters = grown(self.keys, size), grown(self.letters, size)
        self.keys[self.n : size] = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in words], np.uint64)
        self.letters[self.n : size] = [len(w) for w in words]
        self.n = size

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """(texts, samples) signs."""
        out = np.empty((len(texts), SAMPLES), np.uint16)
        texts = [t if t.isascii() else WIDE_SPACE.sub(" ", t) for t in texts]
        for a, b in batches_of(texts, self.units.CHARS):
            out[a:b] = self._least(*self._terms(texts[a:b]), b - a)
        return out

    def _terms(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, key, letters, count) of each distinct term of each text, in order of texts; a text without words has the empty one."""
        unit, many = self.units.numbers(texts)
        doc, key, letters = np.repeat(np.arange(len(texts)), many), self.keys[unit], self.letters[unit]
        if len(none := np.flatnonzero(many == 0)):
            empty = np.full(len(none), xxhash.xxh64_intdigest(b"", SEED), np.uint64)
            doc, key, letters = np.append(doc, none), np.append(key, empty), np.append(letters, np.zeros(len(none), np.int64))
        order = np.lexsort((key, doc))
        doc, key, letters = doc[order], key[order], letters[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
        return doc[first], key[first], letters[first], np.diff(np.append(first, len(doc)))

    def _least(self, doc: np.ndarray, key: np.ndarray, letters: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        out = np.full((texts, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
        tag = _mixed(key, count)
        for at in range(0, len(doc), self.CHUNK):
            part = slice(at, at + self.CHUNK)
            rows, own = self._rows(tag[part], key[part], letters[part], count[part]), doc[part]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[first]] = np.minimum(out[own[first]], np.minimum.reduceat(rows, first, axis=0))
        return (out & np.uint64(0xFFFF)).astype(np.uint16)

    def _rows(self, tag: np.ndarray, key: np.ndarray, letters: np.ndarray, count: np.ndarray) -> np.ndarray:
        slot = (tag >> np.uint64(20)).astype(np.int64) % ROWS_KEPT
        new = np.flatnonzero(~self.filled[slot] | (self.tags[slot] != tag))
        out = self.rows[slot]
        if len(new):
            _, some, back = np.unique(tag[new], return_index=True, return_inverse=True)
            some = new[some]
            values, signs = draw(key[some], (1 + np.log(count[some])) * np.maximum(1, letters[some]))
            bits = values.view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
            made = bits.astype(np.uint64) << np.uint64(16) | signs
            out[new] = made[back]
            self.rows[slot[some]], self.tags[slot[some]], self.filled[slot[some]] = made, tag[some], True
        return out


def sampler() -> Sampler:
    """The worker's own."""
    return worker_model("weighted", Sampler)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following one's start."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): see ``OUT``."""
    spark = docs.sparkSession
    order = ["down", "tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"down": F.bitwise_not(F.coalesce("doc_id", F.lit(LOWEST))), "tie": F.xxhash64("text")})
    keys = rows.select(*order, F.octet_length("text").cast("long").alias("bytes"))
    keys = stage(keys, "fingerprint_keys")
    bounds = range_bounds(keys, order, bucket_bytes)
    bucket = shard_of(order, bounds)
    # at most as many rows as there are buckets: each one's first key
    heads = keys.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(*order)).alias("k")).select("bucket", "k.*").orderBy("bucket").collect()
    before = [(heads[k - 1]["bucket"], r["down"], r["tie"]) for k, r in enumerate(heads)]
    firsts = F.broadcast(spark.createDataFrame(before, "bucket int, down long, tie long"))
    ahead = rows.join(firsts, order).groupBy("bucket", *order).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    both = rows.select(bucket.alias("bucket"), F.lit(0).alias("look"), "doc_id", "text", *order)
    both = both.unionByName(ahead.select("bucket", F.lit(1).alias("look"), "doc_id", "text", *order))
    rows = both.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "look", *order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one is still to come
        pairs: list[tuple] = []
        chars = 0
        for batch in slices(batches, 256):
            for bucket, look, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is not None and held[0] == bucket:
                    pairs.append((held[1], held[2], text))
                    chars += len(held[2]) + len(text)
                    if len(pairs) == ROWS or chars > 4_000_000:
                        yield _rows(pairs)
                        pairs, chars = [], 0
                held = None if look else (bucket, doc_id, text)
        yield _rows(pairs)

    return rows.select("bucket", "look", "doc_id", "text").mapInArrow(run, OUT)


def _rows(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [t for _, t, _ in pairs]
    changed = [edited(t, following) for _, t, following in pairs]
    chained = [k + 1 < len(pairs) and pairs[k][2] is pairs[k + 1][1] for k in range(len(pairs))]
    extra = [following for (_, _, following), c in zip(pairs, chained, strict=True) if not c]
    every = sampler().fingerprints(texts + changed + extra) if pairs else np.empty((0, SAMPLES), np.uint16)
    n = len(pairs)
    own, other, rest = every[:n], every[n : 2 * n], iter(every[2 * n :])
    nxt = [own[k + 1] if c else next(rest) for k, c in enumerate(chained)]
    text = lambda row: row.astype(">u2").tobytes().hex()
    cols = [
        pa.array([i for i, _, _ in pairs], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(map(text, own), pa.string()),
        pa.array(map(text, other), pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, nxt, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in OUT.split(", ")])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
