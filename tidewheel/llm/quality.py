"""Operator 10: quality classifier, logistic regression on hashed word n-grams.

Words are runs of characters other than the six ASCII blanks; one of more than ``LONG`` characters,
such as a text written without blanks, is cut into pieces of ``PIECE`` characters, each a word.
Features are n-grams of two readings
of the words: the word itself in lower case without punctuation around it (1 and 2 words), and its
shape (1 to 3 words), in which runs of capitals, small letters and digits are one sign each and other
characters stand for themselves; and whether a word repeats the one or two before. All are hashed
into ``2 ** BITS`` weights; a feature's value is its share of the features of its kind. The weights
are trained with follow-the-regularised-leader updates, one document at a time, on at most about
``LEARN_DOCS`` labelled rows dealt by a hash of the id into ``SHARDS`` models whose weights are
averaged; a score is the sparse dot product through the logistic function. A model's rows lie in a
temporary file of its task and are read from there in each pass, so texts of any length are learned from in
the memory of one.

Texts that are null or have no word score by the intercept alone. A very long text is scored whole, part
by part. With no labelled row every score is 0.5, and an empty table gives no rows. Repeated rows are
scored alike; other columns stay as they are, and the score takes the name it is told. Labels of a null id or null quality teach nothing; an id that
is labelled several times teaches each label.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, worker_model
from .language import part_of
from .units import WHOLE, Units, batches_of, grown

BITS, LEARN_DOCS, SHARDS, PASSES, THRESHOLD = 18, 12_000, 4, 4, 0.3
ALPHA, BETA, L1, L2 = 0.6, 0.5, 1e-4, 1e-5
MASK = np.uint64((1 << BITS) - 1)
LONG, PIECE = 24, 4
#: Features that are sent at once, but for those of one text.
MANY = 1 << 21


def _shape(word: str) -> str:
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _signs(word: str) -> int:
    """Hashes of a word without punctuation around it, in the upper half, and of its shape."""
    core = word.strip("".join(c for c in set(word) if not c.isalnum())).lower() or word
    return zlib.crc32(core.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(_shape(word).encode("utf-8", "surrogatepass"), 7)


def _kinds(both: np.ndarray, skip: int = 0) -> list[np.ndarray]:
    """The hashes of each kind of feature; of the first ``skip`` words alone nothing is made."""
    core, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    two = max(skip - 1, 0)
    kinds = [core[skip:], _pair(core[:-1], core[1:], 1)[two:], shape[skip:] + np.uint64(1 << 40), _pair(shape[:-1], shape[1:], 2)[two:], _pair(_pair(shape[:-2], shape[1:-1], 3), shape[2:], 4)]
    kinds.append((core[1:] == core[:-1]).astype(np.uint64)[two:] + np.uint64(1 << 41))
    kinds.append((core[2:] == core[:-2]).astype(np.uint64) + np.uint64(1 << 42))
    return kinds


#: How many words a feature of each kind spans.
SPANS = (1, 2, 1, 2, 3, 2, 3)


class Featuriser:
    """Features of texts; words' hashes are kept, up to a bound, and looked up many at once."""

    def __init__(self):
        kinds = np.ones(256, np.uint8)
        kinds[[ord(c) for c in " \t\n\x0b\x0c\r"]] = 0
        kinds[0] = WHOLE
        self.units = Units(kinds, self._learn, self._forget, slots=1 << 20)

    def _forget(self) -> None:
        self.both, self.lengths, self.n = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        size = self.n + len(words)
        self.both, self.lengths = grown(self.both, size), grown(self.lengths, size)
        self.both[self.n : size] = np.array([_signs(w) if len(w) <= LONG else 0 for w in words], np.uint64)
        self.lengths[self.n : size] = [len(w) for w in words]
        self.n = size

    def _hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, how many each text has); a long word is cut into words."""
        unit, many = self.units.numbers(texts)
        both, long = self.both[unit], np.flatnonzero(self.lengths[unit] > LONG)
        if len(long):
            ends, parts, at = np.cumsum(many), [], 0
            words = {}
            for k, text in enumerate(texts):
                if np.searchsorted(long, ends[k] - many[k]) < np.searchsorted(long, ends[k]):
                    words[k] = np.array([_signs(w) for w in _words(text)], np.uint64)
            for k in sorted(words):
                parts += [both[at : ends[k] - many[k]], words[k]]
                at = ends[k]
            both, many = np.concatenate([*parts, both[at:]]), many.copy()
            for k, w in words.items():
                many[k] = len(w)
        return both, many

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, values), a place may recur."""
        both = np.concatenate([self._hashes([part])[0] for part in self.units.cut(text or "")] or [np.zeros(0, np.uint64)])
        if not len(both):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        kinds = _kinds(both)
        places = np.concatenate([_mix(k) & MASK for k in kinds]).astype(np.int64)
        values = np.concatenate([np.full(len(k), 1 / max(len(k), 1), np.float32) for k in kinds])
        return places, values

    def summed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct places, values); a very long text is summed part by part."""
        if len(text or "") <= self.units.CHARS:
            places, values = self.features(text)
            own, where = np.unique(places, return_inverse=True)
            return own, np.bincount(where, values, len(own))
        sums, counts, carried = np.zeros((len(SPANS), 1 << BITS)), np.zeros(len(SPANS)), np.zeros(0, np.uint64)
        for part in self.units.cut(text):
            both = np.concatenate((carried, self._hashes([part])[0]))
            for k, kind in enumerate(_kinds(both, len(carried))):
                sums[k] += np.bincount((_mix(kind) & MASK).astype(np.int64), minlength=1 << BITS)
                counts[k] += len(kind)
            carried = both[-2:]
        own = np.flatnonzero(sums.any(0))
        return own, (sums[:, own] / np.maximum(counts, 1)[:, None]).sum(0)

    def products(self, texts: list[str | None], weights: np.ndarray) -> np.ndarray:
        """The dot product of each text's features and the weights, the intercept added."""
        texts = [t or "" for t in texts]
        out = np.empty(len(texts))
        for a, b in batches_of(texts, self.units.CHARS):
            if b - a == 1 and len(texts[a]) > self.units.CHARS:
                out[a] = self._long(texts[a], weights)
                continue
            both, many = self._hashes(texts[a:b])
            doc = np.repeat(np.arange(b - a), many)
            z = np.full(b - a, float(weights[-1]))
            for kind, span in zip(_kinds(both), SPANS, strict=True):
                inside = doc[span - 1 :] == doc[: len(doc) - span + 1] if len(doc) >= span else np.zeros(0, bool)
                own = doc[: len(inside)][inside]
                worth = np.bincount(own, weights[(_mix(kind[inside]) & MASK).astype(np.int64)], b - a)
                z += worth / np.maximum(many - span + 1, 1)
            out[a:b] = z
        return out

    def _long(self, text: str, weights: np.ndarray) -> float:
        """As above for one very long text, part by part; two words are carried from each to the next."""
        sums, counts, carried = np.zeros(len(SPANS)), np.zeros(len(SPANS)), np.zeros(0, np.uint64)
        for part in self.units.cut(text):
            both = np.concatenate((carried, self._hashes([part])[0]))
            for k, kind in enumerate(_kinds(both, len(carried))):
                sums[k] += weights[(_mix(kind) & MASK).astype(np.int64)].sum(dtype=np.float64)
                counts[k] += len(kind)
            carried = both[-2:]
        return float(weights[-1] + (sums / np.maximum(counts, 1)).sum())


def _words(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if any(len(w) > LONG for w in words):
        words = [p for w in words for p in ([w] if len(w) <= LONG else [w[k : k + PIECE] for k in range(0, len(w), PIECE)])]
    return words


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt << 43)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def featuriser() -> Featuriser:
    """The worker's own."""
    return worker_model("quality", Featuriser)


class Ftrl:
    """Follow the regularised leader, per coordinate; the last weight is the intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """``at``: distinct places, the intercept's last."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = more


def train(docs: DataFrame, labels: DataFrame, bound: int = LEARN_DOCS) -> np.ndarray:
    """Weights, the intercept last. ``labels``: (doc_id, quality); at most about ``bound`` rows of them are used."""
    rows = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL")
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    # its size has a bound, that of the sample
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("__id"))
    some = some.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).alias("shard"), F.xxhash64("doc_id", F.lit(2)).alias("turn"), "__y", "text")

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            first, at, x = 0, [], []
            for k, text in enumerate(batch.column(3).to_pylist(), 1):
                own, values = featuriser().summed(text)
                at.append(own.astype(np.int32))
                x.append(values.astype(np.float32))
                if k == batch.num_rows or sum(map(len, at)) > MANY:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, k - first).columns[:3], pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["shard", "turn", "y", "at", "x"])
                    first, at, x = k, [], []

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[0].as_py(), r[1].as_py(), r[2].values, r[3].values) for b in batches for r in zip(b["shard"], b["y"], b["at"], b["x"], strict=True))
        for _, shard in groupby(rows, lambda r: r[0]):
            with tempfile.TemporaryFile() as file:
                taught = []
                for _, y, at, x in shard:
                    file.write(at.to_numpy().tobytes() + x.to_numpy().tobytes())
                    taught.append((len(at), y))
                model = Ftrl(1 << BITS)
                for _ in range(PASSES):
                    file.seek(0)
                    for n, y in taught:
                        at, x = np.frombuffer(file.read(4 * n), np.int32), np.frombuffer(file.read(4 * n), np.float32)
                        model.update(np.append(at, 1 << BITS), np.append(x, 1.0), y)
            w = model.weights()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([len(taught)], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([w[at]], pa.list_(pa.float64()))], names=["docs", "at", "w"])

    some = some.mapInArrow(ready, "shard long, turn long, y int, at array<int>, x array<float>")
    found = some.repartition("shard").sortWithinPartitions("shard", "turn").mapInArrow(fit, "docs long, at array<long>, w array<double>").collect()
    out, total = np.zeros((1 << BITS) + 1), sum(r["docs"] for r in found)
    for r in found:
        out[np.array(r["at"], np.int64)] += np.array(r["w"]) * r["docs"] / total
    return out.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score added last, under the name ``out``."""
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches):
            z = featuriser().products(batch.column(place).to_pylist(), w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def quality_model(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Trained on the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(part_of(F.col("doc_id"), 5) != 0)
    return train(table(spark, sf_dir, "documents"), labels)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(part_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    found = score(rows, quality_model(spark, sf_dir))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
