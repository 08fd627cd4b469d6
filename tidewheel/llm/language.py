"""Operator 9: language identification with hyperdimensional profiles.

A letter has a random vector of signs; a trigram's vector is the product of its letters' vectors,
the second rotated by one place and the third by two (binding of permuted vectors); a text's vector
is the sum over all its trigrams (bundling), and a language's the sum of its learning texts' unit
vectors. A text has the language of the largest cosine, which is its score (below 0: 0).

Text is lower-cased; each run of characters other than letters is one boundary, a letter of its own,
and so are both ends. The letters a-z have a vector each, all other letters share ``LETTERS`` - 27
vectors by a hash of the code point, which bounds the number of trigrams.

A very long text is one text: its trigrams are counted before vectors are made of them. The cosine grows
with a text's length, so ``in_languages`` rejects by the dot product for each trigram, which does not.

Text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be
learned. Learning takes at most about ``LEARN_DOCS`` rows, dealt by a hash of the id up to one bound
for each language, so that rare ones are learned too; a language gives ``LEAST_DOCS`` rows at least,
if it has them, however many languages there are. Rows of null lang, null id or no letter teach
nothing. Equal cosines go to the smaller language name. Repeated
rows and other columns make no difference to a row's result; what is added takes the names it is told. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, worker_model

SIZE, LETTERS, SEED, LEARN_DOCS, LEAST_DOCS, ROWS, BLOCK, CHARS = 1024, 128, 20240229, 12_000, 100, 256, 4096, 2_000_000
#: Likeness a trigram: letters by chance give 0 with a deviation of 1 over the root of their number, clean texts 1 to 3.
LEAST_LIKENESS = 0.5


class Profiler:
    """Turns texts into hyperdimensional vectors, a batch at a time."""

    def __init__(self, size: int = SIZE):
        signs = np.random.default_rng(SEED).integers(0, 2, (LETTERS, size), np.int8) * 2 - 1
        self.size, self.first, self.second, self.third = size, signs, np.roll(signs, 1, 1), np.roll(signs, 2, 1)
        points = np.arange(0x110000, dtype=np.uint64)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.slot = np.where(letter, 27 + ((points * 2654435761 >> 11) % (LETTERS - 27)), 0).astype(np.uint8)
        self.slot[97:123] = np.arange(1, 27)

    def letters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        slots = np.concatenate(([0], self.slot[points], [0])).astype(np.uint8)
        return slots[np.concatenate(([True], (slots[1:] != 0) | (slots[:-1] != 0)))]

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, trigrams; none where the text has no letter), a row a text."""
        out, sizes = np.zeros((len(texts), self.size), np.float32), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # as many texts at once as their length allows
            end, chars = at, 0
            while end < len(texts) and end - at < ROWS and (end == at or chars + len(texts[end] or "") <= CHARS):
                chars, end = chars + len(texts[end] or ""), end + 1
            codes, row = [], []
            for k in range(at, end):
                s = self.letters(texts[k] or "")
                if s.any():
                    sizes[k] = len(s) - 2
                    s = s.astype(np.int32)
                    codes.append((s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:])
                    row.append(np.full(len(codes[-1]), k - at, np.int64))
            if codes:
                out[at:end] = self._bundle(np.concatenate(codes), np.concatenate(row), end - at)
            at = end
        return out, sizes

    def _bundle(self, codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        seen = np.zeros(LETTERS**3, bool)
        seen[codes] = True
        used = np.flatnonzero(seen)
        place = np.zeros(LETTERS**3, np.int32)
        place[used] = np.arange(len(used))
        cells = np.bincount(place[codes] + row * len(used), minlength=rows * len(used)).astype(np.float32).reshape(rows, len(used)) if rows * len(used) <= 1 << 23 else None
        out = np.zeros((rows, self.size), np.float32)
        for k in range(0, len(used), BLOCK):
            part = used[k : k + BLOCK]
            bound = self.first[part >> 14] * self.second[(part >> 7) & 127] * self.third[part & 127]
            if cells is None:
                mine = (place[codes] >= k) & (place[codes] < k + BLOCK)
                count = np.bincount(place[codes[mine]] - k + row[mine] * len(part), minlength=rows * len(part)).astype(np.float32).reshape(rows, len(part))
            else:
                count = cells[:, k : k + BLOCK]
            out += count @ bound.astype(np.float32)
        return out


def profiler() -> Profiler:
    """The worker's own."""
    return worker_model("language", Profiler)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _share(counts: list[int], bound: int) -> int:
    """The most rows a language may give so that all give ``bound`` at most, but ``LEAST_DOCS`` at least."""
    left = bound
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(LEAST_DOCS, left // (len(counts) - k))
        left -= n
    return max(LEAST_DOCS, *counts)


def learn(docs: DataFrame, bound: int = LEARN_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes from about ``bound`` of the rows at most; what reaches the driver is a vector a language."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = [r["n"] for r in counts.collect()]  # one number a language, as are the prototypes
    if sum(sizes) > bound:
        rows = rows.join(F.broadcast(counts), "lang")
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double") * F.col("n") < float(_share(sizes, bound) << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            vectors, sizes = profiler().vectors(batch.column(0).to_pylist())
            some, names = sizes > 0, np.array(batch.column(1).to_pylist(), object)
            for name in set(names[some]):
                part = _unit(vectors[some & (names == name)]).sum(0, dtype=np.float64)
                sums[name] = sums[name] + part if name in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).select("lang", "v.x").collect()
    return {r["lang"]: _unit(np.array([r["x"]]))[0].astype(np.float32) for r in sorted(whole, key=lambda r: r["lang"])}


def _judged(model: dict[str, np.ndarray]):
    """Of texts: (place of the language, the last for none; its cosine; its likeness for each trigram)."""
    weights = np.array(list(model.values()), np.float32).reshape(len(model), SIZE).T

    def judge(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors, sizes = profiler().vectors(texts)
        best, score, each = np.full(len(texts), len(model)), np.zeros(len(texts)), np.zeros(len(texts))
        if len(model):
            like = vectors @ weights
            norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
            best = np.where(sizes > 0, (like / norm[:, None]).argmax(1), len(model))
            score = np.where(sizes > 0, np.clip(like.max(1) / norm, 0, 1), 0)
            each = np.where(sizes > 0, like.max(1) / np.maximum(sizes, 1), 0)
        return best, score, each

    return judge


def predict(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", out: str = "lang_pred", rate: str = "score") -> DataFrame:
    """``docs`` with the language and its cosine added last, under the names ``out`` and ``rate``."""
    names, judge = np.array([*model, "und"], object), _judged(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType()), T.StructField(rate, T.DoubleType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, score, _ = judge(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, out, rate])

    return docs.mapInArrow(run, schema)


def in_languages(docs: DataFrame, model: dict[str, np.ndarray], languages: tuple[str, ...] | None = None, least: float = LEAST_LIKENESS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are written in one of ``languages`` (all that are learned, if none are named).

    A text goes if it is ``und``, if its language is another one, or if it is like no learned language:
    its likeness to its own for each trigram is below ``least``.
    """
    wanted, judge = np.array([languages is None or n in languages for n in model] + [False]), _judged(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, _, each = judge(batch.column(place).to_pylist())
            yield batch.filter(pa.array(wanted[best] & (each >= least)))

    return docs.mapInArrow(run, docs.schema)


def part_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def language_model(docs: DataFrame) -> dict[str, np.ndarray]:
    """Learned from the documents that are not held out."""
    return learn(docs.filter(part_of(F.col("doc_id"), 3) != 1))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(part_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return predict(rows, language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")
