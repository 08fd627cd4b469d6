"""Operator 3: byte-level BPE encoding and decoding with DuckDB queries inside each partition.

A rank file gives the rank of each token; tokens are their ranks. Texts are cut into the matches of a
pattern, and each distinct match (word) is encoded on its own: if it is a token, as that; else its
bytes are rows (word, position, token) of a recursive query, in which each step joins neighbours with
the merge table, contracts every word's leftmost pair of least rank and ends for a word when no pair
of it is in the table. The merge table holds every way to cut a token into two tokens. Words recur: each
worker keeps their ids, up to a bound, and finds the matches of the common pattern ``SPLIT`` and their
ids by arrays (``units``).

A recursive query keeps the rows of all steps, which grow with the square of a word's length, so
words are dealt to queries by that measure, ``WORD_ROWS`` rows at most. A word that alone has more (of
over some 2,400 bytes: of 100,000 bytes it would be 80 GB) is contracted by the same rule, the leftmost
pair of least rank first, with a heap of its pairs.

Ids are decoded by joining (document, position, id) with the vocabulary and an ordered aggregation.

Null text counts as empty, and has no ids. Very long texts are taken whole. Rows come back one for one:
repeated rows, equal ids and other columns make no difference to a row's result, and an empty table gives
an empty one. Ids outside the vocabulary cannot be decoded and raise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_model
from .units import WHOLE, Units, batches_of, characters, grown

WORD_ROWS, SLOTS, POOL, DOC_IDS, DOCS = 3_000_000, 1 << 22, 1 << 23, 500_000, 512
# The pattern whose matches are found by arrays, and white space beyond Latin-1.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDE_SPACES = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Kinds of a character.
LETTERS, NUMBERS, SIGNS, SPACES = 1, 2, 3, 4
BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

ENCODE = """
WITH RECURSIVE steps(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM words
  UNION ALL
  (WITH best AS (
     SELECT a.word, min((m.tok::BIGINT << 16) + a.pos) AS pair
     FROM steps a JOIN steps b ON b.word = a.word AND b.pos = a.pos + 1
     JOIN merges m ON m.first = a.tok AND m.second = b.tok
     GROUP BY a.word)
   SELECT s.word,
          CASE WHEN pos > pair & 65535 THEN pos - 1 ELSE pos END,
          CASE WHEN pos = pair & 65535 THEN (pair >> 16)::INTEGER ELSE tok END,
          step + 1
   FROM steps s JOIN best USING (word)
   WHERE pos <> (pair & 65535) + 1))
SELECT word, list(tok ORDER BY pos) AS ids
FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step)
GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY pos) AS text, count(*) AS n
FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class BytePairs:
    """A vocabulary of ranks, with DuckDB tables of it."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        self.words = regex.compile(pattern).findall
        splits = [(self.ranks.get(t[:k]), self.ranks.get(t[k:]), n) for t, n in self.ranks.items() for k in range(1, len(t))]
        splits = [s for s in splits if s[0] is not None and s[1] is not None]
        self.merges = {s[:2]: s[2] for s in splits}
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        rows = pa.table([pa.array(c, pa.int32()) for c in zip(*splits, strict=True)], names=["first", "second", "tok"])
        self._query("CREATE TABLE merges AS SELECT * FROM given", rows)
        rows = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})
        self._query("CREATE TABLE vocabulary AS SELECT * FROM given", rows)
        latin = [chr(c) for c in range(256)]
        classes = ((LETTERS, r"\p{L}"), (NUMBERS, r"\p{N}"), (SPACES, r"\s"))
        kinds = np.array([next((k for k, p in classes if regex.match(p, c)), SIGNS) for c in latin], np.uint8)
        kinds[[0, ord("'")]] = WHOLE
        if pattern != SPLIT:  # another pattern: texts are units as a whole
            kinds[:] = WHOLE
        self.kinds = kinds
        self.units = Units(kinds, self._learn, self._forget, slots=SLOTS)

    def _query(self, sql: str, rows: pa.Table, name: str = "given"):
        self.db.register(name, rows)
        try:
            found = self.db.execute(sql)
            return found.fetchall() if sql.lstrip().startswith(("WITH", "SELECT")) else None
        finally:
            self.db.unregister(name)

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of some distinct words of at most 65,535 bytes, by the recursive query."""
        if not words:
            return []
        n = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        return [ids for _, ids in self._query(ENCODE, pa.table({"word": word, "pos": pos, "tok": tok}), "words")]

    def contract_long(self, word: bytes) -> list[int]:
        """The same contraction of one word with a heap of pairs: (rank, position) order, leftmost first."""
        toks, n = self.byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(get((toks[k], toks[k + 1])), k, toks[k], toks[k + 1]) for k in range(n - 1) if (toks[k], toks[k + 1]) in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if toks[k] != a or nxt >= n or toks[nxt] != b:
                continue
            toks[k], toks[nxt], after[k] = rank, -1, after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (more := get((toks[left], toks[right]))) is not None:
                    heapq.heappush(heap, (more, left, toks[left], toks[right]))
        return [t for t in toks if t >= 0]

    def _word_ids(self, words: set[str]) -> dict[str, np.ndarray]:
        """The ids of distinct matches of the pattern."""
        made, part, rows = {}, [], 0

        def contract() -> None:
            for (word, _), ids in zip(part, self.contract([raw for _, raw in part]), strict=True):
                made[word] = np.array(ids, np.int32)
            part.clear()

        for word in words:
            raw = word.encode()
            if raw in self.ranks:
                made[word] = np.array([self.ranks[raw]], np.int32)
            elif (own := len(raw) * (len(raw) + 1) // 2) > WORD_ROWS:
                made[word] = np.array(self.contract_long(raw), np.int32)
            else:
                if rows + own > WORD_ROWS:
                    contract()
                    rows = 0
                part.append((word, raw))
                rows += own
        contract()
        return made

    def _learn(self, units: list[str]) -> None:
        """Puts the ids of new units, which are one match or, where they were not cut, several, into the pool."""
        split = [self.words(u) for u in units]
        made = self._word_ids(set(chain.from_iterable(split)))
        rows = [made[words[0]] if len(words) == 1 else np.concatenate([made[w] for w in words]) for words in split]
        n = np.array([len(r) for r in rows], np.int64)
        every = np.concatenate(rows)
        self.first, self.count = grown(self.first, self.n + len(n)), grown(self.count, self.n + len(n))
        self.pool = grown(self.pool, self.used + len(every))
        self.first[self.n : self.n + len(n)], self.count[self.n : self.n + len(n)] = self.used + np.cumsum(n) - n, n
        self.pool[self.used : self.used + len(every)] = every
        self.n, self.used = self.n + len(n), self.used + len(every)

    def _forget(self) -> None:
        self.first, self.count, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.pool, self.used = np.zeros(1 << 14, np.int32), 0

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the units of all texts, how many each has): matches of ``SPLIT``, found by arrays.

        A run of letters, of numbers or of other signs takes a space before it along; of white space before
        something else the last character stands alone. Chunks with an apostrophe or a character beyond
        Latin-1 are units as a whole, and so are texts with other white space.
        """
        whole = "\n".join(texts) + "\n"
        plain, points = characters(whole)
        kinds = self.kinds[plain]
        ends = np.cumsum([len(t) + 1 for t in texts])
        kinds[ends - 1] = 0
        if (odd := np.flatnonzero(kinds == WHOLE)).size:
            breaks = np.flatnonzero((kinds == 0) | (kinds == SPACES))
            at = np.unique(np.searchsorted(breaks, odd))
            change = np.zeros(len(kinds) + 1, np.int8)
            change[np.where(at > 0, breaks[at - 1] + 1, 0)] += 1
            change[breaks[at]] -= 1
            kinds[np.cumsum(change[:-1], dtype=np.int8) > 0] = WHOLE
        if points is not None:
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(points, WIDE_SPACES)), "right")):
                kinds[(ends[k - 1] if k else 0) : ends[k] - 1] = WHOLE
        starts = np.concatenate(([True], kinds[1:] != kinds[:-1]))
        last = np.flatnonzero((kinds[:-1] == SPACES) & (kinds[1:] != SPACES) & (kinds[1:] != 0))
        starts[last] = True
        starts[last[plain[last] == 32] + 1] = False
        bounds = np.append(np.flatnonzero(starts), len(kinds))
        own = kinds[bounds[1:] - 1]
        start, size, own = (x[own > 0] for x in (bounds[:-1], np.diff(bounds), own))
        return self.units.look_up(whole, plain, start, size, own), np.diff(np.searchsorted(start, ends), prepend=0)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner, many = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            at = 0
            while text and at < len(text):  # a long text is cut before a space between plain letters
                m = BETWEEN_WORDS.search(text, at + self.units.CHARS)
                end = m.start() if m else len(text)
                parts.append(text[at:end])
                owner.append(k)
                at = end
        out = []
        for a, b in batches_of(parts, self.units.CHARS):
            if self.used > POOL:
                self.units.forget()
            unit, units = self._units(parts[a:b])
            n, first = self.count[unit], self.first[unit]
            after = np.concatenate(([0], np.cumsum(n)))
            out.append(self.pool[np.repeat(first - after[:-1], n) + np.arange(after[-1])].astype("<i4"))
            np.add.at(many, owner[a:b], np.diff(after[np.cumsum(units)], prepend=0))
        every = np.concatenate(out) if out else np.zeros(0, "<i4")
        return np.split(every, np.cumsum(many)[:-1]) if len(texts) else []

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out, at = [b""] * len(ids), 0
        while at < len(ids):
            end, n = at, 0
            while end < len(ids) and (end == at or n + len(ids[end]) <= DOC_IDS):
                n, end = n + len(ids[end]), end + 1
            sizes = np.array([len(x) for x in ids[at:end]])
            pos = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            rows = pa.table({"doc": np.repeat(np.arange(at, end, dtype=np.int32), sizes), "pos": pos, "id": np.concatenate([np.asarray(x, np.int32) for x in ids[at:end]])})
            known = 0
            for doc, text, found in self._query(DECODE, rows, "ids"):
                out[doc] = text.encode("latin-1")
                known += found
            if known != len(pos):
                raise ValueError("an id is not in the vocabulary")
            at = end
        return out


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The worker's own."""
    return worker_model(("bpe", path, pattern), lambda: BytePairs(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids = byte_pairs(path, pattern).encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text binary) of every row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids = [np.array([] if x is None else x, np.int32) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(byte_pairs(path, pattern).decode(ids), pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256), one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(path, pattern)
        names = np.array([b"%d" % k for k in range(max(model.ranks.values()) + 1)], object)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in _parts(batches):
            ids = model.encode(part.column(1).to_pylist())
            text = [sha(x) for x in model.decode(ids)]
            cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(b" ".join(names[x].tolist())) for x in ids]), pa.array(text)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            yield batch.slice(at, DOCS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
