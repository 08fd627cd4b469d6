"""Operator 1: token ids as seekable zstandard shards.

File format of a shard: one independent zstandard frame per document (a document of more than
``FRAME_IDS`` ids takes several), a skippable frame with the document index, and as the file's end a
skippable frame with the seek table: for each frame its compressed size, its size and the low 32
bits of the XXH64 of its content. Frames carry zstandard's own content checksum too. A reader takes
the table and the index from the end, then fetches and decompresses the frames of the documents it
was asked for and no others.

Ids are little-endian unsigned 16-bit integers where the vocabulary allows, else 32-bit.

Shards are written by attempt-unique names and count only once the manifest, a Parquet table that
Spark commits atomically, lists them; a lost or repeated task leaves at most an unlisted file.

Null and empty texts give the end id alone. A very long text is encoded in parts that end at a space. Rows
repeated or with equal ids are written each, ordered by id and a hash of their token ids; null ids come first.
Other columns of the input are ignored, whatever their names. An empty table gives an empty manifest.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, open_store, release, slices, stage, worker_model
from .units import WHOLE, Units, grown

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 20
SHARD_BYTES = 64 << 20
SHARD_DOCS = 1 << 18
MOST_TASKS = 20_000
#: Kinds of a character: of a run of letters, of another run.
LETTERS, OTHERS = 1, 2
ENCODED = "doc_id long, n long, ids binary"
MANIFEST = "part int, seq int, file string, first_id long, docs long, ids long, bytes long"


class ShardWriter:
    """Writes one shard to an open binary file."""

    def __init__(self, sink, width: int, level: int = 1):
        self.sink, self.dtype = sink, np.dtype("<u2" if width == 2 else "<u4")
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[bytes] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.size = self.ids = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """``raw``: the document's ids, already in the file's width."""
        step, first = FRAME_IDS * self.dtype.itemsize, len(self.table)
        for at in range(0, max(len(raw), 1), step):
            part = raw[at : at + step]
            packed = self.zip.compress(part)
            self.sink.write(packed)
            self.size += len(packed)
            self.table.append(struct.pack("<III", len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        n = len(raw) // self.dtype.itemsize
        self.ids += n
        self.docs.append((doc_id, first, len(self.table) - first, n))

    def close(self) -> None:
        ids = np.array([d[0] or 0 for d in self.docs], "<i8")
        valid = np.array([d[0] is not None for d in self.docs], "u1")
        first, frames, n = (np.array([d[k] for d in self.docs], t) for k, t in ((1, "<u4"), (2, "<u4"), (3, "<u8")))
        index = struct.pack("<IB", len(self.docs), self.dtype.itemsize) + b"".join(x.tobytes() for x in (ids, n, first, frames, valid))
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append(struct.pack("<III", len(index) + 8, 0, 0))
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.size += len(index) + len(table) + 16
        self.sink.close()


class ShardReader:
    """Random access to the documents of one shard (a seekable binary file)."""

    def __init__(self, source, size: int):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token shard: its seek table is missing")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        source.seek(int(self.at[n - 1]) + 8)
        index = source.read(int(self.table[n - 1, 0]) - 8)
        docs, width = struct.unpack_from("<IB", index)
        self.dtype, at = np.dtype("<u2" if width == 2 else "<u4"), 5
        cols = []
        for kind in ("<i8", "<u8", "<u4", "<u4", "u1"):
            cols.append(np.frombuffer(index, kind, docs, at))
            at += docs * np.dtype(kind).itemsize
        self.doc_ids, self.n_ids, self.first, self.frames, self.valid = cols

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document; only its own frames are read and decompressed."""
        first, last = int(self.first[k]), int(self.first[k] + self.frames[k])
        self.source.seek(int(self.at[first]))
        packed, out = self.source.read(int(self.at[last] - self.at[first])), []
        for f in range(first, last):
            at = int(self.at[f] - self.at[first])
            part = self.unzip.decompress(packed[at : at + int(self.table[f, 0])], max_output_size=int(self.table[f, 1]))
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != int(self.table[f, 2]):
                raise ValueError(f"frame {f}: its checksum is wrong")
            out.append(part)
        return np.frombuffer(b"".join(out), self.dtype)

    def find(self, doc_id: int) -> np.ndarray:
        hits = np.flatnonzero((self.doc_ids == doc_id) & (self.valid == 1))
        if not len(hits):
            raise KeyError(doc_id)
        return self.ids(int(hits[0]))


class ChunkEncoder:
    """Encodes whole texts with a ``tokenizers`` model that splits at white space and drops it.

    No match of such a model's split pattern holds white space, and neither its normaliser nor its
    merges look across it, so the ids of a text are those of its space-separated chunks, in order. In
    a chunk of Latin-1 characters without apostrophe every run of letters is a match of its own as
    well, and lower-casing first changes nothing, so it is cut further into runs of letters and of
    others. These are looked up many at once (``units``); those seen first go to the model. ``SLOTS`` and
    ``POOL`` bound what is kept: beyond them all is forgotten. Strings of the model's added tokens are cut out
    first and are their ids, as the library has it.
    """

    SLOTS, POOL, LONGEST, AT_ONCE, CHARS = 1 << 20, 1 << 22, 48, 2048, 1 << 20
    BETWEEN = "\x01"

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end_id = end_id
        added = {t.content: k for k, t in self.model.get_added_tokens_decoder().items()}
        self.added = {t: np.array([k], self.dtype) for t, k in added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        latin = [chr(c) for c in range(256)]
        lower = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in latin], np.uint8)
        kinds = np.where([c.isalpha() for c in latin], LETTERS, OTHERS).astype(np.uint8)
        kinds[[ord(c) for c in " \t\n\r"]] = 0
        kinds[[0, ord("'")]] = WHOLE
        cut = self._ids(self.BETWEEN)
        self.between = cut[0] if len(cut) == 1 else None
        self.units = Units(kinds, self._learn, self._forget, lower, self.SLOTS)
        self.units.CHARS = self.CHARS

    def _forget(self) -> None:
        self.first, self.count, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.pool, self.used = np.zeros(1 << 14, self.dtype), 0

    def _ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as bytes of the file's width."""
        ids, counts = self.encode_all(texts)
        raw, ends = ids.tobytes(), (np.cumsum(counts) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and how many each has."""
        out, counts = [], np.ones(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            if held:
                ids, n = self._encoded(held)
                np.add.at(counts, owner, n)
                out.append(ids)
                held.clear()
                owner.clear()
                chars = 0

        for k, text in enumerate(texts):
            text = text or ""
            pieces = self.cut_added(text) if self.cut_added and "<|" in text else (text,)
            for j, piece in enumerate(pieces):
                if j % 2:
                    flush()
                    out.append(self.added[piece])
                    counts[k] += 1
                    continue
                for part in self.units.cut(piece):
                    held.append(part)
                    owner.append(k)
                    chars += len(part)
                    if chars >= self.CHARS:
                        flush()
        flush()
        every = np.concatenate(out) if out else np.zeros(0, self.dtype)
        return np.insert(every, np.cumsum(counts - 1), self.end_id), counts

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has), without end ids."""
        if self.used > self.POOL:
            self.units.forget()
        unit, many = self.units.numbers(texts)
        n, first = self.count[unit], self.first[unit]
        after = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(first - after[:-1], n) + np.arange(after[-1])]
        return ids, np.diff(after[np.cumsum(many)], prepend=0)

    def _learn(self, units: list[str]) -> None:
        """Puts the ids of new units into the pool.

        Many units go to the model as one text, which is cut again at the id of a character that none of them holds.
        """
        plain, odd, ids, n = [], [], [], np.zeros(len(units), np.int64)
        for k, u in enumerate(units):
            (plain if self.between is not None and len(u) <= self.LONGEST and self.BETWEEN not in u else odd).append(k)
        for at in range(0, len(plain), self.AT_ONCE):
            part = plain[at : at + self.AT_ONCE]
            some = np.array(self._ids(f" {self.BETWEEN} ".join([units[k] for k in part])), self.dtype)
            cuts = np.flatnonzero(some == self.between)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not keep words apart at spaces")
            n[part] = np.diff(np.concatenate(([-1], cuts, [len(some)]))) - 1
            ids.append(np.delete(some, cuts))
        for k in odd:
            ids.append(np.array(self._ids(units[k]), self.dtype))
            n[k] = len(ids[-1])
        every, order = np.concatenate(ids), np.array(plain + odd, np.int64)
        self.first, self.count = grown(self.first, self.n + len(units)), grown(self.count, self.n + len(units))
        self.pool = grown(self.pool, self.used + len(every))
        numbers = np.arange(self.n, self.n + len(units))
        self.count[numbers] = n
        self.first[numbers[order]] = self.used + np.cumsum(n[order]) - n[order]
        self.pool[self.used : self.used + len(every)] = every
        self.n, self.used = self.n + len(units), self.used + len(every)


def encode_documents(docs: DataFrame, encoder: Callable[[], ChunkEncoder], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids) of every row, staged: the ids in the file's width, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(encoder)
        for batch in slices(batches, 512):
            raw = model.encode(batch.column(1).to_pylist())
            n = [len(r) // model.width for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "n", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(run, ENCODED), "ids", "zstd")


def write_token_files(docs: DataFrame, out: str, encoder: Callable[[], ChunkEncoder], doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` and write shards below ``out`` in ascending id order; returns the manifest.

    Texts are encoded where they are read; what is sorted and shuffled is their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), []
        store, base = open_store(out)
        writer = name = None

        def close():
            writer.close()
            made.append({"part": part, "seq": len(made), "file": name, "first_id": writer.docs[0][0], "docs": len(writer.docs), "ids": writer.ids, "bytes": writer.size})

        for some in slices(batches, 512):
            for key, n, raw in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if writer is None:
                    name = f"part-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.tok.zst"
                    store.create_dir(f"{base}/data", recursive=True)
                    writer = ShardWriter(store.open_output_stream(f"{base}/data/{name}", compression=None), len(raw) // n)
                writer.add(key, raw)
                if writer.size >= shard_bytes or len(writer.docs) >= SHARD_DOCS:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=_ARROW_MANIFEST)

    spark = docs.sparkSession
    rows = encode_documents(docs, encoder, doc_id, text)
    # ties are told apart, so that rows that share an id can be cut into ranges too
    order = ["doc_id", "tie", "row"]
    tied = rows.withColumns({"tie": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    tied.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids").mapInArrow(run, MANIFEST).write.parquet(f"{out}/manifest")
    release(rows)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


_ARROW_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("first_id", "docs", "ids", "bytes"))])


def _encoder(make: Callable[[], ChunkEncoder]) -> ChunkEncoder:
    """The worker's own, whatever the number of its tasks."""
    key = getattr(make, "key", None)
    return make() if key is None else worker_model(("tokens", key), make)


class encoder_of:
    """A picklable maker of a ``ChunkEncoder``."""

    def __init__(self, path: str, end_id: int):
        self.key = (path, end_id)

    def __call__(self) -> ChunkEncoder:
        return ChunkEncoder(*self.key)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Read every document back: (doc_id, start, n_tokens, ids_crc32, ids as little-endian binary).

    ``start`` counts the ids of all documents before it: each part's and shard's offset comes from
    sums over the manifest, not from the documents.
    """
    return _read(spark, out, DIGEST + ", ids binary", True)


def digest_token_files(spark: SparkSession, out: str) -> DataFrame:
    """As ``read_token_files``, without the ids."""
    return _read(spark, out, DIGEST, False)


def _read(spark: SparkSession, out: str, schema: str, with_ids: bool) -> DataFrame:
    shards = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(W.orderBy("part")).alias("part_start"))
    starts = shards.withColumn("in_part", before(W.partitionBy("part").orderBy("seq"))).join(parts, "part")
    starts = starts.select("file", "bytes", (F.col("part_start") + F.col("in_part")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(out)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/data/{row['file']}") as source:
                    shard, at, rows, held = ShardReader(source, row["bytes"]), row["start"], [], 0
                    for k in range(len(shard)):
                        ids = shard.ids(k).astype("<u4").tobytes()
                        one = (int(shard.doc_ids[k]) if shard.valid[k] else None, at, len(ids) // 4, zlib.crc32(ids))
                        rows.append((*one, ids) if with_ids else one)
                        at, held = at + len(ids) // 4, held + len(ids) * with_ids
                        if len(rows) == 4096 or held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds, strict=True)], names=names)

    return starts.repartition(max(1, min(starts.count(), MOST_TASKS)), "file").mapInArrow(run, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    out = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), out, encoder_of(public_tokenizers.path("word_bpe_49k.json"), 1))
    return digest_token_files(spark, out)
