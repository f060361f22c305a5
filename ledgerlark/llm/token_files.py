"""Token ids in binary files: one shared zstandard dictionary, one frame per document, an offset index per file.

A shard file holds, in ascending order of document ids: the frames one after another; an index of (document id, frame
offset, number of ids) as three little-endian arrays; a footer with the number of documents, the width of an id in
bytes, the SHA-256 of the dictionary, and the format's mark. The dictionary lies beside the shards under its hash. A
reader opens the footer and the index first, and one document costs one short read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions.storage import discard, fresh_path, materialize
from ledgerlark.llm.texts import Memo, held, slices, whole_text
from ledgerlark.llm.token_counts import byte_letters

MARK = b"IDS1"
FOOTER = struct.Struct("<QB32s4s")
#: Ends of words that a byte-level pattern always cuts off as one pre-token: no letter, digit, blank or apostrophe.
TAIL = ".,;:!?#$%&*)|"


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizers file, through memos of the chunks between single spaces.

    The pattern of such files starts a pre-token at every space that stands between two visible characters, so chunks
    can be encoded apart. Letters alone go to the library's model; whatever else, to the whole library."""

    def __init__(self, path: str):
        # Imported here: the library starts threads, which a worker must not inherit.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        top = max(self.library.get_vocab(with_added_tokens=True).values())
        self.kind = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.letters = dict(enumerate(byte_letters()))
        self.spaced = Memo(lambda c: self._compute(c, " ", self.spaced))
        self.bare = Memo(lambda c: self._compute(c, "", self.bare), most=300_000)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _compute(self, chunk: str, lead: str, memo: Memo) -> bytes:
        if chunk.isalpha():
            word = (lead + chunk).encode().decode("latin-1").translate(self.letters)
            return self._pack([t.id for t in self.library.model.tokenize(word)])
        core = chunk.rstrip(TAIL)
        if core != chunk and core.isalpha():
            return memo[core] + self.bare[chunk[len(core) :]]
        first, line, rest = chunk.partition("\n")
        if line and first and rest and not first[-1].isspace() and not rest[0].isspace():
            return memo[first] + self._pack(self.library.encode("\n", add_special_tokens=False).ids) + self.bare[rest]
        return self._pack(self.library.encode(lead + chunk, add_special_tokens=False).ids)

    def encode(self, text: str, blanks=re.compile(r"\s\s").search, cut=re.compile(r"(?<=\S) (?=\S)").split) -> bytes:
        chunks = cut(text) if text[:1].isspace() or text[-1:].isspace() or blanks(text) else text.split(" ")
        head = self.bare[chunks[0]]
        return head + b"".join(map(self.spaced.__getitem__, chunks[1:])) if len(chunks) > 1 else head


def _encoder(path: str) -> ByteEncoder:
    store = held("token files")
    return store.get(path) or store.setdefault(path, ByteEncoder(path))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int, sample_chars: int, size: int) -> bytes:
    """A zstandard dictionary from the serialized ids of at most ``sample_docs`` documents. They are drawn evenly from all
    rows; those of more than ``sample_chars`` characters are left out, as the dictionary serves short ones. Their ids,
    bounded by both parameters, come to the driver, which trains on them. Empty if the sample is too small to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer)
        end = coder._pack([end_id])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([coder.encode(t) + end for t in batch.column("text").to_pylist()], pa.binary())], names=["ids"])

    n = docs.count()
    drawn = docs.sample(sample_docs / n, seed=1) if n > sample_docs else docs
    short = drawn.select("text").filter(F.length("text") <= sample_chars)
    samples = [bytes(r.ids) for r in short.mapInArrow(run, "ids binary").collect()][:sample_docs]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(trained: bytes, level: int) -> zstandard.ZstdCompressor:
    if not trained:
        return zstandard.ZstdCompressor(level=level)
    shared = zstandard.ZstdCompressionDict(trained)
    shared.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=shared)


def write_token_files(
    docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 0, sample_docs: int = 1000, sample_chars: int = 16 << 10, dict_bytes: int = 64 << 10,
    level: int = 1, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes shard files into ``out_dir``; returns the manifest, one row per
    shard: ``shard`` (in order of ids), ``path``, ``n_docs``, ``n_ids``, ``dictionary`` (path, empty if none).

    Ids ascend through the shards in order; a null id comes first, and rows with one id follow in the order of their
    frames. A null text is an empty one and holds the end id only. An empty table gives an empty manifest. The encoded
    frames are written once, then shuffled (they, not the texts) by ranges of ids; a shard is written by one task under
    a name of its own attempt, and only the manifest says which files count, so lost executors leave no half shard.
    """
    spark = docs.sparkSession
    texts = whole_text(docs, id_col, text_col)
    trained = train_dictionary(texts, tokenizer, end_id, sample_docs, sample_chars, dict_bytes)
    digest = hashlib.sha256(trained).digest()
    dictionary = f"{out_dir}/{digest.hex()}.dict" if trained else ""
    spark.sparkContext.parallelize([out_dir], 1).foreach(lambda d: _store(d)[0].create_dir(_store(d)[1], recursive=True))
    if trained:
        _put(dictionary, trained)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = _encoder(tokenizer), _compressor(trained, level)
        end = coder._pack([end_id])
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [coder.encode(t) + end for t in batch.column("text").to_pylist()]
                counts = pa.array([len(x) // coder.kind.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array([packer.compress(x) for x in ids], pa.binary())], names=["doc_id", "n", "frame"])

    width = _encoder(tokenizer).kind.itemsize
    frames = materialize(texts.mapInArrow(encode, "doc_id long, n long, frame binary"), "frames")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = max(12, -(-total // shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{out_dir}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        ids, sizes, counts, out = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, place = _store(path)
                out = store.open_output_stream(place)
            frames = batch.column("frame")
            out.write(b"".join(frames.to_pylist()))
            ids.append(batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            sizes.append(pc.binary_length(frames).to_numpy(zero_copy_only=False))
            counts.append(batch.column("n").to_numpy(zero_copy_only=False))
        if out is None:
            return
        ids, sizes, counts = np.concatenate(ids), np.concatenate(sizes).astype("<u8"), np.concatenate(counts)
        out.write(ids.astype("<i8").tobytes() + np.r_[np.uint64(0), np.cumsum(sizes)].astype("<u8").tobytes() + counts.astype("<u4").tobytes())
        out.write(_footer(len(ids), width, digest))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([dictionary])],
            names=["shard", "path", "n_docs", "n_ids", "dictionary"],
        )

    ordered = frames.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame")
    manifest = materialize(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_ids long, dictionary string"), "manifest")
    discard(frames)
    return manifest


def _footer(n_docs: int, width: int, digest: bytes) -> bytes:
    return FOOTER.pack(n_docs, width, digest, MARK)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, local or remote, and the path there."""
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", uri) else uri)


def _put(path: str, data: bytes) -> None:
    store, place = _store(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as f:
        f.write(data)


class ShardReader:
    """One shard file: the index in memory, frames read as asked for."""

    def __init__(self, path: str, dictionary: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        n, width, digest, mark = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        trained = b""
        if dictionary:
            store, place = _store(dictionary)
            with store.open_input_stream(place) as f:
                trained = f.read()
        if mark != MARK or hashlib.sha256(trained).digest() != digest:
            raise ValueError(f"{path}: not a shard of this dictionary")
        self.kind = np.dtype(f"<u{width}")
        index = self.file.read_at(20 * n + 8, size - FOOTER.size - 20 * n - 8)
        self.ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u4", n, 16 * n + 8)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None).decompress

    def all(self, step: int = 4 << 20) -> Iterator[np.ndarray]:
        """Ids of each document in turn; about ``step`` bytes of frames are read at a time."""
        at = 0
        while at < len(self.ids):
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + step, "right")) - 1)
            block = self.file.read_at(int(self.offsets[to] - self.offsets[at]), int(self.offsets[at]))
            for i in range(at, to):
                a, b = (int(x - self.offsets[at]) for x in self.offsets[i : i + 2])
                yield np.frombuffer(self.unpack(block[a:b]), self.kind)
            at = to

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents with this id: a search in the index and one read for each."""
        a, b = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return [np.frombuffer(self.unpack(self.file.read_at(int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i]))), self.kind) for i in range(a, b)]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads shards back: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (of the ids
    as little-endian 32-bit integers). One task per shard; only sums of shards are ordered in one place."""
    shards = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).repartition(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["path", "dictionary", "start"]).to_pylist():
                shard = ShardReader(row["path"], row["dictionary"])
                sums = np.fromiter((zlib.crc32(x.astype("<u4")) for x in shard.all()), np.int64, len(shard.ids))
                counts = shard.counts.astype(np.int64)
                ids = pa.array(shard.ids, mask=shard.ids == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["start"] + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes all documents into fresh shards in the shared folder, and reads them back."""
    return read_token_files(write_token_files(docs, tokenizer, fresh_path(spark, "token-files")))
