"""Importance resampling towards a target distribution by hashed n-gram features.

The texts of a batch are joined with sentinels, one pass of a pattern finds all words and sentinels, and a search among
the sentinels' offsets gives each word's document, which tells the runs of words that stay inside one document. A run's checksum comes from those of its
words, since appending bytes to a checksum is linear; buckets are then counted for the whole batch at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize
from ledgerlark.llm.texts import slices, whole_text
from ledgerlark.llm.words import SENTINEL, WORD_OR_SENTINEL, blocks, joined

BUCKETS = 10_000
#: Text bytes that are joined at once; one longer text goes alone.
BATCH = 4 << 20


def _powers() -> list[np.ndarray]:
    """For each i, what 2^i appended zero bytes make of a checksum's state, as four tables by byte. The state is a vector of
    bits, so appending is linear, and twice as many bytes are the same map applied twice."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    unit = np.arange(256, dtype=np.uint32)
    tables = [one, *(unit << np.uint32(8 * j) >> np.uint32(8) for j in (1, 2, 3))]
    found = [np.stack(tables)]
    for _ in range(40):
        found.append(np.stack([_mapped(found[-1], found[-1][j]) for j in range(4)]))
    return found


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_powers())
    return _TABLES


def appended(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums (CRC-32) of concatenations, from those of both parts and the lengths of the second ones."""
    state = first.copy()
    for bit in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length & (1 << bit))
        state[at] = _mapped(_tables()[bit], state[at])
    return state ^ second


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each word, document of each feature, bucket of each feature), by stretches of the joined texts. A feature
    is counted where its last word stands; the last two words of a stretch are carried into the next one."""
    crc, size, doc = np.zeros(2, np.uint32), np.zeros(2, np.int64), np.full(2, -1, np.int64)
    space, sentinel, before = np.uint32(zlib.crc32(b" ")), np.uint32(zlib.crc32(SENTINEL)), 0
    for _, block in blocks(joined(texts)):
        found = WORD_OR_SENTINEL.findall(block)
        sums = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = (sums == sentinel) & (sizes == 1)
        offsets, at = np.flatnonzero(ends), np.flatnonzero(~ends)
        crc, size = np.concatenate([crc[-2:], sums[at]]), np.concatenate([size[-2:], sizes[at]])
        doc = np.concatenate([doc[-2:], before + np.searchsorted(offsets, at)])
        before += len(offsets)
        if not len(at):
            continue
        inside = doc[1:] == doc[:-1]
        two = appended(_mapped(_tables()[0], crc[:-1]) ^ space, crc[1:], size[1:])
        three = appended(_mapped(_tables()[0], two[:-1]) ^ space, crc[2:], size[2:])
        pairs, triples = inside[1:], inside[1:] & inside[:-1]
        new = doc[2:]
        yield new, np.concatenate([new, new[pairs], new[triples]]), np.concatenate([crc[2:], two[1:][pairs], three[triples]]) % np.uint32(BUCKETS)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sums its own, so at most ``BUCKETS`` rows a task are
    moved, and the driver sees ``BUCKETS`` numbers, whatever the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", BATCH):
                for _, _, bucket in features(piece.column("text")):
                    total += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the source, each count one higher."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of gains over all features of a text. Sums are exact below 2^53."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", BATCH):
                n = piece.num_rows
                words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for of_word, of_feature, bucket in features(piece.column("text")):
                    words += np.bincount(of_word, minlength=n)
                    count += np.bincount(of_feature, minlength=n)
                    weight += np.bincount(of_feature, gains[bucket], minlength=n)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, count, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return whole_text(docs, id_col, text_col).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, draws: int, eligible: str) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... to ``draws`` over eligible rows by descending score, ties by ascending id, null for
    all others. Rows are sorted into ranges; each range is numbered by itself and starts where those before it end, so no
    task sees them all. Equal rows are told apart by their place in a written table, and so fall into several ranges."""
    placed = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "weighed")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    sorted_ = materialize(placed.filter(eligible).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "by_score")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # A row for each range, of which there are as many as shuffle partitions.
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    first = sorted_.join(F.broadcast(starts), "_range").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = placed.filter(f"NOT ({eligible})").withColumn("rank", F.lit(None).cast("long"))
    return first.select(*rows.columns, "rank").unionAll(rest.select(*rows.columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; drawn are those with a rank.

    Features are runs of one to three words in ``BUCKETS`` buckets. ``weight`` sums the gains of a document's features, and
    ``score`` adds noise that depends on seed and id alone (Gumbel-distributed, so the highest scores are a sample without
    replacement). Of the documents with at least ``least_words`` words, ``share`` of them (rounded down) with the highest
    scores are drawn, ties by smaller id. Null and empty texts have no features and weight 0; a null id counts as the empty
    text under the hash and comes last in ties; repeated rows are documents of their own; without documents there are no
    rows, and without target texts the gains are those of an empty target. Only ids and texts are read, twice: counting and
    weighing. No count is sampled."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = materialize(weighed(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise), "scored")
    n = rows.filter(F.col("n_words") >= least_words).count()
    return ranked(rows, share[0] * n // share[1], f"n_words >= {least_words}").select("doc_id", "n_features", "weight", "score", "rank")
