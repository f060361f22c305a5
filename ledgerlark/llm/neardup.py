"""N-gram Jaccard join by MinHash banding.

Exact copies are one text from the start. Each text's band hashes go through one shuffle; texts that meet in a band are
candidates. Their connected groups are cut into blocks, and the blocks that share a band bucket are compared pair by pair
on full shingle sets inside a task: a task gives each text's number of links and a spanning star of each linked group, so
no pairs of a group are ever emitted. Connected stars make the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize
from ledgerlark.llm.bytehash import mix, shingles
from ledgerlark.llm.texts import column, held, keyed, slices, spare, trim, unique_ids
from ledgerlark.operators.components import connected_components

#: Bytes of text whose shingles one pass holds.
PIECE = 1 << 20


def choose_banding(threshold: float, recall: float, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows in each) that find a pair at the threshold with at least this probability. A band count follows from
    the rows; of the choices within ``hashes`` hashes a text, the one with most rows has the fewest chance candidates."""
    bands = lambda rows: max(1, math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
    rows = max((r for r in range(1, hashes + 1) if bands(r) * r <= hashes), default=1)
    return bands(rows), rows


def text_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return shingles(data, offsets - offsets[0], width)


def band_hashes(found: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each text with shingles (all texts here have some)."""
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    out = np.zeros((len(first) - 1, bands), np.uint64)
    for band in range(bands):
        for row in range(rows):
            salt = salts[band * rows + row]
            least = np.minimum.reduceat(((found ^ salt) * (salt | np.uint64(1))) >> np.uint64(24), first[:-1])
            out[:, band] = mix(out[:, band] + least)
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``row, doc_id, h1, h2`` (hash of the text) and ``bands`` (empty for a text without words). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near duplicates")
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                text = batch.column("text")
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(t), 2**64) for t in text.to_pylist()], np.uint64).reshape(-1, 2)
                found, first = text_shingles(text, width)
                some = np.diff(first) > 0
                flat = band_hashes(found, np.r_[first[:-1][some], first[-1]], bands, rows) if some.any() else np.zeros((0, bands), np.int64)
                ends = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))],
                    names=["row", "doc_id", "h1", "h2", "bands"],
                )

    return docs.mapInArrow(run, "row long, doc_id long, h1 long, h2 long, bands array<long>")


def jaccard_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each text, smallest id of its linked group) in one block (all sides 0) or between two (sides 0 and 1)."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner, values = np.repeat(np.arange(n), sizes.astype(np.int64)), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    new = np.r_[True, values[1:] != values[:-1]]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    owner, group = owner[shared], group[shared]
    both = np.zeros((n, n), np.float32)
    if len(group):
        group = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        step = max(256, (8 << 20) // n)
        edges = np.searchsorted(group, np.arange(0, group[-1] + 1 + step, step))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = np.zeros((n, step), np.float32)
            part[owner[a:b], group[a:b] - k * step] = 1
            both += part @ part.T
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    linked &= ids[:, None] != ids[None, :]
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        after = np.minimum(label, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    # ids ascend, so the first of a group is its smallest
    return linked.sum(axis=1), ids[label]


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, hashes: int = 96, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, n_copies``.

    Texts are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least ``threshold``; a
    text of fewer words has one shingle of all its words. ``class_id`` is the smallest id of the linked group,
    ``n_links`` counts the other, different texts that a text is linked to, ``n_copies`` the rows with this very text.
    Pairs at the threshold are found with probability ``recall``, closer pairs with a higher one; every pair that is
    found is verified on full sets. Null and empty texts have no words and are linked to nothing; as exact copies of one
    another they share a class only when not empty. Rows with a null id keep a null class and take part in no group.
    Rows that share an id share a class. Empty tables give no rows.

    A group of any size is cut into blocks of ``block`` texts; blocks are compared only if they share a bucket.
    """
    bands, rows = choose_banding(threshold, recall, hashes)
    texts, unique = keyed(docs, id_col, text_col)
    base = materialize(sketches(texts, width, bands, rows), "sketches")
    known = base.filter(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    # A distinct text goes by the least number of its rows, so that texts that share an id stay apart.
    reps = materialize(known.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")), "texts")
    members = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter(F.col("n") > 1)
    met = materialize(members.join(buckets, ["band", "bucket"]).select("rep", "band", "bucket", "hub"), "met")
    groups = materialize(connected_components(met.select("rep", "hub").distinct(), "rep", "hub"), "groups")

    # Members of a group in an order that keeps bucket mates close, cut into blocks.
    near = met.groupBy("rep").agg(F.min("hub").alias("hub")).join(groups.withColumnRenamed("node", "rep"), "rep")
    # A sort over all groups numbers them, so that one group of any size spreads over many tasks.
    place = ("component", "hub", "rep")
    ordered = near.select(*place).repartitionByRange(*place).sortWithinPartitions(*place)
    placed = materialize(ordered.select("rep", "component", F.floor(F.monotonically_increasing_id() / block).alias("b")), "blocks")
    several = placed.groupBy("component").agg((F.max("b") > F.min("b")).alias("several"))
    placed = placed.join(several, "component")
    own = placed.select("rep", "component", F.col("b").alias("x"), F.col("b").alias("y"), F.lit(0).alias("side"))
    spread = met.join(placed.filter("several").select("rep", "component", "b"), "rep").select("band", "bucket", "component", "b").distinct()
    meets = spread.alias("p").join(spread.alias("q"), ["band", "bucket"]).filter("p.b < q.b").select("p.component", F.col("p.b").alias("x"), F.col("q.b").alias("y")).distinct()
    cross = [
        placed.join(meets.withColumn("b", F.col(side)), ["component", "b"]).select("rep", "component", "x", "y", F.lit(k).alias("side"))
        for k, side in enumerate(("x", "y"))
    ]
    units = own.unionByName(cross[0]).unionByName(cross[1])
    asked = units.groupBy("rep").agg(F.collect_list(F.struct("component", "x", "y", "side")).alias("units"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near duplicates")
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                found, first = text_shingles(batch.column("text"), width)
                packed = [np.unique(found[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("units"), pa.array(packed, pa.binary())], names=["rep", "units", "grams"])

    unit = "struct<component:bigint,x:bigint,y:bigint,side:int>"
    sets = texts.select(F.col("row").alias("rep"), "text").join(asked, "rep").select("rep", "units", "text").mapInArrow(to_sets, f"rep long, units array<{unit}>, grams binary")
    key = ["component", "x", "y"]
    ordered = sets.select("rep", "grams", F.inline("units")).repartition(*key).sortWithinPartitions(*key, "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members_: list[tuple[int, int, bytes]] = []
        now = None
        held("near duplicates")

        def flush() -> pa.RecordBatch:
            ids = np.array([h[0] for h in members_], np.int64)
            links, roots = jaccard_links(ids, np.array([h[1] for h in members_]), [np.frombuffer(h[2], np.uint64) for h in members_], threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(roots)], names=["rep", "links", "root"])

        for batch in batches:
            for *key_, rep, side, grams in zip(*(batch.column(c).to_pylist() for c in (*key, "rep", "side", "grams")), strict=True):
                if key_ != now:
                    if len(members_) > 1:
                        yield flush()
                    members_, now = [], key_
                members_.append((rep, side, grams))
        if len(members_) > 1:
            yield flush()
        trim()

    links = materialize(ordered.mapInArrow(verify, "rep long, links long, root long"), "links")
    edges = links.filter("rep <> root").select("rep", "root")
    if not unique:
        # Texts that share an id share a class.
        own_ids = materialize(known.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").distinct(), "ids")
        heads = own_ids.groupBy("doc_id").agg(F.min("rep").alias("root"), F.count("*").alias("n")).filter("n > 1")
        edges = edges.unionByName(own_ids.join(heads, "doc_id").filter("rep <> root").select("rep", "root"))
    classes = connected_components(edges, "rep", "root").select(F.col("node").alias("rep"), "component")
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    told = reps.select("h1", "h2", "rep", "least", "n_copies").join(counts, "rep", "left").join(classes, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = materialize(told, "told")
    if not unique:
        told = told.drop("least").join(told.groupBy("component").agg(F.min("least").alias("least")), "component").withColumn("component", F.col("least"))
    told = told.select("h1", "h2", "n_copies", F.col("component").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # Rows without words or an id are linked to nothing; they share no key with one another.
    alone = base.filter(F.col("doc_id").isNull() | (F.size("bands") == 0))
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    linked = known.select("doc_id", "h1", "h2").join(told, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "n_copies")
    return linked.unionByName(alone)


def keep_one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that head their class, and those without an id; all columns stay as they are."""
    (name,) = spare(docs, "gone")
    gone = classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates and copies: that with the smallest id, null last. Rows without words all
    stay. Null and repeated ids don't tell rows apart, so a table with such ids is written once with numbered rows."""
    if unique_ids(docs, id_col):
        return keep_one_of_each(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col)
    (row,) = spare(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(rows, id_col=row, text_col=text_col).select(F.col("doc_id").alias("row"), "class_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    heads = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id")).join(classes, "row").groupBy("class_id").agg(first.alias("m")).select(F.col("m.row").alias(row))
    return rows.join(heads, row, "left_semi").select(*map(column, docs.columns))
