"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents become short digests once: their length and the counts of those terms that some item asks for. A task gathers
digests into blocks of bounded size and sorts each term's documents by impact. For an item, its terms' lists are read in
step; each document met is looked up in all the item's lists, which also marks its places there. Each list's best
position is the end of its places seen without a gap, and no document that is still unseen can score more than the sum of
the impacts that follow the best positions. Reading stops once that sum is below the k-th best score, strictly, as
documents of equal score rank by id. What a block finds is the bar for the next one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize
from ledgerlark.llm.texts import slices, whole_text
from ledgerlark.llm.words import WORD, blocks, text_bytes

#: Bytes of distinct terms that items of one round may bring; more items take more rounds.
TERM_BYTES = 32 << 20
#: Places in the lists of one block.
BLOCK_PLACES = 2_000_000


def counted(text: bytes) -> Counter:
    """The terms of a text and how often each stands there."""
    found: Counter = Counter()
    for _, block in blocks(text):
        found.update(WORD.findall(block))
    return found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_id, term``: the distinct terms of each row, which is an item of its own (``item``), in a written table."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(batch.column("item").to_pylist(), batch.column("item_id"), text_bytes(batch.column("text")), strict=True):
                terms = sorted(counted(text))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(terms), pa.int64()), pa.array([key.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(split, "item long, item_id long, term binary"), "item_terms")


def digests(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts``: of every document its number of terms with repeats, and the numbers and counts of those
    among ``terms``. Documents without any term stay out."""
    number = {t: i for i, t in enumerate(terms)}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, sizes, held, times = [], [], [], []
                for key, text in zip(piece.column("doc_id").to_pylist(), text_bytes(piece.column("text")), strict=True):
                    if found := counted(text):
                        asked = sorted((number[t], n) for t, n in found.items() if t in number)
                        ids.append(key)
                        sizes.append(found.total())
                        held.append([i for i, _ in asked])
                        times.append([n for _, n in asked])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return materialize(whole_text(docs, id_col, text_col).mapInArrow(digest, "doc_id long, n long, terms array<int>, counts array<long>"), "digests")


class Lists:
    """Impact lists of one block: of each term its documents by descending impact, and their places by document."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.n = ids, len(ids)
        by_impact = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        self.terms, self.start = np.unique(term[by_impact], return_index=True)
        self.end = np.append(self.start[1:], len(doc))
        by_doc = np.lexsort((self.doc, term[by_impact]))
        self.sorted_doc, self.place = self.doc[by_doc], by_doc - np.repeat(self.start, self.end - self.start)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        i = np.searchsorted(self.terms, term)
        if i == len(self.terms) or self.terms[i] != term:
            return None
        cut = slice(self.start[i], self.end[i])
        return self.doc[cut], self.impact[cut], self.sorted_doc[cut], self.place[cut]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties by smaller id. A first cut at the k-th score keeps sorting short; ties at it stay in."""
    if len(scores) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[kept], scores[kept]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_positions(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray, first: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a block's documents and those given, for one item: its terms and their weights."""
    own = [(w, *found) for t, w in zip(terms, weights, strict=True) if w > 0 and (found := lists.of(t)) is not None]
    met = np.zeros(lists.n, bool)
    seen = [np.zeros(len(doc), bool) for _, doc, *_ in own]
    best = [0] * len(own)
    done, depth = 0, first
    while any(done < len(doc) for _, doc, *_ in own):
        fresh = np.concatenate([doc[done:depth] for _, doc, *_ in own])
        fresh = np.unique(fresh[~met[fresh]])
        met[fresh] = True
        total = np.zeros(len(fresh), np.int64)
        bound = 0
        for i, (w, doc, impact, by_doc, place) in enumerate(own):
            if len(fresh):
                at = np.minimum(np.searchsorted(by_doc, fresh), len(doc) - 1)
                hit = by_doc[at] == fresh
                places = place[at[hit]]
                seen[i][places] = True
                total[hit] += w * impact[places]
            ahead = seen[i][best[i] :]
            best[i] = len(doc) if ahead.all() else best[i] + int(np.argmin(ahead))
            if best[i] < len(doc):
                bound += int(w * impact[best[i]])
        ids, scores = _best(np.concatenate([ids, lists.ids[fresh]]), np.concatenate([scores, total]), k)
        if len(scores) >= k and bound < scores[-1]:
            break
        done, depth = depth, depth * 2
    return ids, scores


def impact_of(count: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """A term's part of the score from its count, in whole numbers: it saturates, and more slowly in long documents."""
    return (1_000_000_000 * count) // (1000 * count + 20 * (100 - 50 + (50 * n * docs) // length))


def _search(found: DataFrame, asked: list[tuple[int, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int, places: int) -> DataFrame:
    """``item, doc_id, score``: the k best of every item in each task's share of the digests, blockwise."""
    nobody = int(np.iinfo(np.int64).max)  # stands for a null id, which ranks last

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {item: (np.empty(0, np.int64), np.empty(0, np.int64)) for item, _ in asked}

        def judge(held: list[pd.DataFrame]) -> None:
            block = pd.concat(held, ignore_index=True)
            sizes = block["terms"].str.len().to_numpy()
            doc = np.repeat(np.arange(len(block)), sizes)
            term, count = np.concatenate(block["terms"].to_list()), np.concatenate(block["counts"].to_list())
            lists = Lists(block["doc_id"].to_numpy(), doc, term, impact_of(count, block["n"].to_numpy()[doc], docs, length))
            for item, terms in asked:
                best[item] = best_positions(lists, terms, weights[terms], k, *best[item])

        held, size = [], 0
        for frame in frames:
            frame = frame[frame["terms"].str.len() > 0]
            ends = np.cumsum(frame["terms"].str.len().to_numpy())
            while len(frame):
                # A block ends with the row that fills it; a document of more places alone fills one.
                cut = int(np.searchsorted(ends, places - size)) + 1
                held.append(frame.iloc[:cut])
                size += int(ends[min(cut, len(ends)) - 1])
                if size < places:
                    break
                judge(held)
                held, size, frame, ends = [], 0, frame.iloc[cut:], ends[cut:] - ends[min(cut, len(ends)) - 1]
        if held:
            judge(held)
        for item, (ids, scores) in best.items():
            yield pd.DataFrame({"item": item, "doc_id": ids, "score": scores})

    return found.select(F.coalesce("doc_id", F.lit(nobody)).alias("doc_id"), "n", "terms", "counts").mapInPandas(search, "item long, doc_id long, score long").withColumn("doc_id", F.nullif("doc_id", F.lit(nobody)))


def top_of_each(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each key with their rank. Candidates are cut to k in parts of a key first, so no task gets more than
    ``32 k`` rows of one."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(32))).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).filter(F.col("_r") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k).drop("_part", "_r")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", term_bytes: int = TERM_BYTES, places: int = BLOCK_PLACES
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents, all integers.

    Every row of ``items`` is an item of its own, also where ids repeat or are null, and every row of ``docs`` a document.
    Null texts and texts without terms score nothing and count nowhere; documents with score 0 are left out, equal scores
    rank by smaller id, null ids last; an empty table gives no rows. Statistics count all documents. Items are dealt by hash
    into rounds whose terms take about ``term_bytes`` at most, so what tasks receive is bounded; each round reads the texts
    once. A block holds ``places`` list entries or one document. What a task keeps per item is its k best.
    """
    terms = item_terms(items, item_col, item_text_col)
    rounds = -(-(terms.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0) // term_bytes)
    outs = []
    for i in range(rounds):
        own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i)
        vocabulary = sorted(bytes(r.term) for r in own.select("term").distinct().collect())
        number = {t: j for j, t in enumerate(vocabulary)}
        asked: dict[int, list[int]] = {}
        for r in own.collect():
            asked.setdefault(r["item"], []).append(number[bytes(r.term)])
        found = digests(docs, vocabulary, id_col, text_col)
        n, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        near = _search(found, [(item, np.array(sorted(t))) for item, t in sorted(asked.items())], weights, n, length, k, places)
        outs.append(near.filter(F.col("score") > 0))
    if not outs:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    near = outs[0]
    for more in outs[1:]:
        near = near.unionAll(more)
    names = materialize(terms.select("item", "item_id").distinct(), "items")
    return top_of_each(near, "item", k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


RANKED_SQL = r"""
WITH t AS (
  SELECT d.rowid AS row, d.doc_id, unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d
), tf AS (
  SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY row, doc_id, term
), n AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row
), a AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), a
), q AS (
  SELECT DISTINCT row AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, item_id, text FROM benchmark)
), p AS (
  SELECT tf.row, tf.doc_id, tf.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n.n * a.docs) // a.length))) AS part
  FROM tf JOIN n USING (row) JOIN w USING (term), a
), s AS (
  SELECT q.item, q.item_id, p.row, p.doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY ALL
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
