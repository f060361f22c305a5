"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule; versioned policies
(masks over the bits) and ablations (what one rule alone removes) are then bitwise operations on the ledger.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.texts import column, held, slices, spare, whole_text

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letter_words")

#: (name, what fails it) over the measurements; the place in this list is the rule's bit. Shares are compared without division.
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("upper_case", "10 * n_upper > 4 * word_chars"),
    ("word_length_low", "2 * word_chars < 5 * n_words"),
    ("word_length_high", "word_chars > 12 * n_words"),
    ("few_letters", "2 * n_letter_words < n_words"),
    ("few_distinct_words", "n_words >= 50 AND 50 * n_distinct_words < n_words"),
]
BASE = ("too_short", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named version: the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << bit for bit, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "symbols", "duplicate_lines", "upper_case")),
        Policy("v2", tuple(name for name, _ in RULES)),
    )
}


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of eight words which occurs twice or more in the text, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        sums ^= sums >> np.uint64(29)
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.r_[order[1:][same], order[:-1][same]])
    # Equal hashes are only a hint: windows count when their words are equal.
    seen: dict[tuple[str, ...], int] = {}
    for i in at.tolist():
        key = tuple(words[i : i + WINDOW])
        seen[key] = seen.get(key, 0) + 1
    at = np.array([i for i in at.tolist() if seen[tuple(words[i : i + WINDOW])] > 1], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@lru_cache(maxsize=1 << 16)
def is_upper(char: str) -> bool:
    """Whether a character is an upper-case letter (category Lu)."""
    return unicodedata.category(char) == "Lu"


def measure(text: str, letter=regex.compile(r"\p{L}").search) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``. Letters are characters of the Unicode categories L*."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    distinct = set(words)
    lettered = {w for w in distinct if w.isalpha() or letter(w)}
    n_letter = len(words) if len(lettered) == len(distinct) else sum(w in lettered for w in words)
    upper = sum(map(text.count, filter(is_upper, set(text))))
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), len(distinct), upper, n_letter,
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``doc_id``, the measurements, and ``failed``, a long whose bit k says that rule k failed.

    A null text counts as empty (and is too short); a null id stays null; repeated rows each get a row; an empty table
    gives none. Whole texts are measured. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for whole in batches:
            for batch in slices(whole, "text"):
                found = np.array([measure(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    rows = whole_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, (_, test) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed)


def failed_rules(mask: Column) -> Column:
    """Names of the rules whose bits are set."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name)) for bit, (name, _) in enumerate(RULES))))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy's mask, and ``only_rule``: the rule without which the policy would
    keep the text, null where none or several reject it. No text is looked at again."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    mask = policy.mask | POLICIES["base"].mask
    seen = F.col("failed").bitwiseAND(F.lit(mask))
    only = F.coalesce(*(F.when(seen == F.lit(1 << bit), F.lit(name)) for bit, (name, _) in enumerate(RULES) if mask >> bit & 1))
    return entries.withColumn("base_failed", base).withColumn("kept", seen == 0).withColumn("only_rule", only)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: texts it fails (``n_failed``), texts that only it rejects (``n_only``, what leaving it
    out would bring back), and all texts kept (``n_kept``). One pass of bitwise aggregation over the ledger."""
    seen = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = entries.groupBy(seen.alias("seen")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, (name, _) in enumerate(RULES) if name in policy.rules)))
    return (
        sums.select("seen", "n", rows.alias("r"))
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("seen").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("seen") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
            F.coalesce(F.sum(F.when(F.col("seen") == 0, F.col("n"))), F.lit(0)).alias("n_kept"),
        )
    )


def keep_good(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns, whatever their names; measured in place, without a
    shuffle. Null and empty texts are too short and go; repeated rows and null ids are judged like any other row."""
    names = dict(zip(MEASURES, spare(docs, *(f"q_{m}" for m in MEASURES)), strict=True))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[m], T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for whole in batches:
            for batch in slices(whole, text_col):
                found = np.array([measure(t or "") for t in batch.column(text_col).to_pylist()], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=schema.names)

    rejected = POLICIES[version].mask | POLICIES["base"].mask
    tests = [re.sub(r"\bn_\w+|\bword_chars\b", lambda m: names[m[0]], test) for bit, (_, test) in enumerate(RULES) if rejected >> bit & 1]
    return docs.mapInArrow(run, schema).filter("NOT (" + " OR ".join(f"({t})" for t in tests) + ")").select(*map(column, docs.columns))


def quality_verdicts(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with a policy's verdicts; cases as in ``ledger``."""
    return apply_policy(ledger(docs), POLICIES[version])


_BITS = " + ".join(f"CASE WHEN {test} THEN {1 << bit} ELSE 0 END" for bit, (_, test) in enumerate(RULES))
_MASK = POLICIES["v2"].mask | POLICIES["base"].mask
_NAMES = " ".join(f"WHEN {1 << bit} THEN '{name}'" for bit, (name, _) in enumerate(RULES))
QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW + 1}
), v AS (
  SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM g
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM v) x WHERE c > 1
), c AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, range({WINDOW}) q(j) GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words,
    CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words
  FROM d LEFT JOIN c ON c.k = d.k
)
SELECT *, (failed & {POLICIES["base"].mask}) <> 0 AS base_failed, (failed & {_MASK}) = 0 AS kept, CASE failed & {_MASK} {_NAMES} END AS only_rule
FROM (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m) f
"""

#: What each rule alone would bring back, from the rows that ``QUALITY_SQL`` gives.
ABLATION_SQL = f"""
SELECT 'v2' AS version, rule, count(*) FILTER (WHERE (failed & bit) <> 0) AS n_failed,
  count(*) FILTER (WHERE (failed & {_MASK}) = bit) AS n_only, count(*) FILTER (WHERE (failed & {_MASK}) = 0) AS n_kept
FROM ({QUALITY_SQL}) q, (VALUES {", ".join(f"('{name}', {1 << bit})" for bit, (name, _) in enumerate(RULES))}) r(rule, bit)
GROUP BY rule
"""
