"""Token counts by rank-synchronous array merging.

A text is cut at single spaces into chunks, which no token crosses. Chunks not seen before are normalised and cut into
pre-tokens; the pre-tokens of a batch are laid into ragged numpy arrays, and each round merges every sequence's
lowest-ranked pair at once until no sequence has a pair left. What remains of a sequence is its number of tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ledgerlark.llm.texts import held, slices, whole_text

NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them: printable Latin-1 stands for itself,
    the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Merges of a byte-pair vocabulary over many sequences at once."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str = ""):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        ranks = np.arange(len(merges), dtype=np.int32)
        # A symbol that a merge makes may itself merge at a lower rank only in odd vocabularies; such merges go one at a time.
        first_use = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.safe = first_use[self.made] > ranks
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        for key, rank in zip(((left << 20) | right).tolist(), range(len(merges)), strict=True):
            slot, probes = self._slot(key), 1
            while self.keys[slot] not in (-1, key):
                slot, probes = (slot + 1) & ((1 << self.bits) - 1), probes + 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, probes)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 12) & ((1 << self.bits) - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        found = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        for _ in range(self.probes - 1):
            open_ = (found == NONE) & (self.keys[slot] != -1) & (self.keys[slot] != key)
            if not open_.any():
                break
            slot = np.where(open_, (slot + 1) & ((1 << self.bits) - 1), slot)
            found = np.where(open_ & (self.keys[slot] == key), self.ranks[slot], found)
        return found

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; an empty word has none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return out
        seq = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[data[ends]]
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that starts here
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = lowest == NONE
            if done.any():
                out[seq[starts[done]]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
                if not len(symbols):
                    break
                lowest, lengths = lowest[~done], lengths[~done]
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
            at = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # Of pairs that overlap (a run of one symbol), every second merges, from the left.
            run = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            unsafe = ~self.safe[rank[at]]
            if unsafe.any():
                first = np.r_[True, seq[at][1:] != seq[at][:-1]]
                at = at[first | ~unsafe]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            again = np.unique(np.r_[moved, moved[moved > 0] - 1])
            rank[again] = NONE
            again = again[again + 1 < len(symbols)]
            again = again[seq[again] == seq[again + 1]]
            rank[again] = self._rank(symbols[again], symbols[again + 1])
        return out


class Counter:
    """Counts tokens of whole texts as a tokenizers file with word ends states them (lower-casing normaliser, split
    pattern, byte-level pairs, special strings matched in the text as written)."""

    def __init__(self, path: str, most: int = 1_200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: this counter knows NFC, blanks to a space, lower case and a kept split pattern only")
        white = r"\p{White_Space}"
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{white}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.library = Tokenizer.from_file(path)
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self.memo: dict[str, int] = {}
        self.most = most

    def _pre_tokens(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of a chunk, and how many special strings it holds."""
        if chunk.isascii() and "<|" not in chunk:
            return self.words.findall(chunk.lower()), 0
        parts = self.special.split(chunk)
        found: list[str] = []
        for part in parts:
            if any(unicodedata.category(c) == "Cn" for c in part):
                # Code points that this Python doesn't know yet: the library's own tables decide where words end.
                text = self.library.normalizer.normalize_str(part)
                found += [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
                continue
            # Lower case goes letter by letter: a sigma at a word's end is no exception.
            found += self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return found, len(parts) - 1

    def learn(self, chunks: list[str]) -> None:
        pieces = [self._pre_tokens(c) for c in chunks]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for found, _ in pieces for w in found))}
        counts = self.merger.counts([w.encode() for w in words]).tolist()
        for chunk, (found, special) in zip(chunks, pieces, strict=True):
            self.memo[chunk] = special + sum(counts[words[w]] for w in found)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > self.most:
            self.memo.clear()
        docs = [t.split(" ") for t in texts]
        missing: set[str] = set()
        for chunks in docs:
            missing.update(filterfalse(self.memo.__contains__, chunks))
        self.learn(list(missing))
        out = [sum(map(self.memo.__getitem__, chunks)) for chunks in docs]
        for chunk in [c for c in missing if len(c) > 48]:
            del self.memo[chunk]
        return out


def _counter(path: str) -> Counter:
    """The worker's counter of this vocabulary; it and its memo live on from task to task."""
    store = held("token counts")
    return store.get(path) or store.setdefault(path, Counter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a tokenizers file that every executor can open. No begin, end or added special tokens,
    no truncation. A null text counts as empty: 0 bytes and 0 tokens. A null id stays null, repeated rows are counted
    each, an empty table gives no rows, and other columns, whatever their names, are not read. A text of any length is
    counted whole. No shuffle: the only state is a bounded memo of chunks in each worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                text = batch.column("text")
                tokens = np.array(counter.count(text.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return whole_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
