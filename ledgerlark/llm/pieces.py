"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model's protobuf is parsed here, and its normaliser, space marker, piece scores and byte fallback are rebuilt as a
tokenizers pipeline. Texts are encoded and decoded by that library, one thread a worker, as Spark runs a worker for each
core. All that it encodes is also given to the sentencepiece library, only to say whether both agree.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerlark.llm.texts import held, slices, whole_text

MARK = "▁"
#: How an unknown piece reads.
UNREADABLE = " ⁇ "
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text that one pass holds as words and ids.
PIECE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message: varints as ints, other values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    """What the protobuf says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                model.kind, model.byte_fallback, model.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
            raise ValueError("only unigram and byte-pair models with a leading space marker are known here")
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of a byte-pair model in the order in which they merge: by the score of what they make, best first."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        if letters := {c for p in usable for c in p} - usable.keys():
            raise ValueError(f"{len(letters)} letters of pieces are no pieces themselves")
        halves = ((p, i, p[:k], p[k:]) for p, i in usable.items() for k in range(1, len(p)))
        found = [(-self.pieces[i][1], i, usable[a], usable[b], a, b) for p, i, a, b in halves if a in usable and b in usable]
        return [f[4:] for f in sorted(found)]

    def normalizer(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()] if self.squeeze else []
        steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def tokenizer(self, words: bool = False):
        """The model as a tokenizers pipeline; with ``words``, for single words that bring their marker along and that are
        met once, so they need no normaliser, no splitting and no cache."""
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        # What is unknown goes by what it reads as; with its spaces, no text holds it once they are markers.
        names = [UNREADABLE if i == unknown else p for i, (p, _, _) in enumerate(self.pieces)]
        if self.kind == UNIGRAM:
            made = Tokenizer(models.Unigram([(p, s) for p, (_, s, _) in zip(names, self.pieces, strict=True)], unk_id=unknown, byte_fallback=self.byte_fallback))
        else:
            vocab = {p: i for i, p in enumerate(names)}
            made = Tokenizer(models.BPE(vocab, self.merges(), cache_capacity=0 if words else 10_000, unk_token=UNREADABLE, fuse_unk=True, byte_fallback=self.byte_fallback))
        if not words:
            made.normalizer = self.normalizer()
        if self.apart and not words:
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        steps = [decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse()]
        made.decoder = decoders.Sequence([*steps, *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return made

    @property
    def apart(self) -> bool:
        """Whether no piece goes on into the next word, so that words can be encoded one by one."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in self.pieces)


#: Texts or words that one call of the encoder gets.
CALL = 256


class Codec:
    """Encodes and decodes texts with the tokenizers library; sentencepiece is asked for parity only.

    Every text is decoded whole and compared. Where the model lets words be encoded one by one, a worker remembers the ids
    of up to ``most`` distinct words, and parity is verified when a word is first met; else on whole texts. ``memo`` has the words
    of late, ``older`` those before; when ``memo`` holds half of ``most``, it takes the place of ``older``, so words that come
    again and again are not forgotten. A call of sentencepiece gets at most ``batch`` words and one of tokenizers ``CALL``,
    as their results take far more memory than the ids that are kept."""

    def __init__(self, path: str, threads: int = 1, most: int = 600_000, batch: int = 4096):
        # Set before the import: the library reads them when it starts its threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        model = Model.parse(data)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        # Words are encoded apart where nothing rewrites or drops spaces.
        self.by_word = model.apart and model.dummy_prefix and not (model.charsmap or model.squeeze)
        self.prefix = model.dummy_prefix
        self.tokenizer = model.tokenizer(words=self.by_word)
        self.aloud = np.array([kind != CONTROL for _, _, kind in model.pieces])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.most, self.batch = most, batch

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """The tokenizers library's ids of each text."""
        calls = (texts[k : k + CALL] for k in range(0, len(texts), CALL))
        return [e.ids for some in calls for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), self.batch):
            some = words[k : k + self.batch]
            found = self._ids([MARK + w.replace(" ", MARK) for w in some])
            self.memo.update(zip(some, [struct.pack(f"<{len(ids)}I", *ids) for ids in found], strict=True))
            theirs = self.reference.encode(some, num_threads=1)
            # A space that ends a text is a lone marker; sentencepiece takes an empty text to have none.
            self.odd.update(w for w, a, b in zip(some, found, theirs, strict=True) if a != (b if w else [self.reference.piece_to_id(MARK)]))

    def encode(self, texts: list[str], runs=re.compile(" +[^ ]*|[^ ]+").findall) -> list[tuple[np.ndarray, bool, bool]]:
        """Of each text: its ids, whether sentencepiece gives the same ones, and whether decoding gives the text back."""
        if not self.by_word:
            ids = [np.array(x, "<u4") for x in self._ids(texts)]
            theirs = self.reference.encode(texts, num_threads=1)
            return [(a, a.tolist() == b, self.normal(t) == d) for a, b, t, d in zip(ids, theirs, texts, self.decode(ids), strict=True)]
        if len(self.memo) > self.most // 2:
            self.memo, self.older = {}, self.memo
            self.odd &= self.older.keys()
        # A word is what follows a space (or the start of the text), with any further spaces before it. A marker that
        # stands in the text counts as a space.
        texts = [t.replace(MARK, " ") if MARK in t else t for t in texts]
        words = [[] if not t else t.split(" ") if "  " not in t and t[0] != " " else [w[1:] for w in runs(" " + t)] for t in texts]
        missing: set[str] = set()
        for found in words:
            missing.update(filterfalse(self.memo.__contains__, found))
        again = {w: ids for w in missing if (ids := self.older.get(w))}
        self.memo.update(again)
        self._learn(list(missing - again.keys()))
        out = []
        for found in words:
            ids = np.frombuffer(b"".join(map(self.memo.__getitem__, found)), "<u4")
            out.append((ids, not self.odd or self.odd.isdisjoint(found)))
        for w in (w for w in missing if len(w) > 48):
            del self.memo[w]
            self.odd.discard(w)
        return [(ids, same, t == back) for (ids, same), t, back in zip(out, texts, self.decode([ids for ids, _ in out]), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each array of ids; control pieces are silent."""
        return [self.tokenizer.decode(x[self.aloud[x]].tolist(), skip_special_tokens=False) for x in ids]

    def normal(self, text: str) -> str:
        """What decoding gives back: the text itself, unless the model's normaliser rewrites it. A marker that stands in
        the text reads as a space, as in sentencepiece."""
        if self.by_word:
            return text.replace(MARK, " ")
        return self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ")[1 if self.prefix else 0 :]


def _codec(path: str) -> Codec:
    """The worker's codec of this model; it and its memo live on from task to task."""
    store = held("pieces")
    return store.get(path) or store.setdefault(path, Codec(path))


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of ints) and ``parity`` of every text: the ids are the tokenizers library's, and parity
    says whether sentencepiece gives the same ones, word by word where words are encoded one by one. A null text is an empty one and has no ids; a null id
    stays null; repeated rows are encoded each; empty tables give no rows; other columns stay behind. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                found = codec.encode(batch.column("text").to_pylist())
                ends = np.cumsum([0, *(len(ids) for ids, _, _ in found)]).astype(np.int32)
                values = pa.array(np.concatenate([ids for ids, _, _ in found]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([same for _, same, _ in found])], names=["doc_id", "ids", "parity"])

    return whole_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text, null entries are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [np.array([i for i in x or () if i is not None], np.int64) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.decode(ids), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``doc_id``, ``n_bytes``, ``n_pieces``, ``ids_crc32`` (of the ids as little-endian 32-bit integers),
    ``parity`` (sentencepiece gives these ids) and ``round_trip`` (the tokenizers decoder gives the text back). Cases as in ``encode_pieces``; ids never leave the task that makes them."""
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "parity", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                text = batch.column("text")
                ids, same, back = zip(*codec.encode(text.to_pylist()), strict=True)
                columns = [
                    batch.column("doc_id"),
                    pc.binary_length(text).cast(pa.int64()),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array(map(zlib.crc32, ids), pa.int64()),
                    pa.array(same),
                    pa.array(back),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean"
    return whole_text(docs, id_col, text_col).mapInArrow(run, schema)
