import random
import struct

import numpy as np
import public_tokenizers
import sentencepiece

from ledgerlark.llm.pieces import Codec, Model, decode_pieces, encode_pieces, piece_digest

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(n=600):
    rng = random.Random(6)
    words = ["the", "Tion", "it's", "<s>", "</s>", "<unk>", "<0x0A>", "é", "naïve", "12", "日本", "🙂", "wh.\nAnd", "tab\there", "##", "▁x", "aaaa", "\x00", "ﬁ", "ğş", "\r\n", "abab", "anan", "nana"]
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "    ", "", "\n"]) for _ in range(rng.randrange(50))) for _ in range(n)]
    return [*out, "", " ", "  ", " a", "a ", "a  ", "\n", "word" * 3000, "a  " * 2000, "▁", "a▁ b", "▁ ", "▁ ▁ a", " ▁"]


def test_equals_sentencepiece():
    reference, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), Codec(PATH)
    found = codec.encode(texts())
    whole = codec.decode([ids for ids, _, _ in found])
    for t, (ids, same, back), text in zip(texts(), found, whole, strict=True):
        assert ids.tolist() == reference.encode(t), repr(t)
        assert same and back and text == codec.normal(t)


def test_ids_come_from_tokenizers_alone():
    class Stub:
        def encode(self, texts, **_):
            return [[7]] * len(texts)

        def piece_to_id(self, _):
            return 7

    codec, real = Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    codec.reference = Stub()
    found = codec.encode(texts())
    assert [ids.tolist() for ids, _, _ in found] == real.encode(texts())
    assert not any(same for t, (_, same, _) in zip(texts(), found, strict=True) if t)
    assert codec.decode([ids for ids, _, _ in found]) == [codec.normal(t) for t in texts()]


def test_memo_stays_small():
    codec = Codec(PATH, most=50)
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts():
        assert codec.encode([t])[0][0].tolist() == reference.encode(t)
        assert len(codec.memo) <= 50 + len(t.split(" "))
        assert all(len(w) <= 48 for w in codec.memo)


def message(number, value):
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model(tmp_path):
    rng = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    grams = {"▁", *"abcd", *("".join(rng.choice("abcd") for _ in range(rng.randrange(2, 5))) for _ in range(60))}
    grams |= {"▁" + g for g in grams if g != "▁"}
    pieces += [(g, -rng.uniform(1, 12), 1) for g in sorted(grams)]
    data = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, k)) for p, s, k in pieces)
    data += message(2, message(3, 1) + message(35, 1)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    codec, reference = Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    sample = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(40))) for _ in range(300)]
    found = codec.encode(sample)
    for t, (ids, same, back), text in zip(sample, found, codec.decode([ids for ids, _, _ in found]), strict=True):
        assert ids.tolist() == reference.encode(t) and same and back and text == t, repr(t)


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(40))] + [(None, None, "x"), (0, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = piece_digest(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    encoded = encode_pieces(docs, PATH)
    back = {(r.doc_id, r.text) for r in decode_pieces(encoded, PATH).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows}
    assert piece_digest(docs.limit(0), PATH).count() == 0


def test_parse():
    with open(PATH, "rb") as f:
        model = Model.parse(f.read())
    assert len(model.pieces) == 32000 and model.byte_fallback and model.kind == 2


def test_round_trip_sees_whole_texts():
    """A decoder that is right for every single word but loses the spaces between words is found out."""
    from tokenizers import decoders

    codec = Codec(PATH)
    assert [back for _, _, back in codec.encode(["one", "one two", " three", ""])] == [True] * 4
    codec.tokenizer.decoder = decoders.Sequence([decoders.Replace("▁", ""), decoders.ByteFallback(), decoders.Fuse()])
    assert [back for _, _, back in codec.encode(["one", "one two", " three", ""])] == [True, False, False, True]


def test_frequent_words_are_learned_once():
    """Words that stand in every text are not encoded again when the memo has filled up with others."""
    codec, given = Codec(PATH, most=40), []
    learn = codec._learn
    codec._learn = lambda words: (given.extend(words), learn(words))[1]
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i in range(60):
        text = " ".join(["the", "naïve", *(f"w{i}x{k}" for k in range(8))])
        assert codec.encode([text])[0][0].tolist() == reference.encode(text)
    assert given.count("the") == given.count("naïve") == 1 and len(given) == 2 + 60 * 8
    assert len(codec.memo) + len(codec.older) <= 40 + 2 * 10


def test_odd_words_are_found_after_the_memo_turned_over():
    class Stub:
        def __init__(self, real):
            self.real = real

        def encode(self, texts, **more):
            return [[7] if t == "odd" else ids for t, ids in zip(texts, self.real.encode(texts, **more), strict=True)]

        def piece_to_id(self, piece):
            return self.real.piece_to_id(piece)

    codec = Codec(PATH, most=20)
    codec.reference = Stub(codec.reference)
    for i in range(30):
        assert [same for _, same, _ in codec.encode([f"an odd one{i} a{i} b{i}", f"even c{i}"])] == [False, True]
    for i in range(30):
        codec.encode([f"d{i} e{i} f{i} g{i}"])
    assert not codec.odd


def test_unknown_pieces(tmp_path):
    """What unknown pieces read as comes from their ids alone, whatever stands in the text."""
    codec, reference = Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    sample = ["<unk>", " ⁇ ", "a ⁇ b", "<unk> <unk>", "▁⁇▁"]
    for t, (ids, same, back) in zip(sample, codec.encode(sample), strict=True):
        assert same and back and ids.tolist() == reference.encode(t), t
    ids = [*reference.encode("one"), reference.unk_id(), *reference.encode("two")]
    assert codec.decode([np.array(ids)]) == [reference.decode(ids)]
    marker = [*reference.encode("one"), *(reference.piece_to_id(f"<0x{b:02X}>") for b in "▁".encode())]
    assert codec.decode([np.array(marker)]) == ["one▁"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(g, -2.0 - k / 8, 1) for k, g in enumerate("▁ a b < > u n k ⁇".split())]
    data = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, k)) for p, s, k in pieces)
    data += message(2, message(3, 1) + message(35, 1)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    codec, reference = Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for t, (ids, same, back) in zip(sample, codec.encode(sample), strict=True):
        assert same and back and ids.tolist() == reference.encode(t), t
