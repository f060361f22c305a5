import random
import sys

import public_tokenizers
from tokenizers import Tokenizer

from ledgerlark.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "aaaaaaaaaaaaaaaa", "  two  spaces \n\t tabs\r\n", "it's we'll I'M don'T", "ΣΑΣ Σ ΟΔΟΣ", "İstanbul ǅ ß ﬁ", "é é ́x a ́", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "12345 a1b2 x y z\x85q\x1cq", "日本語 テスト 🙂🙂 👩‍👩‍👧", "#$%&***", "x" * 30000, "ab" * 9000, "\u0000 �", "naïve—dash…", " l p"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_library_on_odd_texts():
    assert Counter(PATH).count(ODD) == library(ODD)


def test_equals_library_on_random_texts():
    rng = random.Random(5)
    alphabet = "abcdefgh'stlm  \n.,<|>ÀéΣς́ŒﬀĲ1٣½中🙂 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(1500)]
    assert Counter(PATH).count(texts) == library(texts)


def test_equals_library_on_every_code_point():
    texts = [" ".join(f"a{chr(c)}b" for c in range(s, s + 256) if not 0xD800 <= c < 0xE000) for s in range(0, sys.maxunicode, 256)]
    ours, theirs = Counter(PATH).count(texts), library(texts)
    assert sum(a != b for a, b in zip(ours, theirs, strict=True)) == 0


def test_frame_cases(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (None, "a b", "x"), (1, "hello world", "x"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(count_tokens(docs, PATH, limit=1).collect(), key=str)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], key=str) == sorted(
        [(1, 11, 2, True), (2, 0, 0, False), (None, 3, 2, True), (1, 11, 2, True), (3, 0, 0, False)], key=str
    )
    assert count_tokens(docs.limit(0), PATH).count() == 0
