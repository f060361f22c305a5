import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlark.functions.storage import fresh_path
from ledgerlark.llm.token_files import ByteEncoder, ShardReader, read_token_files, train_dictionary, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(n):
    rng = random.Random(3)
    words = ["the", "Tion", "it's", "don't,", "a.b", "x", "é", "naïve", "12", "3rd", "<|endoftext|>", "<|endo", "日本", "🙂", "wh.\nAnd", "end,\n\nNew", "tab\there", "##", "'ll", " nb", "…", "z\x1cq", "\r\n"]
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "", "\n", " \n"]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*out, "", " ", "\n", " lead", "trail ", "word" * 4000, "a " * 3000, "\n a", "a\n"]


def test_encoder_equals_library():
    library, ours = Tokenizer.from_file(PATH), ByteEncoder(PATH)
    for t in texts(800):
        assert np.frombuffer(ours.encode(t), ours.kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 401 if i % 50 else None, t, "x") for i, t in enumerate(texts(300))]
    rows += [(5000, None, "x"), (1, rows[3][1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long".replace("n long", "frame string")).repartition(3)
    manifest = write_token_files(docs, PATH, fresh_path(spark, "t"), shard_bytes=4000)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted(g[0] for g in got)
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((-1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((a, c, d) for a, _, c, d in got) == sorted(want)
    one = next(r for r in manifest.collect() if r.n_docs > 1)
    shard = ShardReader(one.path, one.dictionary)
    full = list(shard.all())
    assert all(any(np.array_equal(x, y) for y in shard.get(int(i))) for i, x in zip(shard.ids, full, strict=True))
    assert shard.get(10**12) == []


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_files(write_token_files(docs, PATH, fresh_path(spark, "t"))).count() == 0


def test_the_dictionary_learns_from_all_rows(spark):
    """Documents of later partitions, of a kind of their own, are in the sample as well; long ones are not."""
    docs = spark.range(0, 6000, 1, 6).selectExpr("id AS doc_id", "concat(IF(id < 3000, 'the first kind of text stands here, number ', 'Quarterly zebra manifests overwhelm seven lighthouses by '), id) AS text")
    docs = docs.unionByName(spark.range(2000).selectExpr("id AS doc_id", "repeat('Unusual giraffe ledgers bewilder nine harbours. ', 30) AS text"))
    trained, coder = train_dictionary(docs, PATH, 0, 1000, 200, 8 << 10), ByteEncoder(PATH)
    assert coder.encode(" first kind of text") in trained and coder.encode(" zebra manifests overwhelm") in trained
    assert coder.encode(" giraffe ledgers") not in trained
    assert train_dictionary(docs.limit(5), PATH, 0, 1000, 200, 8 << 10) == b""
