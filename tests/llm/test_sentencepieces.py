import random

import sentencepiece
from pyspark.sql import functions as F

from leaguelens.llm import sentencepieces as S

RAW = open(S.MODEL, "rb").read()
ODD = ["", " ", "  a  b ", "\n\t x", "日本語 😀 x", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 50 + "x", "x\0y", "tail ", "é​", "a▁b"]


def test_ids_equal_sentencepiece():
    judge, tokenizer, words = sentencepiece.SentencePieceProcessor(model_proto=RAW), S.build(RAW), S.Words(RAW)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab  eé\n▁.Th日🙂") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    theirs = judge.encode(texts)
    assert S.encode_texts(tokenizer, texts) == theirs
    ids, same, back = words.encode(texts)
    assert [i.tolist() for i in ids] == theirs and all(same)
    decoded = S.decode_ids(tokenizer, theirs)
    assert decoded == [judge.decode(i) for i in theirs]
    assert back == [a == b for a, b in zip(decoded, texts, strict=True)]
    assert all(b for b, t in zip(back, texts, strict=True) if S.MARK not in t)


def test_unigram_models_are_rebuilt():
    def text(n, s):
        return bytes([n << 3 | 2, len(s)]) + s

    import struct

    raw = b""
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -0.5, 1), ("a", -2.5, 1)]
    for piece, score, kind in pieces:
        raw += text(1, text(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))
    raw += text(2, bytes([0x18, 1])) + text(3, text(1, b"identity") + bytes([0x18, 1, 0x20, 1]))
    spec = S.read(raw)
    assert [p[0] for p in spec.pieces] == [p[0] for p in pieces] and spec.kind == S.UNIGRAM and spec.squeeze
    judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["ab", "a  b", " aab ", "", "ba"]
    assert S.encode_texts(S.build(raw), texts) == judge.encode(texts)
    assert [i.tolist() for i in S.Words(raw).encode(texts)[0]] == judge.encode(texts)


def test_whole_table_and_edges(spark):
    got = S.op3_sentencepiece(spark, "/root/testdata/sf0.01")
    bad = got.where("not round_trip or not parity").count()
    assert bad == 0 and got.count() == 1000
    schema = "doc_id long, text string, ids string"
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (None, "a b", "x"), (1, " ", "x")], schema)
    out = {r.doc_id: r for r in S.verify(docs).collect()}
    assert all(r.parity for r in out.values()) and out[100].n_tokens == 0 and not out[11].round_trip
    tokens = S.encode(docs)
    assert tokens.where(F.col("ids").isNull()).select("doc_id").collect()[0][0] == 100
    back = {r.doc_id: r.text for r in S.decode(tokens).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(ODD)) and back[100] is None
    assert S.verify(docs.limit(0)).count() == S.encode(docs.limit(0)).count() == 0


def test_very_long_text():
    judge, words = sentencepiece.SentencePieceProcessor(model_proto=RAW), S.Words(RAW)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60_000)), "x" * 60_000]
    ids, same, back = words.encode(texts)
    assert [i.tolist() for i in ids] == judge.encode(texts) and all(same) and all(back)
