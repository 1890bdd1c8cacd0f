"""Encoding and decoding with a SentencePiece model, run by the tokenizers library.

The model file's protobuf is read here, and the model rebuilt from it: the normaliser (its character map, its white space
rules, the marker for a space and the one before the text), the pieces with their scores (unigram) or the merges that
follow from them (byte-pair encoding), and the fall back to bytes. Texts are encoded in batches on several threads, and
sentencepiece itself encodes them again to verify that the ids are the same.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leaguelens.llm.common import bounded_batches

#: Default place of the model file; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text bytes in one call of the library, about; what it returns takes many times that.
CALL_BYTES = 1 << 19

# Fixed values of the SentencePiece protobuf: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message: ints, or the bytes of the other wire types."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(wire) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    suffix: bool = False


def read(raw: bytes) -> Spec:
    """The parts of a model file that encoding depends on."""
    spec = Spec()
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
                elif n == 24:
                    spec.suffix = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze = bool(v)
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, those of the best piece first."""
    usable = {p for p, _, k in spec.pieces if k in (NORMAL, USER)}
    found = []
    for rank, (piece, score, kind) in enumerate(spec.pieces):
        if kind in (NORMAL, USER):
            found += [(-score, rank, cut, piece) for cut in range(1, len(piece)) if piece[:cut] in usable and piece[cut:] in usable]
    return [(p[:cut], p[cut:]) for _, _, cut, p in sorted(found)]


def build(raw: bytes):
    """A tokenizer of the tokenizers library for the model file's bytes."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = read(raw)
    unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), None)
    if spec.kind == BPE:
        model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges=merges(spec), unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    else:
        raise ValueError("only unigram and byte-pair models can be rebuilt")
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix and not spec.suffix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in spec.pieces if k in (NORMAL, USER)):
        # No piece has a mark after another character, so none reaches over such a place: words can be encoded one by one.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return out


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BUILT: dict[str, object] = {}


def built(raw: bytes):
    """The tokenizer of a model, made once in each Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()  # one model at a time
        _BUILT[key] = build(raw)
    return _BUILT[key]


def words_of(raw: bytes) -> Words:
    """The known words of a model, kept in each Python worker from task to task."""
    key = "words " + hashlib.sha256(raw).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Words(raw)
    return _BUILT[key]


def calls(batch: list[str]):
    """Stretches of the batch of about CALL_BYTES each; a longer text is a stretch of its own."""
    part, size = [], 0
    for t in batch:
        if part and size + len(t) > CALL_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_texts(tokenizer, batch: list[str]) -> list[list[int]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return [e.ids for part in calls(batch) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]


class Words:
    """Ids of texts out of the ids of their words, where words can be encoded one by one; each word once.

    The library encodes and decodes the words that are new in a batch, sentencepiece judges them, and what is known is
    kept up to KEPT words. A word is a stretch of marks and what follows up to the next mark.
    """

    KEPT = 300_000

    def __init__(self, raw: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer, self.judge = built(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bare = Tokenizer(self.tokenizer.model)
        spec = read(raw)
        #: whether a text's ids are those of its words: no normaliser but the marks, and no piece over a word's end
        self.apart = self.tokenizer.pre_tokenizer is not None and spec.dummy_prefix and not (spec.squeeze or spec.charsmap or spec.suffix)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.same, self.back = np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        plain = [w[1:].replace(MARK, " ") for w in new]  # the library and sentencepiece put the first mark before it
        ids = encode_texts(self.bare, new)
        # All new words in one text: if that is encoded and decoded alike, so is each of them; else they are told apart.
        joined, flat = " ".join(plain), [k for i in ids for k in i]
        theirs = [self.judge.encode(joined)] == [flat] or self.judge.encode(plain, num_threads=1)
        text = decode_ids(self.tokenizer, [flat]) == [joined] or decode_ids(self.tokenizer, ids)
        start = len(self.flat)
        length = np.array([len(i) for i in ids], np.int64)
        self.first = np.concatenate([self.first, start + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.same = np.concatenate([self.same, np.ones(len(new), bool) if theirs is True else [a == b for a, b in zip(ids, theirs, strict=True)]])
        self.back = np.concatenate([self.back, np.ones(len(new), bool) if text is True else [a == b for a, b in zip(text, plain, strict=True)]])
        for w in new:
            self.known[w] = len(self.known)

    def encode(self, batch: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """For each text its ids, whether sentencepiece gives the same, and whether they decode to the text."""
        if not self.apart:
            ids, theirs = encode_texts(self.tokenizer, batch), self.judge.encode(batch, num_threads=1)
            return [np.array(i, np.int32) for i in ids], [a == b for a, b in zip(ids, theirs, strict=True)], [a == b for a, b in zip(decode_ids(self.tokenizer, ids), batch, strict=True)]
        words, ends = [], [0]
        for text in batch:
            if text:
                words += _WORD.findall(MARK + text.replace(" ", MARK))
            ends.append(len(words))
        if words and words.count(MARK):
            return self._whole(batch, words, ends)
        return self._joined(batch, words, ends)

    def _whole(self, batch, words, ends):
        """A text that ends in a single mark, whose id no shorter text has, is encoded as a whole; the others by words."""
        out = [None] * len(batch)
        rest = []
        for i in range(len(batch)):
            if MARK in words[ends[i] : ends[i + 1]]:
                ids, theirs = encode_texts(self.tokenizer, [batch[i]])[0], self.judge.encode(batch[i])
                out[i] = (np.array(ids, np.int32), ids == theirs, decode_ids(self.tokenizer, [ids])[0] == batch[i])
            else:
                rest.append(i)
        kept, at = [], [0]
        for i in rest:
            kept += words[ends[i] : ends[i + 1]]
            at.append(len(kept))
        for i, row in zip(rest, zip(*self._joined([batch[i] for i in rest], kept, at), strict=True), strict=True):
            out[i] = row
        return tuple(map(list, zip(*out, strict=True)))

    def _joined(self, batch, words, ends):
        if len(self.known) > self.KEPT:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        length = self.length[at]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.flat[np.repeat(self.first[at] - total[:-1], length) + np.arange(total[-1])]
        ids = [flat[total[a] : total[b]] for a, b in zip(ends, ends[1:])]  # noqa: B905
        same = [bool(self.same[at[a:b]].all()) for a, b in zip(ends, ends[1:])]  # noqa: B905
        back = [bool(self.back[at[a:b]].all()) and MARK not in t for t, a, b in zip(batch, ends, ends[1:])]  # noqa: B905
        return ids, same, back


def decode_ids(tokenizer, batch: list[list[int]]) -> list[str]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return tokenizer.decode_batch(batch, skip_special_tokens=False)


def _model(spark, path: str):
    """The model file's bytes, read by Spark and broadcast; model files are of a fixed size, a few MB at most."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:  # a driver's local file
            raw = f.read()
    else:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids of each row of docs (doc_id, text). A null text has null ids, an empty one an empty array."""
    bounded_batches(docs.sparkSession)
    shared = _model(docs.sparkSession, path)

    def run(batches):
        words = words_of(shared.value)
        for batch in batches:
            raw, ids = batch.column(1).to_pylist(), []
            for part in calls([t or "" for t in raw]):
                ids += words.encode(part)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else i for t, i in zip(raw, ids, strict=True)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of each row of tokens (doc_id, ids); null ids have a null text. Bytes that aren't UTF-8 become U+FFFD."""
    bounded_batches(tokens.sparkSession)
    shared = _model(tokens.sparkSession, path)

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            text = decode_ids(built(shared.value), [i or [] for i in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else t for i, t in zip(raw, text, strict=True)], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def verify(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip, parity of each row of docs (doc_id, text), by its whole text.

    ids_sha256 is of the ids as little-endian 32-bit integers; round_trip tells whether decoding the ids gives the text
    again; parity whether sentencepiece gives the same ids. A null text counts as empty, which has no ids. Repeated rows
    are answered one by one; further columns of docs are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = _model(docs.sparkSession, path)

    def run(batches):
        words = words_of(shared.value)
        for batch in batches:
            n, sha, trip, same = [], [], [], []
            for part in calls([t or "" for t in batch.column(1).to_pylist()]):
                ids, equal, back = words.encode(part)
                n += map(len, ids)
                sha += map(digest, ids)
                trip += back
                same += equal
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(trip, pa.bool_()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids, with round trip and parity."""
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
