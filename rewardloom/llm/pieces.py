"""SentencePiece models on the tokenizers library: encoding, decoding and a parity check."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a blank inside pieces
# Fixed values of the model format: kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message in protobuf wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        elif kind == 2:
            size = number()
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not used by these models")
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """What a SentencePiece file says, as far as encoding and decoding need it."""

    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind; the place is the id
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze_blanks: bool
    escape_blanks: bool

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        pieces, kind, fallback = [], UNIGRAM, False
        charsmap, prefix, squeeze, escape = b"", True, True, True
        for field, value in _fields(data):
            if field == 1:
                text, score, own = "", 0.0, NORMAL
                for part, inner in _fields(value):
                    if part == 1:
                        text = inner.decode()
                    elif part == 2:
                        score = struct.unpack("<f", inner)[0]
                    elif part == 3:
                        own = inner
                pieces.append((text, score, own))
            elif field == 2:
                trainer = dict(_fields(value))
                kind, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
                if trainer.get(24, 0):
                    raise ValueError("models with white space as a suffix are not supported")
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, prefix = spec.get(2, b""), bool(spec.get(3, 1))
                squeeze, escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return PieceModel(tuple(pieces), kind, fallback, charsmap, prefix, squeeze, escape)

    def splits_at_marks(self) -> bool:
        """True if no piece goes on over a blank that follows another character.

        The text then falls apart before each run of blanks: no best path crosses the cut.
        """
        return all(MARK not in text.lstrip(MARK) for text, _, _ in self.pieces)


def normalizer_of(model: PieceModel) -> object:
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_blanks:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARK if model.escape_blanks else " "
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence([*steps, normalizers.Prepend(mark)] if model.dummy_prefix else steps)


def _merges(model: PieceModel, ids: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, best score first; a piece's own ways in order of their ids."""
    found = []
    for text, score, kind in model.pieces:
        if kind in (NORMAL, USER_DEFINED):
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                if left in ids and right in ids:
                    found.append((-score, ids[text], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: PieceModel) -> object:
    """A tokenizers object that encodes as the SentencePiece model does, without adding control pieces."""
    from tokenizers import Tokenizer, decoders, models

    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        scored = [(text, score if kind in (NORMAL, USER_DEFINED) else -1e30) for text, score, kind in model.pieces]
        core = models.Unigram(scored, unknown, model.byte_fallback)
    else:
        core = models.BPE(
            vocab={text: i for i, (text, _, _) in enumerate(model.pieces)}, merges=_merges(model, ids),
            unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizer_of(model)
    steps = [decoders.Replace(MARK, " "), *[decoders.ByteFallback()] * model.byte_fallback, decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*steps, *[decoders.Strip(" ", 1, 0)] * model.dummy_prefix])
    return tokenizer


# Texts that every rebuilt tokenizer has to agree on with the library of the model.
PROBES = [
    "", " ", "  ", "a", " a  b ", "Hello\n\nworld\t x", "1234567890 12,345.6", "漢字 \u00e9e\u0301 \U0001F600",
    "<s> </s> <unk> <0x0A>", "    def f(x):\n        return x", "\u00a0x\u200b\ufeff", "a" * 300,
]


def parity_failures(model_bytes: bytes, texts: list[str]) -> list[int]:
    """Places of the texts that the sentencepiece library itself encodes or decodes differently."""
    import sentencepiece

    own, other = build_tokenizer(PieceModel.parse(model_bytes)), sentencepiece.SentencePieceProcessor()
    other.LoadFromSerializedProto(model_bytes)
    wrong = []
    for place, text in enumerate(texts):
        ids = own.encode(text, add_special_tokens=False).ids
        if ids != other.encode(text) or own.decode(ids, skip_special_tokens=False) != other.decode(ids):
            wrong.append(place)
    return wrong


def _slices(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _encoder(sent: object, threads: int, slice_chars: int, check_parity: bool) -> Callable:
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
        tokenizer = build_tokenizer(PieceModel.parse(sent.value))
        other = None
        if check_parity:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor()
            other.LoadFromSerializedProto(sent.value)
        for batch in batches:
            packed, trips, same = [np.empty(0, np.int32)], [], []
            lengths = [0]
            for texts in _slices((v.as_py() or "" for v in batch), slice_chars):
                # Python's numbers of a slice become four bytes each before the next slice is encoded.
                ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                back = tokenizer.decode_batch(ids, skip_special_tokens=False)
                trips += [b == t for b, t in zip(back, texts, strict=True)]
                same += [None] * len(ids) if other is None else [
                    a == b for a, b in zip(ids, other.encode(texts, num_threads=threads), strict=True)]
                packed += [np.array(i, np.int32) for i in ids]
                lengths += map(len, ids)
            missing = batch.is_null()
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(packed), pa.int32()))
            yield pa.StructArray.from_arrays(
                [lists, pa.array(trips, pa.bool_()), pa.array(same, pa.bool_())],
                names=["ids", "round_trip", "parity"], mask=missing)

    return F.arrow_udf(encode, "ids array<int>, round_trip boolean, parity boolean", F.ArrowUDFType.SCALAR_ITER)


def _decoder(sent: object, threads: int) -> Callable:
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
        tokenizer = build_tokenizer(PieceModel.parse(sent.value))
        for batch in batches:
            values = [v.as_py() for v in batch]
            texts = tokenizer.decode_batch([[i for i in v or () if i is not None] for v in values],
                                           skip_special_tokens=False)
            yield pa.array([t if v is not None else None for v, t in zip(values, texts, strict=True)], pa.string())

    return F.arrow_udf(decode, "string", F.ArrowUDFType.SCALAR_ITER)


def encoded(
    documents: DataFrame, model_bytes: bytes, text: str = "text", out: str = "pieces", threads: int = 2,
    slice_chars: int = 1 << 18, check_parity: bool = False,
) -> DataFrame:
    """Documents with a struct ``out``: ids, round_trip (decoding gives the text back), parity.

    The tokenizer is rebuilt from the model file's bytes in each task, after it has
    agreed with the sentencepiece library on ``PROBES``; texts go to it whole, in
    slices of about ``slice_chars`` characters, on ``threads`` threads.
    ``parity`` compares with the sentencepiece library row by row, and is null
    unless asked for. An empty text has no ids; a null text gives a null struct.
    """
    if wrong := parity_failures(model_bytes, PROBES):
        raise ValueError(f"the rebuilt tokenizer differs on probes {wrong}")
    sent = documents.sparkSession.sparkContext.broadcast(model_bytes)
    return documents.withColumn(out, _encoder(sent, threads, slice_chars, check_parity)(F.col(text)))


def decoded(documents: DataFrame, model_bytes: bytes, ids: str, out: str = "text", threads: int = 2) -> DataFrame:
    """Documents with the text of an array of ids; null for a null array, null ids inside are passed over."""
    sent = documents.sparkSession.sparkContext.broadcast(model_bytes)
    return documents.withColumn(out, _decoder(sent, threads)(F.col(ids)))
