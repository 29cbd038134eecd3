"""SentencePiece models on the tokenizers library.

The model file's protobuf is read field by field; its pieces, scores, normaliser and byte pieces become a `tokenizers`
model (BPE merges in order of score, or unigram with its scores) with byte fallback, and the metaspace marker U+2581.
No piece of most models has the marker after another character; then no merge crosses the start of a run of spaces, a
text is the sequence of its space-led chunks, and each distinct chunk of a batch is encoded once, in one multithreaded
call. Each distinct chunk is also encoded by SentencePiece itself, and differences are counted (`parity_diff`); for models
whose chunks cannot be compared alone, whole texts are.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.llm import textops as tx

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bounds of each of the two generations of a worker's table of known chunks: their number, and the bytes of their texts and ids.
KNOWN_CHUNKS = 120_000
KNOWN_BYTES = 8 << 20
#: Threads of a worker's encoder; an executor has a worker for each of its cores.
ENCODE_THREADS = "2"


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: integers, floats as raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def chunks_split(self) -> bool:
        return self.escape and not self.suffix and not any(re.search(f"[^{MARK}]{MARK}", p[0]) for p in self.pieces)


def read_model(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 24:
                    spec.suffix = bool(v)
                elif n == 35:
                    spec.byte_fallback = bool(v)
                elif n == 44:
                    spec.unk_surface = v.decode()
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    return spec


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score of the whole first."""
    known = {p: i for i, (p, _, t) in enumerate(spec.pieces) if t in (NORMAL, USER)}
    found = []
    for p, i in known.items():
        found += [(-spec.pieces[i][1], i, known[p[:k]], known[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    return [(a, b) for *_, a, b in sorted(found)]


def build(spec: Spec):
    """A `tokenizers.Tokenizer` of normalised, marked text."""
    from tokenizers import Tokenizer, models

    if spec.kind == BPE:
        # Distinct chunks are kept by the codec, so the model needs no cache of its own.
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, _merges(spec), unk_token=spec.pieces[spec.unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)
    elif spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk, spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.kind} is not supported")
    return Tokenizer(model)


class Codec:
    """Encodes and decodes texts as SentencePiece does, without special pieces."""

    def __init__(self, raw: bytes, verify: bool = True):
        self.spec = read_model(raw)
        self.tokenizer = build(self.spec)
        self.split = self.spec.chunks_split
        self._normaliser = None
        if self.spec.charsmap:
            from tokenizers import normalizers

            self._normaliser = normalizers.Precompiled(self.spec.charsmap)
        self._judge = None
        if verify:
            import sentencepiece

            self._judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self._bytes = {i: int(p[3:5], 16) for i, (p, _, t) in enumerate(self.spec.pieces) if t == BYTE}
        #: A chunk alone, as a text, is encoded like the chunk only under these settings.
        self._comparable = self.spec.dummy_prefix and not self.spec.squeeze and self.split
        self._plain = [p.replace(MARK, " ") if t in (NORMAL, USER) else None for p, _, t in self.spec.pieces]
        #: Ids of each known chunk, in a younger and an older generation; when the younger is full it becomes the older.
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._young_bytes = 0
        #: The few known chunks whose text is not the chunk itself, or that differ from SentencePiece.
        self._odd: dict[str, tuple[str, bool]] = {}

    def normalise(self, text: str) -> str:
        """The text as the model sees it, spaces unmarked and without the dummy prefix."""
        if self._normaliser is not None:
            text = self._normaliser.normalize_str(text)
        text = text.replace(MARK, " ")
        return re.sub(" +", " ", text).strip(" ") if self.spec.squeeze else text

    def _chunks(self, text: str) -> list[str]:
        """Space-led chunks of a normalised text, each without its first marker."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, held = [], ""
        for p in parts[:-1]:
            if p:
                out.append(held + p)
                held = ""
            else:
                held += MARK
        out.append(held + parts[-1])
        return out

    def _surface(self, ids: list[int]) -> str:
        try:
            return "".join([self._plain[i] for i in ids])
        except TypeError:
            pass
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self._bytes:
                raw.append(self._bytes[i])
                continue
            if raw:
                out.append(_decode_bytes(bytes(raw)))
                raw.clear()
            if i >= 0:
                p, _, t = self.spec.pieces[i]
                out.append(self.spec.unk_surface if t == UNKNOWN else "" if t == CONTROL else p)
        return "".join(out).replace(MARK, " ")

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(self._young) >= KNOWN_CHUNKS or self._young_bytes >= KNOWN_BYTES:
            self._old, self._young, self._young_bytes = self._young, {}, 0
        self._young[chunk] = ids
        self._young_bytes += len(chunk) + len(ids)

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of the chunks; those not yet known are encoded in one multithreaded call and held against SentencePiece.

        The ids are this backend's own; where SentencePiece has others the chunk is counted as differing.
        """
        out: dict[str, bytes] = {}
        new = []
        for c in chunks:
            if (ids := self._young.get(c)) is not None:
                out[c] = ids
            elif (ids := self._old.pop(c, None)) is not None:
                out[c] = ids
                self._keep(c, ids)
            else:
                new.append(c)
        lead = MARK if self.spec.dummy_prefix or self.split else ""
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            mine = [e.ids for e in self.tokenizer.encode_batch_fast([lead + c for c in part], add_special_tokens=False)]
            truth = self._judge.encode(part, num_threads=1) if self._judge is not None and self._comparable else mine
            for c, ids, other in zip(part, mine, truth, strict=True):
                out[c] = packed = array("i", ids).tobytes()
                self._keep(c, packed)
                same = ids == other or not c
                surface = self._surface(ids)
                if not same or surface != (lead + c).replace(MARK, " "):
                    self._odd[c] = surface, same
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, int | None]]:
        """(ids as little-endian 32-bit integers, decoded text, parity difference) of each text.

        The difference is the number of chunks whose ids are not SentencePiece's; where chunks alone cannot be compared, whole
        texts are, and it is 0 or 1; without verification it is None.
        """
        clear = [self.normalise(t) for t in texts]
        cut = [(self._chunks(t) if self.split else [t]) if t else [] for t in clear]
        out = []
        lead = " " if self.spec.dummy_prefix or self.split else ""
        for at in range(0, len(cut), 64):
            part = cut[at : at + 64]
            if len(self._odd) > KNOWN_CHUNKS:
                # Odd chunks are few in any language the model knows; beyond the bound all is learnt anew.
                self._odd.clear()
                self._old.clear()
                self._young.clear()
                self._young_bytes = 0
            known = self.learn(set().union(*part))
            for k, chunks in enumerate(part):
                odd = not self._odd.keys().isdisjoint(chunks)
                if odd:
                    surface = "".join([self._odd[c][0] if c in self._odd else lead + c.replace(MARK, " ") for c in chunks])
                else:
                    surface = lead + clear[at + k] if chunks else ""
                first = self.spec.dummy_prefix and surface.startswith(" ")
                ids = b"".join(map(known.__getitem__, chunks))
                diff = sum(c in self._odd and not self._odd[c][1] for c in chunks) if odd else 0
                if self._judge is None:
                    diff = None
                elif not self._comparable:
                    diff = int(array("i", self._judge.encode(texts[at + k])).tobytes() != ids)
                out.append((ids, surface[1:] if first else surface, diff))
        return out


def _decode_bytes(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is not part of a character, as SentencePiece does."""
    out = []
    at = 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def token_rows(docs: DataFrame, model_path: str, text_col: str = "text", verify: bool = True, with_text: bool = True) -> DataFrame:
    """`docs` without its text, with n_tokens, token_ids (binary, 32-bit little-endian), decoded and parity_diff in place of
    columns of those names.

    Null and empty texts have no tokens. A text that holds the marker U+2581 decodes with a space in its place, as
    SentencePiece has it. The model file is read on the driver and sent along, so executors need no file of their own.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    docs = docs.drop("n_tokens", "token_ids", "decoded", "parity_diff")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    key = hashlib.sha256(raw).hexdigest() + str(verify)
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(key)
        if codec is None:
            os.environ.setdefault("RAYON_NUM_THREADS", ENCODE_THREADS)
            tx.release()
            codec = _CODECS[key] = Codec(shared.value, verify)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = codec.encode([t or "" for t in part.column(text_col).to_pylist()])
                made = {"n_tokens": pa.array([len(g[0]) // 4 for g in got], pa.int64()), "token_ids": pa.array([g[0] for g in got], pa.binary()), "parity_diff": pa.array([g[2] for g in got], pa.int32())}
                if with_text:
                    made["decoded"] = pa.array([g[1] for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made.values()], names=[*kept, *made])
            tx.trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    return docs.mapInArrow(run, f"{fields}, n_tokens long, token_ids binary, parity_diff int" + ", decoded string" * with_text)
