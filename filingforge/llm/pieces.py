"""SentencePiece encoding and decoding of BPE models by a table of last tokens.

Merging symbols by score, each prefix of a text has one encoding, and so one last token. The table stores it: an automaton
over the pieces gives, for each position, the pieces that end there; of these the one is right that is compatible with
the last token of the prefix before it, that is, the pair on its own is encoded as these two pieces. (Within a text, the
first merge across a token boundary depends on the tokens beside it alone, so that compatible neighbours are enough.) Ids
are then read from the table backwards. Pairs are tested once a worker, by merging the few characters of the two.

A text falls into units that no piece crosses, cut before runs of spaces and at control characters that no piece holds;
units are encoded on their own and remembered, in two generations of bounded size. Where the vocabulary has a piece with
a space behind another character, a text is one unit.

Characters outside of all pieces become their bytes, or the unknown id in models without bytes. Decoding is the
inverse: bytes form characters again, a byte that can't is U+FFFD, and the space in front of the first piece goes.

Defined results: a null text is an empty one, which has the end id only and decodes to nothing; U+2581 counts as a
space, as in the library; a very long text without spaces is one unit, in memory for its own length; repeated rows are rows of
their own, a null id stays null; an empty table gives an empty result; other columns are ignored, whatever their names.
Models other than BPE without normalisation rules, user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.session import spread

from .common import arrow_schema, slices, small_batches

SPACE = "▁"
#: Units and pairs that a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Characters that most vocabularies keep out of pieces: where this one does, they cut units.
CONTROLS = "\t\n\r\x0b\x0c"
#: The columns that can be asked for.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


class Memory(dict):
    """A dict of two generations: when the young one is full the old one is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Pieces:
    """A BPE vocabulary with its automaton and its tables."""

    def __init__(self, model: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(model, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = pb.ModelProto.SentencePiece
        rules, trainer = spec.normalizer_spec, spec.trainer_spec
        odd = {p.type for p in spec.pieces} & {kinds.USER_DEFINED, kinds.UNUSED}
        plain = not rules.precompiled_charsmap and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
        if trainer.model_type != pb.TrainerSpec.BPE or odd or not plain:
            raise ValueError(f"{model}: only BPE models without normalisation rules are supported")
        self.prefix = " " if rules.add_dummy_prefix else ""
        texts = [p.piece.replace(SPACE, " ") for p in spec.pieces]
        self.scores = {texts[i]: p.score for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.ids = {texts[i]: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.pairs_of_chars = {t[i : i + 2] for t in self.scores for i in range(len(t) - 1)}
        # Characters are symbols of their own, pieces or not; the latter have numbers behind the vocabulary.
        loose = sorted({c for t in self.scores for c in t} - self.ids.keys())
        self.texts = texts + loose
        numbers = self.ids | {c: len(texts) + i for i, c in enumerate(loose)}
        self.sizes = [len(t) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for t, i in numbers.items():
            if self.merged(t) == [t]:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        named = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = [named[f"<0x{b:02X}>"] for b in range(256)] if trainer.byte_fallback else None
        self.byte_of = {i: b for b, i in enumerate(self.bytes or [])}
        self.end = next((i for i, p in enumerate(spec.pieces) if p.piece == (trainer.eos_piece or "</s>")), None)
        self.controls = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.spaced = {i for t, i in self.ids.items() if t.startswith(" ")} if self.prefix else set()
        surface = trainer.unk_surface.encode()
        self.written = [b"" if i in self.controls else surface if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(texts)]
        self.decimal = [str(i) for i in range(len(texts))]
        cuts = "".join(c for c in CONTROLS if not any(c in t for t in self.scores))
        inner = any(a != " " and b == " " for a, b in self.pairs_of_chars)
        self.units = re.compile("(?s).+" if inner else f" +[^ {cuts}]*|[{cuts}]|[^ {cuts}]+" if cuts else " +[^ ]*|[^ ]+")
        self.compatible, self.encoded = Memory(self.pair), Memory(self.unit)

    def merged(self, text: str) -> list[str]:
        """The pieces of a few characters: the neighbours of the best score are merged, of equal ones the leftmost."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            found = [(-s, i) for i in range(len(parts) - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pair(self, key: int) -> bool:
        """Whether the pieces of a pair (left << 32 | right) are what their joined text is encoded as."""
        left, right = self.texts[key >> 32], self.texts[key & 0xFFFFFFFF]
        return left[-1] + right[0] not in self.pairs_of_chars or self.merged(left + right) == [left, right]

    def unit(self, text: str) -> bytes:
        """The ids of one unit, 32 bits each."""
        last, sizes, compatible = [-1] * (len(text) + 1), self.sizes, self.compatible
        for at, token in self.automaton.iter(text):
            if last[at + 1] < 0:
                before = at + 1 - sizes[token]
                # No token ends before: the text begins there, or behind a character that no piece holds.
                if before == 0 or (left := last[before]) < 0 or compatible[left << 32 | token]:
                    last[at + 1] = token
        out, at, known = [], len(text), len(self.written)
        while at:
            token = last[at]
            if 0 <= token < known:
                out.append(token)
                at -= sizes[token]
            else:
                out.extend([self.bytes[b] for b in reversed(text[at - 1].encode())] if self.bytes else [self.unknown])
                at -= 1
        if not self.bytes:  # neighbouring unknown characters share one id
            out = [t for i, t in enumerate(out) if t != self.unknown or i == 0 or out[i - 1] != t]
        return array("I", out[::-1]).tobytes()

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        if not text:
            return []
        return memoryview(b"".join(map(self.encoded.__getitem__, self.units.findall(self.prefix + text.replace(SPACE, " "))))).cast("I").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes on both sides of a control don't join."""
        runs, first = [], next((i for i in ids if i not in self.controls), None)
        while (cut := next((k for k, i in enumerate(ids) if i in self.controls), len(ids))) < len(ids):
            runs.append(ids[:cut])
            ids = ids[cut + 1 :]
        text = "".join(characters(b"".join(map(self.written.__getitem__, run))) for run in [*runs, ids])
        return text[1:] if first in self.spaced else text


def characters(raw: bytes) -> str:
    """Bytes as text; a byte that forms no character is U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="surrogateescape").translate(dict.fromkeys(range(0xDC80, 0xDD00), "\ufffd"))


@cache
def vocabulary(model: str) -> Pieces:
    """The vocabulary of a file, read once a process."""
    return Pieces(model)


def default_model() -> str:
    """The installed public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", end: bool = True, outputs: Sequence[str] = ("ids", "n_tokens")) -> DataFrame:
    """key and the outputs asked for: ids with the end id, their number, the text they decode to, and SHA-256 digests.

    The model is a file on every machine. One narrow pass; half a megabyte of text is in work at a time.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        tail = [pieces.end] if end else []

        def row(content: str | None) -> dict:
            ids = pieces.encode(content or "") + tail
            out: dict = {"ids": ids, "n_tokens": len(ids)}
            if "ids_sha256" in outputs:
                out["ids_sha256"] = hashlib.sha256(" ".join(map(pieces.decimal.__getitem__, ids)).encode()).hexdigest()
            if "decoded" in outputs or "decoded_sha256" in outputs:
                out["decoded"] = pieces.decode(ids)
                out["decoded_sha256"] = hashlib.sha256(out["decoded"].encode()).hexdigest()
            return out

        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                rows = [row(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key").cast(shape.field("key").type), *(pa.array([r[o] for r in rows], shape.field(o).type) for o in outputs)], schema=shape)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text: what the ids of each row decode to; null ids are none."""
    source = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, text string"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(shape.field("key").type), pa.array(texts, pa.string())], schema=shape)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with an end id and decoded again, as digests of ids and texts."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encode_documents(docs, default_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
