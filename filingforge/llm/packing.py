"""Packing of token ids into sequences of bounded length by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and one closing id. Pieces of a full sequence are cut from its front; what is left
over, a tail, is cut into pieces that wait in a pool. When the pool holds tokens for a given number of windows, or very
many pieces, they are spread over windows: small pieces are gathered into parts of some hundred tokens; every part starts
as a partial partition of windows with that part in one of them; the two partial partitions of the largest imbalance are
merged again and again, the fullest windows of one with the emptiest of the other, until one partition is left, whose
windows are near equal. If a window exceeds the capacity, the number of windows rises and the pool is packed again.

A pool lives inside one partition of the input, so nothing is shuffled, and a lost task repeats exactly its own
sequences. Both its tokens and its pieces are bounded, and parts are gathered from pieces, so tables of empty or tiny
texts need no more memory than others. Sequence ids are partition number * 2^40 + count.

Defined results: a null or empty text has the closing id alone; a very long text is cut like any other; repeated rows are
packed each for itself; an empty table gives no pieces; columns beyond key and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from filingforge.session import spread

from .common import arrow_schema, slices

#: Windows that a pool is packed into.
POOL_WINDOWS = 192
#: Tokens of the parts that tails are cut into, so that differencing has several for each window.
CUT = 256
#: Pieces of a pool at most, and the part of a cut that small pieces are gathered to.
POOL_PIECES, GATHER = 32_768, 0.25
#: Entries of a worker's memory of words, characters of the longest of them (longer ones rarely come again), and unknown
#: words after which a full memory starts anew.
MEMORY, REMEMBERED, PATIENCE = 600_000, 12, 8_000_000


def byte_alphabet() -> dict[str, int]:
    """The published mapping of byte-level BPE: printable Latin-1 characters stand for themselves, other bytes for 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """Ids by word; a word that isn't there is encoded, and kept if it is short and there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.misses = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(word) <= REMEMBERED:
            if len(self) < MEMORY:
                self[word] = ids
            else:
                self.misses += 1
                if self.misses >= PATIENCE:
                    self.clear()
                    self.misses = 0
        return ids


class WordTokenizer:
    """Byte-level BPE ids of texts, word by word with a memory of bounded size.

    path: a `tokenizers` file. Its vocabulary is run by tiktoken where ids follow the order of merges, which is
    checked; a text is cut only before a space or around a line feed that stands before a visible character, where the
    pre-tokeniser of such files always cuts too. The file's added tokens, such as <|endoftext|>, are cut out first and
    have their own ids, as in `tokenizers`; files whose added tokens take spaces or whole words with them are refused.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, added = content["model"], {t["content"]: t for t in content.get("added_tokens") or []}
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(vocabulary[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the vocabulary's ids don't follow its merges")
        if content.get("normalizer") or any(t[flag] for t in added.values() for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens are found in texts as they are, without conditions")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed as little-endian 32-bit numbers")
        special = set(vocabulary) - {a + b for a, b in merges} - set(alphabet)
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.encoding = tiktoken.Encoding("words", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unsafe = re.compile(r"[ \n](?=\s|$)|\x01")
        self.memory = Memory(self.encoding.encode_ordinary)
        self.added = {token: array("I", [t["id"]]).tobytes() for token, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ids(self, text: str) -> bytes:
        """The ids, each as an unsigned little-endian 32-bit number."""
        if self.cut and self.cut.search(text):
            return b"".join(self.added[part] if i % 2 else self.ordinary(part) for i, part in enumerate(self.cut.split(text)))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if self.unsafe.search(text):
            return array("I", self.encoding.encode_ordinary(text)).tobytes()
        return b"".join(map(self.memory.__getitem__, text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")))


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway Karmarkar-Karp differencing."""
    if windows == 1 or not len(sizes):
        return np.zeros(len(sizes), dtype=np.int64)
    # A node is a partial partition: window sums in falling order. left[i], right[i]: the nodes that node len(sizes) + i
    # was merged from; turn[i]: for each of its windows, the window of the left node (the right's is its mirror).
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        start = np.zeros(windows, dtype=np.int64)
        start[0] = size
        sums[i] = start
        heap.append((-size, i))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = len(sizes) + len(merged)
        merged.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (-int(both[0] - both[-1]), node))
    out = np.zeros(len(sizes), dtype=np.int64)
    places = {heap[0][1]: np.arange(windows)}  # where a node's windows stand in the end
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        final = np.empty(windows, dtype=np.int64)
        final[order] = places.pop(len(sizes) + k)
        for node, own in ((a, final), (b, final[::-1])):
            if node < len(sizes):
                out[node] = own[0]
            else:
                places[node] = own
    return out


def gathered(sizes: np.ndarray, least: float) -> np.ndarray:
    """The part of each size: neighbours that are smaller than `least` share one until together they are not."""
    part, held, number = np.zeros(len(sizes), np.int64), 0.0, -1
    for i, size in enumerate(sizes.tolist()):
        if size >= least or held >= least or held == 0:
            number, held = number + 1, 0.0 if size >= least else size
        else:
            held += size
        part[i] = number
    return part


def pack_tails(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, of which none exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        place = differencing(sizes, windows)
        if np.bincount(place, weights=sizes, minlength=windows).max(initial=0) <= capacity:
            return place, windows
        windows += 1


def pack_documents(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, cut: int = CUT, pool_windows: int = POOL_WINDOWS) -> DataFrame:
    """A row for each piece: key, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    shape = arrow_schema(schema)
    end = np.array([end_id], dtype="<u4").tobytes()
    #: A pool is closed while a window in some hundreds is still empty, so that near-equal windows fit.
    fill = pool_windows * capacity - pool_windows // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = WordTokenizer(vocabulary)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []
        pool: list[tuple] = []
        pooled = held = 0

        def close() -> None:
            nonlocal sequence, pooled
            if not pool:
                return
            pool.sort(key=lambda x: -x[2])
            sizes = np.array([x[2] for x in pool], dtype=np.int64)
            part = gathered(sizes, cut * GATHER)
            of_part, windows = pack_tails(np.bincount(part, weights=sizes).astype(np.int64), capacity)
            place, at = of_part[part], [0] * windows
            for piece, window in zip(pool, place.tolist(), strict=True):
                rows.append((*piece, sequence + window, at[window]))
                at[window] += piece[2]
            sequence += windows
            pool.clear()
            pooled = 0

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
            rows.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for name, content in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = tokenizer.ids(content or "") + end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        rows.append((name, start, capacity, ids[4 * start : 4 * (start + capacity)], total, sequence, 0))
                        sequence += 1
                    for start in range(whole, total, cut):
                        length = min(cut, total - start)
                        if pooled + length > fill or len(pool) >= POOL_PIECES:
                            close()
                        pool.append((name, start, length, ids[4 * start : 4 * (start + length)], total))
                        pooled += length
                    held += total
                    if rows and (held > 1 << 20 or len(rows) >= POOL_PIECES):
                        yield emit()
                        held = 0
        close()
        if rows:
            yield emit()

    return source.mapInArrow(pack, schema).withColumnRenamed("key", key)


def with_digests(pieces: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast(LongType())).drop("ids")


def default_vocabulary() -> str:
    """The installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), default_vocabulary())
    return with_digests(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
