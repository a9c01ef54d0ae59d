"""Language identification by a linear-chain conditional random field over words.

A word is a run of ASCII letters and non-ASCII characters; spaces and punctuation of the Unicode blocks U+0080 to U+00BF,
U+2000 to U+206F, U+3000 to U+303F and U+FF00 to U+FF0F end words like those of ASCII. Its features are byte n-grams of 2 to 4 with word edges,
prefixes and suffixes of 1 to 4, and membership in a lexicon of each language; transitions between languages are
learned too. Forward-backward gives each word of a whole text its distribution over languages, also where the text
switches between them; the text's language is the one with the most expected words, its score their share.

Training reads a bounded sample of labelled rows: up to `sample_docs` documents of each language, whichever languages
there are (fewer of each where there are more than 22), of each a few segments from places all over the text. Rows are drawn within each language, so copies of one
text can neither crowd out a language nor leave it out. Segments of different languages are strung together, so that the
chain sees switches. Statistics and predictions cover all rows and whole texts. The model holds a weight for each hashed
feature that training met and each language.

Long texts are cut into blocks for speed alone: transfer matrices of blocks carry the messages of forward-backward from
block to block, so the result is that of one chain.

Defined results: a null text, and one without a letter, is `und` with score 0, as are all where no row is labelled; a
null key is in training; rows that repeat are judged alike; a very long text or word is read whole; other columns are
ignored, and carried ones may have any names but those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingforge.session import spread

from .common import arrow_schema, slices, small_batches
from .words import LOWER, M1, Words, mixed, split_words, text_bytes, word_hashes

#: Documents of each language in training at most, segments of each, and words of a segment.
SAMPLE_DOCS, SEGMENTS, SEGMENT_WORDS = 400, 3, 24
#: Where there are many languages, a language's share of the sample shrinks with their number squared: words times
#: languages, which training holds, stay bounded. 22 languages still get SAMPLE_DOCS each, 60 get 55.
SHARED_DOCS = 200_000
#: Numbers that a step of training works on at once.
TRAIN_CELLS = 1 << 21
#: Slots of hashed features.
TABLE = 1 << 17
#: Bytes of text that are worked on at once, about; working memory is some forty times that.
SLICE_BYTES = 1 << 19
#: Words of a block of forward-backward.
BLOCK = 32

#: Everything in ASCII but letters (after folding A-Z).
NOT_LETTER = np.zeros(256, dtype=bool)
NOT_LETTER[[*range(0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Model:
    """Languages; the row of weights of each feature slot (0: never met) and these weights; weights of lexicons, of transitions and of first words; lexicons as sorted word hashes with language bits."""

    languages: list[str]
    slots: np.ndarray
    features: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    lexicon_words: np.ndarray
    lexicon_bits: np.ndarray


def letter_words(column: pa.Array) -> Words:
    """The words of every text of the column."""
    content, offsets = text_bytes(column)
    wide = content >= 0x80
    if wide.any():
        lead = np.concatenate([content, np.zeros(2, np.uint8)])
        a, b, c = lead[:-2], lead[1:-1], lead[2:]
        # Feminine and masculine ordinals and the micro sign are letters.
        latin = (a == 0xC2) & ~np.isin(b, [0xAA, 0xB5, 0xBA])
        three = ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80) & ~np.isin(c, [0x85, 0x86, 0x87])) | ((a == 0xEF) & (b == 0xBC) & (c < 0x90))
        content = content.copy()
        for start, length in ((latin, 2), (three, 3)):
            at = np.flatnonzero(start)
            for d in range(length):
                content[np.minimum(at + d, len(content) - 1)] = 0x20
        column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(content))
    return split_words(column, NOT_LETTER, lower=True)


def unique_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the number of one occurrence of each, and each word's number among them."""
    return np.unique(word_hashes(words), return_index=True, return_inverse=True)


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each of the words, and the word each belongs to (both in the order of words)."""
    starts, lengths = words.starts[which], words.lengths[which]
    # Each word between two edge bytes, all in one buffer.
    sizes = lengths + 2
    begin = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()) + 8, 0x20, np.uint8)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(begin + 1, lengths) + inner] = words.data[np.repeat(starts, lengths) + inner]
    eights = np.ndarray((len(flat) - 7,), dtype="<u8", buffer=flat, strides=(1,))
    owner = np.repeat(np.arange(len(which)), sizes)
    end = np.repeat(begin + sizes, sizes)
    at = np.arange(len(owner))
    rows, owners = [], []

    def add(place: np.ndarray, own: np.ndarray, n: int, salt: int) -> None:
        value = eights[place] & np.uint64((1 << (8 * n)) - 1)
        rows.append((mixed(value * M1 + np.uint64(salt)) >> np.uint64(64 - 17)).astype(np.int64))
        owners.append(own)

    for n in (2, 3, 4):
        fits = at + n <= end
        add(at[fits], owner[fits], n, n)
    numbers = np.arange(len(which))
    for n in (1, 2, 3, 4):
        long = lengths >= n
        add(begin[long] + 1, numbers[long], n, 16 + n)
        add(begin[long] + 1 + lengths[long] - n, numbers[long], n, 32 + n)
    return np.concatenate(rows), np.concatenate(owners)


def lexicon_membership(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Which languages' lexicons hold each word."""
    out = np.zeros((len(hashes), len(model.languages)))
    if len(model.lexicon_words):
        at = np.minimum(np.searchsorted(model.lexicon_words, hashes), len(model.lexicon_words) - 1)
        hit = model.lexicon_words[at] == hashes
        out[hit] = model.lexicon_bits[at[hit]]
    return out


def summed(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by owner."""
    return np.stack([np.bincount(owners, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1)


def emissions(model: Model, words: Words) -> np.ndarray:
    """Scores of each word for each language."""
    hashes, one, inverse = unique_words(words)
    scores = np.zeros((len(one), len(model.languages)))
    step = 1 << 15
    for i in range(0, len(one), step):
        rows, owners = word_features(words, one[i : i + step])
        scores[i : i + step] = summed(model.features[model.slots[rows]], owners, len(one[i : i + step]))
    scores += lexicon_membership(model, hashes) @ model.lexicon_weights
    return scores[inverse]


def _scaled(x: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.max(axis=axis, keepdims=True), 1e-300)


def expected_words(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each text, the expected number of its words in each language, by forward-backward over its whole chain."""
    total, states = scores.shape
    texts = len(first) - 1
    out = np.zeros((texts, states))
    if not total:
        return out
    counts = np.diff(first)
    blocks = -(-counts // block)
    owner = np.repeat(np.arange(texts), blocks)
    ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    place = (first[owner] + ordinal * block)[:, None] + np.arange(block)[None, :]
    real = place < first[owner + 1][:, None]
    x = np.exp(scores - scores.max(axis=1, keepdims=True))[np.minimum(place, total - 1)]
    a, s = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    opening = ordinal == 0
    # Transfer matrices of blocks; the first word of a text forgets what stands before it.
    moves = np.where(opening[:, None, None], np.broadcast_to(s, (states, states)), a) * x[:, 0, None, :]
    for t in range(1, block):
        moves = np.where(real[:, t, None, None], _scaled((moves @ a) * x[:, t, None, :], (1, 2)), moves)
    before, behind = np.ones((len(owner), states)), np.ones((len(owner), states))
    by_ordinal = np.argsort(ordinal, kind="stable")
    edges = np.searchsorted(ordinal[by_ordinal], np.arange(int(blocks.max()) + 1))
    for k in range(1, int(blocks.max())):
        rows = by_ordinal[edges[k] : edges[k + 1]]
        before[rows] = _scaled(np.einsum("pi,pij->pj", before[rows - 1], moves[rows - 1]), 1)
    for k in range(int(blocks.max()) - 1, 0, -1):
        rows = by_ordinal[edges[k] : edges[k + 1]]
        behind[rows - 1] = _scaled(np.einsum("pij,pj->pi", moves[rows], behind[rows]), 1)
    forward = np.empty_like(x)
    state = np.where(opening[:, None], s, before @ a) * x[:, 0]
    forward[:, 0] = state = _scaled(state, 1)
    for t in range(1, block):
        forward[:, t] = state = _scaled((state @ a) * x[:, t], 1)
    back = behind
    for t in range(block - 1, -1, -1):
        if t < block - 1:
            back = np.where(real[:, t + 1, None], _scaled((x[:, t + 1] * back) @ a.T, 1), back)
        both = forward[:, t] * back
        both /= np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
        both[~real[:, t]] = 0
        forward[:, t] = both
    per_block = forward.sum(axis=1)
    for j in range(states):
        out[:, j] = np.bincount(owner, weights=per_block[:, j], minlength=texts)
    return out


class Groups:
    """Sums of rows by group, a bounded number of rows at a time. rows: the row of each entry; every group has entries."""

    def __init__(self, groups: np.ndarray, rows: np.ndarray, n: int):
        order = np.argsort(groups, kind="stable")
        self.rows, self.n = rows[order], n
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))])

    def sums(self, values: np.ndarray) -> np.ndarray:
        out, at, limit = np.empty((self.n, values.shape[1]), np.float32), 0, max(1, TRAIN_CELLS // values.shape[1])
        while at < self.n:
            stop = max(at + 1, int(np.searchsorted(self.edges, self.edges[at] + limit, side="right")) - 1)
            low, high = self.edges[at], self.edges[stop]
            out[at:stop] = np.add.reduceat(values[self.rows[low:high]], self.edges[at:stop] - low, axis=0)
            at = stop
        return out


def expectations(x: np.ndarray, real: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded chains of word scores: the distribution of each word, and the expected moves between languages over all chains.

    Moves are added up step by step, so memory is that of the words, however many languages there are.
    """
    width = x.shape[1]
    forward, back = np.empty_like(x), np.ones_like(x)
    forward[:, 0] = _scaled(s * x[:, 0], 1)
    for t in range(1, width):
        forward[:, t] = np.where(real[:, t, None], _scaled((forward[:, t - 1] @ a) * x[:, t], 1), forward[:, t - 1])
    pair = np.zeros_like(a)
    for t in range(width - 2, -1, -1):
        ahead = x[:, t + 1] * back[:, t + 1]
        back[:, t] = np.where(real[:, t + 1, None], _scaled(ahead @ a.T, 1), back[:, t + 1])
        weight = ((forward[:, t] @ a) * ahead).sum(axis=1)
        pair += (forward[:, t] * (real[:, t + 1] / np.maximum(weight, 1e-300))[:, None]).T @ ahead
    node = forward * back
    return node / np.maximum(node.sum(axis=2, keepdims=True), 1e-300) * real[:, :, None], pair * a


def train(samples: list[tuple[str, list[str]]], languages: list[str], *, rounds: int = 60, rate: float = 0.15, decay: float = 1e-3, seed: int = 7) -> Model:
    """The model that maximises the likelihood of the segments' labels. samples: (language, words), all words non-empty.

    Segments are strung together, three by three, in seeded random order; each word has its segment's language.
    """
    number = {x: i for i, x in enumerate(languages)}
    states = len(languages)
    random = np.random.default_rng(seed)
    samples = [samples[i] for i in random.permutation(len(samples))]
    text = [" ".join(w) for _, w in samples]
    words = letter_words(pa.array(text, pa.string()))
    label = np.repeat([number[x] for x, _ in samples], words.counts())
    hashes, one, inverse = unique_words(words)
    # Lexicons from every other segment: the others show the model what a word outside of them looks like.
    learned = np.repeat(np.arange(len(samples)) % 2 == 0, words.counts())
    seen = np.stack([np.bincount(inverse[learned & (label == j)], minlength=len(hashes)) for j in range(states)], axis=1)
    known = seen.max(axis=1) >= 2
    model = Model(languages, np.zeros(TABLE, np.int32), np.zeros((1, states)), np.zeros((states, states)), np.zeros((states, states)), np.zeros(states), hashes[known], (seen[known] >= 2).astype(float))
    rows, owners = word_features(words, one)
    used, slot = np.unique(rows, return_inverse=True)
    member = lexicon_membership(model, hashes).astype(np.float32)
    # Chains of three segments; a step works on a block of them, padded to the longest.
    chain = np.repeat(np.arange(len(samples)) // 3, words.counts())
    sizes = np.bincount(chain, minlength=-(-len(samples) // 3))
    begin = np.cumsum(sizes) - sizes
    width = int(sizes.max(initial=0))
    block = max(1, TRAIN_CELLS // max(1, width * states))
    parts = [(begin[i : i + block], sizes[i : i + block]) for i in range(0, len(sizes), block)]
    of_word, of_slot, of_place = Groups(owners, slot, len(one)), Groups(slot, owners, len(used)), Groups(inverse, np.arange(len(inverse)), len(one))
    parameters = [np.zeros((len(used), states), np.float32), model.lexicon_weights, model.transitions, model.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    off, total = np.empty((len(label), states), np.float32), max(len(label), 1)
    for step in range(1, rounds + 1):
        weights, lexicon, transitions, first = parameters
        scores = of_word.sums(weights) + (member @ lexicon).astype(np.float32)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        pairs, opening = np.zeros((states, states)), np.zeros(states)
        for starts, lengths in parts:
            place = np.minimum(starts[:, None] + np.arange(width)[None, :], len(label) - 1)
            real = np.arange(width)[None, :] < lengths[:, None]
            node, pair = expectations(scores[inverse[place]].astype(float), real, np.exp(transitions), np.exp(first))
            k, t = np.nonzero(real)
            node[k, t, label[place[k, t]]] -= 1
            off[place[k, t]] = node[k, t]
            opening += node[:, 0].sum(axis=0)
            k, t = np.nonzero(real[:, 1:])
            pairs += pair - np.bincount(label[place[k, t]] * states + label[place[k, t + 1]], minlength=states * states).reshape(states, states)
        by_word = of_place.sums(off)
        slopes = [of_slot.sums(by_word), member.T @ by_word, pairs, opening]
        for p, g, (m, v) in zip(parameters, slopes, moments, strict=True):
            g = g / total * 100 + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
    model.slots[used] = np.arange(1, len(used) + 1)
    model.features = np.concatenate([np.zeros((1, states)), parameters[0]]).astype(np.float32)
    return model


def training_samples(rows: DataFrame, *, key: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Languages and segments of a sample of labelled rows, at most `sample_docs` rows of each language."""
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text, F.lit(11)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # a row a language
    if not counts:
        return [], []
    languages = sorted(r["lang"] for r in counts)
    sample_docs = max(1, min(sample_docs, SHARED_DOCS // len(languages) ** 2))
    # About twice as many rows as wanted pass by their own hash, and in any case the first of each language; of these,
    # the first by hash are taken.
    spark = rows.sparkSession
    plan = spark.createDataFrame([(r["lang"], min(1.0, 2 * sample_docs / r["n"]), r["least"]) for r in counts], "lang string, share double, least long")
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.join(F.broadcast(plan), "lang").where((draw < F.col("share")) | (F.col("h") == F.col("least")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = drawn.withColumn("number", number).where(F.col("number") <= sample_docs).select("lang", "text", (F.col("h") + F.col("number")).alias("h"))
    shape = arrow_schema("lang string, h long, segments array<string>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = letter_words(part.column("text"))
                out = []
                for i, h in enumerate(part.column("h").to_pylist()):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    random, found = np.random.default_rng(h & 0xFFFFFFFF), []
                    for _ in range(SEGMENTS if b > a else 0):
                        at = a + int(random.integers(max(b - a - SEGMENT_WORDS, 0) + 1))
                        span = range(at, min(at + SEGMENT_WORDS, b))
                        found.append(" ".join(words.data[words.starts[k] : words.starts[k] + words.lengths[k]].tobytes().decode() for k in span))
                    out.append(found)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(out, pa.list_(pa.string()))], schema=shape)

    got = chosen.mapInArrow(cut, "lang string, h long, segments array<string>").collect()
    got.sort(key=lambda r: (r["h"], r["lang"]))
    return languages, [(r["lang"], words) for r in got for s in r["segments"] if (words := s.split())]


def held_out_column(key: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the key as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """The model learned from labelled rows that aren't held out; None if there are none."""
    rows = docs.where(~held_out_column(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages, samples = training_samples(rows, key="key", text="text", lang="lang", sample_docs=sample_docs)
    languages = sorted({x for x, _ in samples})
    return train(samples, languages) if samples else None


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The columns to carry, lang_pred, score, and n_words by language (in the order of the model's languages)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.struct(*carry).alias("__row"), F.col(text).alias("__text"))
    full = source.select("__row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("words_by_language")).schema
    shape = arrow_schema(full)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "__text", SLICE_BYTES):
                n = part.num_rows
                words = letter_words(part.column("__text"))
                states = len(model.languages) if model else 0
                found = expected_words(emissions(model, words), words.first, model.transitions, model.first) if states else np.zeros((n, 0))
                total = words.counts()
                # A text without an ASCII letter may still hold another.
                content = LOWER[words.data[: words.offsets[-1]]]
                ascii_letters = np.concatenate([[0], np.cumsum((content >= 0x61) & (content <= 0x7A))])
                letter = np.diff(ascii_letters[words.offsets]) > 0
                for i in np.flatnonzero(~letter & (total > 0)).tolist():
                    letter[i] = any(c.isalpha() for c in part.column("__text")[i].as_py())
                if states:
                    best = found.argmax(axis=1)
                    score = np.where(letter, np.clip(found[np.arange(n), best] / np.maximum(total, 1), 0, 1), 0.0)
                    name = np.where(letter, np.array(model.languages, dtype=object)[best], "und")
                else:
                    score, name = np.zeros(n), np.full(n, "und", dtype=object)
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(found.tolist(), pa.list_(pa.float64()))], schema=shape)

    return source.mapInArrow(run, full).select("__row.*", "lang_pred", "score", "words_by_language")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return predict(docs, train_on(docs), carry=["doc_id"]).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")
