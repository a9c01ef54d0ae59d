import numpy as np
import pytest
from pyspark.sql import functions as F

from filingforge.llm import packing

from .fixtures import documents, mixed_rows, prose

ODD = ["", " ", "a  b   c \n\n d\t e\n", "  lead", "trail  \n", "it's we'll\n\nfoo \n bar", "a\x01b c", "日本 語　x  y", " \n a", "a  b", "x \x85y", "1 2 33  444", "\n\n", "a \n b"]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    texts = ODD + [prose(i, 300) for i in range(20)] + [t for _, t in mixed_rows() if t]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    own = packing.WordTokenizer(path)
    assert [np.frombuffer(own.ids(t), "<u4").tolist() for t in texts] == want


def test_added_tokens_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    path, end = packing.default_vocabulary(), "<|endoftext|>"
    texts = ["hello<|endoftext|>world", end, end * 3, f" a {end} b ", f"one\n{end}\n\ntwo {end}", "<|endoftext|", "<<|endoftext|>>", "<|ENDOFTEXT|>", f"日本{end}語", f"a\x01b {end}  c"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [31373, 50256, 6894]
    own = packing.WordTokenizer(path)
    assert [np.frombuffer(own.ids(t), "<u4").tolist() for t in texts] == want


@pytest.mark.parametrize("sizes, windows", [([8, 7, 6, 5, 4], 2), ([5, 5, 5, 4, 3, 3], 3), ([1], 4), ([], 2), ([9] * 12, 4)])
def test_differencing_covers_all(sizes, windows):
    place = packing.differencing(np.array(sizes, np.int64), windows)
    assert len(place) == len(sizes) and all(0 <= p < windows for p in place)


def test_differencing_of_the_textbook_case():
    sizes = np.array([8, 7, 6, 5, 4])
    place = packing.differencing(sizes, 2)
    sums = np.bincount(place, weights=sizes, minlength=2)
    assert abs(sums[0] - sums[1]) == 2


def test_windows_rise_where_capacity_is_exceeded():
    place, windows = packing.pack_tails(np.array([6, 6, 6]), 10)
    assert windows == 3 and sorted(place) == [0, 1, 2]


@pytest.mark.parametrize("capacity, cut", [(64, 16), (2048, 256)])
def test_each_id_lies_in_one_piece(spark, capacity, cut):
    rows = mixed_rows() + [(100 + i, prose(i, 30 + i)) for i in range(150)]
    docs = documents(spark, rows)
    got = packing.pack_documents(docs, packing.default_vocabulary(), capacity=capacity, cut=cut, pool_windows=8).collect()
    own = packing.WordTokenizer(packing.default_vocabulary())
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, text in rows:
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        want = own.ids(text or "") + (1).to_bytes(4, "little")
        assert b"".join(bytes(p.ids) for p in pieces) == want
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        assert all(p.doc_tokens == len(want) // 4 and p.length * 4 == len(p.ids) for p in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        assert sum(p.length for p in pieces) <= capacity


def test_little_padding(spark):
    docs = documents(spark, [(i, prose(i, 40 + 7 * (i % 90))) for i in range(2500)]).coalesce(1)
    got = packing.pack_documents(docs, packing.default_vocabulary()).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    assert 1 - got.n / (got.s * 2048) < 0.02


def test_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    assert packing.pack_documents(docs, packing.default_vocabulary()).count() == 3
    assert packing.with_digests(packing.pack_documents(docs.limit(0), packing.default_vocabulary())).count() == 0
