import hashlib
import random

import pytest
import sentencepiece

from filingforge.llm import pieces

from .fixtures import documents, mixed_rows


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.default_model())


def test_encodes_and_decodes_like_the_library(own, library):
    r = random.Random(4)
    odd = " ▁\n\tabcdethés😀日本語\x00<>0123,.-AB́​eeeee    "
    for i in range(12_000):
        if i % 3 == 0:  # runs of spaces: pieces of one score, merged from the left
            text = "".join(r.choice(" ▁") if r.random() < 0.7 else r.choice("ab") for _ in range(r.randrange(60)))
        elif i % 3 == 1:
            text = "".join(own.texts[r.randrange(3, 32_000)] for _ in range(6))
        else:
            text = "".join(r.choice(odd) for _ in range(r.randrange(40)))
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
    for text in ("", " ", "x" * 30_000, "日本語" * 3000, "\n" * 500, "<s></s><unk><0x41>"):
        assert own.encode(text) == library.encode(text)


def test_decodes_any_ids(own, library):
    r = random.Random(5)
    for _ in range(6000):
        ids = [r.randrange(32_000) if r.random() < 0.4 else r.randrange(262) for _ in range(r.randrange(9))]
        assert own.decode(ids) == library.decode(ids)


def test_prefix_table_is_unique(own):
    """At each position just one piece is compatible with the token before it, and units don't change the encoding."""
    for text in (" internationalisation", " aaaaaaaaaaa", "    x", "thththe"):
        last = {0: None}
        for end in range(1, len(text) + 1):
            fit = []
            for start in last:
                piece = own.ids.get(text[start:end])
                if piece is not None and own.merged(text[start:end]) == [text[start:end]] and (start == 0 or own.pair(last[start] << 32 | piece)):
                    fit.append(piece)
            assert len(fit) == 1
            last[end] = fit[0]
    text = "one two  three\nfour"
    assert own.encode(text) == [i for u in own.units.findall(" " + text) for i in memoryview(own.unit(u)).cast("I")]


def test_memory_forgets(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    made = []
    memory = pieces.Memory(lambda k: made.append(k) or k * 2)
    assert [memory[k] for k in (1, 2, 3, 4, 1, 2, 5, 6, 7, 1)] == [2, 4, 6, 8, 2, 4, 10, 12, 14, 2] and len(memory) + len(memory.old) <= 6
    assert made.count(1) <= 2


def test_documents(spark, library):
    rows = [*mixed_rows(), (1, mixed_rows()[0][1]), (None, "no id"), (None, None)]
    docs = documents(spark, rows).withColumnRenamed("key", "ids")
    model = pieces.default_model()
    got = pieces.encode_documents(docs, model, outputs=list(pieces.OUTPUTS)).collect()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_eos=True)
        back = library.decode(ids)
        want.append((key, ids, len(ids), back, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    decoded = pieces.decode_documents(pieces.encode_documents(docs, model), model).collect()
    assert sorted(map(tuple, decoded), key=str) == sorted(((w[0], w[3]) for w in want), key=str)
    assert pieces.encode_documents(docs.limit(0), model).count() == 0
    assert pieces.encode_documents(docs.where("doc_id = 4"), model, end=False).first().ids == []
