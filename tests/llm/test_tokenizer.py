"""Problems 8 and 9."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
S = "doc_id long, text string"


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.vocabulary())


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_the_public_library(own, public, text):
    assert own.encode([text]) == [public(text)]


def test_long_pieces(own, public):
    random.seed(1)
    texts = ["a" * 5000, "ab" * 600, "".join(random.choice("etaoinshr") for _ in range(3000)), "日本語" * 500, " " * 700, "<|endoftext|> is text", "\x00\ud83d"[:1], "x" * 256, "x" * 257]
    assert own.encode(texts) == [public(t) for t in texts]
    pieces = [bytes(random.choice(b"abcdehnorst ") for _ in range(random.randint(1, 64))) for _ in range(400)]
    assert own.matrix(pieces, 64) == [own.long(p) for p in pieces]


def test_rows(spark, rows, crowded, public):
    data = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x"), (5, " \n"), (6, "word " * 20_000)]
    got = rows(bpe.encoded(crowded(spark.createDataFrame(data, S))))
    assert [r for r in got if r[0] in (1, 2)] == [(1, []), (2, [])]
    assert sum(r == (3, public("Hello world")) for r in got) == 2 and len(got) == 7
    assert next(r[1] for r in got if r[0] == 6) == public("word " * 20_000)
    assert rows(bpe.encoded(spark.createDataFrame([], S))) == []


def test_containers(spark, crowded, public):
    random.seed(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    data = [(i, " ".join(random.choice(words) for _ in range(random.choice([1, 5, 20, 60, 150])))) for i in range(150)] + [(1000, "word " * 1000), (1001, None), (1002, ""), (1003, "word " * 128)]
    out = packing.containers(crowded(spark.createDataFrame(data, S)), capacity=128, shard=40).toPandas()
    sizes = {i: len(public(t)) for i, t in data if t}
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 128
    split = out.groupby("doc_id").size()
    assert all(sizes[i] > 128 for i in split[split > 1].index)
    for i, g in out.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["n_tokens"].cumsum().tolist()[:-1]]
    assert sum(sizes.values()) / (128 * out["container_id"].nunique()) > 0.93
    assert packing.containers(spark.createDataFrame([], S)).count() == 0


def test_neighbours_share_containers():
    import numpy as np

    texts = [np.array([k] * 3 + [100 + i]) for i, k in enumerate([1, 2] * 8)]
    boxes = packing.pack(np.array([4] * 16), texts, 16)
    assert sorted(i for b in boxes for i in b) == list(range(16)) and len(boxes) == 4
    assert all(len({i % 2 for i in b[:3]}) == 1 for b in boxes)
