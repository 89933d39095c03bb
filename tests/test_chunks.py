import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioquery.errors import ContextTooLong, EmptyInput, ProviderError
from folioquery.functions.estimate import estimate
from folioquery.operators import chunking as C
from folioquery.operators import embedding as E


def test_sentences():
    assert C.sentences("Dr. Ann came. She e.g. ran! Why? It is out") == ["Dr. Ann came.", "She e.g. ran!", "Why?", "It is out"]
    assert C.sentences("end etc.") == ["end etc."] and C.sentences(" ") == []


def test_paragraphs():
    long = "\n".join(["word " * 60] * 5)
    assert C.paragraphs("a\n\n b \n\n\n\nc") == ["a", "b", "c"]
    assert len(C.paragraphs(long)) == 5


@given(st.text(alphabet="ab c.\n", max_size=600), st.integers(1, 40), st.integers(0, 20))
def test_token_chunks_cover_the_text(text, size, lap):
    found = C.by_tokens(text, C.ChunkOptions(size, lap))
    assert all(text[a:b].strip() == body for _, body, a, b, _ in found)
    held = set().union(*(range(a, b) for _, _, a, b, _ in found)) if found else set()
    assert all(i in held or c.isspace() for i, c in enumerate(text))


@given(st.text(alphabet="ab c.\n", max_size=900), st.integers(20, 200), st.integers(0, 19))
def test_pieces_cover_the_text(text, size, lap):
    found = C.pieces(text, size, lap)
    assert all(text[a:b] == body and len(body) <= size for _, body, a, b, _ in found)
    if text:
        assert found[0][2] == 0 and found[-1][3] == len(text)
        assert all(x[3] >= y[2] for x, y in zip(found, found[1:]))


def test_merging():
    opts = C.ChunkOptions(max_tokens=5, overlap_tokens=2)
    text = "one two three\n\nfour five six\n\nseven"
    found = C.chunk(text, opts)
    assert [x[1] for x in found[:2]] == ["one two three", "three  four five six"]
    assert [x[0] for x in found] == list(range(len(found)))
    assert C.chunk("", opts) == C.chunk(None, opts) == C.chunk("  ", opts) == []
    whole = C.chunk(text, C.ChunkOptions(max_tokens=500))
    assert [(x[1], x[2], x[3]) for x in whole] == [("one two three four five six seven", 0, len(text))]


def test_rows(spark, rows):
    df = spark.createDataFrame([(1, "a b. c d."), (2, None), (3, ""), (4, "x" * 100_000)], "doc_id long, text string")
    got = rows(C.chunked(df, "doc_id", "text", C.ChunkOptions(chunk_by="tokens", max_tokens=1000, overlap_tokens=0)), "doc_id", "chunk_idx", "start_idx", "end_idx")
    assert [r for r in got if r[0] == 1] == [(1, 0, 0, 9)] and len([r for r in got if r[0] == 4]) == 25 and {r[0] for r in got} == {1, 4}


@pytest.mark.parametrize("alone", [False, True])
def test_groups(spark, alone):
    sizes = [3, 4, 5, 20, 1, 1, 9, 10, 11, 2]
    df = spark.createDataFrame([(g, i, s) for i, s in enumerate(sizes) for g in ("a", None, "b")], "g string, i int, w int").repartition(3)
    chunks = C.grouped_rows(df, "g", ["i"], "w", 10, alone).collect()
    by = {g: [r["chunk"] for r in sorted(chunks, key=lambda r: r["i"]) if r["g"] == g] for g in ("a", None, "b")}
    got = by["a"]
    assert got == by["b"] == by[None]
    want, group, used, n = [], 0, 0, 0
    for s in sizes:
        if alone and s > 10:
            group += 1 if n else 0
            want.append(group)
            used, n = 11, n + 1
            continue
        if n and used + s > 10:
            group, used = group + 1, 0
        used, n = used + s, n + 1
        want.append(group)
    assert got == want


def test_combined(spark, rows):
    df = spark.createDataFrame([("d", 1, " b "), ("d", 0, "a"), ("d", 2, " "), ("d", 3, None)], "k string, i int, t string")
    assert rows(C.combined(df, ["k"], "i", "t")) == [("d", "a\n\nb")]


class Broken:
    name, dimension, max_batch = "broken", 2, 2

    def __init__(self, faults):
        self.faults = faults

    def embed(self, texts):
        if self.faults:
            raise self.faults.pop(0)
        return [[float(len(t)), 1.0] for t in texts]


def test_providers(spark, rows):
    assert E.batches(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]] and len(E.batches(["x"] * 150, 0)) == 2
    assert E.retried(Broken([ProviderError("x"), ProviderError("y")]), ["abcd"], delay=0) == [[4.0, 1.0]]
    assert E.retried(Broken([ContextTooLong("z")]), ["abcd"]) == [[2.0, 1.0]]
    assert E.retried(Broken([ContextTooLong("z")] * 2), ["abcd"]) == [[1.0, 1.0]]
    with pytest.raises(ContextTooLong):
        E.retried(Broken([ContextTooLong("z")] * 3), ["abcd"])
    with pytest.raises(EmptyInput):
        E.retried(Broken([]), [""])
    h = E.HttpProvider("http://x", "m", 1)
    assert h.read({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}) == [[1], [2]]
    assert E.HttpProvider("http://x", "m", 1, style="ollama").read({"embedding": [1]}) == [[1]]
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, "b a")], "i int, content string")
    got = {r["i"]: r for r in E.embedded(df, E.HashProvider(8)).collect()}
    assert got[1]["vector"] == got[4]["vector"] and got[2]["vector"] is None and got[3]["model"] is None and got[1]["dimension"] == 8
    assert estimate("abcd") == 1
