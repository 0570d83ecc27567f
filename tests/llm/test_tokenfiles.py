import heapq
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import tokenfiles
from paperloom.llm.chat import vocabulary
from tests.llm import data


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary())


def whole_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1f", "\xa0", " ", "a", "Word", "it's", "don't.", "é", "日本", "🙂", "9", "12ab", "<|endoftext|>", "<|", ".", ",", "!", "...", "'s", "x'"]), max_size=12).map("".join))
def test_encoder_equals_the_tokenizer(text):
    assert np.frombuffer(tokenfiles.encoder(vocabulary())(text), "<u4").tolist() == whole_ids(text)[:-1]


PIECES = [" ", "  ", "\n", "\t", "\x1f", "\xa0", "\x85", "a", "Word", "it's", "é", "日本", "ɀ", "9", "<|endoftext|>", "<", "|", ".", ",", "!", "...", "x'", "'s", "s", "×", "÷", "Ý", "«", "²", "&&&", "§", "-"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=8), st.integers(1, 40), st.integers(0, 2))
def test_texts_together_equal_the_tokenizer(texts, together, skip):
    import pyarrow as pa

    for kind in (pa.string(), pa.large_string()):
        got = list(tokenfiles.encode_texts(vocabulary(), pa.array(texts, kind)[skip:], together))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole_ids(t)[:-1] for t in texts[skip:]]


def test_a_run_is_looked_up_once_for_many_texts(monkeypatch):
    import pyarrow as pa

    class Counted(dict):
        n = 0

        def __getitem__(self, run):
            self.n += 1
            return b"\x01\x00\x00\x00"

    seen = Counted()
    monkeypatch.setattr(tokenfiles, "_encoders", lambda _: (None, seen))
    assert list(tokenfiles.encode_texts("", pa.array(["a b a b b", " b a", None]))) == [b"\x01\x00\x00\x00" * 5, b"\x01\x00\x00\x00" * 2, b""]
    assert seen.n == 3  # "a" and " b", and " a"


def huffman_total(counts):
    """The least total of bits without a limit."""
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths_are_a_full_code_and_least(counts):
    counts = np.array(counts)
    bits = tokenfiles.code_lengths(counts, 16)
    assert sum(2.0**-b for b in bits) == 1 and bits.max() <= 16
    free = tokenfiles.code_lengths(counts, 40)
    assert int((free * counts).sum()) == huffman_total(counts.tolist()) <= int((bits * counts).sum())


def test_limited_lengths_equal_a_search_of_all():
    from itertools import product

    for seed in range(20):
        r = random.Random(seed)
        counts = [int(3**i * r.random()) + 1 for i in range(6)]
        best = min(sum(c * b for c, b in zip(counts, bits)) for bits in product(range(1, 4), repeat=6) if sum(2.0**-b for b in bits) <= 1)
        assert int((tokenfiles.code_lengths(np.array(counts), 3) * counts).sum()) == best
    with pytest.raises(ValueError):
        tokenfiles.code_lengths(np.ones(9), 3)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n) - 1, 50000).astype("<u4")
    some, counts = np.unique(ids, return_counts=True)
    code = tokenfiles.Code(some, tokenfiles.code_lengths(counts))
    blocks = [(len(x), *code.encode(x)) for x in (ids, ids[: n // 2 + 1])]
    assert [x.tolist() for x in code.decode(blocks)] == [ids.tolist(), ids[: n // 2 + 1].tolist()]
    assert len(blocks[0][1]) <= n * 2 + 4


def expect(rows):
    at, out = 0, []
    for doc_id, ids in rows:
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_equal_brute_force(spark, tmp_path, monkeypatch):
    docs = data.docs(spark)
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(docs.repartition(3), path)
    got = sorted(map(tuple, tokenfiles.read_tokens(spark, path, with_ids=False).collect()), key=lambda r: r[1])
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert [r[0] for r in got[:2]] == [None, None] and [r[0] for r in got[2:]] == sorted([*texts, 5])
    assert [r for r in got[2:]] == [(d, s + got[2][1], n, c) for d, s, n, c in expect([(r[0], whole_ids(texts[r[0]])) for r in got[2:]])]


def test_a_document_over_many_blocks_and_ids_back(spark, tmp_path, monkeypatch):
    text = data.prose(9, 40000)
    docs = spark.createDataFrame([(2, text), (1, "first"), (3, "last")], "doc_id long, text string")
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(docs, path)
    assert spark.read.parquet(path + "/blocks").count() > 2
    rows = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [whole_ids("first"), whole_ids(text), whole_ids("last")]
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == expect([(1, whole_ids("first")), (2, whole_ids(text)), (3, whole_ids("last"))])


def test_no_documents_and_a_damaged_block(spark, tmp_path):
    path = str(tmp_path / "none")
    tokenfiles.write_tokens(data.no_docs(spark), path)
    assert tokenfiles.read_tokens(spark, path).count() == 0
    path = str(tmp_path / "bad")
    tokenfiles.write_tokens(data.docs(spark), path)
    blocks = spark.read.parquet(path + "/blocks")
    from pyspark.sql import functions as F

    blocks.withColumn("crc32", F.col("crc32") + 1).write.parquet(str(tmp_path / "worse/blocks"))
    spark.read.parquet(path + "/codebook").write.parquet(str(tmp_path / "worse/codebook"))
    with pytest.raises(Exception, match="damaged"):
        tokenfiles.read_tokens(spark, str(tmp_path / "worse")).count()
