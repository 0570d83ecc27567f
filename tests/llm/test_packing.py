import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import packing
from tests.llm.data import docs, no_docs, odd_rows, prose


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x400, exclude_categories=["Cs"]), st.sampled_from("abc.,'s \n\x1c<|ſİΣﬁ日")), max_size=60))
def test_encoder_equals_the_tokenizer(text):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.frombuffer(packing._encoder(packing.vocabulary())(text), "<u4").tolist()
    assert ids == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_give_their_own_ids(name):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    encode = packing._encoder(packing.vocabulary(public_tokenizers.path(name)))
    for text in ("Hello  World's 42 ends.\nNew line", " É日 <|endoftext|> x", prose(4, 50), ""):
        assert np.frombuffer(encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def naive_bins(lengths, capacity):
    """Best-two-fit, one document after another: fill greedily with the longest that fits, then swap the smallest for two."""
    left, bins = sorted(lengths), 0
    while left:
        own, gap = [], capacity
        while any(x <= gap for x in left):
            x = max(x for x in left if x <= gap)
            left.remove(x)
            own.append(x)
            gap -= x
        while gap:
            least = min(own)
            pairs = [(left[i] + left[j], left[i]) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap + least]
            if not pairs or max(pairs)[0] <= least:
                break
            total, a = max(pairs)
            own.remove(least)
            for x in (a, total - a):
                left.remove(x)
                own.append(x)
            gap += least - total
            left.append(least)
        bins += 1
    return bins


def test_plan_on_the_histogram_equals_packing_one_by_one():
    r = random.Random(11)
    for _ in range(60):
        capacity = r.choice([12, 30, 64])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 40))]
        assert check_plan(lengths, capacity) == naive_bins(lengths, capacity)


def check_plan(lengths, capacity):
    slots, bins = packing.plan_bins(dict(Counter(lengths)), capacity)
    fill, count = defaultdict(int), Counter()
    for length, first, ranks, first_bin, per_bin, offset in slots:
        assert first == count[length]
        count[length] += ranks
        for i in range(ranks):
            fill[first_bin + i // per_bin] += length
    assert count == Counter(lengths) and len(fill) == bins and max(fill.values(), default=0) <= capacity
    return bins


def test_plan_is_tight_and_whole():
    r = random.Random(2)
    for capacity in (10, 64, 4096):
        lengths = [r.randint(1, capacity) for _ in range(500)]
        bins = check_plan(lengths, capacity)
        small = [x for x in lengths if x * 2 <= capacity]
        assert bins >= -(-sum(lengths) // capacity) and bins <= len(lengths) - len(small) + -(-2 * sum(small) // capacity) + 1
    # Greedy alone (6 + 3) leaves gaps of one; two documents in place of the smallest close them (6 + 2 + 2).
    assert check_plan([6, 3, 2, 2] * 20, 10) == 27


def test_two_for_one_beats_greedy():
    slots, bins = packing.plan_bins({5: 1, 4: 1, 3: 1, 2: 1}, 10)
    assert bins == 2 and sum(s[0] * s[2] for s in slots if s[3] == 0) == 10


def test_pack_round_trip(spark, model):
    source = [(i, t) for i, t, *_ in odd_rows()] + [(200 + i, prose(i, 5 + 40 * i)) for i in range(30)]
    df = docs(spark).unionByName(docs(spark, [t for i, t in source if i is not None and i >= 200], first=200))
    capacity = 128
    got = packing.pack(df, capacity=capacity).collect()
    want = Counter()
    for i, t in source:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_seq) <= -(-sum(r["length"] for r in got) // capacity) + 2


def test_rows_that_repeat_an_id_get_places_of_their_own(spark):
    got = packing.pack(spark.createDataFrame([(None, "same words here")] * 40 + [(1, "same words here")] * 40, "doc_id long, text string"), capacity=16).collect()
    assert len(got) == 80 and len({(r["sequence_id"], r["offset"]) for r in got}) == 80


def test_empty_table(spark):
    assert packing.pack(no_docs(spark)).count() == 0
