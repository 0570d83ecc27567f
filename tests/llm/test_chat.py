import hashlib
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import chat

PARTS = ["<", "|", "\\", "<|im_end|>", "<|im_start|>assistant ok", "<|im_sep|>", "<|endoftext|>", "\n", " ", "  ", "é", "日", "🙂", "́", "a", "end"]
texts = st.lists(st.sampled_from(PARTS), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_end|>\n"]), texts), max_size=5))
def test_round_trip_and_mask(turns):
    formatted, ids, offsets, mask = chat.format_conversation(turns, chat.encoder(chat.vocabulary()))
    assert chat.parse(formatted) == turns and len(ids) == len(mask) == len(offsets)
    learned = "".join(t for r, t in turns if r == "assistant")
    assert [chat.unescape(t) for t in chat.text_under(formatted, offsets, mask)] == [t for r, t in turns if r == "assistant" and t]
    assert any(mask) == bool(learned)


def test_mask_by_binary_search_equals_scan():
    r = random.Random(1)
    for _ in range(200):
        cuts = sorted(r.sample(range(60), 20))
        offsets = list(zip(cuts, cuts[1:]))
        ends = sorted(r.sample(range(60), 6))
        spans = list(zip(ends[::2], ends[1::2]))
        assert chat.loss_mask(offsets, spans) == [any(a < d and c < b for c, d in spans) for a, b in offsets]


def test_a_token_missing_from_the_mask_is_missing_from_the_text():
    formatted, ids, offsets, mask = chat.format_conversation([("assistant", "one two three")], chat.encoder(chat.vocabulary()))
    on = [i for i, m in enumerate(mask) if m]
    mask[on[1]] = False
    assert "".join(chat.text_under(formatted, offsets, mask)) != "one two three"


def test_rows(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (2, None, None, "only text", "x"), (None, 0, "assistant", "n", "x"), (3, 0, "assistant", "", "x"), (4, 0, "user", "dup", "x"), (4, 0, "user", "dup", "x"), (5, 0, "assistant", "long " * 20000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b") and got[1]["loss_chars"] == 1
    assert got[2]["turns_sha256"] == sha("\nonly text\n") and got[2]["loss_chars"] == 0
    assert got[3]["loss_sha256"] == sha("") and got[4]["n_turns"] == 2 and got[5]["loss_chars"] == 100000
    assert got[None]["loss_sha256"] == sha("n")
    assert chat.format_conversations(df.where("false")).count() == 0


def test_batches_are_handed_on_by_tokens():
    turns = [[{"turn": 0, "role": "user", "text": "a b"}, {"turn": 1, "role": "assistant", "text": "c d e é " * (i % 3)}] for i in range(40)]
    given = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 20), pa.int64()), pa.array(turns[k : k + 20])], ["conv_id", "turns"]) for k in (0, 20)]
    model = chat.encoder(chat.vocabulary())
    got = list(chat.formatted_batches(given, model, tokens=60))
    most = max(len(x) for b in got for x in b.column("ids"))
    assert len(got) > 5 and all(len(b.column("ids").flatten()) < 60 + most for b in got)
    rows = [tuple(x.values()) for b in got for x in b.to_pylist()]
    for (conv, n, formatted, ids, offsets, mask), own in zip(rows, turns, strict=True):
        want = chat.format_conversation([(x["role"], x["text"]) for x in own], model)
        assert n == 2 and (formatted, ids, [(o["start"], o["end"]) for o in offsets], mask) == want
    assert [r[0] for r in rows] == list(range(40))
