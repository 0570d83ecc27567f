"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, each turn as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline,
and encoded once with offsets. The three control strings are special tokens of the encoder, so no
token reaches over a text's ends. The spans of the turns to learn are intersected with the tokens'
spans by binary search, both being sorted.

Control strings inside roles and texts are escaped: after ``<`` and any backslashes, a ``|`` gets one
more backslash before it (``<|`` -> ``<\\|``, ``<\\|`` -> ``<\\\\|``). No escaped text holds ``<|``, and taking one
backslash away restores it. Turns are read back from the rendered string by its control strings.

Turns are ordered by turn number (null first), then role and text, so ties and repeated rows have one
order. Null roles and texts are empty. A null conversation id is a conversation of its own. Extra
columns are ignored. A conversation is one training example and is held by one task, as it must be to
be rendered whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = frozenset({"assistant"})
FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, offsets array<struct<start:int,end:int>>, loss_mask array<boolean>"
#: Tokens after which a task hands on the conversations it has formatted.
BATCH_TOKENS = 200_000
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation, and each turn's role and the start and end of its escaped text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        out += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@lru_cache(2)
def encoder(vocab: str):
    """The byte-level encoder with the control strings as special tokens. Offsets keep leading spaces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(vocab)
    model.add_special_tokens([START, SEP, END])
    return model


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _masked(places: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the tokens (n x 2: start and end) lie in a span. Both are sorted."""
    inside = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(places[:, 1], inside[:, 0], "right")
    last = np.searchsorted(places[:, 0], inside[:, 1], "left")
    real = first < last
    steps = np.zeros(len(places) + 1, np.int64)
    np.add.at(steps, first[real], 1)
    np.add.at(steps, last[real], -1)
    return np.cumsum(steps[:-1]) > 0


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Which tokens lie in a span. Both lists are sorted."""
    return _masked(np.array(offsets, np.int64).reshape(-1, 2), spans).tolist()


def text_under(formatted: str, offsets: list[tuple[int, int]] | np.ndarray, mask: list[bool] | np.ndarray) -> list[str]:
    """The text that the masked tokens cover, a piece for each run of them. Tokens may share a character."""
    places = np.array(offsets, np.int64).reshape(-1, 2)
    on = np.flatnonzero(np.asarray(mask, bool))
    if not len(on):
        return []
    ends = np.maximum.accumulate(places[on, 1])
    covered = np.concatenate(([0], ends[:-1]))
    starts = np.maximum(places[on, 0], covered)
    run = np.concatenate(([True], np.diff(on) > 1))
    # Slices that meet are taken at once.
    cut = np.flatnonzero(run | (starts != covered))
    until = np.concatenate((cut[1:], [len(on)])) - 1
    pieces: list[list[str]] = []
    for a, b, new in zip(starts[cut].tolist(), ends[until].tolist(), run[cut].tolist()):
        if new:
            pieces.append([])
        pieces[-1].append(formatted[a:b])
    return ["".join(x) for x in pieces]


def format_conversation(turns: list[tuple[str, str]], model, learned: frozenset[str] = LEARNED) -> tuple[str, list[int], list[tuple[int, int]], list[bool]]:
    """(formatted, ids, offsets, mask)."""
    formatted, spans = render(turns)
    code = model.encode(formatted, add_special_tokens=False)
    return formatted, code.ids, code.offsets, loss_mask(code.offsets, [(a, b) for role, a, b in spans if role in learned and a < b])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    convs, sizes, texts, ids, places, masks = zip(*rows)
    bounds = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    both = np.concatenate(places)
    spans = pa.StructArray.from_arrays([pa.array(both[:, i]) for i in range(2)], ["start", "end"])
    lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(np.concatenate(ids)), spans, pa.array(np.concatenate(masks)))]
    return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), *lists], ["conv_id", "n_turns", "formatted", "ids", "offsets", "loss_mask"])


def formatted_batches(batches: Iterator[pa.RecordBatch], model, learned: frozenset[str] = LEARNED, tokens: int = BATCH_TOKENS) -> Iterator[pa.RecordBatch]:
    """FORMATTED of rows (conv_id, turns), handed on whenever ``tokens`` or more are held; a conversation stays whole."""
    rows, held = [], 0
    for b in batches:
        for conv, own in zip(b.column(0), b.column(1)):
            own = own.as_py()
            formatted, spans = render([(x["role"], x["text"]) for x in own])
            code = model.encode(formatted, add_special_tokens=False)
            ids, places = np.array(code.ids, np.int32), np.array(code.offsets, np.int32).reshape(-1, 2)
            rows.append((conv.as_py(), len(own), formatted, ids, places, _masked(places, [(a, z) for role, a, z in spans if role in learned and a < z])))
            held += len(ids)
            if held >= tokens:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: frozenset[str] = LEARNED, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: FORMATTED."""
    vocab = turns.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from formatted_batches(batches, encoder(vocab.value), learned)

    empty = F.lit("")
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    whole = turns.select(F.col(id_col).cast("long").alias("conv_id"), one.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    return whole.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from FORMATTED: turns by the control strings, learned text by the masked tokens' offsets."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, formatted, ids, places, mask in zip(*(b.column(c) for c in ("conv_id", "formatted", "ids", "offsets", "loss_mask"))):
                formatted, places, mask = formatted.as_py(), places.values, mask.values.to_numpy(zero_copy_only=False)
                turns = parse(formatted)
                learned = [unescape(t) for t in text_under(formatted, np.stack([places.field(i).to_numpy() for i in range(2)], axis=1), mask)]
                rows.append(
                    (
                        conv.as_py(),
                        len(turns),
                        hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest(),
                        sum(map(len, learned)),
                        hashlib.sha256("".join(learned).encode()).hexdigest(),
                        len(formatted),
                        len(ids),
                        int(np.sum(mask)),
                    )
                )
            names, types = zip(*(c.split() for c in schema.split(", ")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if t == "string" else pa.int64()) for x, t in zip(zip(*rows), types)], list(names))

    return formatted.mapInArrow(run, schema)
