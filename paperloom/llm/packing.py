"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

A bin is filled greedily with the longest piece that fits, again and again. Then its smallest piece
is taken out if two unpacked pieces fit the expanded gap more tightly, as long as that helps.

Pieces of one length are alike, so the plan is made on the histogram of lengths: at most ``capacity``
numbers whatever the corpus' size. A bin's pattern is repeated while enough pieces of each of its
lengths are left, exactly as packing one bin after another would. The plan is a table of slots (ranges
of ranks within a length), again bounded by the capacity alone, and each piece finds its place by its
rank among the pieces of its length. No task sees all documents.

Null texts are empty: their single piece is the end token alone. Documents longer than the capacity
are cut into full pieces and a rest. Repeated rows are packed each for itself, whatever their ids: ranks
are dealt by the pieces' places in a written table. Extra columns are ignored.

Any tokenizer file serves. Words are cached only under the normaliser and the word splitter that the
cache knows (``_KNOWN_PARTS``); texts go through other tokenizers whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import parts, persisted, spread_rank

CAPACITY = 4096
END_ID = 1
_END = np.array([END_ID], "<u4").tobytes()
#: Entries in a Python worker's cache of ids; a full one starts anew.
CACHE = 200_000
#: The type code of unsigned 32-bit numbers, which are little-endian on all machines Spark runs on but s390x.
_U4 = next(c for c in "IL" if array(c).itemsize == 4)
#: Normaliser and word splitter of a tokenizer file under which words can be encoded one by one.
_KNOWN_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(path: str | None = None) -> str:
    """The vocabulary as JSON text, read where the driver runs and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(2)
def _encoder(vocab: str):
    """text -> ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The pre-tokeniser never joins over white space, so chunks between white space are encoded once and
    remembered, and so are the words inside them. Texts with characters whose lower case, composition
    or class the two languages might see differently go through the tokenizer whole, and so do all
    texts if the tokenizer is not one of this kind.
    """
    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(vocab)

    def encode_whole(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    said = json.loads(vocab)
    if {k: said.get(k) for k in _KNOWN_PARTS} != _KNOWN_PARTS:
        return encode_whole
    words_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
    odd = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]|<\\|").search
    letters = _byte_letters()

    class Spelled(dict):
        def __missing__(self, c: int) -> str:
            out = self[c] = "".join(letters[b] for b in chr(c).encode())
            return out

    spelled, tokenize = Spelled(), whole.model.tokenize

    def word_ids(word: str) -> bytes:
        return array(_U4, [t.id for t in tokenize(word.translate(spelled))]).tobytes()

    class Known(dict):
        """Ids of words and of chunks."""

        def __missing__(self, chunk: str) -> bytes:
            if chunk.isalpha():
                ids = word_ids(chunk)
            elif chunk[-1] in ".,!" and chunk[:-1].isalpha():
                ids = self[chunk[:-1]] + marks[chunk[-1]]
            else:
                ids = b"".join([self[w] if w.isalpha() else word_ids(w) for w in words_of(chunk)])
            if len(self) >= CACHE:
                self.clear()
            if len(chunk) <= 64:
                self[chunk] = ids
            return ids

    known, marks = Known(), {c: word_ids(c) for c in ".,!"}

    def encode(text: str) -> bytes:
        if odd(text) or not unicodedata.is_normalized("NFC", text):
            return encode_whole(text)
        return b"".join(map(known.__getitem__, text.lower().split()))

    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids as little-endian unsigned 32-bit numbers."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(frames):
        encode = _encoder(vocab.value)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                flat = np.frombuffer(encode(text or "") + _END, "<u4")
                for k, at in enumerate(range(0, len(flat), capacity)):
                    part = flat[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, ranks, first bin, pieces of this length per bin, offset of the first) and the number of bins."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    slots, bins = [], 0
    while left.any():
        own: dict[int, int] = {}
        gap = capacity
        lengths = np.flatnonzero(left)

        def largest(limit: int) -> int:
            i = int(np.searchsorted(lengths, limit, side="right")) - 1
            while i >= 0 and left[lengths[i]] <= own.get(int(lengths[i]), 0):
                i -= 1
            return int(lengths[i]) if i >= 0 else 0

        while gap and (x := largest(gap)):
            n = min(int(left[x]) - own.get(x, 0), gap // x)
            own[x] = own.get(x, 0) + n
            gap -= n * x
        while gap:
            least = min(own)
            room = gap + least
            free = left.copy()
            for x, n in own.items():
                free[x] -= n
            have = np.flatnonzero(free[: room + 1])
            if not len(have):
                break
            # The largest partner of each length that still fits beside it.
            at = np.searchsorted(have, room - have, side="right") - 1
            same = (at >= 0) & (have[at] == have) & (free[have] < 2)
            at = np.where(same, at - 1, at)
            total = np.where(at >= 0, have + have[at], 0)
            best = int(np.argmax(total))
            if total[best] <= least:
                break
            a, b = int(have[best]), int(have[at[best]])
            own[least] -= 1
            if not own[least]:
                del own[least]
            own[a] = own.get(a, 0) + 1
            own[b] = own.get(b, 0) + 1
            gap = room - a - b
        times = min(int(left[x]) // n for x, n in own.items())
        offset = 0
        for x, n in sorted(own.items(), reverse=True):
            slots.append((x, int(used[x]), times * n, bins, n, offset))
            used[x] += times * n
            left[x] -= times * n
            offset += n * x
        bins += times
    return slots, bins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: PIECES, sequence_id and offset."""
    spark = docs.sparkSession
    cut = pieces(docs, id_col, text_col, capacity, tokenizer)
    cut = persisted(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most `capacity` rows, however many documents there are.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan_bins(counts, capacity)
    by_length: dict[int, np.ndarray] = {}
    for length in counts:
        by_length[length] = np.array([s[1:] for s in slots if s[0] == length], np.int64)
    plan = spark.sparkContext.broadcast(by_length)

    def place(frames):
        for frame in frames:
            seq, off = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, ranks = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(own):
                    runs, rank = plan.value[int(lengths[own[0]])], ranks[own]
                    run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
                    i = rank - run[:, 0]
                    seq[own] = run[:, 2] + i // run[:, 3]
                    off[own] = run[:, 4] + i % run[:, 3] * lengths[own]
            yield frame.drop(columns="rank").assign(sequence_id=seq, offset=off)

    ranked = spread_rank(cut, ["length"], ["row"], "rank", parts(spark)).select(*[x.split()[0] for x in PIECES.split(", ")], "rank")
    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
