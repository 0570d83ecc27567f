"""Repeated passages over sparse suffix arrays.

Only suffixes that start at minimisers are kept: for each stretch of ``length`` words, the place in it
whose 8-word head hashes lowest, the leftmost of equals. The choice depends on the words alone, so a
passage of ``length`` words or more selects the same suffixes wherever it stands. A suffix stands for
a run of neighbouring stretches, and carries the words of that run: its head, those to the right and,
in reverse, those to the left.

The suffixes are sorted by their words twice, once reading to the right and once to the left of the
head, and each is compared with its neighbours from other texts: the common words to both sides give
the match, extended left and right, and if it has ``length`` words or more its stretches are repeated.
A neighbour in the first order has the longest match to the right of all, one in the second order the
longest to the left; where the neighbours' matches together fill the range that these two leave open,
no other suffix can add to them. The few suffixes with a gap in that range are settled by bringing
equal stretches together. So the result is exact: all words that lie in a stretch of ``length`` words
that two documents or more hold, merged into passages. Words are compared as they are; hashes choose
the suffixes and find which heads stand in two texts, they never make two words equal.

The sorts are by range over head, words and text, so a passage that stands in a third of all documents
is sorted by many tasks. A task sees its rows in order; the rows at its two ends are compared once
more with those of the tasks beside it, a few rows per task. Copies of one text are one text with a
count; the passage of a text with two copies or more is the whole text, if it is long enough.

Words are split at ASCII white space. Null texts and texts of fewer than ``length`` words have no
passage. Repeated rows are copies. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import persisted

HEAD = 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = "at:int,starts:array<int>,ends:array<int>"
#: at is the suffix' place; its stretches start at at - back to at + ahead; right and left are the words beside the head, each with a space after it.
SUFFIX = f"key binary, at int, back int, ahead int, head binary, right binary, left binary, places array<struct<{_PLACE}>>"
_SORTED = "key binary, at int, back int, ahead int, lows array<int>, highs array<int>, best int, edge boolean, head binary, right binary, left binary"


class _Hashes(dict):
    """Word -> hash, starting anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def head_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of every run of HEAD words; equal runs have equal hashes."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            a, b = h[:-step], h[step:]
            x = (a ^ (b >> np.uint64(31)) ^ (b << np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
            x = ((x ^ (x >> np.uint64(29))) + b) * np.uint64(0xBF58476D1CE4E5B9)
            h = x ^ (x >> np.uint64(32))
    return h


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n neighbours."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :])


def minimisers(words: list[bytes], length: int) -> np.ndarray:
    """The distinct hashes of the heads at minimisers."""
    return np.unique(lowest(head_hashes(words), length - HEAD + 1)) if len(words) >= length else np.zeros(0, np.uint64)


def suffix_runs(words: list[bytes], length: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first stretch, last stretch) of the suffixes whose head is one of ``heads``."""
    h = head_hashes(words)
    low = lowest(h, length - HEAD + 1)
    values, ranks = np.unique(h, return_inverse=True)
    # The leftmost place of the lowest head from each stretch's start on.
    order = np.sort(ranks * len(h) + np.arange(len(h)))
    place = order[np.searchsorted(order, np.searchsorted(values, low) * len(h) + np.arange(len(low)))] % len(h)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(low)) - 1
    wanted = np.isin(low[first], heads)
    return place[first][wanted], first[wanted], last[wanted]


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in code points."""
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80))).astype(np.int32)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    return chars[np.flatnonzero(inside[1:] & ~inside[:-1])], chars[np.flatnonzero(inside[:-1] & ~inside[1:])]


def _joined(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " if words else b""


def common_words(a: bytes, b: bytes) -> int:
    """How many words two runs of words have in common from their start on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return a.count(b" ", 0, n)
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return a.count(b" ", 0, int(differ.argmax()))


def _batched(frames: Iterable[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Joins small frames into larger ones."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _suffixes_of(length: int):
    """Texts with the heads that stand in other texts too -> SUFFIX, one row for all places of a text with the same words around."""

    def rows_of(key: bytes, text: str, heads: np.ndarray) -> pd.DataFrame:
        words = text.encode().split()
        starts, ends = word_bounds(text)
        found: dict[tuple, list] = {}
        for p, a, b in zip(*(x.tolist() for x in suffix_runs(words, length, heads))):
            around = (_joined(words[p : p + HEAD]), _joined(words[p + HEAD : b + length]), _joined(words[a:p][::-1]), p - a, b - p)
            found.setdefault(around, []).append({"at": p, "starts": starts[a : b + 1], "ends": ends[a + length - 1 : b + length]})
        rows = [(key, places[0]["at"], back, ahead, head, right, left, places) for (head, right, left, back, ahead), places in found.items()]
        return pd.DataFrame(rows, columns=["key", "at", "back", "ahead", "head", "right", "left", "places"])

    def run(frames):
        each = (rows_of(key, text, np.asarray(heads, np.int64).view(np.uint64)) for frame in frames for key, text, heads in zip(frame["key"], frame["text"], frame["heads"]))
        yield from _batched(x for x in each if len(x))

    return run


def _compared(length: int, to_right: bool):
    """Rows in order -> _SORTED: the stretches (lows to highs, counted from the suffix) that the neighbours from other texts share, and the longest match in the order's direction."""

    def match(a: tuple, b: tuple) -> tuple[int, int]:
        """Common words to the left of the head, and from the head on."""
        return (common_words(a[6], b[6]), HEAD + common_words(a[5], b[5])) if a[4] == b[4] else (0, 0)

    def settled(rows: list[tuple], runs: list[int], k: int) -> Iterator[tuple]:
        """Results of the rows of run k; runs holds where each run starts, and the end."""
        lo, hi = runs[k], runs[k + 1]
        before, after = (rows[lo - 1] if lo else None), (rows[hi] if hi < len(rows) else None)
        for i in range(lo, hi):
            lows, highs, best = [], [], 0
            for other in (before, after):
                if other is not None:
                    left, right = match(rows[i], other)
                    best = max(best, right if to_right else left)
                    if left + right >= length:
                        lows.append(max(-rows[i][2], -left))
                        highs.append(min(rows[i][3], right - length))
            yield (*rows[i][:4], lows, highs, best)

    def run(frames):
        held: list[tuple] = []  # the run that is still open, and the row before it
        n_runs = 0  # how many are done
        columns = [c.split()[0] for c in _SORTED.split(", ")]

        def process(rows: list[tuple], last: bool) -> list[tuple]:
            nonlocal held, n_runs
            runs = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]] + [len(rows)]
            done = []
            # A row kept from before the open run only serves to be compared with.
            start = 1 if n_runs else 0
            stop = len(runs) - 1 if last else len(runs) - 2
            for k in range(start, stop):
                end = n_runs == 0 or (last and k == stop - 1)
                for i, x in enumerate(settled(rows, runs, k), runs[k]):
                    # What follows the first run is what a run that began in the task before is compared with.
                    edge = end or (n_runs == 1 and i == runs[k])
                    done.append((*x, edge, *(rows[i][4:7] if edge else (None, None, None))))
                n_runs += 1
            if last and runs[-2]:  # and so is what comes before the last
                x = rows[runs[-2] - 1]
                done.append((*x[:4], [], [], 0, True, *x[4:7]))
            held = rows[runs[stop] - 1 :] if stop > start else rows
            return done

        for frame in frames:
            done = process(held + list(frame.itertuples(index=False, name=None)), False)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if held:
            yield pd.DataFrame(process(held, True), columns=columns)

    return run


def _neighbour_matches(suffixes: DataFrame, length: int, to_right: bool) -> DataFrame:
    """_SORTED of all suffixes in one order, and again of the rows at the tasks' ends."""
    order = ["head", "right", "left", "key", "at"] if to_right else ["head", "left", "right", "key", "at"]
    columns = ["key", "at", "back", "ahead", "head", "right", "left"]
    compare = _compared(length, to_right)
    name = "suffixes-to-the-right" if to_right else "suffixes-to-the-left"
    inner = suffixes.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(compare, _SORTED)
    inner = persisted(inner, name)
    # A few rows of each task: their number grows with the tasks, not with the rows of a task.
    ends = inner.where("edge").select(*columns).coalesce(1).sortWithinPartitions(*order).mapInPandas(compare, _SORTED)
    return inner.unionByName(persisted(ends, name + "-ends")).select("key", "at", "back", "ahead", "lows", "highs", "best")


def _equal_stretches(suffixes: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """(key, at, lows, highs) of the suffixes in ``open_rows`` (key, at, head): each stretch of theirs that another text holds."""

    def stretches(frames):
        for frame in frames:
            rows = []
            for key, at, back, ahead, head, right, left in frame.itertuples(index=False, name=None):
                words = left.split(b" ")[:-1][::-1] + (head + right).split(b" ")[:-1]
                rows += [(key, at, i - back, b" ".join(words[i : i + length])) for i in range(back + ahead + 1)]
            yield pd.DataFrame(rows, columns=["key", "at", "low", "words"])

    rows = suffixes.join(open_rows.select("head").distinct(), "head", "left_semi").select("key", "at", "back", "ahead", "head", "right", "left")
    rows = persisted(rows.mapInPandas(stretches, "key binary, at int, low int, words binary"), "open-stretches")
    twice = rows.groupBy("words").agg((F.min("key") != F.max("key")).alias("several")).where("several").select("words")
    found = rows.join(open_rows.select("key", "at"), ["key", "at"], "left_semi").join(twice, "words", "left_semi")
    return found.groupBy("key", "at").agg(F.collect_set("low").alias("lows")).select("key", "at", "lows", F.col("lows").alias("highs"))


def _has_gap() -> Column:
    """Whether the matches leave stretches open between the furthest ones that the longest matches allow."""
    low, high = F.greatest(-F.col("back"), -F.col("left_best")), F.least(F.col("ahead"), F.col("right_best") - F.col("length"))
    asked = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    covered = F.flatten(F.zip_with("lows", "highs", lambda a, b: F.sequence(a, b)))
    return F.size(F.array_except(asked, covered)) > 0


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per passage: (doc_id, start_word, end_word, start_char, end_char), ends exclusive, in code points."""
    if length <= HEAD:
        raise ValueError(f"a passage has more than {HEAD} words")
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("key"), text.alias("text"))

    @F.pandas_udf("n_words long, lead long, tail long, heads array<long>")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            words = x.encode().split()
            lead = len(x) - len(x.lstrip(" \t\n\x0b\x0c\r"))
            out.append((len(words), lead, len(x.rstrip(" \t\n\x0b\x0c\r")), minimisers(words, length).view(np.int64)))
        return pd.DataFrame(out, columns=["n_words", "lead", "tail", "heads"])

    # Called nondeterministic so that the filter below is not moved under it, which would read each text twice.
    ids = rows.select("doc_id", "key", read.asNondeterministic()("text").alias("x")).select("doc_id", "key", "x.*").where(F.col("n_words") >= length)
    ids = persisted(ids, "text-keys")
    copies = persisted(ids.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "text-copies")
    # Written, so that the join deals both sides itself and Spark can split a head that very many texts hold.
    selected = ids.select("key", F.explode("heads").alias("head_hash"))
    several = F.min(F.xxhash64("key")) != F.max(F.xxhash64("key"))
    common = persisted(selected.groupBy("head_hash").agg(several.alias("several")).where("several").select("head_hash"), "common-heads")
    kept = selected.join(common, "head_hash").groupBy("key").agg(F.collect_set("head_hash").alias("heads"))
    # One row of each text is searched: the one with the smallest id. The id deals too, so copies go to many tasks.
    wanted = kept.join(copies, "key").select(F.col("key").alias("own_key"), "first_id", "heads")
    suspects = rows.join(wanted, (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", "text", "heads")
    # Rows that repeat an id and its text give each suffix again; one of them is enough.
    twice = ids.groupBy("key", "doc_id").count().where("count > 1")
    suffixes = suspects.mapInPandas(_suffixes_of(length), SUFFIX)
    if not twice.isEmpty():
        suffixes = suffixes.dropDuplicates(["key", "at"])
    suffixes = persisted(suffixes, "sparse-suffixes")

    none = F.lit(None)
    matches = []
    for to_right in (True, False):
        best = [F.col("best").alias("right_best"), none.cast("int").alias("left_best")] if to_right else [none.cast("int").alias("right_best"), F.col("best").alias("left_best")]
        found = _neighbour_matches(suffixes, length, to_right)
        matches.append(found.where((F.size("lows") > 0) | (F.col("best") > 0)).select("key", "at", "lows", "highs", *best))
    both = matches[0].unionByName(matches[1]).groupBy("key", "at").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"), F.coalesce(F.max("right_best"), F.lit(0)).alias("right_best"), F.coalesce(F.max("left_best"), F.lit(0)).alias("left_best"))
    both = persisted(both.where(F.col("right_best") + F.col("left_best") >= length), "suffix-matches")
    ranged = both.join(suffixes.select("key", "at", "back", "ahead", "head", "places"), ["key", "at"]).withColumn("length", F.lit(length))
    ranged = persisted(ranged.withColumn("open", _has_gap()), "suffix-ranges")
    hits = ranged.select("key", "at", "back", "lows", "highs", "places")
    open_rows = ranged.where("open").select("key", "at", "head")
    if not open_rows.isEmpty():
        more = _equal_stretches(suffixes, open_rows, length)
        hits = hits.unionByName(more.join(ranged.select("key", "at", "back", "places"), ["key", "at"]).select(hits.columns))

    # Passages of texts without copies: ranges of stretches that touch or overlap.
    hits = hits.where(F.size("lows") > 0).join(copies.where("copies = 1").select("key"), "key", "left_semi")
    hits = hits.select("key", "back", "places", F.explode(F.array_distinct(F.arrays_zip("lows", "highs"))).alias("r")).select("key", "back", "r.*", F.explode("places").alias("p"))
    place = {"start_word": F.col("p.at") + F.col("lows"), "end_word": F.col("p.at") + F.col("highs") + length, "start_char": F.get("p.starts", F.col("lows") + F.col("back")), "end_char": F.get("p.ends", F.col("highs") + F.col("back"))}
    hits = hits.select("key", *[c.cast("long").alias(n) for n, c in place.items()])
    order = Window.partitionBy("key").orderBy("start_word", "end_word")
    upto = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = hits.withColumn("new", (F.col("start_word") > F.coalesce(upto, F.lit(-1))).cast("int"))
    island = island.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = [f(c).alias(c) for c, f in (("start_word", F.min), ("end_word", F.max), ("start_char", F.min), ("end_char", F.max))]
    passages = island.groupBy("key", "island").agg(*bounds).drop("island")
    out = ["doc_id", "start_word", "end_word", "start_char", "end_char"]
    in_parts = ids.join(passages, "key").select(*out)
    whole = ids.join(copies.where("copies > 1").select("key"), "key", "left_semi")
    whole = whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.col("lead").alias("start_char"), F.col("tail").alias("end_char"))
    return in_parts.unionByName(whole)
