"""Small tables with the odd rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, length string, component string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    s = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    out = ["".join(r.choices(s, k=r.randint(1, 4))) for _ in range(words)]
    for i in range(9, words, 10):
        out[i] += "."
    return " ".join(out)


def rows(texts, first: int = 0):
    return [(first + i, t, "en", "src", len(t) if t is not None else None, "k", "i", "l", "c") for i, t in enumerate(texts)]


def odd_rows():
    """Null ids, null, empty and blank texts, non-ASCII, one long text, repeated rows."""
    base = [None, "", " \n\t ", "word", "ä é 日本 🙂 \x0b x", prose(1, 30), prose(1, 30), prose(2, 6000)]
    out = rows(base)
    return [*out, out[5], (None, "a null id has this text " + prose(3, 20), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def docs(spark, texts=None, first: int = 0):
    return spark.createDataFrame(odd_rows() if texts is None else rows(texts, first), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
