import random

import corpus_pipeline
from paperloom.llm import linededup
from tests.llm.data import docs, no_docs, prose

LICENCE = "Licensed under the Apache License, Version {}."


def run(spark, df, **options):
    out = linededup.dedup_lines(df, **options)
    return out, {r["doc_id"]: r for r in out.collect()}


def test_recurring_templates_go_and_copies_stay(spark):
    own = [prose(i, 40) for i in range(12)]
    texts = [f"{t}\n{LICENCE.format(i)}\n{prose(100 + i, 30)}" for i, t in enumerate(own)]  # a variable field
    copied = "\n".join(prose(200 + k, 20) for k in range(5))
    texts += [copied] * 20 + ["short\n" + prose(300 + i, 15) for i in range(9)]
    out, got = run(spark, docs(spark, texts))
    for i in range(12):
        assert got[i]["text"] == f"{own[i]}\n{prose(100 + i, 30)}" and got[i]["__n_dropped"] == 1 and got[i]["__n_lines"] == 3
    assert all(got[i]["text"] == texts[i] for i in range(12, len(texts)))  # neighbours are the same; too short to tell


def test_middle_of_a_line_may_vary(spark):
    texts = [f"{prose(i, 30)}\nPosted in the general news section of our site by {prose(900 + i, 2)} again\n{prose(50 + i, 30)}" for i in range(8)]
    _, got = run(spark, docs(spark, texts))
    assert all("Posted" not in r["text"] for r in got.values())


def test_names_vary_in_lines_of_any_length(spark):
    """A name at any place behind the leading tokens, in short, middling and long lines."""
    long = prose(800, 21).split()
    r = random.Random(1)

    def notices(i):
        name = prose(1000 + i, 1).strip(".") + "x" * (i % 7)
        return [f"Posted by {name} in news", f"This page was last changed {name} ago by the team here", f"Read on {name} for all the rest of it", " ".join([*long[:9], name, *long[9:], name])]

    planted = [notices(i) for i in range(40)]
    texts = []
    for i, found in enumerate(planted):
        lines = [prose(i * 50 + k, r.randint(5, 30)) for k in range(6)] + found
        r.shuffle(lines)
        texts.append("\n".join(lines))
    _, got = run(spark, docs(spark, texts))
    caught = sum(line not in got[i]["text"].split("\n") for i, found in enumerate(planted) for line in found)
    assert caught >= 0.9 * 160
    assert all(got[i]["__n_dropped"] <= 4 for i in range(40))


def test_a_common_value_belongs_to_the_wider_template(spark):
    names = ["Smith"] * 4 + [f"Name{chr(97 + i)}" for i in range(6)]
    texts = [f"{prose(i, 40)}\nPosted by {name} in our news\n{prose(60 + i, 20)}" for i, name in enumerate(names)]
    texts += [f"{prose(100 + i, 40)}\nPosted by Smith in {w} news\n{prose(160 + i, 20)}" for i, w in enumerate(("blue", "red"))]
    _, got = run(spark, docs(spark, texts))
    assert all(("Posted" in got[i]["text"]) == (i > 9) for i in range(12))


def test_fewer_documents_than_asked_keep_their_lines(spark):
    texts = [f"{prose(i, 30)}\n{LICENCE.format(2)}" for i in range(4)]
    _, got = run(spark, docs(spark, texts))
    assert all(got[i]["text"] == t for i, t in enumerate(texts))
    _, got = run(spark, docs(spark, texts), min_docs=4)
    assert all("Licensed" not in r["text"] for r in got.values())


def test_a_line_repeated_in_one_document_is_one_document(spark):
    text = "\n".join(x for i in range(30) for x in ("the very same line of text", prose(i, 8)))
    _, got = run(spark, docs(spark, [text, prose(99, 20)]))
    assert got[0]["text"] == text


def test_odd_rows_and_columns(spark):
    df = docs(spark)
    out = linededup.dedup_lines(df).drop(linededup.N_LINES, linededup.N_DROPPED)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert linededup.dedup_lines(no_docs(spark)).count() == 0


def independent(spark, texts):
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), "").collect()}


def test_blocks_of_lines_go_from_independent_documents(spark):
    block = "\n".join(prose(500 + k, 8) for k in range(3))
    copied = "\n".join([*(prose(200 + k, 20) for k in range(9)), block])
    own = [f"{prose(i, 60)}\n{prose(100 + i, 30)}" for i in range(20)]
    edited = [copied.replace(prose(200 + i % 9, 20), prose(300 + i, 20)) for i in range(45)]  # each has a line of its own
    got = independent(spark, [f"{t}\n{block}" for t in own] + [copied] * 80 + edited)
    assert [got[i] for i in range(20)] == own
    assert got[20] == copied[: -len(block) - 1]
    assert all(got[100 + i] == t[: -len(block) - 1] for i, t in enumerate(edited))


def test_copies_alone_keep_their_lines(spark):
    copied = "\n".join(prose(200 + k, 20) for k in range(9))
    texts = [copied] * 30 + [copied.replace(prose(200 + i % 9, 20), prose(300 + i, 20)) for i in range(45)]
    assert list(independent(spark, texts).values()) == texts


def test_short_lines_need_more_documents(spark):
    texts = [f"{prose(i, 40)}\nAll rights reserved.\n{prose(100 + i, 30)}" + ("\nThank you." if i < 15 else "\nAnd ornd.") for i in range(40)]
    got = independent(spark, texts)
    assert all("reserved" not in t and "ornd" not in t for t in got.values())
    assert all(("Thank" in got[i]) == (i < 15) for i in range(40))
    odd = docs(spark)
    out = linededup.dedup_lines(odd).drop(linededup.N_LINES, linededup.N_DROPPED)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))


def test_a_line_shared_by_alike_and_unlike_documents(spark, tmp_path):
    """A long line in many unlike documents and in a family of alike ones, whose members link to each other and not to most others."""
    import duckdb

    from paperloom.llm.queries import ORACLE_SQL

    r = random.Random(3)
    long = prose(7000, 30)
    pool = [prose(7100 + i, r.randint(6, 9)) for i in range(12)]
    texts = [f"{prose(i, 25)}\n{long}" for i in range(150)]  # the line is more than half of these
    texts += [f"{prose(200 + i, 40)}\n{long}" for i in range(100)]  # and less than half of these
    texts += ["\n".join([prose(400 + i, 35), long, *r.sample(pool, 5)]) for i in range(80)]
    texts += [f"{prose(600 + i, 45)}\n{pool[i % 12]}\n{prose(800 + i, 45)}" for i in range(60)]
    r.shuffle(texts)
    df = docs(spark, texts).select("doc_id", "text")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {d: (n, k, t) for d, n, k, t in con.execute(f"SELECT doc_id, n_lines, n_dropped, text FROM ({ORACLE_SQL['op10_line_dedup']})").fetchall()}
    out, got = run(spark, df)
    assert {d: (x["__n_lines"], x["__n_dropped"], x["text"]) for d, x in got.items()} == want
    assert 0 < sum(k > 0 for _, k, _ in want.values())


def test_columns_named_like_the_operators_own(spark):
    df = docs(spark, [prose(1, 30)] * 3)
    for name in ("drop", "__drop", "hit_id", "LINES", "hit_hash"):
        df = df.withColumn(name, df["doc_id"])
    out = linededup.dedup_lines(df).drop(linededup.N_LINES, linededup.N_DROPPED)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
