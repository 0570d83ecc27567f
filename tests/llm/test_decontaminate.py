import random

from paperloom.llm import decontaminate
from tests.llm.data import docs, no_docs, prose

QUESTION = "Maria has 12 apples and gives 5 apples to Peter then walks 3 km to the market near Berlin to buy 12 more. How many apples does she hold"


def bench(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def hits(spark, texts, items):
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, texts), bench(spark, items)).collect()}


def test_passages_and_swapped_parameters_are_caught(spark):
    item = prose(1, 30)
    swapped = QUESTION.replace("12", "40").replace("5 ", "9 ").replace("Maria", "Anna").replace("Peter", "Paul")
    broken = QUESTION.replace("12 more", "17 more")  # 12 stands for 12 and for 17
    around = lambda t: f"{prose(50, 40)} {t} {prose(51, 40)}"
    texts = [around(item), around(item.upper().replace(" ", " !! ")), around(QUESTION), around(swapped), around(broken), prose(60, 200), around(" ".join(item.split()[8:24])), around(" ".join(item.split()[:9]))]
    got = hits(spark, texts, [item, QUESTION])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1), (6, 0)}
    assert got[0, 0]["same_slots"] and got[2, 1]["same_slots"] and not got[3, 1]["same_slots"]
    assert got[0, 0]["span"] == 30


def test_two_values_never_share_one(spark):
    item = "Tom gives 3 apples to Sue and 5 pears to Bob while 7 plums stay in the basket near the old door today"
    merged = item.replace("Sue", "Tom").replace("5", "3").replace("7", "3")
    swapped = item.replace("Sue", "Ann").replace("5", "6").replace("Tom", "Sue")
    assert set(hits(spark, [merged, swapped, item], [item])) == {(1, 0), (2, 0)}


def test_scattered_phrases_are_no_passage(spark):
    words = prose(2, 220).split()
    item = " ".join(words)
    far = [" ".join(words[a : a + 9]) for a in range(0, 200, 40)]  # two windows each
    stuffed = " ".join(f"{x} {prose(300 + i, 31)}" for i, x in enumerate(far))
    assert not hits(spark, [stuffed], [item])


def test_null_and_repeated_item_ids(spark):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    table = spark.createDataFrame([(None, a), (7, b), (7, c), (7, c), (8, None)], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, [f"x {a} y", f"x {b} y", f"x {c} y", prose(9, 60)]), table).collect()
    assert sorted((r["doc_id"], str(r["item_id"])) for r in got) == [(0, "None"), (1, "7"), (2, "7")]


def test_recall_of_reparameterised_questions(spark):
    """Names, numbers and units replaced one to one, and a word put in, left out or changed."""
    r = random.Random(5)
    names = ["Anna", "Boris", "Clara", "David", "Elena", "Frank", "Greta", "Henry"]

    def question(i, values):
        filler = prose(2000 + i, 24).replace(".", "").split()
        slots = iter(values)
        return " ".join(w if k % 6 or not k else f"{w} {next(slots)}" for k, w in enumerate(filler))

    def values():
        return [*r.sample(names, 2), f"{r.randint(10, 99)}.{r.randint(10, 99)} kg"]

    items = [question(i, values()) for i in range(30)]
    asked = [question(i, values()) for i in range(30)]
    for i in range(30):
        words = asked[i].split()
        k = r.randint(9, 18)
        if i % 4 == 1:
            words.insert(k, "inserted")
        elif i % 4 == 2:
            words[k : k + 1] = []
        elif i % 4 == 3:
            words[2] = "changed"
        asked[i] = f"{prose(50, 30)} {' '.join(words)} {prose(51, 30)}"
    clean = [prose(4000 + i, 90) for i in range(30)]
    got = set(hits(spark, asked + clean, items))
    assert len(got & {(i, i) for i in range(30)}) >= 27 and got <= {(i, i) for i in range(30)}


def test_short_items_match_whole_texts_only(spark):
    got = hits(spark, ["What is 2 plus 2", "what is 7 plus 9?", "Well, what is 2 plus 2 then", ""], ["What is 2 plus 2?", None, ""])
    assert set(got) == {(0, 0), (1, 0)}


def test_placeholders_alone_are_no_evidence(spark):
    numbers = " ".join(str(i) for i in range(40))
    assert not hits(spark, [" ".join(str(900 + i) for i in range(40))], [numbers])


def test_remove_keeps_clean_documents_and_columns(spark):
    item = prose(1, 30)
    df = docs(spark).unionByName(docs(spark, ["so " + item + " it ends"], first=500))
    kept = decontaminate.remove_leaks(df, bench(spark, [item]))
    assert kept.columns == df.columns
    # The odd rows hold the same thirty words as a text of their own, twice and once more as a repeated row.
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["0", "1", "2", "3", "4", "7", "None", "None"])
    assert decontaminate.remove_leaks(no_docs(spark), bench(spark, [item])).count() == 0
    assert decontaminate.remove_leaks(df, bench(spark, []).where("false")).count() == df.count()


def test_slots_keep_their_place():
    assert decontaminate.WINDOW == 8


def test_copies_of_items_full_of_names_are_caught(spark):
    names = ["Alice Brown, Bob Green and Carol White met near Paris today.", "Maria Lopez sold Peter Smith 3 kg of Gala Apples near New York City for 12 dollars."]
    long = "Anna Bell, Carl Dunn, Eva Ford, Gus Hale, Ida Jones, Karl Lamb, Mia Nash and Otto Pratt came. " + prose(5, 30)
    around = lambda t: f"{prose(50, 40)} {t} {prose(51, 40)}"
    texts = [around(t) for t in names] + [around(t.lower()) for t in names] + [around(t.upper()) for t in names]
    texts += [around(long[: long.index(" came")]), around(names[1].replace("Maria Lopez", "Rosa Marin").replace("Gala Apples", "Conference Pears"))]
    assert set(hits(spark, texts, [*names, long])) == {(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 2)}


def test_one_name_for_two(spark):
    item = "How long does the train from Boston to Denver take when it leaves at 9 in the morning and waits for 20 minutes in the old station"
    asked = item.replace("Boston", "New York").replace("Denver", "Salt Lake City").replace("20", "45")
    around = lambda t: f"{prose(50, 40)} {t} {prose(51, 40)}"
    back = "The bus to Santa Rosa Beach passes Fort Worth at 7 and then goes on over the long hill to the small town by the sea"
    fewer = back.replace("Santa Rosa Beach", "Miami").replace("Fort Worth", "Tulsa")
    assert set(hits(spark, [around(asked), around(item), around(fewer), prose(9, 120)], [item, back])) == {(0, 0), (1, 0), (2, 1)}


def test_short_items_inside_longer_texts(spark):
    items = ["What is the capital of France?", "Name the largest city of Peru and Chile", "Why?"]
    around = lambda t: f"{prose(50, 40)} {t} {prose(51, 40)}"
    texts = [around("What is the capital of France?"), around("what is the capital of france"), around("What is the capital of Spain?"), around("Paris is the capital of France."), around("What is the capital"), around("Name the largest city of Cuba and Cuba!"), around("Name the largest city of Cuba and Haiti"), around("Why?")]
    got = hits(spark, texts, items)
    assert set(got) == {(0, 0), (1, 0), (2, 0), (6, 1)}
    assert got[0, 0]["same_slots"] and not got[2, 0]["same_slots"]


def test_no_column_name_clashes_and_long_texts(spark):
    item = prose(1, 30)
    df = docs(spark, [prose(7, 60_000) + " " + item, prose(8, 60_000)])
    for name in ("bad_id", "bad_hash", "__id", "__hash", "h", "view"):
        df = df.withColumn(name, df["doc_id"])
    kept = decontaminate.remove_leaks(df, bench(spark, [item]))
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_the_search_makes_each_texts_slots_once(spark, monkeypatch):
    plans = {}

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return persisted(df, name, *more)

    persisted = decontaminate.persisted
    monkeypatch.setattr(decontaminate, "persisted", seen)
    bench = spark.createDataFrame([(1, "Anna Berg of New York bought nine red apples for 3 kg of green paint on Monday")], "item_id long, text string")
    decontaminate.leaks(docs(spark), bench).count()
    assert plans["window-hits"].count("kilometres") == 1
