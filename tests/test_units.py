"""Operators whose results SQL does not state: literal cases, invariants, streams against their batch twins."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from paperloom.functions.literals import frame
from paperloom.operators import answers, forms, pages, retrieval, textops, usage
from paperloom.sources import files, logs
from paperloom.streaming import counters

SF = "/root/testdata/sf0.001"


def test_retrieval_literals(spark):
    docs = frame(spark, [(1, "Total amount due 500 EUR"), (2, "Payment terms net 30 days"), (3, "الاسم الأول محمد تاريخ الميلاد"), (4, ""), (5, None)], "doc_id long, text string")
    index = retrieval.chunks(docs)

    def search(q):
        return [r["doc_id"] for r in retrieval.top_k(retrieval.score(index, frame(spark, [(0, q)], "query_id long, query string"))).collect()]

    assert search("payment terms")[0] == 2 and search("الاسم محمد") == [3] and search("") == search("   ") == []


def test_windows_cover_the_text(spark):
    text = " ".join(f"w{i}" for i in range(701))
    rows = retrieval.chunks(frame(spark, [(1, text)], "doc_id long, text string")).orderBy("chunk").collect()
    assert [r["text"].split()[0] for r in rows] == ["w0", "w150", "w300", "w450", "w600"] and len(rows[0]["text"].split()) == 300


def test_summary_chunks_join_to_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) > 3000")
    chunks = textops.summary_chunks_of(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("joined"), F.max(F.length("text")).alias("most"))
    bad = docs.join(chunks, "doc_id").where((F.col("joined") != F.col("text")) | (F.col("most") > 3000))
    assert bad.count() == 0


def test_rate_limit_batch_and_stream(spark):
    calls = frame(spark, [(i, "a", float(s)) for i, s in enumerate([0, 1, 2, 9, 10, 11, 25])], "id long, identity string, second double")
    got = usage.rate_limited(calls.withColumn("ts", F.timestamp_micros((F.col("second") * 1e6).cast("long"))).drop("second"), 2, 10)
    assert [r["allowed"] for r in got.orderBy("id").collect()] == [True, True, False, False, True, True, True]
    batch = {(r["id"], r["allowed"]) for r in usage.rate_limit(spark, SF).collect()}
    assert batch == {(r["id"], r["allowed"]) for r in counters.stream_rate_limit(spark, SF).collect()}


def test_streams_equal_batch_over_several_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    sort = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert sort(counters.stream_funnel(spark, str(tmp_path))) == sort(counters.batch_funnel_counts(spark, SF))
    quota = usage.quota_daily(spark, SF).where("allowed").count()
    assert counters.stream_quota(spark, str(tmp_path)).agg(F.sum("used")).first()[0] == quota


def test_cache_hits_do_not_prolong(spark, tmp_path):
    frame(spark, [(i, "h", float(s)) for i, s in enumerate([0, 8, 10, 11, 19])], "id long, hash string, second double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, hash string, second double").parquet(str(tmp_path / "in"))
    got = counters.drain(counters.cache_stream(stream, 10), "cache-test", "append").orderBy("id").collect()
    assert [r["hit"] for r in got] == [False, True, True, False, True]


def test_upsert_keeps_the_latest(spark, tmp_path):
    write = counters.upsert_latest(str(tmp_path / "t"), ["k"], ["at"])
    write(frame(spark, [("a", 1, 1), ("b", 1, 2)], "k string, v int, at int"), 0)
    for _ in range(2):  # a batch run twice
        write(frame(spark, [("a", 2, 3), ("b", 0, 1)], "k string, v int, at int"), 1)
    want = {("a", 2, 3), ("b", 1, 2)}
    assert {tuple(r) for r in counters.latest_rows(spark, str(tmp_path / "t"), ["k"], ["at"]).collect()} == want
    counters.compact(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"], ["at"])
    assert {tuple(r) for r in counters.latest_rows(spark, str(tmp_path / "u"), ["k"], ["at"]).collect()} == want


def test_revision_log_and_exports(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "1", "at": 5, "summary": "x"}\nbroken\n{"id": "2", "at": 6}\n')
    assert [r["id"] for r in logs.revision_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["2", "1"]
    log = usage.audit_source(spark, SF).limit(5)
    logs.export_cef(log, str(tmp_path / "cef"))
    lines = spark.read.text(str(tmp_path / "cef")).collect()
    assert len(lines) == 5 and all(r[0].startswith("CEF:0|") and "doc\\=\\|" in r[0] for r in lines)
    logs.export_csv(log.select("id", "action"), str(tmp_path / "csv"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_audit_chain_goes_over_batches_and_gathers_no_log(spark):
    rows = [(i, i // 3, (None, 1, 2)[i % 3 % 2 + (i % 7 == 0)], "act", None if i % 5 == 0 else f"t{i}", "d") for i in range(200)]
    log = frame(spark, rows, "id long, second long, team long, action string, target string, detail string").withColumn("ts", F.timestamp_seconds("second"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        chain = usage.audit_chain_rows(log)
        assert "collect_list" not in chain._jdf.queryExecution().toString()
        got = {r["id"]: tuple(r) for r in chain.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    before, want = {}, {}
    for i, second, team, action, target, detail in rows:
        prev = before.get(team, usage.ZEROS)
        before[team] = hashlib.sha256(f"{prev}|{action}|{target or ''}|{detail}|1970-01-01T00:{second // 60:02}:{second % 60:02}".encode()).hexdigest()
        want[i] = (team, i, prev, before[team])
    assert got == want


def test_hmac(spark):
    got = {r["id"]: r["signature"] for r in logs.webhook_signatures(spark, SF).collect()}
    events = [(r["event_id"] + 1000, r["props"], f"key{r['user_id']}") for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert got == {i: hmac.new(k.encode(), p.encode(), hashlib.sha256).hexdigest() for i, p, k in [*logs.SIGNED, *events]}


def test_label_values(spark):
    lines = frame(spark, textops.LINES, "doc_id long, line long, text string")
    got = {r["key"]: r["value"] for r in textops.label_values(lines).collect()}
    assert got["full_name"] == "Ahmad Omar" and got["date_of_birth"] == "15.03.1990" and got["phone_number"] == "0176 1234567" and got["first_name"] == "Ali"
    assert "last_name" not in got  # the next line is a label itself


def test_mapping_precedence(spark):
    rows = {r["id"]: r for r in forms.ontology_match(spark, SF).collect()}
    label = {x: i for i, x in forms.LABELS}
    assert rows[label["Passport number"]]["key"] == "city"  # "ort" comes first
    assert rows[label["Bundesland"]]["key"] == "country" and rows[label["Vor- und Nachname"]]["key"] == "last_name"
    assert rows[label["zzz"]]["key"] is None and rows[label[""]]["key"] is None


@pytest.mark.parametrize("query, loose, cased, whole", [("na", 3, 3, 0), ("invoice", 3, 1, 3), ("cat", 4, 4, 2)])
def test_search(spark, query, loose, cased, whole):
    text = {"na": "na na nabatman", "invoice": "Invoice INVOICE invoice", "cat": "cat category concatenate cat"}[query]
    t = F.lit(text)
    row = spark.range(1).select(textops.occurrences(t, query).alias("a"), textops.occurrences(t, query, True).alias("b"), textops.occurrences(t, query, whole_word=True).alias("c")).first()
    assert (row["a"], row["b"]) == (loose, cased) and (query == "na" or row["c"] == whole)


def test_page_lists(spark):
    got = {r["id"]: r["pages"] for r in pages.page_range_parse(spark, SF).collect()}
    assert got[0] == "0 1 2 4 7 8 9" and got[3] == "0 1 2" and got[4] == "" and got[6] is None and got[7] is None and got[8] is None
    df = frame(spark, [(1, p) for p in (2, 0, 1, 1)] + [(2, 5)], "g long, p int")
    assert {r["g"]: r["spec"] for r in pages.page_spec(df, "g", "p").collect()} == {1: "1-3", 2: "6"}


def test_otsu_edges(spark):
    hist = frame(spark, [("two", 40, 100), ("two", 210, 100), ("one", 200, 5)], "image string, bin long, n long")
    got = {r["image"]: r["threshold"] for r in pages.otsu(hist).collect()}
    assert 40 <= got["two"] < 210 and got["one"] == 127


def test_answers(spark):
    got = {r["id"]: r["json"] for r in answers.json_salvage(spark, SF).collect()}
    assert got[1] == '{"a": 2}' and got[2] == '{"a": {"b": 3}}' and got[3] is None and got[4] is None
    edits = answers.edit_repair(spark, SF).collect()
    assert {(r["id"], r["original"], r["suggestion"], r["category"]) for r in edits if r["id"] < 1000} == {(0, "colour", "color", "spelling"), (1, "teh", "the", "other"), (2, "u", "you", "tone")}


def test_file_verdicts(spark):
    got = {r["id"]: (r["refused"], r["verdict"]) for r in files.file_screen(spark, SF).collect()}
    assert got[1] == (None, "Complete") and got[2] == (None, "Truncated") and got[3][0] == got[5][0] == got[7][0] == "executable" and got[4] == ("empty", "NotPdf")


def test_redaction_leaves_no_needle(spark):
    assert textops.redact_text(spark, SF).where("needle_left").count() == 0


def test_no_module_outside_llm_imports_it():
    from pathlib import Path

    root = Path(__file__).parent.parent / "paperloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "paperloom.llm" not in f.read_text(), f


def test_an_index_holds_texts_only_where_they_are_cited(spark):
    assert "text" not in retrieval._index(spark, SF).columns and "text" in retrieval._index(spark, SF, True).columns
