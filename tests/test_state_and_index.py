import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ravelin.operators import evaluation, postings, relational, retrieval
from ravelin.sources import named_files, readers, services, sinks
from ravelin.streaming import chat

TURN = "conv_id long, turn long, lang string, text string, n_words long"


def sent(spark, folder, name, rows):
    """One more file of turns, and everything the stream has given since it began."""
    spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(TURN).json(f"{folder}/in")
    got = chat.drained(chat.sessions(stream, 2, name), f"{folder}/out-{name}", timers=name > 0)
    return sorted(map(tuple, got.collect()))


def test_sessions_go_on_after_a_restart_and_end_with_the_language(spark, tmp_path):
    first = sent(spark, tmp_path, 0, [(1, 1, "a", "y", 2), (1, 0, "a", "x", 1), (2, None, "a", None, 0)])
    assert first == [(1, 0, "a", 1, 0, 1, ""), (1, 1, "a", 1, 1, 3, "x"), (2, None, "a", 1, 0, 0, "")]
    second = sent(spark, tmp_path, 0, [(1, 2, "a", "z", 4), (1, 3, "b", "w", 1), (1, 4, "b", "v", 1)])
    assert [x for x in second if x not in first] == [(1, 2, "a", 1, 2, 7, "x\ny"), (1, 3, "b", 2, 0, 1, ""), (1, 4, "b", 2, 1, 2, "w")]


def test_idle_sessions_expire(spark, tmp_path):
    first = sent(spark, tmp_path, 200, [(1, 0, "a", "x", 1), (1, 1, "a", "y", 1)])
    time.sleep(0.3)
    second = sent(spark, tmp_path, 200, [(1, 2, "a", "z", 1)])
    assert len(first) == 2 and [x for x in second if x not in first] == [(1, 2, "a", 2, 0, 1, "")]


def test_index_reads_fewer_postings_and_finds_the_same(spark, tmp_path):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randint(1, 60)))) for i in range(600)] + [(600, None), (601, "")]
    # a few ranges hold what rare words ask for
    docs += [(700 + i, " ".join(["rare", "rarer"] * r.randint(3, 9) + ["w0"])) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    postings.build(df, f"{tmp_path}/index", width=16)
    index = postings.Index(spark, f"{tmp_path}/index")
    asked = [(1, "rare w0 w1"), (2, "w3 w7"), (3, "Rarer rare w2 w0"), (4, "unknown"), (5, None), (6, "w59")]
    got = index.search(spark.createDataFrame(asked, "query_id long, text string"), 4, f"{tmp_path}/s", first=2).collect()
    for q, text in asked:
        want = retrieval.top(retrieval.bm25(df, (text or "").lower().split()), 4).collect()
        assert sorted((x.rank, x.doc_id, x.score) for x in got if x.query_id == q) == [(i + 1, x.doc_id, x.score) for i, x in enumerate(want)], q
    read, held = index.postings_read(f"{tmp_path}/s")
    assert 0 < read < 0.8 * held
    index.search(spark.createDataFrame(asked[:1], "query_id long, text string"), 4, f"{tmp_path}/one", first=1).collect()
    read, held = index.postings_read(f"{tmp_path}/one")
    assert read < 0.1 * held


def shuffled(spark):
    """Records that all stages so far have written to the shuffle."""
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_index_shuffles_texts_once_and_no_pairs_of_queries_and_documents(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    n, asks = 1500, 40
    df = spark.createDataFrame([(i, " ".join(r.sample(words, 25))) for i in range(n)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    queries = spark.createDataFrame([(q, " ".join(r.sample(words, 8))) for q in range(asks)], "query_id long, text string")
    before = shuffled(spark)
    postings.build(df, f"{tmp_path}/index")
    built = sum(v for k, v in shuffled(spark).items() if k not in before)
    # texts, and terms once a task; no posting (37,500)
    assert n <= built < 3 * n
    index, before = postings.Index(spark, f"{tmp_path}/index"), shuffled(spark)
    got = index.search(queries, 3, f"{tmp_path}/s").collect()
    # blocks and ranges, each twice at most; pairs of a query and a document that holds its words are nearly 60,000
    assert sum(v for k, v in shuffled(spark).items() if k not in before) < 0.2 * n * asks
    for q, text in queries.where("query_id % 20 = 0").collect():
        want = retrieval.top(retrieval.bm25(df, text.split()), 3).collect()
        assert sorted((x.rank, x.doc_id, x.score) for x in got if x.query_id == q) == [(i + 1, x.doc_id, x.score) for i, x in enumerate(want)]


@pytest.mark.parametrize("sent", [postings.SENT, 0])
def test_index_takes_null_and_repeated_ids(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(postings, "SENT", sent)
    docs = [(i, f"a w{i % 7} w{i % 5}") for i in range(300)] + [(None, "a rare"), (None, "a rare"), (None, "rare rare w1"), (-3, "rare"), (5, "a rare w5"), (5, "rare")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    postings.build(df, f"{tmp_path}/index", width=16)
    asked = [("x", "a rare"), ("x", "rare w1"), ("y", "w3 w4"), ("z", "none")]
    got = postings.Index(spark, f"{tmp_path}/index").search(spark.createDataFrame(asked, "query_id string, text string"), 6, f"{tmp_path}/s", first=1).collect()
    for q, words in {"x": ["a", "rare", "w1"], "y": ["w3", "w4"], "z": ["none"]}.items():
        all_ = retrieval.bm25(df, words).collect()
        want = sorted((-x.score, x.doc_id is None, x.doc_id or 0, x.doc_id) for x in all_)[:6]
        assert sorted((x.rank, x.doc_id, x.score) for x in got if x.query_id == q) == [(i + 1, x[-1], -x[0]) for i, x in enumerate(want)], q


def test_a_service_opens_the_answers_that_are_asked_for(spark, tmp_path):
    rows = [(s, f"{h:02}00", h % 2 == 0) for s in ("a", "b/c", "d") for h in range(5)]
    services.store(spark.createDataFrame(rows, "station string, time string, up boolean"), f"file://{tmp_path}/t", "station")
    read = lambda **how: services.answers(spark, f"file://{tmp_path}/t", "station string, time string, up boolean", "station", **how)
    assert sorted(map(tuple, read().collect())) == sorted(rows)
    for f in os.listdir(tmp_path / "t/station=d"):
        (tmp_path / "t/station=d" / f).write_text("not json")
    with services.pushdown(spark):
        some = read().where(F.col("station").isin("a", "b/c") & F.col("up"))
        assert sorted(map(tuple, some.collect())) == sorted(x for x in rows if x[0] != "d" and x[2])
        assert read().where("station = 'a'").count() == 5 and read().where("station = 'nowhere'").count() == 0
        assert read(limit=2).where("station = 'a'").count() == 2
    with pytest.raises(Exception, match="JSON|Expecting"):
        read().collect()


def test_named_files(spark, tmp_path):
    rows = [(f"f{i}.md", f"body {i}\n\nsecond") for i in range(20)] + [("ä b.md", None)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(3)
    for _ in range(2):
        named_files.write(df, f"file://{tmp_path}/x")
        held = {f: (tmp_path / "x" / f).read_text() for f in os.listdir(tmp_path / "x") if not f.startswith(("_", "."))}
        assert held == {n: b or "" for n, b in rows}
    docs = readers.markdown(spark, f"{tmp_path}/x").collect()
    assert sorted((d.metadata["filename"], d.text) for d in docs if d.text) == sorted((n, b) for n, b in rows if b)
    named_files.write(df.limit(1), f"file://{tmp_path}/x")
    assert len([f for f in os.listdir(tmp_path / "x") if f.endswith(".md") and f[0] != "."]) == 1
    # a task that fails leaves no file, and its job none of the others
    bad = df.union(spark.createDataFrame([("../up.md", "x")], "name string, body string"))
    with pytest.raises(Exception, match="not a file name"):
        named_files.write(bad, f"file://{tmp_path}/y")
    assert not [f for _, _, names in os.walk(tmp_path / "y") for f in names]
    sinks.text_files(df, f"file://{tmp_path}/z")
    assert len(os.listdir(tmp_path / "z")) >= len(rows)


def test_nothing_is_left_out(spark):
    codes = spark.range(12_000).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    got = relational.looked_up(codes.select("k").union(spark.createDataFrame([("x",), (None,)], "k string")), codes, "k", "other")
    assert got.where(F.col("label") == F.concat(F.lit("l"), F.col("k"))).count() == 12_000 and got.where("label = 'other'").count() == 2
    docs = spark.createDataFrame([("a" * 10,), ("b" * 25,), ("",), (None,)], "text string")
    configurations = evaluation.trials({"size": list(range(1, 61)), "overlap": list(range(25))}, spark)
    got = {(r.size, r.overlap): (r.n_chunks, r.per_document) for r in evaluation.run_trials(docs, configurations).collect()}
    want = {(s, o): sum(max(-(-(n - o) // (s - o)), 1) for n in (10, 25, 0)) for s in range(1, 61) for o in range(25) if o < s}
    assert len(want) > 1000 and got == {k: (n, round(n / 3, 6)) for k, n in want.items()}


def test_append_takes_null_keys_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, None)], "k int, v string")
    for _ in range(3):
        sinks.append_new(df, f"{tmp_path}/c", ["k"])
    got = {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/c").collect()}
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3 and got.keys() == {1, 2, None} and got[2] is None
    other = spark.createDataFrame([(1, "b"), (1, "a"), (None, "d"), (None, "c"), (2, None)], "k int, v string")
    sinks.append_new(other, f"{tmp_path}/d", ["k"])
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/d").collect()} == got


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_subsequence_by_bits():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(2))
        assert evaluation.lcs(a, b) == plain_lcs(a, b)
    a, b = ([str(r.randint(0, 500)) for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    assert evaluation.lcs(a, b) > 1000 and time.process_time() - began < 3
