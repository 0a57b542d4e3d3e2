import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import chunking, evaluation, memory, rag, relational, retrieval, transit
from ravelin.sources import readers, sinks
from ravelin.streaming import events


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_names(spark):
    pairs = [("qwen/qwen3-4b:free", "result_qwen_qwen3_4b_free.json.json", "qwen_qwen3_4b_free"), ("google/gemma-3-4b-it:free", "result_google_gemma_3_4b_it_fr.json", "google_gemma_3_4b_it_fr"), ("gpt-4o-mini", "result_gpt_4o_mini.json.json", "gpt_4o_mini")]
    for model, name, key in pairs:
        assert one(spark, T.result_name(F.lit(model))) == name
        assert one(spark, T.model_key(F.lit(name))) == key


def test_small_rules(spark):
    assert one(spark, T.clean_text(F.lit("a\xa0b\n c >"))) == "a b c "
    assert [one(spark, T.station(F.lit(s))) for s in ("하단", "서면역", "남포경찰서")] == ["하단역", "서면역", "남포역"]
    assert [one(spark, T.direction(F.lit(s))) for s in ("1001", "2002")] == ["up", "down"]
    assert sorted(["001000", "043000", "235900", "042959"], key=lambda s: one(spark, T.service_seconds(F.lit(s)))) == ["043000", "235900", "001000", "042959"]
    assert [one(spark, T.day_code(F.lit(f"2024-01-{d:02d}").cast("date"))) for d in range(1, 8)] == ["8"] * 5 + ["7", "9"]
    assert one(spark, T.final_answer(F.lit("x Final Answer: a Final Answer: b "))) == "b"


def test_recursive_split_bounds():
    text = "Some words here. " * 40 + "\n\n" + "x" * 700 + "\nlast line"
    for size, overlap in ((100, 20), (512, 128), (64, 0)):
        chunks = chunking.recursive_split(text, size, overlap)
        assert all(0 < len(c) <= size for c in chunks)
        assert set("".join(chunks).split()) >= {"Some", "words", "here."} and "last line" in chunks[-1]


def test_split_and_resume(spark):
    df = spark.range(7).toDF("id")
    got = relational.positional_split(df, 0.8, ["id"]).orderBy("id").collect()
    assert [r.part for r in got] == ["train"] * 5 + ["test"] * 2 and [r.position for r in got] == list(range(1, 8))
    tasks, done = (spark.createDataFrame([(x,) for x in s], "q string") for s in ("abc", "b"))
    assert sorted(r.q for r in relational.remaining(tasks, done, ["q"]).collect()) == ["a", "c"]


def test_mmr_with_full_balance_is_top_k(spark):
    rows = [(1, k, 1 / (k + 1), [float(k), 1.0]) for k in range(8)]
    got = retrieval.mmr(spark.createDataFrame(rows, "query_id long, vec_id long, score double, embedding array<double>"), 4, 1.0)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_scores():
    assert evaluation.rouge_l("a b c d".split(), "a c d".split()) == 6 / 7
    assert evaluation.bleu("a b c d".split(), "a b c d".split()) == 1.0 and evaluation.bleu([], ["a"]) == 0.0


def test_memory(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", str(k)) for k in range(1, 8)], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in memory.last_exchanges(turns, 2).collect()) == [5, 6, 7]
    assert sorted(r.turn for r in memory.within_budget(turns, 3, F.lit(1)).collect()) == [5, 6, 7]


def test_sources_and_sinks(spark, tmp_path):
    assert readers.collection(spark, f"{tmp_path}/none") is None
    assert readers.resume_state(spark, f"{tmp_path}/none", "q string").count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    for _ in range(2):
        sinks.append_new(df, f"{tmp_path}/c", ["k"])
    assert readers.collection(spark, f"{tmp_path}/c").count() == 2
    (tmp_path / "x.jsonl").write_text('{"q": "a"}\nbad\n{"q": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "q string").count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# A\ntext")
    assert readers.markdown(spark, str(tmp_path / "d")).first().metadata["filename"] == "a.md"


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"q": "a"}\n{"q": "b"}\n')
    for name in ("1", "2"):
        if name == "2":
            (tmp_path / "in" / "2.json").write_text('{"q": "b"}\n{"q": "c"}\n')
        stream = events.file_batches(spark, str(tmp_path / "in"), "q string", 1)
        events.resume(stream, f"{tmp_path}/out", ["q"], lambda d: d, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.q for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_sentences(spark):
    assert one(spark, transit.sentences(F.array(F.lit("go"), F.lit(None).cast("string"), F.lit("turn")))) == "1. go\n2. turn"


def test_nearest_walks_queries_in_blocks(spark, monkeypatch):
    rows = [(k, [float(k % 7 + 1), float(k % 5), float(k)]) for k in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    take = lambda q: sorted(map(tuple, retrieval.nearest(v, q, 3).collect()))
    whole = take(v.where("vec_id % 2 = 0"))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 6)
    assert take(v.where("vec_id % 2 = 0")) == whole and len(whole) == 60
    assert take(v.limit(0)) == []


def test_agent_steps_by_lines(spark):
    cases = {
        'Thought: x\nAction: Search\nAction Input: "rain"': ("Search", "rain"),
        "Action 1: Add\nAction 1 Input 1: 3 4\nmore": ("Add", "3 4\nmore"),
        "Action Input: 1\nAction: A\nAction Input: 2": ("A", "2"),
        "Action: A": (None, None), "Action Input: x": (None, None), "": (None, None),
    }
    for said, want in cases.items():
        assert (one(spark, T.action(F.lit(said))), one(spark, T.action_input(F.lit(said)))) == want


def test_one_failing_prompt_stops_no_other(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "q string").coalesce(1)
    assert sorted(map(tuple, rag.generate(df, "q", model).collect())) == [("a", "A", None), ("b", "B", None), ("bad", None, "no")]


def test_a_repeated_key_fails(spark):
    with pytest.raises(Exception, match="not unique"):
        relational.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_white_space_of_any_script(spark):
    assert one(spark, T.clean_text(F.lit("a\u3000\u2003b\x0b\x1cc "))) == "a b c"


def test_scores_of_mixtures_are_left_out(spark):
    rows = [("base", 2.0, 0.5, 0.5), ("mix", 100.0, 0.5, 0.5)]
    got = {r.model: r for r in evaluation.leaderboard(spark.createDataFrame(rows, "model string, params double, faithfulness double, factual double"), "base", ("mix",)).collect()}
    assert got["mix"].faith_per_b is None and got["base"].faith_per_b == 0.25 and got["mix"].combined == 0.5


def test_a_board_ranks_only_the_ends_of_the_day(spark):
    from ravelin.operators import transit

    times = [("050000", "11"), ("050000", "12"), ("120000", "11"), ("120000", "11"), ("031500", "13"), ("023000", "17"), ("023000", "15"), ("080000", "13"), (None, "19"), ("120500", "22"), ("060000", "24")]
    df = transit.board(spark.createDataFrame(times, "arrival string, train string").repartition(3), 12 * 3600)
    got = sorted((x.direction, x.arrival, x.train) for x in df.collect())
    assert got == sorted([("up", "050000", "11"), ("up", "120000", "11"), ("up", "031500", "13"), ("up", "023000", "17"), ("down", "120500", "22"), ("down", "060000", "24")])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2  # trains of whole days are never ranked


def test_chunks_and_scores_leave_a_task_piece_by_piece(spark, monkeypatch):
    from ravelin.operators import chunking, evaluation

    docs = spark.createDataFrame([(k, None if k == 3 else f"some words of text {k}. " * 40) for k in range(30)], "doc_id long, text string").coalesce(1)
    pairs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("candidate"), F.reverse("text").alias("reference"))
    run = lambda: (sorted(map(tuple, chunking.recursive_chunks(docs).collect())), sorted(map(tuple, evaluation.text_scores(pairs).collect())))
    want = run()
    monkeypatch.setattr(chunking, "CHARS", 2000)
    monkeypatch.setattr(evaluation, "ROWS", 7)
    assert run() == want and len(want[0]) > 29 and len(want[1]) == 30
