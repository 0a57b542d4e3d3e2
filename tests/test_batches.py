import pytest
from pyspark.sql import functions as F

from ravelin.streaming import batches

ROW = "a long, text string"


class Lost(Exception):
    pass


def stream(spark, folder):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def send(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").json(f"{folder}/in")


def work(df):
    return df.withColumn("n", F.length("text"))


def run(spark, folder, f=work):
    counters = {"empty": F.col("text").isNull().cast("int"), "chars": F.col("n")}
    batches.write(stream(spark, folder), f"{folder}/out", f"{folder}/at", f, counters).awaitTermination()


def rows(spark, folder):
    got = batches.committed(spark, f"{folder}/out")
    return sorted(map(tuple, got.select("a", "text", "n").collect()), key=repr)


@pytest.mark.parametrize("after", [False, True])
def test_a_batch_lost_before_or_after_its_commit_takes_effect_once(spark, tmp_path, monkeypatch, after):
    folder = f"file://{tmp_path}"
    sent = [[(1, "x"), (1, "x"), (2, None)], [(1, "x"), (3, "yy")], [(1, "x")]]
    for r in sent:
        send(spark, folder, r)
    real, calls = batches._commit, []

    def dying(spark, path, run, batch, counted):
        calls.append(batch)
        if calls == [0, 1]:
            if after:
                real(spark, path, run, batch, counted)
            raise Lost
        real(spark, path, run, batch, counted)

    monkeypatch.setattr(batches, "_commit", dying)
    with pytest.raises(Exception, match="Lost"):
        run(spark, folder)
    # what isn't committed isn't read
    assert len(rows(spark, folder)) == (5 if after else 3)
    run(spark, folder)
    assert calls == ([0, 1, 2] if after else [0, 1, 1, 2])
    want = sorted(((a, t, t and len(t)) for r in sent for a, t in r), key=repr)
    assert rows(spark, folder) == want
    counted = sorted((x.batch, x.counted) for x in batches.log(spark, f"{folder}/out").collect())
    by_batch = [(r["rows"], r["empty"], r["chars"]) for _, r in counted]
    assert [k for k, _ in counted] == [0, 1, 2] and sorted(by_batch) == [(1, 0, 1), (2, 0, 3), (3, 1, 2)]
    # nothing new, nothing added; new rows go on with the same run
    run(spark, folder)
    assert rows(spark, folder) == want
    send(spark, folder, [(9, "z")])
    run(spark, folder)
    assert rows(spark, folder) == sorted([*want, (9, "z", 1)], key=repr)
    assert batches.log(spark, f"{folder}/out").select("run").distinct().count() == 1


def test_no_input_and_empty_batches(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert batches.committed(spark, f"{folder}/out") is None and batches.log(spark, f"{folder}/out").collect() == []
    send(spark, folder, [(1, "x")])
    run(spark, folder, lambda df: work(df).where("a > 1"))
    assert rows(spark, folder) == [] and [x.counted for x in batches.log(spark, f"{folder}/out").collect()] == [{"rows": 0, "empty": 0, "chars": 0}]
