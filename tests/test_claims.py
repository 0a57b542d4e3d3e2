import random
import re

from ravelin.operators import claims


def plain(answer, reference, percent):
    """(tp, fp, fn) by taking the most alike pair of claims again and again."""
    a, b = ([w for w in (sorted(set(re.findall(r"[^\W_]+", s.lower()))) for s in re.split(r"[.!?\n]+", t or "")) if w] for t in (answer, reference))
    na, nb, tp = len(a), len(b), 0
    while True:
        best = min(((-len(set(x) & set(y)) / len(set(x) | set(y)), x, y) for x in a for y in b if 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y))), default=None)
        if best is None:
            return tp, na - tp, nb - tp
        a.remove(best[1])
        b.remove(best[2])
        tp += 1


def test_claims_are_matched_as_one_by_one(spark, tmp_path):
    r = random.Random(8)
    say = lambda n: ". ".join(" ".join(r.choices("abcdefgh", k=r.randint(1, 5))) for _ in range(n))
    rows = [(i, say(r.randint(0, 9)), say(r.randint(0, 9))) for i in range(80)]
    rows += [(100, None, "a b."), (101, "a b", None), (102, "", "..!"), (103, "The cat. the CAT! a dog", "cat the.\nThe cat? The cat"), (104, "a b c. " * 40, "a b. a b c. " * 30), (105, None, None)]
    for percent in (50, 80, 100):
        got = claims.correctness(spark.createDataFrame(rows, "id long, answer string, reference string"), f"{tmp_path}/{percent}", percent).collect()
        assert {x.id: (x.tp, x.fp, x.fn) for x in got} == {i: plain(a, b, percent) for i, a, b in rows}
        assert all(x.f1 == round(2 * x.tp / max(1, 2 * x.tp + x.fp + x.fn), 6) for x in got)


def test_no_pairs(spark, tmp_path):
    assert claims.correctness(spark.createDataFrame([], "id long, answer string, reference string"), f"{tmp_path}/m").collect() == []


def test_claims_are_compared_where_their_row_is(spark):
    rows = spark.createDataFrame([(1, ["a b", "a b", "c d e", "f"], ["a b", "c d", "c d", "g"])], "id long, a array<string>, b array<string>")
    df = claims.compared(rows, 50)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    # what is left of a is a b, c d e and f, of b c d (twice) and g
    got = df.first()
    assert (got.made, got.wanted, got.same) == (4, 4, 1) and [tuple(x) for x in got.links] == [(1, 0, 1, 2, 2 / 3)]


def test_rows_of_one_id_are_one_pair(spark, tmp_path):
    rows = [(1, "a b. c d", "a b"), (1, "e f", "c d. g h"), (2, "a", "b"), (None, "a b", "a b")]
    got = claims.correctness(spark.createDataFrame(rows, "id long, answer string, reference string"), f"{tmp_path}/m").collect()
    assert sorted((tuple(x)[:4] for x in got), key=repr) == sorted([(1, 2, 1, 1), (1, 2, 1, 1), (2, 0, 1, 1), (None, 0, 0, 0)], key=repr)
