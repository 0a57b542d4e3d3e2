import json
import os

import pytest
from pyspark.sql import functions as F

from ravelin.operators import rag
from ravelin.operators.tools import TableTool, register_tables
from ravelin.sources import readers


def walked(edges, start, depth, most, good):
    """(url, depth) in the order of a queue."""
    seen, queue = [(start, 0)], [(start, 0)]
    while queue:
        at, d = queue.pop(0)
        if d == depth:
            break
        for u, v, _ in sorted((e for e in edges if e[0] == at and e[1]), key=lambda e: e[2]):
            if good(u, v) and v not in [s for s, _ in seen]:
                seen.append((v, d + 1))
                queue.append((v, d + 1))
    return seen[:most]


@pytest.mark.parametrize("depth,most", [(2, 10), (3, 4), (1, 1), (4, 100)])
def test_a_crawl_visits_what_a_queue_does(spark, depth, most):
    url = lambda k: f"http://h{k % 3}.org/{k}"
    edges = [(url(k), url((k * 7 + j * j) % 40), j) for k in range(40) for j in range(8)] + [(url(1), None, 9), (url(2), url(2), 0), (url(3), url(5), 0), (url(3), url(5), 11)]
    df = spark.createDataFrame(edges, "url string, target string, place int")
    starts = spark.createDataFrame([(url(k),) for k in (0, 1, 7, 7)] + [(None,), ("http://nowhere.org",)], "url string")
    for same, like in ((False, None), (True, None), (False, "%h1%")):
        good = lambda u, v: (not same or u.split("/")[2] == v.split("/")[2]) and (like is None or "h1" in v)  # noqa: B023, E731
        got = readers.crawl(df, starts, depth, most, like, same).orderBy("start", "visit").collect()
        for s in {url(0), url(1), url(7), "http://nowhere.org"}:
            assert [(x.url, x.depth) for x in got if x.start == s] == walked(edges, s, depth, most, good)
            assert [x.visit for x in got if x.start == s] == list(range(1, 1 + sum(x.start == s for x in got)))


def test_every_row_of_a_crawls_starts_can_be_a_visit(spark):
    df = spark.createDataFrame([("a", x, k) for k, x in enumerate("bcd")], "url string, target string, place int")
    starts = spark.createDataFrame([(x,) for x in "aaa"] + [("d",), (None,), (None,)] + [("e",)] * 9, "url string")
    got = readers.crawl(df, starts, 2, 5, repeats=True).orderBy("start", "visit").collect()
    want = {"a": ["a", "a", "a", "b", "c"], "d": ["d"], None: [None, None], "e": ["e"] * 5}
    assert {s: [x.url for x in got if x.start == s] for s in want} == want and len(got) == 13
    assert [x.visit for x in got if x.start == "a"] == [1, 2, 3, 4, 5] and [x.depth for x in got if x.start == "a"] == [0, 0, 0, 1, 1]
    assert [(x.start, x.visit) for x in readers.crawl(df, starts, 2, 1, repeats=True).orderBy("start").collect()] == [(None, 1), ("a", 1), ("d", 1), ("e", 1)]


def test_the_crawl_is_its_sql_where_pages_share_a_url(spark, tmp_path):
    import duckdb

    from ravelin.plans import registry

    pages = [(k, None if k % 6 == 5 else f"http://h{k % 4}.com/{k % 4}", f'<a href="/p{k % 3}">x</a><a href="/p{k % 5}">y</a>') for k in range(24)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.queries()["crawl"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(registry.oracle_sql()["crawl"]).fetchall(), key=repr)


def test_tools_that_give_tables_check_their_arguments(spark):
    route = TableTool("legs", "trip struct<from: string, to: struct<x: int, y: int>>, stops array<string>", "place int, stop string", lambda given: [(k, f"{given['trip']['to']['y']}{s}") for k, s in enumerate(given["stops"] or [])])
    register_tables(spark, "test_tool", {"route": route, "one": TableTool("one", "a int", "b long", lambda given: [(given["a"] or 0,)])})
    ask = lambda args, tool="'route'": spark.sql(f"select id, t.* from range(2), lateral test_tool({tool}, {args}) t").collect()
    fits = "named_struct('stops', array('p', 'q'), 'trip', named_struct('to', named_struct('y', cast(id as int), 'x', 1), 'from', null))"
    assert sorted(map(tuple, ask(fits))) == [(0, 0, "0p"), (0, 1, "0q"), (1, 0, "1p"), (1, 1, "1q")]
    assert [tuple(r) for r in ask("if(id = 1, named_struct('a', 4), null)", "'one'")] == [(1, 4)]
    wrong = {
        "named_struct('stops', array('p'), 'trip', named_struct('to', named_struct('y', 'z', 'x', 1), 'from', 'a'))": "arguments.trip.to.y is string, not int",
        "named_struct('stops', array('p'), 'trip', named_struct('to', named_struct('y', 1), 'from', 'a'))": "arguments.trip.to.x is missing",
        "named_struct('stops', array(1), 'trip', null)": r"arguments.stops\[\] is int, not string",
        "named_struct('stops', null, 'trip', null, 'more', 1)": "arguments.more is not an argument",
    }
    for args, said in wrong.items():
        with pytest.raises(Exception, match=said):
            ask(args)
    with pytest.raises(Exception, match="no such tool: nope"):
        ask(fits, "'nope'")


def test_only_failed_rows_are_asked_again(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.mkdir(log)

    def called(who, prompts):
        for p in prompts:
            with open(f"{log}/{who}", "a") as f:
                f.write(p + "\n")

    def strict(prompts):
        if any(p.startswith("raise") for p in prompts):
            raise ValueError("down")
        called("strict", prompts)
        return ["{}" if p.startswith("poor") else "[" if p.startswith("bad") else json.dumps({"title": p, "n": 1}) for p in prompts]

    def plain(prompts):
        called("plain", prompts)
        return [json.dumps({"title": "again", "n": 2}) if not p.endswith("ever") else "no" for p in prompts]

    rows = [(1, "good"), (2, "raise"), (3, "poor"), (4, "bad"), (5, "bad for ever"), (6, None), (None, "null key"), (1, "good")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = f"file://{tmp_path}/out"
    run = lambda d: sorted(((r.id or 0, r.parsed and tuple(r.parsed), r.error, r.tries) for r in rag.rewritten(d, "text", "title string, n int", path, strict, plain).collect()))
    done = [(0, ("null key", 1), None, 1), (1, ("good", 1), None, 1), (2, ("again", 2), None, 2), (3, ("again", 2), None, 2), (4, ("again", 2), None, 2)]
    failed = [(5, None, "not a record", 2), (6, None, "no prompt", 2)]
    assert run(df) == done + failed
    count = lambda who: sorted(open(f"{log}/{who}").read().splitlines())
    assert count("plain") == ["bad", "bad for ever", "poor", "raise"]
    before = count("strict")
    assert run(df.union(spark.createDataFrame([(7, "new")], df.schema))) == done + failed[:0] + sorted([*failed, (7, ("new", 1), None, 1)])
    assert sorted(count("strict")) == sorted([*before, "bad for ever", "new"]) and count("plain").count("bad for ever") == 2
    errors = sorted(r.value for r in spark.read.text(f"{path}/errors").collect())
    assert errors == ['{"id":5}\tnot a record'] * 2 + ['{"id":6}\tno prompt'] * 2


def test_records_that_dont_parse_are_empty(spark):
    said = ['{"title": "a", "content": "b"}', '{"title": "a"}', "none", None, "[]", '{"title": "a", "content": "b", "more": 1}']
    got = rag.structured(spark.createDataFrame([(x,) for x in said], "a string"), "a", "title string, content string", {"title": "", "content": ""}).select("parsed.*").collect()
    assert list(map(tuple, got)) == [("a", "b"), ("", ""), ("", ""), ("", ""), ("", ""), ("a", "b")]


def test_legs_are_read_from_the_events(spark, tmp_path):
    from ravelin.plans import registry

    rows = [(0, 1, "click"), (1, 1, "error"), (2, 1, "view"), (3, 2, "error")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry.queries()["leg_suffix"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0, "SUBWAY", "하단역", "남포역"), (1, 1, "WALK", "남포역", "서면역"), (1, 2, "SUBWAY", "서면역", "home역"), (2, 3, "WALK", "home", "남포")]
