import collections
import hashlib
import re
import time
from html import unescape

import corpus_pipeline
import pytest
import test_dedup
import test_native
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.llm import _store, bpe, html_text, quality_rules, queries, shards, token_counts
from ravelin.llm.shards import ShardStore

PAGE = """<html><head><title>x</title></head><body><header class="top"><h1>Site</h1></header><nav><a href="/">home</a></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div id="content"><h2>Title &amp; more</h2><p>First <a href="/x">link</a> para<br>line&nbsp;two
 end.</p><aside>side</aside><div class="ad">buy</div><p>Second.</p><form><input><p>f</p></form></div>
<section class="comments"><p>nice post</p></section><footer>c</footer><script>var t="<p>";</script>"""


def test_html(spark):
    assert html_text.extract(PAGE, {}) == "Title & more\nFirst link para line two end.\nSecond."
    assert [html_text.extract(x, {}) for x in (None, "", "<nav><p>a</p></nav>", "<!-- x", "x < y")] == ["", "", "", "", "x < y"]
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "<article>" + "<p>w</p>" * 5000, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[2].text == "" and got[None].n_chars == 9999 and got[1].n_chars == len(got[1].text)
    assert html_text.main_text(df.limit(0)).count() == 0


def truth(page):
    """Text of the one <article> of a page of the sample tables, by patterns of its own."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", body)
    lines = (" ".join(unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def test_every_page_as_its_article(spark):
    """Marked pages give their article; so do held-out pages whose mark is taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.fit(pages, most=50)
    rows = pages.orderBy("page_id").collect()
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == {r.page_id: truth(r.html) for r in rows}
    for r in rows[-100:]:
        bare = re.sub("<(/?)article>", r"<\1div>", r.html)
        assert html_text.extract(bare, weights) == truth(r.html)


def brute_run(x):
    runs = [(-sum(x[i : j + 1]), j, -i) for i in range(len(x)) for j in range(i, len(x)) if sum(x[i : j + 1]) > 0]
    return (-min(runs)[2], min(runs)[1]) if runs else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=14))
def test_the_scan_finds_the_maximum_run(x):
    assert html_text.best_run(x) == brute_run(x)


BODY = " ".join(f"word{k}" for k in range(60))


def test_containers_keep_their_text():
    for name in ("layout has-sidebar", "no-sidebar", "sidebar-left", "content ad", "page-wrapper"):
        for inner in (f"<p>{BODY}</p>", f"<article><p>{BODY}</p></article>", f"<main><div><p>{BODY}</p></div></main>"):
            assert html_text.extract(f'<html><body><div class="{name}">{inner}</div></body></html>', {}) == BODY
            assert html_text.extract(f'<html><body class="{name}"><form id="f">{inner}</form></body></html>', {}) == BODY
    for name in ("social-science", "notice-board", "ad-free", "related-work", "shareholders", "commentary"):
        for mark in ("article", "div"):
            assert html_text.extract(f'<{mark}><p>{BODY}</p><div class="{name}">kept here</div></{mark}>', {}) == f"{BODY}\nkept here"
    for name in ("sidebar", "cookie-notice", "adBanner", "site-footer", "share-buttons", "related_posts", "comments", "comment-list"):
        for mark in ("article", "div"):
            assert html_text.extract(f'<{mark}><p>{BODY}</p><div class="{name}"><p>gone</p></div></{mark}>', {}) == BODY
    # reader comments go however long they are
    assert html_text.extract(f'<article><p>{BODY}</p><section id="comments">{("<p>" + BODY + "</p>") * 9}</section></article>', {}) == BODY


def test_several_marked_parts_are_kept():
    small, between = "one two three four five", "<div>" + "x " * 12 + "</div>"
    assert html_text.extract(f"<article>{small}</article>{between}<article><p>{BODY}</p></article>", {}) == f"{small}\n{BODY}"
    cards = "".join(f"<article><a href='/{k}'>card number {k}</a></article>" for k in range(4))
    assert html_text.extract(f"<main><p>{BODY}</p></main>{cards}", {}) == BODY


def test_weights_change_what_unmarked_pages_give(spark):
    """Names that labelled pages show outside of their articles only, and words in contexts they show there."""
    labelled = [(k, f'<body><div class="x9">{"teaser words " * 9}</div><ul><li>{"item " * 30}</li></ul><article><p class="lead">{BODY}</p></article></body>') for k in range(5)]
    weights = html_text.fit(spark.createDataFrame(labelled, "page_id long, html string"))
    assert weights["o:x9"] and weights["c:x9"] == -100 and weights["w:li"] == -100 and weights["w:p"] > 0 and weights["c:lead"] > 0
    page = f'<div><p>{BODY}</p><div class="x9">out</div><p>{BODY}</p></div><ul><li>some tail</li></ul>'
    assert html_text.extract(page, {}) == f"{BODY}\nout\n{BODY}\nsome tail"
    assert html_text.extract(page, weights) == f"{BODY}\n{BODY}"
    # rows that repeat an id count once
    assert html_text.fit(spark.createDataFrame(labelled * 3, "page_id long, html string"), most=5) == weights


def test_no_section_goes_for_its_name_alone(spark):
    part = " ".join(f"said{k}" for k in range(40))
    for name in ("promotion", "discussion", "related", "responses"):
        for mark in ("article", "div"):
            assert html_text.extract(f'<{mark}><p>{BODY}</p><section id="{name}"><h2>On it</h2><p>{part}</p></section></{mark}>', {}) == f"{BODY}\nOn it\n{part}"
            for unit in (f'<ul>{"<li><a href=x>other story</a></li>" * 3}</ul>', '<div class="c">so said one</div>' * 3, "<p>write</p><form><textarea></textarea></form>"):
                assert html_text.extract(f'<{mark}><p>{BODY}</p><section class="{name}">{unit}</section></{mark}>', {}) == BODY
    labelled = [(k, f'<body><div class="digest">{part}</div><article><p>{BODY}</p></article></body>') for k in range(5)]
    weights = html_text.fit(spark.createDataFrame(labelled, "page_id long, html string"))
    assert weights["o:digest"] and html_text.extract(f'<div><p>{BODY}</p><div class="digest">{part}</div><p>{BODY}</p></div>', weights) == f"{BODY}\n{part}\n{BODY}"
    assert html_text.extract(f'<div><div class="digest">{part}</div><p>{BODY}</p></div>', weights) == f"{part}\n{BODY}"
    began = time.process_time()
    html_text.extract('<div class="related">a ' * 40_000, {})
    assert time.process_time() - began < 8


def test_a_heading_right_before_the_article_is_kept():
    assert html_text.extract(f"<body><nav>m</nav><h1>The title</h1><div class='ad'>buy</div><article><p>{BODY}</p></article></body>", {}) == f"The title\n{BODY}"
    for page in (f"<h1><a href='/'>Site</a></h1><article><p>{BODY}</p></article>", f"<header><h1>Site</h1></header><article><p>{BODY}</p></article>", f"<h1>Site</h1><p>some words</p><article><p>{BODY}</p></article>"):
        assert html_text.extract(f"<body>{page}</body>", {}) == BODY
    assert html_text.extract(f"<h1>Site</h1><article><h1>Own</h1><p>{BODY}</p></article>", {}) == f"Own\n{BODY}"


def test_malformed_pages_take_linear_time():
    for bad in ("<p ", '<p a="', "<p a='\"", "<!--", "<script>", "</", "<", "<p>", "<li>", "<div>", "<a b='>", "<nav>", "<td><tr>"):
        began = time.process_time()
        html_text.extract(bad * (1_000_000 // len(bad)), {})
        assert time.process_time() - began < 8, bad
    began = time.process_time()
    html_text.extract("<div>a " * 60_000 + "<article></article>" * 60_000, {})
    assert time.process_time() - began < 8
    assert html_text.extract("text <b unclosed", {}) == "text < b unclosed"
    assert html_text.extract('<p title="never closed>one <b>two</b></p><p>three</p>', {}) == "one two\nthree"
    assert html_text.extract("<p>a<script>var x = '</p>'", {}) == "a" and html_text.extract("<p>a<nav>b<article>c d</article>", {}) == "c d"


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "t", 5, "k")] * 2 + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, id string")
    got = sorted(map(tuple, html_text.main_text(df).collect()), key=repr)
    assert got == [(1, "u", BODY, len(BODY))] * 2 + [(None, None, "", 0)]


class Lost(Exception):
    pass


def lose_at(monkeypatch, module, name, after=False):
    """The next call of a module's function ends the driver, before or after it took effect."""
    real = getattr(module, name)

    def once(*a, **k):
        monkeypatch.setattr(module, name, real)
        if after:
            real(*a, **k)
        raise Lost

    monkeypatch.setattr(module, name, once)


def counted(spark):
    return spark.createDataFrame([(1, "s", "en", 3, "x"), (2, "s", "en", None, "x"), (3, None, "de", 4, "x")], "doc_id long, source string, lang string, n long, tokens string")


def test_rollup_is_idempotent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FOLD", 3)
    monkeypatch.setattr(token_counts, "SEGMENT", 2)
    docs = counted(spark)
    folder = f"file://{tmp_path}/r"
    roll = token_counts.Rollup(spark, folder)
    assert roll.totals().count() == 0 and roll.fold() == 0
    put = lambda name, op, df, **k: roll.apply(name, token_counts.changes(df, op, "v1", F.col("n"), **k))
    assert put("a", "insert", docs) and not put("a", "insert", docs)
    assert put("../b' %/", "revise", docs.where("doc_id = 1").withColumn("n", F.lit(10)), old=F.lit(3))
    assert not token_counts.Rollup(spark, folder).apply("../b' %/", token_counts.changes(docs, "insert", "v1", F.col("n")))
    want = [("s", "en", "v1", 2, 10), (None, "de", "v1", 1, 4)]
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == want
    for k in range(9):
        assert put(f"more {k}", "insert", docs) and not put("a", "insert", docs)
    assert roll._base()["version"] >= 9 and len(roll._tail(roll._base())) < 3
    for k in range(9):
        assert put(f"less {k}", "delete", docs) and not put(f"more {k}", "insert", docs)
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == want
    assert put("c", "delete", docs.where("doc_id = 3")) and put("d", "insert", docs.limit(0))
    assert list(map(tuple, roll.totals().collect())) == [("s", "en", "v1", 2, 10)]


def test_rollup_after_lost_drivers(spark, tmp_path, monkeypatch):
    docs, n = counted(spark), 0
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    for after in (False, True):
        for name in ("_summed", "create_once"):
            n += 1
            lose_at(monkeypatch, token_counts, name, after)
            with pytest.raises(Lost):
                roll.apply(f"b{n}", token_counts.changes(docs, "insert", "v1", F.col("n")))
            taken = after and name == "create_once"
            assert roll.apply(f"b{n}", token_counts.changes(docs, "insert", "v1", F.col("n"))) != taken
        # between the totals of a base and its name
        lose_at(monkeypatch, token_counts, "create_once", after)
        with pytest.raises(Lost):
            roll.fold()
        assert sorted(map(tuple, roll.totals().collect()), key=repr) == [("s", "en", "v1", 2 * n, 3 * n), (None, "de", "v1", n, 4 * n)]


def test_two_drivers_commit_a_batch_once(spark, tmp_path, monkeypatch):
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    signed = token_counts.changes(counted(spark), "insert", "v1", F.col("n"))
    real = token_counts.create_once

    def late(spark_, path, content):
        # the other driver commits the same batch, and one of its own, just before
        monkeypatch.setattr(token_counts, "create_once", real)
        assert token_counts.Rollup(spark, roll.folder).apply("other", signed) and token_counts.Rollup(spark, roll.folder).apply("a", signed)
        return real(spark_, path, content)

    monkeypatch.setattr(token_counts, "create_once", late)
    assert not roll.apply("a", signed)
    assert {r.docs for r in roll.totals().collect()} == {4, 2}


def test_token_counts_query_as_the_library(spark, tmp_path):
    """Totals of op3 by the library, with special tokens in a text, copies, nulls and texts of a hot group."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(900_000 + k, "same text <|endoftext|> here", "en", "s", 0) for k in range(300)] + [(None, "same text <|endoftext|> here", None, None, None), (7, None, None, "s", None)]
    base.unionByName(spark.createDataFrame(more, base.select("doc_id", "text", "lang", "source", "n_chars").schema)).write.parquet(f"{tmp_path}/documents.parquet")
    whole = bpe.tokenizer(bpe.default_vocabulary()).whole
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    first, want = {}, collections.Counter()
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    for r in rows:
        if r.doc_id is None or r.doc_id == first[r.text or ""]:
            for version, plain in (("special", False), ("plain", True)):
                whole.encode_special_tokens = plain
                want[r.source, r.lang, version, "docs"] += 1
                want[r.source, r.lang, version, "tokens"] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + (not plain)
    whole.encode_special_tokens = False
    got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in queries.op3_token_counts(spark, str(tmp_path)).collect() for c in ("docs", "tokens")}
    assert got == {k: v for k, v in want.items() if v or want[(*k[:3], "docs")]}


def test_shards(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=400_000, fanout=4)
    df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("file"), F.lit(None).cast("int").alias("bytes"))
    for k in range(9):
        store.append(df.where(F.col("id") % 9 == k).repartition(2))
    before = store.manifest()
    assert len(before["shards"]) == 18 and before["version"] == 9
    after = store.compact()
    assert after["version"] >= 10 and len(after["shards"]) < 18
    # nothing is left to merge, also among what was merged
    assert store.compact() == after and all(len(x) < 4 for x in store.tiers().values())
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect()))
    assert store.read(9).count() == 20_000
    assert store.vacuum() >= 18 and store.read().count() == 20_000
    assert store.append(df.limit(0))["version"] > 10 and store.read().count() == 20_000
    store.append(df.limit(5)), store.append(df.limit(5))
    assert store.read().count() == 20_010


def test_shards_of_many_arrivals(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.range(1000).selectExpr("id", "id % 7 as arrival", "cast(null as string) as x").repartition(3)
    made = store.append_each(df, F.col("id") % 5)
    assert [m["version"] for m in made] == [1, 2, 3, 4, 5] and store.read(2).count() == 400
    assert len(store.compact()["shards"]) == 1 and sorted(store.read().columns) == ["arrival", "id", "x"]
    assert sorted(r.id for r in store.read().collect()) == list(range(1000))
    other = ShardStore(spark, f"file://{tmp_path}/empty")
    assert other.append_each(df.limit(0), F.col("id"))[0]["version"] == 1 and other.read().count() == 0 and other.compact()["version"] == 1
    got = queries.op8_shards(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and got.where("not compacted").count() == 0


def test_op8_says_the_same_of_tables_of_any_size(spark, tmp_path, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'s' as source", "7L as n_chars")
    seen, real = [], ShardStore.append_each
    monkeypatch.setattr(ShardStore, "append_each", lambda self, df, arrival: (seen.append({r.doc_id: r.a for r in df.select("doc_id", arrival.alias("a")).collect()}), real(self, df, arrival))[1])
    # one row, one file, more files than arrivals, and a target that every shard fills
    for k, (rows, files, target) in enumerate([(1, 1, shards.TARGET), (40, 1, shards.TARGET), (40, 12, shards.TARGET), (40, 12, 1)]):
        docs.where(F.col("doc_id") < rows).repartition(files).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        monkeypatch.setattr(ShardStore.__init__, "__defaults__", (target, shards.FANOUT))
        got = queries.op8_shards(spark, f"{tmp_path}/{k}").collect()
        assert sorted(r.doc_id for r in got) == list(range(rows)) and all(r.compacted for r in got)
    assert seen[1] == seen[2] == seen[3] == seen[1] | seen[0] and set(seen[1].values()) == set(range(queries.ARRIVALS))


def test_a_merge_that_wins_nothing_ends(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, f"file://{tmp_path}/s", fanout=3)
    store.append(spark.range(100).repartition(5))
    monkeypatch.setattr(store, "_merged", lambda run, m: store._written(store.read().repartition(9)))
    assert store.compact()["version"] == 1 and store.read().count() == 100 and len(store.manifest()["shards"]) == 5


def test_no_column_of_a_shard_is_lost(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fanout=2)
    store.append(spark.createDataFrame([(1, "a")], "id long, text string"))
    store.append(spark.createDataFrame([(2,)], "id long"))
    store.append(spark.createDataFrame([(3, 0.5)], "id long, score double"))
    want = [(1, "a", None), (2, None, None), (3, None, 0.5)]
    for _ in range(2):
        assert sorted(map(tuple, store.read().select("id", "text", "score").collect())) == want
        store.compact()
        store.vacuum()
    assert len(store.manifest()["shards"]) == 1
    for bad in ("id string", "ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], bad))
    assert sorted(map(tuple, store.read().select("id", "text", "score").collect())) == want


def test_shards_after_lost_and_other_writers(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, f"file://{tmp_path}/s", fanout=3)
    df = spark.range(10).select("id").coalesce(1)
    for after in (False, True):
        lose_at(monkeypatch, shards, "create_once", after)
        with pytest.raises(Lost):
            store.append(df)
        assert store.append(df)["version"] == store.manifest()["version"]
    assert store.read().count() == 30
    lose_at(monkeypatch, shards, "create_once")
    with pytest.raises(Lost):
        store.compact()
    assert store.read().count() == 30
    real = shards.create_once

    def late(spark_, path, content):
        monkeypatch.setattr(shards, "create_once", real)
        ShardStore(spark, store.folder, fanout=3).append(df)
        return real(spark_, path, content)

    # another writer appends while shards are merged, and while another arrival is appended
    monkeypatch.setattr(shards, "create_once", late)
    assert len(store.compact()["shards"]) == 2 and store.read().count() == 40
    monkeypatch.setattr(shards, "create_once", late)
    store.append(df)
    assert store.read().count() == 60

    def merged(spark_, path, content):
        monkeypatch.setattr(shards, "create_once", real)
        ShardStore(spark, store.folder, fanout=3).compact()
        return real(spark_, path, content)

    # another writer merges the same shards
    monkeypatch.setattr(shards, "create_once", merged)
    assert len(store.compact()["shards"]) < 4 and store.read().count() == 60 and store.vacuum() > 0 and store.read().count() == 60


def test_a_file_is_made_once(spark, tmp_path):
    at = f"file://{tmp_path}/a/b"
    assert _store.create_once(spark, at, b"one") and not _store.create_once(spark, at, b"two")
    assert _store.file_text(spark, at) == "one" and _store.names_in(spark, f"file://{tmp_path}/a") == ["b"] and _store.names_in(spark, at + "/none") == []


def chain(rows, items):
    """Brute force of all five stages over (doc_id, text, source): what is left with its masked text."""
    out = []
    for d, t, source in rows:
        n_words, chars, symbols, dup, _, failed = test_native.measure(t)
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        stops = sum(x in quality_rules.STOP_WORDS or x in [v.capitalize() for v in quality_rules.STOP_WORDS] for x in w)
        if not failed and 2 <= chars / n_words <= 14 and symbols / n_words <= 0.25 and (stops + 3) / n_words >= 0.03 and dup / len(lines) <= 0.5:
            out.append((d, t, source))
    kept = {r[0] for r in test_dedup.groups([(d, t) for d, t, _ in out], 5, 80) if r[3]}
    out = [r for r in out if r[0] in kept]
    bad = {r[0] for r in test_native.judged([(d, t) for d, t, _ in out], items) if r[5]}
    out = [r for r in out if r[0] not in bad]
    return {d: test_native.masked(t, spans) for (d, t, _), spans in zip(out, test_native.with_live(out))}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = table, [table.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out
        seen.append(out.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = chain([tuple(r) for r in table.select("doc_id", "text", "source").collect()], items)
    whole = bpe.tokenizer(bpe.default_vocabulary()).whole
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = {}
    for d, t in want.items():
        ids = whole.encode(t, add_special_tokens=False).ids
        digests[d] = (d, len(ids), sha(",".join(map(str, ids))), sha(t))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(digests.values())


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    long, other = (" ".join(f"the {x}{k} of" for k in range(2000)) for x in "wv")
    rows = [(1, long, "en", "s", 3, "x"), (1, long, "en", "s", 3, "x"), (2, None, None, None, None, None), (None, long + " end", None, None, None, "y"), (3, "", "de", "s", 0, "x"), (4, long + " last", "en", None, None, "x"), (5, other, "en", "s", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = sorted(((r.doc_id is None, r.doc_id or 0) for r in out.collect()))
            if docs is not df:
                assert got == []
                continue
            assert name == "bpe" or out.columns == docs.columns
            # without words: rejected by the rules, linked with nothing, clean of benchmark text and secrets
            ids = [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
            gone = {"quality_rules": {(False, 2), (False, 3)}, "near_duplicates": {(False, 4)}}.get(name, set())
            assert got == [x for x in ids if x not in gone], name


def test_only_words_mark_an_article(spark):
    body = "".join(f"<p>Sentence {k} of the long body text.</p>" for k in range(20))
    want = "\n".join(f"Sentence {k} of the long body text." for k in range(20))
    hidden = ["<!-- <article class=x> <main> -->", "<script>var t = '<article >';</script>", "<template><main>x</main></template>", "<article></article>"]
    pages = [f"<html><body>{x}<div>{body}</div></body></html>" for x in hidden]
    teasers = "".join(f"<article><a href='/{k}'>card {k}</a><p>more</p></article>" for k in range(3))
    pages.append(f"<html><body><div>{body}</div>{teasers}</body></html>")
    real = "<html><body><div>outside</div><article><p>" + "inside words " * 9 + "</p></article><div>outside</div></body></html>"
    assert [html_text.extract(x, {}) for x in pages[:4]] == [want] * 4 and html_text.extract(pages[4], {}).startswith(want)
    assert html_text.extract(real, {}) == ("inside words " * 9).strip()
    # pages that mark nothing don't count as labelled, however many come first
    rows = [(k, x) for k, x in enumerate([*pages, real])]
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert html_text.fit(df, most=1) == html_text.fit(df.where("page_id = 5"), most=1) != {}
    assert html_text.fit(df.where("page_id < 5"), most=1) == {}
