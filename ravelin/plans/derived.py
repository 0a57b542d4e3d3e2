"""Queries whose rows are made in SQL from the given tables: names, replies, tool calls, itineraries and services, stored and searched."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import evaluation, postings, transit
from ravelin.operators.tools import Registry
from ravelin.plans.registry import HOSTED, LOCAL, SCORES, SIGNATURES, query, table, tokens_sql
from ravelin.sources import named_files, services, sinks
from ravelin.streaming import chat


def _pick(names: list[str], number: str):
    """One of the names by a number: what makes the column (there is no session yet when this is imported), and SQL."""
    made = lambda: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(number) % len(names) + 1).cast("int"))
    return made, "[" + ", ".join(f"'{n}'" for n in names) + f"][{number} % {len(names)} + 1]"


_SIGNATURE, _SIGNATURE_SQL = _pick(SIGNATURES, "event_id")
_ROUTED, _ROUTED_SQL = _pick([*SIGNATURES, "other"], "event_id")
_MODEL, _MODEL_SQL = _pick([m for m, *_ in SCORES], "event_id")


@query(f"""select event_id, name, replace(replace(name, 'result_', ''), '.json', '') as key from (select event_id, 'result_' || substring(regexp_replace(model, '[^a-zA-Z0-9_.]', '_', 'g') || '.json', 1, 23) || '.json' as name from (select event_id, user_id || '-' || {_SIGNATURE_SQL} as model from events))""")
def result_filename(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", T.result_name(F.concat(F.col("user_id").cast("string"), F.lit("-"), _SIGNATURE())).alias("name"))
    return m.withColumn("key", T.model_key(F.col("name")))


@query("select event_id, case when model like '%gpt%' then 'openai' when model in (" + ", ".join(f"'{m}'" for m in LOCAL) + ") then 'local' when model in (" + ", ".join(f"'{m}'" for m in HOSTED) + f") then 'openrouter' end as provider from (select event_id, {_ROUTED_SQL} as model from events)")
def model_routing(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.provider(_ROUTED(), LOCAL, HOSTED).alias("provider"))


@query(f"select event_id, upper(left(split_part(model, '_', 1), 1)) || lower(substring(split_part(model, '_', 1), 2)) || ' (' || params || 'B)' as label from (select event_id, {_MODEL_SQL} as model, cast(user_id % 90 as double) + 0.5 as params from events)")
def display_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", _MODEL().alias("model"), ((F.col("user_id") % 90).cast("double") + 0.5).alias("params"))
    return e.select("event_id", T.display_label(F.col("model"), F.col("params")).alias("label"))


_SAID = "case doc_id % 3 when 0 then 'Thought: which' || chr(10) || 'Action: Search' || chr(10) || 'Action Input: \"' || lang || '\"' when 1 then 'Thought: known' || chr(10) || 'Final Answer: ' || lang else 'no step at all' end"


@query("select doc_id, case when doc_id % 3 = 0 then 'Search' end as tool, case when doc_id % 3 = 0 then lang end as input, case when doc_id % 3 = 1 then lang end as answer from documents where lang is not null")
def react_parse(spark, sf_dir):
    s = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.expr(_SAID).alias("said"))
    return s.select("doc_id", T.action(F.col("said")).alias("tool"), T.action_input(F.col("said")).alias("input"), T.final_answer(F.col("said")).alias("answer"))


@query("select doc_id, 'which ' || lang || ' ' || n as question, coalesce(source, 'none') as answer from documents, (values (1), (2)) s(n) where lang is not null and n <= doc_id % 3")
def qa_parse(spark, sf_dir):
    one = "'[Q]: which ' || lang || ' {0}' || chr(10) || '[A]: ' || coalesce(source, 'none') || chr(10)"
    said = F.expr(f"case doc_id % 3 when 0 then 'none' when 1 then {one.format(1)} else {one.format(1)} || {one.format(2)} end")
    s = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", said.alias("said"))
    return s.select("doc_id", F.explode(T.qa_pairs(F.col("said"))).alias("p")).select("doc_id", "p.question", "p.answer")


@query("""select event_id as id, 0 as place, 'add' as tool, cast(user_id + event_id as varchar) as observation from events union all select event_id, 1, 'upper', upper(event_type) from events
    union all select event_id, 2, 'nope', 'no such tool' from events where event_id % 3 = 0""")
def tool_dispatch(spark, sf_dir):
    r = Registry()
    r.tool("add", "sum of two integers", "a int, b int")(lambda x: x["a"] + x["b"])
    r.tool("upper", "capitals", "text string")(lambda x: F.upper(x["text"]))
    call = lambda tool, given: F.struct(F.lit(tool).alias("tool"), given.alias("input"))
    two = F.array(call("add", F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_id").alias("b")))), call("upper", F.to_json(F.struct(F.col("event_type").alias("text")))))
    actions = F.when(F.col("event_id") % 3 == 0, F.concat(two, F.array(call("nope", F.lit("{}"))))).otherwise(two)
    return r.run_all(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), actions.alias("actions")))


_RATED = "select lang as model, 1.0 + count(*) % 50 as params, cast(count(*) filter (where n_chars % 2 = 0) as double) / count(*) as faithfulness, cast(count(*) filter (where n_chars % 3 = 0) as double) / count(*) as factual from documents where lang is not null group by lang"


@query(f"""with s as (select model, cast(params as double) as params, faithfulness, factual from ({_RATED})), b as (select faithfulness, factual from s where model = 'en')
    select s.model, round((s.faithfulness + s.factual) / 2, 6) as combined, round((s.faithfulness - b.faithfulness) / b.faithfulness * 100, 4) as faith_diff, round((s.factual - b.factual) / b.factual * 100, 4) as fact_diff, round(s.faithfulness / s.factual, 6) as ratio,
    case when not starts_with(s.model, 'de') then round(s.faithfulness / s.params, 6) end as faith_per_b, case when not starts_with(s.model, 'de') then round(s.factual / s.params, 6) end as fact_per_b from s, b""")
def model_leaderboard(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("ravelin_rated")
    s = spark.sql(_RATED.replace("from documents", "from ravelin_rated")).withColumn("params", F.col("params").cast("double"))
    return evaluation.leaderboard(s, "en", ("de",))


@query("select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2 from (select value / 1000 as y, cast(user_id % 100 as double) as x from events)")
def scaling_regression(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("y"), (F.col("user_id") % 100).cast("double").alias("x"))
    return evaluation.regression(e, "y", "x")


@query("""with o as (select o_custkey as id, o_orderkey as n, cast(floor(o_totalprice) as int) as fare, o_orderkey % 3 = 0 as bus, row_number() over (partition by o_custkey order by o_orderkey) as k from orders)
    select id, case when max(case when k = 1 then bus end) then coalesce(min(fare) filter (where not bus), max(case when k = 1 then fare end)) else max(case when k = 1 then fare end) end as fare from o group by id""")
def itinerary_pick(spark, sf_dir):
    """A customer's orders as itineraries in the order a service gave them."""
    fare = F.struct(F.struct(F.floor("o_totalprice").cast("int").alias("totalFare")).alias("regular"))
    legs = F.array(F.struct(F.when(F.col("o_orderkey") % 3 == 0, "BUS").otherwise("SUBWAY").alias("mode")))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderkey").alias("n"), fare.alias("fare"), legs.alias("legs")).alias("it"))
    o = o.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("it")), lambda x: F.struct(x["fare"].alias("fare"), x["legs"].alias("legs"))).alias("its"))
    return o.select("id", transit.pick_itinerary(F.col("its"))["fare"]["regular"]["totalFare"].alias("fare"))


@query("select leg, n, description from (select user_id as leg, event_id as n, case when event_type = 'error' then 'left at 3번 출구' else event_type end as description, max(event_type = 'error') over (partition by user_id order by event_id) as seen from events) where seen")
def steps_from_exit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return transit.steps_from(e.select(F.col("user_id").alias("leg"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", "left at 3번 출구").otherwise(F.col("event_type")).alias("description")))


@query("select c_mktsegment as age, cast(count(*) as int) as one, cast(max(c_nationkey) as int) as two from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1")
def fare_lookup(spark, sf_dir):
    f = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("age")).agg(F.count("*").cast("int").alias("one"), F.max("c_nationkey").cast("int").alias("two"))
    return transit.fares(f, ["BUILDING", "MACHINERY"])


@query("select user_id as id, coalesce(string_agg(i || '. ' || event_type, chr(10) order by i) filter (where event_type <> 'error'), '') as said from (select *, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by event_id) as i from events) group by user_id")
def numbered_sentences(spark, sf_dir):
    step = F.struct("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("said"))
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return u.select("id", transit.sentences(F.transform("steps", lambda x: x["said"])).alias("said"))


# keyed state, an index, a source and a sink

_LANG = r"regexp_matches(text, '[^\x00-\x7F]')"


@query(f"""with t as (select conv_id, turn, case when {_LANG} then 'other' else 'ascii' end as lang, text, len({tokens_sql('text')}) as w from conversations),
    c as (select *, coalesce(lag(lang) over (partition by conv_id order by turn nulls first, text) <> lang, true) as new from t), s as (select *, cast(sum(cast(new as int)) over (partition by conv_id order by turn nulls first, text) as int) as session from c)
    select conv_id, turn, lang, session, row_number() over x - 1 as n_before, cast(sum(w) over x as bigint) as n_words, md5(coalesce(concat_ws(chr(10), lag(text, 2) over x, lag(text) over x), '')) as memory from s window x as (partition by conv_id, session order by turn nulls first, text)""")
def chat_sessions(spark, sf_dir):
    """Sessions of the conversations as a stream whose keyed state is cleared where a turn's language changes."""
    path = f"{sf_dir}/conversations.parquet"
    # as a pattern the path may be a file or a folder
    turns = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/conversations.parque[t]")
    lang = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), "other").otherwise("ascii")
    turns = turns.select("conv_id", "turn", lang.alias("lang"), "text", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words"))
    return chat.drained(chat.sessions(turns), sinks.scratch(spark)).withColumn("memory", F.md5("memory"))


@query(f"""with t as (select doc_id, {tokens_sql('text')} as t from documents), l as (select doc_id, len(t) as len, t from t), a as (select count(*) as n, avg(len) as avg_len from l),
    tf as (select doc_id, len, term, count(*) as tf from (select doc_id, len, unnest(t) as term from l) group by all), df as (select term, count(*) as df from tf group by term),
    q as (select distinct item_id as query_id, unnest({tokens_sql("coalesce(text, '')")}) as term from benchmark),
    s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score from q join tf using (term) join df using (term), a group by 1, 2)
    select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from s) where rank <= 5""")
def bm25_index_search(spark, sf_dir):
    """The five best documents of every benchmark text, by an index of all documents."""
    folder = sinks.scratch(spark)
    postings.build(table(spark, sf_dir, "documents"), f"{folder}/index")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.Index(spark, f"{folder}/index").search(queries, 5, f"{folder}/search")


@query("select user_id, event_type, count(*) as n, max(strftime(ts, '%H%M%S')) as last from events where event_type in ('click', 'view') group by 1, 2")
def service_timetable(spark, sf_dir):
    """Stored answers of a service, asked for two values of its parameter: a data source that opens those answers only."""
    folder = sinks.scratch(spark)
    e = table(spark, sf_dir, "events")
    services.store(e.select("event_type", "user_id", F.date_format("ts", "HHmmss").alias("time")), f"{folder}/answers", "event_type")
    with services.pushdown(spark):
        got = services.answers(spark, f"{folder}/answers", "event_type string, user_id long, time string", "event_type").where(F.col("event_type").isin("click", "view"))
        got.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("time").alias("last")).write.parquet(f"{folder}/counted")
    return spark.read.parquet(f"{folder}/counted")


@query("select 'item_' || item_id || '.md' as name, md5(coalesce(text, '')) as body from benchmark")
def named_text_files(spark, sf_dir):
    """Every benchmark text as a file of its own name, read back as files."""
    folder = sinks.scratch(spark)
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".md")).alias("name"), F.col("text").alias("body"))
    named_files.write(b, f"{folder}/files")
    files = spark.read.option("pathGlobFilter", "*.md").text(f"{folder}/files", wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("name"), F.md5(F.coalesce("value", F.lit(""))).alias("body"))
