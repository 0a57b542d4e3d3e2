"""The queries against their SQL, over tables with nulls, repeats, ties and short texts."""

import duckdb
import pytest

from ravelin.llm.queries import ORACLE_SQL, QUERIES

RUN = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "one two", "Ünder THE sea", RUN, RUN, RUN.upper(), f"before {RUN[:-4]} after", "a b c d e " * 9, "x\nx\n\nx y\n \ny", "# & | <tag> $",
    'password: "abcdefghijklmnop" and token=short AKIAABCDEFGHIJKLMN', "deadbeefdeadbeefdead é😀 Zx9Kq2LmNb7Rt5Yw1PcV8s", "copied Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op", "also Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op here", "api_key = deadbeefdeadbeefdeadbeef",
]
ITEMS = [(1, "one two"), (2, RUN[:80]), (3, None), (4, "..."), (5, "É sea"), (10, "one TWO")]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder with documents, benchmark, conversations and embeddings, written by DuckDB."""
    con, path = duckdb.connect(), tmp_path_factory.mktemp("tables")
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [(k, t, None if k % 5 == 0 else "en", [None, "a", "b"][k % 3], len(t or "")) for k, t in enumerate(TEXTS)])
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", ITEMS)
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    turns = [(c, None if t == 2 and c % 4 == 0 else t, [None, "user", "bot"][(c + t) % 3], [None, "", "a  b", "Ü x\ny"][c * t % 4]) for c in [*range(0, 25), 40, 41, 63] for t in range(c % 5)]
    con.executemany("insert into conversations values (?, ?, ?, ?)", [*turns, turns[5], (None, 0, "user", "lost")])
    con.sql("create table embeddings (vec_id bigint, embedding float[], label integer)")
    vectors = [(k, [((k * 37 + d * 11) % 19 - 9) / 8 for d in range(4)], k % 3) for k in range(0, 160)]
    vectors += [(200, None, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [float("nan"), 0.0, 0.0, 0.0], 1), (350, [1.0, 1.0, 0.0, 0.0], None), vectors[50], vectors[3]]
    con.executemany("insert into embeddings values (?, ?, ?)", vectors)
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"copy {t} to '{path}/{t}.parquet' (format parquet)")
    return con, str(path)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    con, path = tables
    df = QUERIES[name](spark, path)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = [tuple(r[c] for c in rel.columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(rel.fetchall(), key=repr)
