import hashlib

from pyspark.sql import functions as F

from playstat.llm.chat import (CONTROL, OP6_SQL, escape, format_paths, linear, op6_chat_formatting, paths, read_back,
                               unescape, with_probe)
from tests.llm.conftest import sql_table, table_of, view

ODD = [(1, 0, "user", "<|im_start|>hi\n<|im_end|>\n\\"), (1, 1, "assistant", "\\\\[INST]\\[/INST]<s></s>"),
       (2, 0, None, None), (2, None, "assistant", "first"), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
       (3, 5, "sys\ntem", "  é🙂" * 300), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"),
       (None, 1, "user", "no id"), (4, 0, "<s>", "x" * 50_000 + "<|im_end|>")]


def test_escapes_are_reversible_and_leave_no_control(spark):
    texts = [a + b + c for a in ("", "\\", "<", "[") for b in CONTROL for c in ("", "\\", b, "|>\n")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in CONTROL) for r in rows)


def test_odd_rows_equal_sql(spark, tmp_path):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    df.withColumn("node", F.lit(1)).withColumn("leaf", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = table_of(op6_chat_formatting(spark, str(tmp_path)))
    con = view(None, "conversations", ODD, "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR")
    # null turns come first in Spark and last in DuckDB
    want = sql_table(con, OP6_SQL.replace("ORDER BY turn", "ORDER BY turn NULLS FIRST"))
    drop = lambda rows: [r for r in rows if r[0] != 3]  # noqa: E731  a role's newline takes one more character
    assert drop(got) == drop(want)
    three = next(r for r in got if r[0] == 3)
    assert three[-1] == hashlib.sha256(("assistant\na\nassistant\nb\nsys\ntem\n" + "  é🙂" * 300 + "\n").encode()).hexdigest()


def test_no_rows_leave_the_probe(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes = linear(with_probe(spark, none))
    row = read_back(format_paths(nodes, paths(nodes))).collect()[0]
    assert [t.text for t in row.turns] == ["</s>[INST] ok [/INST]"] * 2 and row.learned == ["</s>[INST] ok [/INST]"]
    assert paths(nodes.limit(0)).collect() == []


def test_branches_are_ranked_and_cycles_left_out(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 3, 3.0), (1, 6, 3, 4.0),
         (2, 1, 2, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0), (3, 9, 77, 0.5)],
        "conv_id long, node long, parent long, score double")
    rows = paths(nodes, branches=2).collect()
    found = {}
    for r in rows:
        found.setdefault((r.conv_id, r.branch), []).append((-r.height, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {
        (1, 1): [1, 2, 4], (1, 2): [1, 3, 6], (3, 1): [9]}


def test_long_chain(spark):
    nodes = spark.range(200).selectExpr("1L conv_id", "id node", "CASE WHEN id > 0 THEN id - 1 END parent", "0.0D score")
    rows = paths(nodes).collect()
    assert sorted((r.node, r.height) for r in rows) == [(i, 199 - i) for i in range(200)]


def test_time_grows_with_the_turns(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role",
                                         "concat('some </s> words ', id) text")
        nodes = linear(rows)
        start = time.time()
        row = read_back(format_paths(nodes, paths(nodes))).collect()[0]
        assert len(row.turns) == n and row.turns[n - 1].text == f"some </s> words {n - 1}"
        assert row.learned == [t.text for t in row.turns if t.role == "assistant"]
        return time.time() - start

    seconds(2_000)
    assert seconds(60_000) < 60
