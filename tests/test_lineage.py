import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.lineage import index
from lodestream.lineage.analysis import analyze
from lodestream.lineage.lexer import statements, tokenize, without_settings
from lodestream.lineage.parser import file_class, parse_script
from lodestream.plans.dialects import into_target, rewrite
from lodestream.sources import scripts


def test_tokens_keep_lines_and_drop_comments():
    tokens = tokenize("a -- x\n/* y\n */ 'it''s' `b c`")
    assert [(t.text, t.line) for t in tokens] == [("a", 1), ("'it''s'", 3), ("`b c`", 3)]
    assert len(statements("a;;b;")) == 2


def test_settings_go_but_not_those_of_an_update():
    assert without_settings("SET x = 1;\nUPDATE t\nSET a = 1;\nset y=2") == "\nUPDATE t\nSET a = 1;\n"


def test_rewrites():
    assert rewrite("SELECT TOP 3 a FROM t WITH (NOLOCK)").split() == "SELECT a FROM t LIMIT 3".split()
    assert rewrite("SELECT a FROM t FETCH FIRST 2 ROWS ONLY").endswith("LIMIT 2")
    assert into_target("SELECT a INTO b.c FROM t") == "b.c"
    assert "get_json_object(x.j, '$.k')" in rewrite("SELECT x.j ->> 'k' FROM x")
    assert rewrite("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1").startswith("SELECT * EXCEPT (_q)")


def test_rewritten_queries_run(spark):
    spark.createDataFrame([(1, '{"k": "v"}'), (2, "{}")], "a int, j string").createOrReplaceTempView("rewritten")
    assert spark.sql(rewrite("SELECT a FROM rewritten QUALIFY row_number() OVER (ORDER BY a DESC) = 1")).collect()[0].a == 2
    assert spark.sql(rewrite("SELECT j ->> 'k' AS v FROM rewritten ORDER BY a")).collect()[0].v == "v"


def test_one_source_each_and_never_a_guess():
    p = parse_script("s", "SELECT a.x, y FROM t a, u")
    assert {(r["qualifier"], r["column"]) for r in p.refs} == {("a", "x"), ("", "y")}
    assert {(s["alias"], s["table"]) for s in p.scopes if s["kind"] == "physical"} == {("a", "t"), ("u", "u")}


@pytest.mark.parametrize(
    ("name", "text", "kind"),
    [("a.ddl", "SELECT 1", "schema"), ("a.sql", "CREATE TABLE t (a INT); GRANT x", "schema"), ("a.sql", "CREATE TABLE t AS SELECT 1 AS a", "script"), ("a.sql", "", "script"), ("a.sql", "SELECT 1", "script")],
)
def test_file_classes(name, text, kind):
    assert file_class(name, text) == kind


def test_odd_texts_do_not_stop_the_parser():
    for text in ("", ";", "(((", "SELECT", "SELECT * FROM", "INSERT", "MERGE INTO", "WITH", "'open", "SELECT a FROM (SELECT b FROM c", "\u0000", "CREATE", "FROM x", "UPDATE", "DELETE", "SELECT CASE WHEN a FROM b"):
        parse_script("s", text)


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        for name in ("a/one.sql", "__MACOSX/x.sql", "../up.sql", "b/note.txt"):
            z.writestr(name, "SELECT 1")
    assert [r.script for r in scripts.from_archive(spark, str(tmp_path / "w.zip")).collect()] == ["a/one.sql"]
    (tmp_path / "folder/deep").mkdir(parents=True)
    (tmp_path / "folder/deep/x.sql").write_bytes(b"SELECT '\xff' AS a")
    assert [(r.script, "�" in r.sql_text) for r in scripts.from_folder(spark, str(tmp_path / "folder")).collect()] == [("deep/x.sql", True)]
    with pytest.raises(ValueError):
        scripts.from_text(spark, {"a": " "})


@pytest.mark.parametrize("encoding", ["utf-8-sig", "gb18030", "latin-1"])
def test_scope_csv_encodings(spark, tmp_path, encoding):
    word = {"latin-1": "café"}.get(encoding, "表")
    (tmp_path / "f.csv").write_bytes(f"SCRIPT_NAME,TABLE_NAME\na.sql,{word}\n".encode(encoding))
    found = index.read_scope_csv(spark, str(tmp_path / "f.csv"), ["SCRIPT_NAME", "TABLE_NAME"]).collect()
    assert len(found) == 1 and (encoding == "latin-1" or found[0].TABLE_NAME == word)


def test_typing_errors_are_forgiven(spark):
    names = spark.createDataFrame([(n,) for n in ("orders", "order_items", "users", "oders")], "name string")
    assert [r.name for r in index.complete(names, "orders").collect()] == ["orders", "oders"]
    assert [r.name for r in index.complete(names, "order").collect()] == ["order_items", "orders"]


def test_empty_scripts(spark):
    a = analyze(spark.createDataFrame([("a.sql", None), ("b.sql", "")], "script string, sql_text string"))
    assert a.variables.count() == 0 and a.files.count() == 2


def test_parts_of_lines(spark):
    lines = spark.createDataFrame([("s", i) for i in range(1, 11)], "script string, line int")
    parts = spark.createDataFrame([("s", 1, 5), ("s", 4, 6)], "script string, low int, high int")
    r = index.partition_metrics(parts, lines).collect()[0]
    assert (r.coverage, r.overlap, r.gap) == (0.6, 0.2, 0.4)
    assert spark.range(1).select(index.accuracy_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()[0] == pytest.approx(0.6)


def test_more_sources(spark, tmp_path):
    for name in ("one.sql", "two.sql"):
        (tmp_path / name).write_bytes(b"SELECT '\xff' AS a")
    found = scripts.from_files(spark, [str(tmp_path / "one.sql"), str(tmp_path / "two.sql")]).collect()
    assert sorted(r.script for r in found) == ["one.sql", "two.sql"] and all("�" in r.sql_text for r in found)
    with pytest.raises(ValueError):
        scripts.from_files(spark, [str(tmp_path / "one.sql")])
    (tmp_path / "big.csv").write_bytes(b"SCRIPT_NAME\n" + b"x" * (20 << 20))
    with pytest.raises(ValueError):
        index.read_scope_csv(spark, str(tmp_path / "big.csv"), ["SCRIPT_NAME"])


def test_log_keeps_the_newest(spark, tmp_path):
    from lodestream.sources.sinks import LogQueue

    log = LogQueue(3)
    for i in range(5):
        log.put("info", str(i))
    assert [e[3] for e in log.after()] == ["2", "3", "4"] and [e[3] for e in log.after(4)] == ["4"]
    listener = log.listen(spark)
    q = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    q.awaitTermination(60)
    spark.streams.removeListener(listener)
    assert log.number >= 5


def test_samples_and_writes(spark):
    from lodestream.operators.relational import hash_sample, update_from

    df = spark.range(20000).withColumnRenamed("id", "k")
    n = hash_sample(df, ["k"], 0.25, 1).count()
    assert 4600 < n < 5400 and n == hash_sample(df.repartition(7), ["k"], 0.25, 1).count()
    target, source = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double"), spark.createDataFrame([(1, 5.0), (1, 6.0)], "k long, w double")
    with pytest.raises(Exception, match="several rows"):
        update_from(target, source, "k", {"v": F.col("s.w")}).collect()


def test_layers_of_the_smoothing_stay_below_the_furthest_neighbour(spark):
    from lodestream.lineage.levels import smooth

    layers = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("x", 0)], "node string, layer int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "s string, t string")
    assert {r.node: r.layer for r in smooth(layers, edges, "s", "t").collect()} == {"a": 3, "b": 4, "c": 5, "x": 4}


def test_snippets_are_the_lines_around(spark):
    from lodestream.lineage.zoom import snippets

    text = "one\ntwo\nthree\nfour\nfive"
    scripts = spark.createDataFrame([("a", text), ("b", "alone")], "script string, sql_text string")
    items = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 5), ("b", "w", 1)], "script string, item string, line int")
    got = {(r.script, r["item"]): (r.low, r.high, r.text) for r in snippets(scripts, items, 1).collect()}
    assert got == {("a", "x"): (1, 2, "one\ntwo"), ("a", "y"): (2, 4, "two\nthree\nfour"), ("a", "z"): (4, 5, "four\nfive"), ("b", "w"): (1, 1, "alone")}
