import zipfile

import pytest

from lodestone.sources import collections, readers


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode("latin-1"))
    (tmp_path / "b.md").write_text("# Title\n\nSome **bold** [link](http://x)")
    (tmp_path / "c.html").write_text("<p>a&amp;b</p><script>x</script>")
    (tmp_path / "d.csv").write_text("x,y\n1,a\n2,\n")
    (tmp_path / "e.json").write_text('[{"k": 1}, {"k": 2}]')
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>')
    (tmp_path / "g.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "h.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><row><c t="inlineStr"><is><t>name</t></is></c></row><row><c><v>5</v></c></row></worksheet>')
    found = sorted((r["kind"], r["text"]) for r in readers.read_files(spark, str(tmp_path)).collect())
    assert ("md", "Title\n\nSome bold link") in found and ("html", "a&b") in found
    assert ("csv", "x: 1 | y: a") in found and ("csv", "x: 2") in found
    assert ("json", '{"k":1}') in found and ("docx", "One\n\nTwo") in found and ("docx", "") in found and ("xlsx", "name: 5") in found


def test_names():
    assert readers.column_name("  a b--c ") == "a_b_c" and readers.column_name("!!") == "column"
    assert readers.table_name("/x/My File.xlsx", "Sheet 1") == "my_file_sheet_1"


def test_collection(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path / "c"))
    docs = spark.createDataFrame([("a", "x", {"k": "v"}, [1.0]), ("b", "y", None, None)], collections.COLUMNS)
    c.overwrite(docs)
    c.append(spark.createDataFrame([("c", "z", None, None)], collections.COLUMNS))
    c.delete(spark.createDataFrame([("a",)], "id string"))
    c.update(spark.createDataFrame([("b", "new", None)], "id string, text string, metadata map<string,string>"))
    assert sorted((r["id"], r["text"]) for r in c.read().collect()) == [("b", "new"), ("c", "z")]
    assert c.info().first()["documents"] == 2


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; DROP TABLE t", "not sql"])
def test_only_queries_run(spark, sql):
    with pytest.raises(ValueError):
        collections.safe_select(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "WITH x AS (SELECT 1 AS id) INSERT INTO sink SELECT * FROM x", "SELECT * FROM secret -- , secret as (", "SELECT * FROM secret, (WITH secret AS (SELECT 1) SELECT * FROM secret) y",
        "SELECT (SELECT max(id) FROM secret) AS m", "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT * FROM t UNION SELECT * FROM secret",
        "EXECUTE IMMEDIATE 'CREATE TABLE planted USING parquet AS SELECT 1 AS id'", "EXECUTE IMMEDIATE 'SELECT * FROM secret'", "SELECT * FROM IDENTIFIER('secret')", "SELECT IDENTIFIER('id') FROM t",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM t", "SELECT reflect('java.lang.System', 'setProperty', 'a', 'b') FROM t", "SELECT try_reflect('java.lang.System', 'getProperty', 'a') FROM t",
        "SELECT id FROM t ORDER BY reflect('java.lang.System', 'getProperty', 'a')", "SELECT transform(array(1), x -> java_method('java.lang.Math', 'abs', x)) FROM t", "SELECT * FROM t LATERAL VIEW reflect('a', 'b') v AS x",
        "SELECT * FROM read_files('/etc')", "SELECT input_file_name() FROM t", "SELECT session.own(id) FROM t", "SELECT assert_true(false) FROM t", "SELECT TRANSFORM(id) USING 'cat' FROM t", "TABLE secret", "FROM t INSERT INTO sink SELECT id",
        "BEGIN SELECT 1; END", "DECLARE x INT", "SHOW TABLES", "DESCRIBE t", "CALL p()", "SELECT * FROM t |> EXTEND java_method('java.lang.System', 'getProperty', 'a') AS x", "CACHE TABLE t", "REFRESH TABLE t",
        "SELECT * FROM parquet.`/etc`", "EXPLAIN SELECT 1", "SET x = 1", "CREATE VIEW v AS SELECT 1", "SELECT * FROM other.t",
    ],
)
def test_no_way_around_the_guard(spark, sql):
    with pytest.raises(ValueError):
        collections.safe_select(spark, sql, {"t"})


def test_common_table_expressions_pass(spark):
    spark.range(3).createOrReplaceTempView("t")
    sql = "WITH x AS (SELECT id FROM t WHERE id > 0), y AS (SELECT max(id) AS m FROM x) SELECT m, (SELECT count(*) FROM T) AS n FROM y WHERE m IN (SELECT id FROM x)"
    assert tuple(collections.safe_select(spark, sql, {"t"}).first()) == (2, 3)


@pytest.mark.parametrize(
    ("sql", "first"),
    [
        ("SELECT count(*) AS n FROM t a JOIN t b USING (id) WHERE a.id BETWEEN 0 AND 5", 3), ("SELECT id FROM t UNION ALL SELECT id + 9 FROM t EXCEPT SELECT 2 ORDER BY 1 DESC LIMIT 1", 11),
        ("SELECT sum(id) FILTER (WHERE id > 0) FROM t", 3), ("SELECT max(r) FROM (SELECT rank() OVER (PARTITION BY id % 2 ORDER BY id) AS r FROM t) x", 2), ("SELECT count(*) FROM t LATERAL VIEW explode(array(1, 2)) v AS x", 6),
        ("SELECT id % 2 AS k, count(*) FROM t GROUP BY ROLLUP (id % 2) HAVING count(*) > 2 ORDER BY 2", None), ("SELECT CASE WHEN id IN (SELECT max(id) FROM t) THEN upper('a') ELSE trim(' b ') END FROM t ORDER BY id DESC", "A"),
        ("SELECT count(*) FROM t, LATERAL (SELECT t.id AS y) z WHERE EXISTS (SELECT 1 FROM t u WHERE u.id = t.id)", 3), ("SELECT s[0] FROM (VALUES (array('x'))) v(s)", "x"), ("SELECT date_trunc('year', DATE'2024-05-06') IS NOT NULL", True),
        ("SELECT extract(YEAR FROM DATE'2024-05-06') + CAST('1' AS INT) FROM t", 2025), ("SELECT aggregate(transform(array(1, 2), x -> x * 2), 0, (a, b) -> a + b) FROM t", 6), ("SELECT count(DISTINCT id) FROM (SELECT DISTINCT id FROM t) x", 3),
        ("SELECT * FROM (SELECT id, id % 2 AS k FROM t) PIVOT (count(id) FOR k IN (0, 1))", 2), ("SELECT id FROM t WHERE id LIKE '2%'", 2),
    ],
)
def test_plain_queries_pass_the_guard(spark, sql, first):
    spark.range(3).createOrReplaceTempView("t")
    assert collections.safe_select(spark, sql, {"t"}).first()[0] == first


def test_appended_rows_are_added_to_a_version(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path / "c"))
    for k in "abc":
        c.append(spark.createDataFrame([(k, k, None, None)], collections.COLUMNS))
    assert c._latest()[0] == 2 and len(c._latest()[1]) == 3 and c.read().count() == 3
    assert not c._publish(2, ["other"]) and c.read().count() == 3


def test_a_verb_in_a_string_is_no_verb(spark):
    assert collections.safe_select(spark, "SELECT ' drop table ' AS x").first()["x"] == " drop table "
    with pytest.raises(ValueError):
        collections.safe_select(spark, "SELECT * FROM nowhere", {"t"})


def test_sequential_ids(spark):
    ids = [r["id"] for r in collections.sequential_ids(spark.range(10).repartition(3), "chunk", 5).collect()]
    assert sorted(ids, key=lambda x: int(x[6:])) == [f"chunk_{i}" for i in range(5, 15)]
