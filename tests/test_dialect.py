"""Semantics of the dialect: parsing, typing, nulls, enums, JSON, changes and transactions."""

from __future__ import annotations

import datetime as dt
import json
import threading
from decimal import Decimal

import pytest

from skarn import errors as E
from skarn.operators.values import normalise_json
from skarn.session import Engine
from skarn.sql import ast
from skarn.sql.parser import parse, parse_interval


@pytest.fixture
def db(spark):
    with Engine(spark) as engine:
        yield engine


def rows(db, sql):
    return [tuple(r) for r in db.sql(sql).collect()]


@pytest.fixture(scope="module")
def staff(spark):
    engine = Engine(spark)
    engine.sql(
        """
        CREATE TABLE staff (id SERIAL PRIMARY KEY, name VARCHAR(20), team "ops" | "dev" | "art" NULLABLE, pay DOUBLE PRECISION NULLABLE,
            rank SMALLINT UNSIGNED NULLABLE, since DATE NULLABLE, boss INT NULLABLE, info JSONB NULLABLE);
        INSERT INTO staff (name, team, pay, rank, since, boss, info) VALUES
            ('Ada', 'dev', 100.5, 1, '2020-02-29', NULL, {langs: ['rust', 'sql'], age: 41, home: {city: 'Rome'}}),
            ('Bo', 'ops', NULL, 2, '2021-12-31', 1, {age: 9, langs: []}),
            ('Cy', NULL, 80, NULL, NULL, 1, NULL),
            ('Di', 'art', 80, 2, '2019-06-15', 2, {age: 'old', active: true});
        """
    )
    return engine


def expr(text):
    return parse(f"SELECT {text} FROM t;")[0].items[0].expr


def test_precedence():
    assert expr("1 + 2 * 3") == ast.Binary("+", ast.Literal(1, "int"), ast.Binary("*", ast.Literal(2, "int"), ast.Literal(3, "int")))
    assert expr("a = 1 OR b = 2 AND c = 3").op == "OR"
    assert expr("1 - 2 - 3") == ast.Binary("-", expr("1 - 2"), ast.Literal(3, "int"))
    assert expr("-a + b") == ast.Binary("+", ast.Unary("-", ast.Name(("a",))), ast.Name(("b",)))
    assert expr("a BETWEEN 1 AND 2 AND b IN (1, 2)").op == "AND"
    assert expr("(1 + 2) * 3").op == "*"
    assert expr("x.y[-1].z[*]") == ast.Name(("x", "y", ast.Index(-1), "z", ast.Index("*")))


def test_statements_parse():
    text = 'CREATE TABLE t (a INT UNSIGNED PRIMARY KEY, b "x" | "y" NULLABLE, c NUMERIC(5, 2) UNIQUE, d DOUBLE PRECISION, e INTERVAL);'
    created = parse(text)[0]
    assert [str(c.type) for c in created.columns] == ["INT UNSIGNED", '"x" | "y"', "NUMERIC(5, 2)", "DOUBLE PRECISION", "INTERVAL"]
    assert [type(s) for s in parse("BEGIN TRANSACTION; COMMIT; ROLLBACK; DROP TABLE t; SOURCE 'a.sql'; EXPLAIN DELETE FROM t;")] == [
        ast.Transaction, ast.Transaction, ast.Transaction, ast.DropTable, ast.Source, ast.Explain,
    ]
    q = parse("select a as b from t right join u on t.x = u.y where a is not null group by a order by a desc, b limit 3 offset 4;")[0]
    assert (q.joins[0].how, q.limit, q.offset, q.order[0].descending) == ("right", 3, 4, True)


@pytest.mark.parametrize(
    "text",
    ["SELECT a FROM t", "SELECT a;", "SELECT a FROM t WHERE;", "SELECT a b FROM t;", "SELECT a <> b FROM t;", "SELECT 'a FROM t;", "CREATE TABLE t (a WIDE);",
     "CREATE TABLE t (a VARCHAR);", "CREATE DATABASE x;", "DROP DATABASE x;", "SOURCE 'a.txt';", "SELECT # FROM t;", "INSERT INTO t VALUES ();", "SELECT INTERVAL '1' FROM t;"],
)
def test_parse_errors(text):
    with pytest.raises(E.ParseError):
        parse(text)


def test_intervals():
    assert parse_interval("1 year 2 months -3 weeks 4 hours 5 microseconds") == ast.Interval(14, -21, 4 * 3_600_000_000 + 5)


@pytest.mark.parametrize(
    "given,want",
    [("{a: 1,}", {"a": 1}), ("{'a': +0x1F, b: [1., .5, -2e3]}", {"a": 31, "b": [1.0, 0.5, -2000.0]}), ("[NaN, true /* x */] // y", [None, True]), ("plain", "plain"), ('{"a":"it\'s"}', {"a": "it's"})],
)
def test_json5(given, want):
    assert json.loads(normalise_json(given)) == want


def test_order_of_nulls_and_enums(staff):
    assert rows(staff, "SELECT name FROM staff ORDER BY team;") == [("Bo",), ("Ada",), ("Di",), ("Cy",)]
    assert rows(staff, "SELECT name FROM staff ORDER BY team DESC;") == [("Cy",), ("Di",), ("Ada",), ("Bo",)]
    assert rows(staff, "SELECT name FROM staff ORDER BY pay DESC, name DESC;") == [("Bo",), ("Ada",), ("Di",), ("Cy",)]
    assert rows(staff, "SELECT name FROM staff WHERE team >= 'dev' ORDER BY name;") == [("Ada",), ("Di",)]
    assert rows(staff, "SELECT MIN(team), MAX(team) FROM staff;") == [("ops", "art")]


def test_null_logic(staff):
    assert rows(staff, "SELECT name FROM staff WHERE pay = NULL;") == []
    assert rows(staff, "SELECT name FROM staff WHERE rank != 2;") == [("Ada",)]
    assert rows(staff, "SELECT team, COUNT(*) FROM staff WHERE pay IS NOT NULL GROUP BY team ORDER BY team;") == [("dev", 1), ("art", 1), (None, 1)]
    assert rows(staff, "SELECT COUNT(pay), SUM(pay), AVG(rank), COUNT(*) FROM staff;") == [(3, 260.5, pytest.approx(5 / 3), 4)]
    assert rows(staff, "SELECT SUM(pay), COUNT(*) FROM staff WHERE id > 9;") == [(None, 0)]
    assert rows(staff, "SELECT pay + rank FROM staff WHERE id = 3;") == [(None,)]


def test_json_paths(staff):
    got = rows(staff, "SELECT info.age, info.langs[0], info.langs[-1], info.langs[*], info.home.city, info.none FROM staff ORDER BY id;")
    assert got == [("41", "rust", "sql", '["rust","sql"]', "Rome", None), ("9", None, None, "[]", None, None), (None,) * 6, ("old", None, None, None, None, None)]
    assert rows(staff, "SELECT name FROM staff WHERE info.age > 9;") == [("Ada",)]
    assert rows(staff, "SELECT name FROM staff WHERE info.active = TRUE;") == [("Di",)]
    assert rows(staff, "SELECT name FROM staff WHERE info.home.city = 'Rome' OR info.age = 'old' ORDER BY name;") == [("Ada",), ("Di",)]
    assert rows(staff, "SELECT name, info.age AS a FROM staff WHERE a IS NOT NULL ORDER BY a;") == [("Bo", "9"), ("Ada", "41"), ("Di", "old")]
    assert rows(staff, "SELECT info.age + 1 AS n FROM staff WHERE id = 1;") == [(42.0,)]


def test_functions(staff):
    one = "FROM staff WHERE id = 1;"
    assert rows(staff, f"SELECT SUBSTRING(name FROM 2), SUBSTRING(name FROM 0 FOR 2), SUBSTRING(name FROM -1), SUBSTRING(name FROM 2 FOR -1), SUBSTRING(name FOR 1) {one}") == [("da", "Ad", "", "da", "A")]
    assert rows(staff, f"SELECT ASCII(''), ASCII('é'), POSITION('d' IN name), POSITION('z' IN name), CONCAT(name, '-', team) {one}") == [(0, 233, 2, 0, "Ada-dev")]
    assert rows(staff, f"SELECT TRUNC(pay), TRUNC(-pay), TRUNC(pay / 3, 2), ABS(-pay), SIGN(-pay), SIGN(0) {one}") == [(100.0, -100.0, 33.5, 100.5, -1, 0)]
    assert rows(staff, f"SELECT SQRT(16), POWER(2, 10), POWER(2, 0.5), 7 / 2, 4 / 2 {one}") == [(4.0, 1024, pytest.approx(2**0.5), 3.5, 2.0)]
    assert rows(staff, "SELECT COALESCE(team, 'none'), COALESCE(pay, rank, 0) FROM staff ORDER BY id;") == [("dev", 100.5), ("ops", 2.0), ("none", 80.0), ("art", 80.0)]
    assert rows(staff, "SELECT TYPEOF(rank) FROM staff;") == [("SMALLINT UNSIGNED",)]
    assert rows(staff, f"SELECT TYPEOF(name), TYPEOF(team) {one}") == [("VARCHAR(20)", '"ops" | "dev" | "art"')]
    assert rows(staff, "SELECT name FROM staff WHERE name LIKE '_d%';") == [("Ada",)]
    assert rows(staff, r"SELECT name FROM staff WHERE name LIKE '\%';") == []
    assert rows(staff, r"SELECT name FROM staff WHERE name LIKE CONCAT('\', '%') OR CONCAT('\', name) LIKE CONCAT('\', 'B%');") == [("Bo",)]
    with pytest.raises(Exception, match="negative"):
        rows(staff, f"SELECT SQRT(0 - rank) {one}")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(staff, f"SELECT rank / 0 {one}")


def test_dates(staff):
    got = rows(staff, "SELECT since + INTERVAL '1 year', since - INTERVAL '1 month', INTERVAL '1 day' + since, EXTRACT(CENTURY FROM since), EXTRACT(EPOCH FROM since) FROM staff WHERE id = 1;")
    assert got == [(dt.date(2021, 2, 28), dt.date(2020, 1, 29), dt.date(2020, 3, 1), 21, 1582934400)]
    assert rows(staff, "SELECT name FROM staff WHERE since BETWEEN '2020-01-01' AND '2021-12-31' ORDER BY since DESC;") == [("Bo",), ("Ada",)]
    assert rows(staff, "SELECT EXTRACT(YEAR FROM since) AS y, COUNT(*) AS n FROM staff GROUP BY y ORDER BY y LIMIT 1;") == [(2019, 1)]


def test_times_and_intervals(db):
    db.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, at TIME, ts TIMESTAMP, i INTERVAL); INSERT INTO t (at, ts, i) VALUES ('23:59:00', '2024-01-31T10:00:00', '1 year -2 days 90 minutes');")
    assert rows(db, "SELECT at + INTERVAL '25 hours 75 seconds', at - INTERVAL '24 hours', EXTRACT(MINUTE FROM at) FROM t;") == [("01:00:15", "23:59:00", 59)]
    assert rows(db, "SELECT ts + INTERVAL '1 month 27 hours', ts + i FROM t;") == [(dt.datetime(2024, 3, 1, 13), dt.datetime(2025, 1, 29, 11, 30))]
    units = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "EPOCH")
    assert rows(db, f"SELECT {', '.join(f'EXTRACT({u} FROM i) AS x{k}' for k, u in enumerate(units))} FROM t;") == [(1, 12, -2, 1, 30, 358 * 86400 + 5400)]
    assert rows(db, "SELECT id FROM t WHERE at > '23:00:00' AND ts < '2024-02-01 00:00:00';") == [(1,)]


def test_joins(staff):
    assert rows(staff, "SELECT a.name AS w, b.name AS b FROM staff AS a LEFT JOIN staff AS b ON a.boss = b.id ORDER BY a.id;") == [("Ada", None), ("Bo", "Ada"), ("Cy", "Ada"), ("Di", "Bo")]
    assert rows(staff, "SELECT b.name, COUNT(a.id) AS n FROM staff AS a RIGHT JOIN staff AS b ON a.boss = b.id GROUP BY b.id ORDER BY n DESC, b.id;") == [("Ada", 2), ("Bo", 1), ("Cy", 0), ("Di", 0)]
    assert len(rows(staff, "SELECT a.id, b.id FROM staff AS a FULL JOIN staff AS b ON a.boss = b.id;")) == 6
    assert staff.sql("SELECT a.id, b.id FROM staff AS a JOIN staff AS b ON a.id = b.id;").columns == ["id", "id_2"]
    assert staff.sql("SELECT * FROM staff AS a JOIN staff AS b ON a.id = b.id LIMIT 0;").columns[8:10] == ["id_2", "name_2"]


@pytest.mark.parametrize(
    "sql,error",
    [("SELECT x FROM staff;", E.InvalidColumn), ("SELECT a FROM none;", E.InvalidTable), ("SELECT z.name FROM staff;", E.InvalidTable), ("SELECT staff.zz FROM staff;", E.InvalidColumn),
     ("SELECT name, COUNT(*) FROM staff;", E.InvalidGroupBy), ("SELECT name FROM staff WHERE pay;", E.TypeMismatch), ("SELECT name + 1 FROM staff;", E.TypeMismatch),
     ("SELECT name FROM staff WHERE team = 'boss';", E.InvalidEnumVariant), ("SELECT ABS(1, 2) FROM staff;", E.InvalidArguments), ("SELECT NOPE(1) FROM staff;", E.AnalysisError),
     ("SELECT name FROM staff WHERE COUNT(*) > 1;", E.AnalysisError), ("SELECT SUM(SUM(pay)) FROM staff;", E.AnalysisError), ("SELECT EXTRACT(HOUR FROM since) FROM staff;", E.TypeMismatch),
     ("SELECT name FROM staff WHERE pay = 'x';", E.TypeMismatch), ("SELECT SUM(name) FROM staff;", E.TypeMismatch), ("SELECT a.id FROM staff AS a JOIN staff AS a ON a.id = a.id;", E.AnalysisError)],
)
def test_analysis_errors(staff, sql, error):
    with pytest.raises(error):
        staff.sql(sql)


def test_functional_dependency(staff):
    assert rows(staff, "SELECT id, name, COUNT(*) AS n FROM staff GROUP BY id ORDER BY name DESC LIMIT 2;") == [(4, "Di", 1), (3, "Cy", 1)]


@pytest.mark.parametrize(
    "values,error",
    [("(1, 'abcdef', 1, 1.5, 'x')", E.OutOfRange), ("(1, 'a', 70000, 1.5, 'x')", E.OutOfRange), ("(1, 'a', -1, 1.5, 'x')", E.OutOfRange), ("(1, 'a', 1, 1.555, 'x')", E.OutOfRange),
     ("(1, 'a', 1, 1.5, 'z')", E.InvalidEnumVariant), ("(1, NULL, 1, 1.5, 'x')", E.NotNullViolation), ("(1, 5, 1, 1.5, 'x')", E.TypeMismatch), ("(1, 'a', 'b', 1.5, 'x')", E.TypeMismatch),
     ("(1, 'a', 1, 1.5, 'x'), (1, 'b', 1, 1.5, 'x')", E.DuplicatedKey), ("(1, 'a', 1, 1.5)", E.AnalysisError)],
)
def test_insert_checks(db, values, error):
    db.sql('CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(5), u SMALLINT UNSIGNED, n NUMERIC(4,2), e "x" | "y");')
    with pytest.raises(error):
        db.sql(f"INSERT INTO t (id, s, u, n, e) VALUES {values};")
    assert rows(db, "SELECT COUNT(*) FROM t;") == [(0,)]


def test_keys(db):
    db.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, mail TEXT UNIQUE NULLABLE, n INT NULLABLE); INSERT INTO t (mail, n) VALUES ('a', 1), (NULL, 1), (NULL, 2);")
    for sql in ("INSERT INTO t (mail) VALUES ('a');", "INSERT INTO t (id, mail) VALUES (2, 'z');", "UPDATE t SET mail = 'b';", "UPDATE t SET id = 1;", "CREATE UNIQUE INDEX i ON t(n);"):
        with pytest.raises(E.DuplicatedKey):
            db.sql(sql)
    assert len(rows(db, "SELECT id FROM t;")) == 3
    db.sql("UPDATE t SET n = id; CREATE UNIQUE INDEX i ON t(n);")
    with pytest.raises(E.DuplicatedKey):
        db.sql("INSERT INTO t (mail, n) VALUES ('q', 3);")
    with pytest.raises(E.AlreadyExists):
        db.sql("CREATE UNIQUE INDEX i ON t(n);")
    with pytest.raises(E.AnalysisError):
        db.sql("CREATE INDEX j ON t(n);")


def test_update(db):
    db.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, a INT, b INT, p NUMERIC(10,2)); INSERT INTO t (a, b, p) VALUES (1, 10, 999.99), (2, 20, 29.95);")
    got = rows(db, "UPDATE t SET a = a + 1, b = a * 100, p = p * 1.05 WHERE a < 3 RETURNING id, old.a, new.a AS now, b, new.p AS p, TRUNC(new.p - old.p, 2) AS d;")
    assert sorted(got) == [(1, 1, 2, 200, Decimal("1049.9895"), Decimal("49.99")), (2, 2, 3, 300, Decimal("31.4475"), Decimal("1.49"))]
    assert sorted(rows(db, "SELECT a, b, p FROM t;")) == [(2, 200, Decimal("1049.99")), (3, 300, Decimal("31.45"))]
    assert rows(db, "UPDATE t SET a = 0 WHERE id = 77;") == [(0,)]
    for sql, error in (("UPDATE t SET z = 1;", E.InvalidColumn), ("UPDATE t SET a = 'x';", E.TypeMismatch), ("UPDATE t SET a = NULL;", E.NotNullViolation)):
        with pytest.raises(error):
            db.sql(sql)
    with pytest.raises(Exception, match="does not fit"):
        db.sql("UPDATE t SET a = 3000000000;")


def test_delete_keeps_unknown(db):
    db.sql("CREATE TABLE t (n INT NULLABLE); INSERT INTO t (n) VALUES (1), (2), (NULL);")
    assert rows(db, "DELETE FROM t WHERE n > 1;") == [(1,)]
    assert sorted(rows(db, "SELECT * FROM t;"), key=str) == [(1,), (None,)]
    assert rows(db, "DELETE FROM t; SELECT COUNT(*) FROM t;") == [(0,)]


def test_transactions(db):
    db.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, n INT);")
    db.sql("BEGIN TRANSACTION; INSERT INTO t (n) VALUES (1), (2); ROLLBACK;")
    assert rows(db, "SELECT * FROM t;") == []
    assert rows(db, "INSERT INTO t (n) VALUES (5) RETURNING id;") == [(3,)]  # numbers drawn stay drawn
    with pytest.raises(E.TransactionError):
        db.sql("COMMIT;")
    db.sql("BEGIN TRANSACTION;")
    with pytest.raises(E.TransactionError):
        db.sql("BEGIN TRANSACTION;")
    db.sql("INSERT INTO t (n) VALUES (6);")
    with pytest.raises(E.InvalidTable):
        db.sql("SELECT a FROM none;")
    with pytest.raises(E.TransactionError):
        db.sql("SELECT n FROM t;")
    db.sql("COMMIT;")  # of a failed transaction: a rollback
    assert rows(db, "SELECT n FROM t;") == [(5,)]
    db.sql("BEGIN TRANSACTION; CREATE TABLE u (a INT); DROP TABLE t; COMMIT;")
    assert db.tables() == ["u"]


def test_a_dropped_table_comes_back_with_its_sequence(db):
    db.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, n INT); INSERT INTO t (n) VALUES (1), (2); BEGIN TRANSACTION; DROP TABLE t; ROLLBACK;")
    assert rows(db, "INSERT INTO t (n) VALUES (3) RETURNING id;") == [(3,)]
    db.sql("DROP TABLE t; CREATE TABLE t (id SERIAL PRIMARY KEY, n INT);")
    assert rows(db, "INSERT INTO t (n) VALUES (3) RETURNING id;") == [(1,)]


@pytest.mark.parametrize("text,digits,want", [("1.239", 2, "1.23"), ("-1.239", 2, "-1.23"), ("-0.009", 1, "0.0"), ("987.65", 0, "987"), ("-987.65", -2, "-900"), ("0.000001", 6, "0.000001")])
def test_trunc_of_decimals_is_exact(db, text, digits, want):
    db.sql(f"CREATE TABLE t (n NUMERIC(20,6)); INSERT INTO t (n) VALUES ({text});")
    assert rows(db, f"SELECT TRUNC(n, {digits}) FROM t;") == [(Decimal(want),)]


def test_writers_wait(db):
    db.sql("CREATE TABLE t (n INT); BEGIN TRANSACTION; INSERT INTO t (n) VALUES (1);")
    seen = []
    other = threading.Thread(target=lambda: seen.append(rows(db, "SELECT COUNT(*) FROM t;")))
    other.start()
    other.join(1)
    assert other.is_alive() and not seen
    db.sql("COMMIT;")
    other.join(60)
    assert seen == [[(1,)]]


def test_leaving_rolls_back_and_manifest_survives(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    with Engine(spark, root) as first:
        first.sql("CREATE TABLE t (id BIGSERIAL PRIMARY KEY, j JSONB); INSERT INTO t (j) VALUES ({a: 1}); BEGIN TRANSACTION; DELETE FROM t;")
    with Engine(spark, root) as second:
        assert rows(second, "SELECT id, j.a FROM t;") == [(1, "1")]
        second.sql("UPDATE t SET j = 'text';")
        assert second.vacuum() >= 1
        assert rows(second, "SELECT j FROM t;") == [('"text"',)]


def test_catalog_explain_source(db, tmp_path):
    script = tmp_path / "s.sql"
    script.write_text("CREATE TABLE s (id SERIAL PRIMARY KEY, w TEXT); INSERT INTO s (w) VALUES ('x'); SELECT w FROM s;")
    assert rows(db, f"SOURCE '{script}';") == [("x",)]
    assert {tuple(r)[:3] for r in db.catalog_df().collect()} == {("table", "s", "s"), ("sequence", "s.id", "s")}
    assert db.describe("s").count() == 2
    assert db.sql("EXPLAIN SELECT w FROM s WHERE id = 1;").columns == ["Query Plan"]
    assert rows(db, "EXPLAIN INSERT INTO s (w) VALUES ('y');")[0] == ("Insert into s",)
    db.sql("CREATE SEQUENCE q AS BIGINT OWNED BY s; DROP TABLE s;")
    assert db.catalog_df().count() == 0
    with pytest.raises(E.InvalidTable):
        db.sql("DROP TABLE s;")


def test_uuid_and_row_id(db):
    db.sql("CREATE TABLE c (name TEXT, uid UUID UNIQUE); INSERT INTO c (name) VALUES ('a'), ('b');")
    got = rows(db, "SELECT * FROM c ORDER BY name;")
    assert len({k for _, k in got}) == 2 and all(len(k) == 36 for _, k in got)
    assert rows(db, f"SELECT name FROM c WHERE uid = '{got[1][1].upper()}';") == [("b",)]
    with pytest.raises(E.TypeMismatch):
        db.sql("INSERT INTO c (name, uid) VALUES ('z', 'nope');")


def test_commands(db):
    from skarn.__main__ import HELP, command

    db.sql("CREATE TABLE a (x INT); CREATE TABLE b (y TEXT NULLABLE);")
    assert command(db, "/dt") == "a\nb"
    assert command(db, "/d b") == "y TEXT"
    assert command(db, "/help") == HELP and command(db, "/quit") is None
    assert "no command" in command(db, "/what")


def test_bulk_load(db, spark):
    db.sql('CREATE TABLE t (id SERIAL PRIMARY KEY, n INT UNIQUE, s VARCHAR(4) NULLABLE, e "x" | "y" NULLABLE); INSERT INTO t (n) VALUES (0);')
    assert db.load("t", spark.range(1, 501, numPartitions=4).selectExpr("id AS n", "cast(id AS string) AS s")) == 500
    assert rows(db, "SELECT COUNT(*), MIN(id), MAX(id), SUM(id) FROM t;") == [(501, 1, 501, 501 * 502 // 2)]
    assert len({r[0] for r in rows(db, "SELECT id FROM t;")}) == 501
    for bad, error in (("5 AS n", E.DuplicatedKey), ("900 AS n, 'toolong' AS s", E.OutOfRange), ("901 AS n, 'z' AS e", E.OutOfRange), ("CAST(NULL AS INT) AS n", E.OutOfRange), ("'a' AS s", E.AnalysisError), ("1 AS q, 902 AS n", E.InvalidColumn)):
        with pytest.raises(error):
            db.load("t", spark.range(1).selectExpr(bad.split(", ")[0], *bad.split(", ")[1:]))
    with pytest.raises(E.DuplicatedKey):
        db.load("t", spark.createDataFrame([(990,), (990,)], "n int"))
    assert rows(db, "SELECT COUNT(*) FROM t;") == [(501,)]
    db.sql("BEGIN TRANSACTION;")
    db.load("t", spark.range(1000, 1002).selectExpr("id AS n"))
    db.sql("ROLLBACK;")
    assert rows(db, "SELECT COUNT(*) FROM t;") == [(501,)]


@pytest.fixture
def chain(spark, db, tmp_path):
    """A fact of 300 rows and three smaller relations around it; what is joined first, by relations' names."""
    for name, n in (("mid", 30_000), ("small", 10), ("far", 5)):
        spark.range(n).selectExpr(f"id AS {name}_id", f"id % 5 AS {name}_far").write.parquet(f"{tmp_path}/{name}.parquet")
    fact = spark.range(300).selectExpr("id AS f_id", "id % 30 AS f_mid", "id % 10 AS f_small", "array_join(transform(sequence(1, 500), x -> uuid()), '') AS pad")
    fact.write.parquet(f"{tmp_path}/fact.parquet")
    for name in ("far", "mid", "fact", "small"):
        db.register(name, f"{tmp_path}/{name}.parquet")

    def joins(sql):
        plan = db.sql(sql)._jdf.queryExecution().analyzed()
        found = []
        while plan.nodeName() != "Join":
            plan = plan.children().head()
        while plan.nodeName() == "Join":
            found.append(plan.right().output().head().name().split(".")[0])
            plan = plan.left()
        return [plan.output().head().name().split(".")[0], *reversed(found)]

    return joins


CHAIN = "FROM far JOIN mid ON far.far_id = mid.mid_far JOIN fact ON mid.mid_id = fact.f_mid JOIN small ON fact.f_small = small.small_id"


def test_inner_chain_starts_at_the_largest_and_takes_filtered_relations_first(db, chain):
    assert chain(f"SELECT f_id {CHAIN};") == ["fact", "small", "mid", "far"]
    assert chain(f"SELECT f_id {CHAIN} WHERE mid.mid_id > 3;") == ["fact", "mid", "far", "small"]
    assert chain(f"SELECT f_id, mid_id AS k {CHAIN} WHERE k > 3 AND far_id < f_id;") == ["fact", "mid", "far", "small"]
    found = rows(db, f"SELECT f_id, small_id, far_id {CHAIN} WHERE mid.mid_id > 3;")
    assert sorted(found) == [(k, k % 10, k % 5) for k in range(300) if k % 30 > 3]


def test_outer_chains_and_conditions_on_one_relation_keep_their_order(db, chain):
    written = ["far", "mid", "fact", "small"]
    assert chain(f"SELECT f_id {CHAIN.replace('JOIN small', 'LEFT JOIN small')};") == written
    assert chain(f"SELECT f_id {CHAIN} AND fact.f_id > 5;") == written
    assert len(rows(db, f"SELECT f_id {CHAIN} AND fact.f_id > 5;")) == 294
