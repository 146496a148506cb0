import random

import duckdb
import pytest
from pyspark.sql import functions as F

import tessera.operators.relational as R
from tessera.functions import Field, Predicate, all_of, count_of, equals, is_in, max_of
from tessera.operators import block_product, equi_join, group_by, index_join, index_select, join_all, materialize, merge_join, product, project, select, sort_by, spread_join
from tessera.plans import table_statistics
from tessera.sources import display_sizes, result_rows

STUDENTS = [(1, "joe", 10, 2021, True), (2, "amy", 20, 2020, True), (3, "max", 10, 2022, False), (4, "sue", 20, 2022, True), (5, "bob", 30, 2020, False), (6, "kim", 20, 2020, True), (7, "art", 30, 2021, True), (8, "pat", 20, 2019, False), (9, "lee", 10, 2021, True)]
DEPTS = [(10, "compsci"), (20, "math"), (30, "drama")]
ENROLLS = [(14, 1, 13, "A"), (24, 1, 43, "C"), (34, 2, 43, "B+"), (44, 4, 33, "B"), (54, 4, 53, "A"), (64, 6, 53, "A")]


@pytest.fixture(scope="module")
def students(spark):
    return spark.createDataFrame(STUDENTS, "sid int, sname string, majorid int, gradyear int, is_active boolean")


@pytest.fixture(scope="module")
def depts(spark):
    return spark.createDataFrame(DEPTS, "did int, dname string")


@pytest.fixture(scope="module")
def enrolls(spark):
    return spark.createDataFrame(ENROLLS, "eid int, studentid int, sectionid int, grade string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_select_and_project(students):
    assert rows(project(select(students, equals(Field("majorid"), 10)), ["sname"])) == [("joe",), ("lee",), ("max",)]
    assert rows(project(select(students, is_in(Field("gradyear"), [2019, 2022])), ["sid"])) == [(3,), (4,), (8,)]
    assert project(students, ["sid", "sid"]).columns == ["sid", "sid"]
    with pytest.raises(ValueError, match="nothing"):
        project(students, ["nothing"])
    with pytest.raises(ValueError, match="nothing"):
        select(students, equals(Field("nothing"), 1))


@pytest.mark.parametrize("left, right", [(Field("majorid"), "10"), (Field("sname"), 10), (Field("is_active"), 1), (True, 1), ("1", 1), (Field("sid"), Field("sname"))])
def test_values_of_other_types_are_never_equal(students, left, right):
    assert select(students, equals(left, right)).count() == 0


def test_mixed_list(students):
    assert rows(project(select(students, is_in(Field("sid"), [1, "2", True, 3])), ["sid"])) == [(1,), (3,)]
    with pytest.raises(ValueError):
        is_in(Field("sid"), [])


def test_constants(students):
    assert select(students, equals(1, 1)).count() == 9
    assert select(students, equals(1, 2)).count() == 0
    assert select(students, Predicate()).count() == 9


def test_predicate_parts():
    p = all_of(equals(Field("a"), 1), equals(Field("b"), Field("c")), is_in(Field("a"), [1, 2]))
    assert len(p.within(["a"]).terms) == 2
    assert len(p.joining(["a", "b"], ["c"]).terms) == 1
    assert p.constant_of("a") == 1 and p.constant_of("b") is None
    assert p.partner_of("b") == "c" and p.partner_of("c") == "b"
    assert p.applies_to(["a", "b", "c"]) and not p.applies_to(["a", "b"])


def test_joins_agree(students, depts):
    on = equals(Field("majorid"), Field("did"))
    want = rows(project(select(product(students, depts), on), ["sname", "dname"]))
    assert len(want) == 9
    for df in (equi_join(students, depts, on), join_all([students, depts], on), merge_join(students, depts, "majorid", "did"), index_join(students, depts, "majorid", "did")):
        assert rows(project(df, ["sname", "dname"])) == want
    assert "SortMergeJoin" in plan(merge_join(students, depts, "majorid", "did"))
    assert "ShuffledHashJoin" not in plan(index_join(students, depts, "majorid", "did"))  # no hash table of a size that nobody has checked
    assert "CartesianProduct" in plan(block_product(students, depts))


def test_join_of_three_forms_no_product(students, depts, enrolls):
    where = all_of(equals(Field("majorid"), Field("did")), equals(Field("sid"), Field("studentid")), equals(Field("grade"), "A"))
    df = join_all([students, depts, enrolls], where)
    assert rows(project(df, ["sname", "dname"])) == [("joe", "compsci"), ("kim", "math"), ("sue", "math")]
    assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
    with pytest.raises(ValueError, match="nothing"):
        join_all([students, depts], equals(Field("nothing"), 1))


def test_join_all_starts_from_what_is_narrowed(spark):
    """Nothing meets on a value that many rows have before the rows are as few as terms make them; fields keep their order."""
    a, b, c = (spark.range(200).selectExpr(f"id as {x}id", f"cast(id % 4 as int) as {x}key", f"cast(id % 3 as int) as {x}s") for x in "abc")
    c = c.where("cid < 4")
    where = all_of(equals(Field("akey"), Field("bkey")), equals(Field("bkey"), Field("ckey")), equals(Field("cs"), 1))
    df = join_all([a, b, c], where)
    assert df.columns == [f"{x}{y}" for x in "abc" for y in ("id", "key", "s")]
    assert rows(df.select("aid", "bid", "cid")) == rows(spark.range(200).alias("x").crossJoin(spark.range(200).alias("y")).where("x.id % 4 = 1 and y.id % 4 = 1").selectExpr("x.id", "y.id", "cast(1 as long)"))
    first = [x.strip() for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x][-1]
    assert "akey" in first and "ckey" in first and "bkey" not in first


def test_equalities_that_follow():
    p = all_of(equals(Field("a"), Field("b")), equals(Field("b"), Field("c")), equals(Field("d"), Field("c")))
    added = {t.fields for t in p.closed(dict.fromkeys("abcd", "int")).terms} - {t.fields for t in p.terms}
    assert added == {frozenset("ac"), frozenset("ad"), frozenset("bd")}
    assert p.closed({"a": "bigint", "b": "double", "c": "bigint", "d": "bigint"}).terms[3:] == ()  # 2**53 + 1 = 2.0**53 = 2**53


def test_pairs_of_a_value_that_many_rows_have_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(R, "TILE", 64)
    monkeypatch.setattr(R, "TASK_PAIRS", 20_000)
    a = spark.range(3000).selectExpr("id as x", "if(id % 10 = 9, null, if(id % 7 = 0, cast(id as int), 5)) as k", "'a' as name", "cast(id % 2 as string) as m")
    b = spark.range(700).selectExpr("id + 10 as y", "if(id % 10 = 9, null, if(id % 7 = 0, cast(id as int), 5)) as l", "'b' as name", "cast(id % 3 as string) as o")
    a, b = a.union(a.where("x < 50")), b.union(b.where("y < 50"))
    for on in (equals(Field("k"), Field("l")), all_of(equals(Field("l"), Field("k")), equals(Field("m"), Field("o")), equals(Field("o"), "1"))):
        got, plain = spread_join(a, b, on), equi_join(a, b, on)
        assert got.columns == plain.columns
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0 < got.count()
    dealt = [r["count"] for r in spread_join(a, b, equals(Field("k"), Field("l"))).groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) > 40 and max(dealt) < sum(dealt) / 10
    assert spread_join(a, b.limit(0), equals(Field("k"), Field("l"))).count() == 0
    assert spread_join(a, b, equals(Field("k"), Field("o"))).count() == 0  # a number is no string


def test_products(spark, students, depts):
    assert product(students, depts).count() == block_product(students, depts).count() == 27
    assert product(students, students).count() == 81
    assert product(students, students).columns == students.columns
    for a, b in ((students.limit(0), depts), (students, depts.limit(0)), (students.limit(0), depts.limit(0))):
        assert product(a, b).count() == block_product(a, b).count() == 0
        assert equi_join(a, b, equals(Field("majorid"), Field("did"))).count() == 0


def test_left_field_wins(spark):
    a, b = spark.createDataFrame([(1, "left")], "k int, v string"), spark.createDataFrame([(2, "right")], "w int, v string")
    assert rows(project(product(a, b), ["v", "w"])) == [("left", 2)]


def test_sort(students):
    assert [r.sname for r in sort_by(students, ["gradyear", "sname"]).collect()] == ["pat", "amy", "bob", "kim", "art", "joe", "lee", "max", "sue"]


def test_group(students):
    assert rows(group_by(students, ["majorid"], [count_of("sid"), max_of("gradyear")])) == [(10, 3, 2022), (20, 4, 2022), (30, 2, 2021)]
    assert rows(group_by(students, [], [max_of("sname"), max_of("is_active")])) == [("sue", True)]
    assert group_by(students.limit(0), [], [count_of("sid")]).count() == 0
    assert group_by(students.limit(0), ["majorid"], [count_of("sid")]).count() == 0
    assert group_by(students, ["majorid"], [count_of("sid")]).dtypes == [("majorid", "int"), ("countof_sid", "bigint")]


def test_index_select_and_materialize(students):
    assert rows(index_select(students, "majorid", 10)) == rows(select(students, equals(Field("majorid"), 10)))
    assert rows(materialize(students)) == rows(students)


def test_filters_reach_the_scan(spark, students, tmp_path):
    students.write.parquet(str(tmp_path / "s"))
    df = project(select(spark.read.parquet(str(tmp_path / "s")), all_of(equals(Field("majorid"), 10), is_in(Field("sid"), [1, 3]))), ["sname"])
    text = plan(df)
    assert "EqualTo(majorid,10)" in text and "In(sid, [1,3])" in text and "gradyear" not in text


def test_statistics(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert rows(table_statistics(df)) == [(50, 17)] and [t for _, t in table_statistics(df).dtypes] == ["bigint", "bigint"]


def test_predicates_against_duckdb(spark):
    """Random conjunctions of comparisons, with joins, against the same in SQL."""
    r = random.Random(9)
    a = [(i, r.randrange(6), r.choice("xyz")) for i in range(60)]
    b = [(r.randrange(6), r.choice("xyz"), r.random() < 0.5) for _ in range(30)]
    left, right = spark.createDataFrame(a, "i int, n int, s string"), spark.createDataFrame(b, "m int, t string, f boolean")
    c = duckdb.connect()
    c.sql("create table l (i int, n int, s varchar)")
    c.executemany("insert into l values (?, ?, ?)", a)
    c.sql("create table r (m int, t varchar, f boolean)")
    c.executemany("insert into r values (?, ?, ?)", b)
    make = [
        lambda: (lambda k: (equals(Field("n"), k), f"n = {k}"))(r.randrange(6)),
        lambda: (equals(Field("n"), Field("m")), "n = m"),
        lambda: (equals(Field("t"), Field("s")), "t = s"),
        lambda: (lambda v: (is_in(Field("s"), v), "s in (" + ", ".join(f"'{x}'" for x in v) + ")"))(r.sample("xyz", 2)),
        lambda: (lambda v: (equals(v, Field("f")), f"f = {v}"))(r.random() < 0.5),
        lambda: (is_in(Field("m"), [1, "2", 3]), "m in (1, 3)"),
        lambda: (equals(Field("n"), Field("s")), "1 = 0"),
        lambda: (equals(Field("m"), "4"), "1 = 0"),
    ]
    for _ in range(25):
        terms = [r.choice(make[:6] if r.random() < 0.9 else make)() for _ in range(r.randrange(1, 4))]
        got = join_all([left, right], all_of(*(t for t, _ in terms)))
        want = c.sql("select i, n, s, m, t, f from l, r where " + " and ".join(t for _, t in terms)).fetchall()
        assert rows(got) == sorted(want, key=str)


def test_results(students):
    assert [r.sid for r in result_rows(students.orderBy("sid"))] == list(range(1, 10))
    assert display_sizes(students)["gradyear"] == 9
