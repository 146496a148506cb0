import pytest

from tessera.functions import Field, equals, is_in
from tessera.operators import equi_join, project, select
from tessera.sources import Conflict, Database, Type

STUDENTS = {"sid": Type("int"), "sname": Type("varchar", 9), "majorid": Type("int"), "gradyear": Type("int"), "is_active": Type("boolean")}
ROWS = [(1, "joe", 10, 2021, True), (2, "amy", 20, 2020, True), (3, "max", 10, 2022, False), (4, "sue", 20, 2022, True), (5, "bob", 30, 2020, False)]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}")


def filled(db):
    tx = db.begin()
    tx.create_table("students", STUDENTS)
    tx.create_table("depts", {"did": Type("int"), "dname": Type("varchar", 8)})
    tx.create_index("majorid_idx", "students", "majorid")
    for r in ROWS:
        assert tx.insert("students", dict(zip(STUDENTS, r))) == 1
    for r in ((10, "compsci"), (20, "math"), (30, "drama")):
        tx.insert("depts", dict(zip(("did", "dname"), r)))
    tx.commit()
    return tx


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_from_creation_to_deletion(db):
    tx = filled(db)
    assert rows(tx.table("students")) == sorted(ROWS, key=str)
    assert rows(project(select(tx.table("students"), equals(Field("majorid"), 10)), ["sid", "sname"])) == [(1, "joe"), (3, "max")]
    joined = equi_join(tx.table("students"), tx.table("depts"), equals(Field("majorid"), Field("did")))
    assert rows(project(joined, ["sname", "dname"])) == [("amy", "math"), ("bob", "drama"), ("joe", "compsci"), ("max", "compsci"), ("sue", "math")]
    tx.create_view("cs_students", "select sid, sname from students where majorid = 10 and sname = 'joe'")
    tx.create_view("again", "select sname from cs_students")
    assert rows(tx.table("again")) == [("joe",)]
    assert tx.update("students", "gradyear", 2023, equals(Field("sid"), 1)) == 1
    assert tx.update("students", "majorid", Field("sid"), equals(Field("sid"), 2)) == 1
    assert tx.delete("students", equals(Field("sid"), 5)) == 1
    tx.commit()
    tx = db.begin()
    assert rows(tx.table("students")) == [(1, "joe", 10, 2023, True), (2, "amy", 2, 2020, True), (3, "max", 10, 2022, False), (4, "sue", 20, 2022, True)]
    assert rows(project(select(tx.table("students"), is_in(Field("sid"), [1, 3])), ["sname"])) == [("joe",), ("max",)]
    assert rows(tx.table("again")) == [("joe",)]
    assert tx.delete("students") == 4 and tx.table("students").count() == 0


def test_omitted_fields_and_checks(db):
    tx = filled(db)
    tx.insert("students", {"sid": 6})
    assert (6, "", 0, 0, False) in rows(tx.table("students"))
    for bad in ({"sid": "1"}, {"sid": True}, {"sid": 2**31}, {"sname": "a" * 10}, {"sname": "é" * 5}, {"nothing": 1}):
        with pytest.raises(ValueError):
            tx.insert("students", bad)
    assert tx.table("students").count() == 6
    with pytest.raises(ValueError):
        tx.update("students", "sname", "a" * 10)
    with pytest.raises(ValueError):
        Type("float")


def test_names(db):
    tx = filled(db)
    for f in (lambda: tx.create_table("students", STUDENTS), lambda: tx.create_index("majorid_idx", "depts", "did"), lambda: tx.create_index("i", "depts", "x"), lambda: tx.table("nothing"), lambda: tx.insert("tblcat", {"tblname": "x"}), lambda: tx.create_table("tblcat", STUDENTS)):
        with pytest.raises(ValueError):
            f()
    tx.create_view("v", "select sid from students")
    with pytest.raises(ValueError, match="view"):
        tx.delete("v")
    tx.create_view("depts", "select did from depts where did = 10")  # stands before the table
    assert rows(tx.table("depts")) == [(10,)]


def test_catalog(db):
    tx = filled(db)
    tx.create_view("v", "select sid from students")
    sizes = dict(rows(tx.table("tblcat")))
    assert sizes == {"students": 33, "depts": 20, "tblcat": 28, "fldcat": 56, "viewcat": 128, "idxcat": 64}
    assert ("students", "sname", 12, 9, 8) in rows(tx.table("fldcat"))
    assert rows(tx.table("idxcat")) == [("majorid_idx", "students", "majorid")]
    assert rows(tx.table("viewcat")) == [("v", "select sid from students")]


def test_rollback_and_snapshot(db):
    tx = filled(db)
    other = db.begin()
    other.delete("students")
    other.rollback()
    assert other.table("students").count() == 5
    other.delete("students", equals(Field("sid"), 1))
    other.commit()
    assert tx.table("students").count() == 5  # the older snapshot
    assert db.begin().table("students").count() == 4


def test_conflict(db):
    filled(db)
    a, b, c = db.begin(), db.begin(), db.begin()
    a.delete("students", equals(Field("sid"), 1))
    b.delete("students", equals(Field("sid"), 2))
    c.delete("depts", equals(Field("did"), 10))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    c.commit()  # other tables
    tx = db.begin()
    assert (tx.table("students").count(), tx.table("depts").count()) == (4, 2)


def test_index_never_changes_results(db):
    tx = filled(db)
    tx.insert("students", {"sid": 7, "majorid": 10})
    tx.create_index("grad_idx", "students", "gradyear")
    tx.commit()
    assert rows(project(select(tx.table("students"), equals(Field("majorid"), 10)), ["sid"])) == [(1,), (3,), (7,)]


def test_university(db):
    from tessera.functions import all_of
    from tessera.operators import join_all
    from tessera.sources.samples import create_university

    create_university(db.begin())
    tx = db.begin()
    tables = [tx.table(n) for n in ("students", "enrolls", "sections", "courses")]
    where = all_of(equals(Field("sid"), Field("studentid")), equals(Field("sectionid"), Field("sectid")), equals(Field("courseid"), Field("cid")))
    got = rows(project(join_all(tables, where), ["sname", "title", "prof", "grade"]))
    assert got == [("amy", "calculus", "einstein", "B+"), ("joe", "calculus", "einstein", "C"), ("joe", "db systems", "turing", "A"), ("kim", "elocution", "brando", "A"), ("sue", "calculus", "newton", "B"), ("sue", "elocution", "brando", "A")]
    assert join_all([tx.table(n) for n in ("students", "depts", "courses")]).count() == 162
    assert rows(tx.query("select grade from enrolls where studentid = 6")) == [("A",)]


def test_folders_that_no_manifest_names_are_never_read(db, spark):
    tx = filled(db)
    spark.range(5).write.parquet(f"{db.folder}/students/lost")
    assert db.begin().table("students").count() == 5
    tx.delete("students")
    assert db.begin().table("students").count() == 5  # not committed


def test_typed_views(db):
    tx = filled(db)
    tx.create_typed_view("v", ["sname", "dname"], ["students", "depts"], equals(Field("majorid"), Field("did")))
    tx.create_typed_view("w", ["sname"], ["v"], is_in(Field("dname"), ["math", 20]))
    tx.create_typed_view("none", ["sid"], ["students"], equals(Field("majorid"), "10"))
    tx.commit()
    tx = db.begin()
    assert rows(tx.table("w")) == [("amy",), ("sue",)] and rows(tx.table("none")) == []
    assert ("v", "select sname, dname from students, depts where majorid = did") in rows(tx.table("viewcat"))
    assert ("w", "select sname from v where dname in ('math', 20)") in rows(tx.table("viewcat"))


def test_names_made_meanwhile(db):
    filled(db)
    a, b = db.begin(), db.begin()
    a.create_view("v", "select sid from students")
    b.create_view("v", "select did from depts")
    a.commit()
    with pytest.raises(Conflict, match="v was made"):
        b.commit()


def test_one_writer_of_a_version(db):
    filled(db)
    state = db.state()
    state.version += 1
    db.publish(state)
    with pytest.raises(Conflict):
        db.publish(state)
    assert db.state().version == state.version


def test_shell_prints_all_rows(spark, capsys):
    from tessera.__main__ import show

    assert show(spark.range(50).toDF("x")) == 50
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 53 and out[-1] == "50 rows" and out[2].strip() == "0"
