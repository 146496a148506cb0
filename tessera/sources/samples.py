"""A small university to try things on."""

from __future__ import annotations

from .database import Transaction
from .tables import Type

_INT = Type("int")

#: Fields and rows of each table.
UNIVERSITY: dict[str, tuple[dict[str, Type], list[tuple]]] = {
    "students": (
        {"sid": _INT, "sname": Type("varchar", 9), "majorid": _INT, "gradyear": _INT, "is_active": Type("boolean")},
        [(1, "joe", 10, 2021, True), (2, "amy", 20, 2020, True), (3, "max", 10, 2022, False), (4, "sue", 20, 2022, True), (5, "bob", 30, 2020, False), (6, "kim", 20, 2020, True), (7, "art", 30, 2021, True), (8, "pat", 20, 2019, False), (9, "lee", 10, 2021, True)],
    ),
    "depts": ({"did": _INT, "dname": Type("varchar", 8)}, [(10, "compsci"), (20, "math"), (30, "drama")]),
    "courses": (
        {"cid": _INT, "title": Type("varchar", 10), "deptid": _INT},
        [(12, "db systems", 10), (22, "compilers", 10), (32, "calculus", 20), (42, "algebra", 20), (52, "acting", 30), (62, "elocution", 30)],
    ),
    "sections": (
        {"sectid": _INT, "courseid": _INT, "prof": Type("varchar", 8), "yearoffered": _INT},
        [(13, 12, "turing", 2018), (23, 12, "turing", 2019), (33, 32, "newton", 2019), (43, 32, "einstein", 2017), (53, 62, "brando", 2018)],
    ),
    "enrolls": (
        {"eid": _INT, "studentid": _INT, "sectionid": _INT, "grade": Type("varchar", 2)},
        [(14, 1, 13, "A"), (24, 1, 43, "C"), (34, 2, 43, "B+"), (44, 4, 33, "B"), (54, 4, 53, "A"), (64, 6, 53, "A")],
    ),
}


def create_university(tx: Transaction) -> None:
    """Five tables, their rows, and two indexes, committed."""
    for name, (fields, rows) in UNIVERSITY.items():
        tx.create_table(name, fields)
        for row in rows:
            tx.insert(name, dict(zip(fields, row)))
    tx.create_index("majorid_idx", "students", "majorid")
    tx.create_index("studentid_idx", "enrolls", "studentid")
    tx.commit()
