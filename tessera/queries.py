"""One query per relational operator, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import Field, Predicate, all_of, count_of, equals, is_in, max_of
from .operators import block_product, equi_join, group_by, index_join, index_select, join_all, materialize, merge_join, product, project, select, sort_by
from .plans import table_statistics
from .sources import Conflict, Database, Transaction, Type, read_table
from .shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return [read_table(spark, sf_dir, n) for n in names]


def scratch(spark: SparkSession) -> Database:
    """A new database in the folder that all executors share."""
    return Database(spark, f"{shared_folder(spark)}/db-{uuid.uuid4().hex}")


def _imported(spark: SparkSession, sf_dir: str, *names: str) -> Transaction:
    tx = scratch(spark).begin()
    for n, df in zip(names, _t(spark, sf_dir, *names)):
        tx.import_table(df, n)
    return tx


@query("select r_regionkey, r_name from region")
def scan_region(spark, d):
    return _t(spark, d, "region")[0]


@query("select n_name, n_regionkey from nation")
def project_subset(spark, d):
    return project(*_t(spark, d, "nation"), ["n_name", "n_regionkey"])


@query("select c_mktsegment, c_name, c_custkey from customer")
def project_reorder(spark, d):
    return project(*_t(spark, d, "customer"), ["c_mktsegment", "c_name", "c_custkey"])


@query("select n_name from nation where n_regionkey = 1")
def filter_eq_int(spark, d):
    return project(select(*_t(spark, d, "nation"), equals(Field("n_regionkey"), 1)), ["n_name"])


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def filter_eq_string(spark, d):
    return project(select(*_t(spark, d, "customer"), equals(Field("c_mktsegment"), "BUILDING")), ["c_custkey", "c_name"])


@query("select n_name from nation where 1 = n_regionkey")
def filter_eq_flipped(spark, d):
    return project(select(*_t(spark, d, "nation"), equals(1, Field("n_regionkey"))), ["n_name"])


@query("select doc_id from (select doc_id, cast(quality = 1 as boolean) as is_good from labels) where is_good = true")
def filter_eq_bool(spark, d):
    labels = _t(spark, d, "labels")[0].select("doc_id", (F.col("quality") == 1).alias("is_good"))
    return project(select(labels, equals(Field("is_good"), True)), ["doc_id"])


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber = l_quantity")
def filter_eq_fields(spark, d):
    return project(select(*_t(spark, d, "lineitem"), equals(Field("l_linenumber"), Field("l_quantity"))), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber in (1, 3)")
def filter_in_int(spark, d):
    return project(select(*_t(spark, d, "lineitem"), is_in(Field("l_linenumber"), [1, 3])), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_in_string(spark, d):
    return project(select(*_t(spark, d, "orders"), is_in(Field("o_orderpriority"), ["1-URGENT", "2-HIGH"])), ["o_orderkey", "o_orderpriority"])


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber in (1, 3)")
def filter_in_mixed(spark, d):
    """Constants of another type never match."""
    return project(select(*_t(spark, d, "lineitem"), is_in(Field("l_linenumber"), [1, "2", 3, True])), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber in (1, 2)")
def filter_and_chain(spark, d):
    where = all_of(equals(Field("l_returnflag"), "R"), equals(Field("l_linestatus"), "F"), is_in(Field("l_linenumber"), [1, 2]))
    return project(select(*_t(spark, d, "lineitem"), where), ["l_orderkey", "l_linenumber"])


@query("select r_name from region where 1 = 1")
def filter_const_true(spark, d):
    return project(select(*_t(spark, d, "region"), equals(1, 1)), ["r_name"])


@query("select n_name, r_name from nation, region")
def product_two(spark, d):
    return project(product(*_t(spark, d, "nation", "region")), ["n_name", "r_name"])


@query("select n_name, r_name, s_name from nation, region, supplier")
def product_three(spark, d):
    return project(join_all(_t(spark, d, "nation", "region", "supplier")), ["n_name", "r_name", "s_name"])


@query("select n_name, r_name from nation, region")
def join_multibuffer(spark, d):
    return project(block_product(*_t(spark, d, "nation", "region")), ["n_name", "r_name"])


_REGION = equals(Field("n_regionkey"), Field("r_regionkey"))


@query("select n_name, r_name from nation, region where n_regionkey = r_regionkey")
def join_equi(spark, d):
    return project(equi_join(*_t(spark, d, "nation", "region"), _REGION), ["n_name", "r_name"])


@query("select n_name, r_name from nation, region where n_regionkey = r_regionkey")
def join_merge(spark, d):
    return project(merge_join(*_t(spark, d, "nation", "region"), "n_regionkey", "r_regionkey"), ["n_name", "r_name"])


@query("select o_orderkey, c_name from orders, customer where o_custkey = c_custkey")
def join_index(spark, d):
    return project(index_join(*_t(spark, d, "orders", "customer"), "o_custkey", "c_custkey"), ["o_orderkey", "c_name"])


@query("select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey")
def join_three(spark, d):
    where = all_of(equals(Field("c_nationkey"), Field("n_nationkey")), _REGION)
    return project(join_all(_t(spark, d, "customer", "nation", "region"), where), ["c_name", "n_name", "r_name"])


@query("select o_orderkey, c_name, n_name, r_name from orders, customer, nation, region where o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = r_regionkey and o_orderstatus = 'F'")
def join_four(spark, d):
    where = all_of(equals(Field("o_custkey"), Field("c_custkey")), equals(Field("c_nationkey"), Field("n_nationkey")), _REGION, equals(Field("o_orderstatus"), "F"))
    return project(join_all(_t(spark, d, "orders", "customer", "nation", "region"), where), ["o_orderkey", "c_name", "n_name", "r_name"])


@query("select c_name, s_name from customer, supplier, nation where c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = 2")
def join_multi_key(spark, d):
    where = all_of(equals(Field("c_nationkey"), Field("s_nationkey")), equals(Field("s_nationkey"), Field("n_nationkey")), equals(Field("n_regionkey"), 2))
    return project(join_all(_t(spark, d, "customer", "supplier", "nation"), where, spread=["s_nationkey"]), ["c_name", "s_name"])


@query("select a.n_name from nation a, nation b")
def self_product(spark, d):
    nation = _t(spark, d, "nation")[0]
    return project(product(nation, nation), ["n_name"])


@query("select c_custkey, c_nationkey, c_name from customer order by c_nationkey, c_custkey")
def sort_multi(spark, d):
    return sort_by(project(*_t(spark, d, "customer"), ["c_custkey", "c_nationkey", "c_name"]), ["c_nationkey", "c_custkey"])


@query("select r_regionkey, r_name from region")
def materialize_region(spark, d):
    return materialize(*_t(spark, d, "region"))


@query("select c_nationkey, count(*) as countof_c_custkey from customer group by c_nationkey")
def group_count(spark, d):
    return group_by(*_t(spark, d, "customer"), ["c_nationkey"], [count_of("c_custkey")])


@query("select p_brand, max(p_size) as maxof_p_size from part group by p_brand")
def group_max(spark, d):
    return group_by(*_t(spark, d, "part"), ["p_brand"], [max_of("p_size")])


@query("select c_nationkey, max(c_name) as maxof_c_name from customer group by c_nationkey")
def group_max_string(spark, d):
    return group_by(*_t(spark, d, "customer"), ["c_nationkey"], [max_of("c_name")])


@query("select l_returnflag, l_linestatus, count(*) as countof_l_orderkey, max(l_quantity) as maxof_l_quantity from lineitem group by l_returnflag, l_linestatus")
def group_multi(spark, d):
    return group_by(*_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [count_of("l_orderkey"), max_of("l_quantity")])


@query("select max(p_size) as maxof_p_size, count(*) as countof_p_size from part")
def group_global_max(spark, d):
    return group_by(*_t(spark, d, "part"), [], [max_of("p_size"), count_of("p_size")])


@query("select count(*) as num_recs, cast(1 + floor(count(*) / 3) as bigint) as distinct_est from lineitem")
def stats_table(spark, d):
    return table_statistics(*_t(spark, d, "lineitem"))


@query("select c_custkey, c_name from (select c_custkey, c_name, c_nationkey from customer) v")
def view_simple(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_view("v", "select c_custkey, c_name, c_nationkey from customer")
    return project(tx.table("v"), ["c_custkey", "c_name"])


@query("select c_name from (select c_name, c_mktsegment from customer where c_nationkey = 3) v where c_mktsegment = 'BUILDING'")
def view_filtered(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_view("v", "select c_name, c_mktsegment from customer where c_nationkey = 3")
    return project(select(tx.table("v"), equals(Field("c_mktsegment"), "BUILDING")), ["c_name"])


@query("select c_custkey from (select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING') v where c_nationkey = 3")
def view_string_const(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_view("v", "select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    return project(select(tx.table("v"), equals(Field("c_nationkey"), 3)), ["c_custkey"])


@query("select c_name, n_name from (select c_name, c_nationkey from customer where c_mktsegment = 'BUILDING') v, nation where c_nationkey = n_nationkey")
def view_joined(spark, d):
    tx = _imported(spark, d, "customer", "nation")
    tx.create_view("v", "select c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    return project(equi_join(tx.table("v"), tx.table("nation"), equals(Field("c_nationkey"), Field("n_nationkey"))), ["c_name", "n_name"])


@query("select c_name from (select c_name, c_nationkey from (select c_name, c_nationkey, c_mktsegment from customer) v where c_mktsegment = 'BUILDING') w where c_nationkey = 3")
def view_nested(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_view("v", "select c_name, c_nationkey, c_mktsegment from customer")
    tx.create_view("w", "select c_name, c_nationkey from v where c_mktsegment = 'BUILDING'")
    return project(select(tx.table("w"), equals(Field("c_nationkey"), 3)), ["c_name"])


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def index_select_segment(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_index("segment_idx", "customer", "c_mktsegment")
    tx.commit()
    return project(index_select(tx.table("customer"), "c_mktsegment", "BUILDING"), ["c_custkey", "c_name"])


@query("select o_orderkey, o_orderstatus from orders where not (o_orderstatus = 'F')")
def dml_delete(spark, d):
    tx = _imported(spark, d, "orders")
    tx.delete("orders", equals(Field("o_orderstatus"), "F"))
    tx.commit()
    return project(tx.table("orders"), ["o_orderkey", "o_orderstatus"])


@query("select n_nationkey, n_name, cast(case when n_regionkey = 1 then 9 else n_regionkey end as int) as n_regionkey from nation")
def dml_update_const(spark, d):
    tx = _imported(spark, d, "nation")
    tx.update("nation", "n_regionkey", 9, equals(Field("n_regionkey"), 1))
    tx.commit()
    return tx.table("nation")


@query("select s_suppkey, s_name, cast(case when s_nationkey = 3 then s_suppkey else s_nationkey end as int) as s_nationkey from supplier")
def dml_update_field(spark, d):
    tx = _imported(spark, d, "supplier")
    tx.update("supplier", "s_nationkey", Field("s_suppkey"), equals(Field("s_nationkey"), 3))
    tx.commit()
    return project(tx.table("supplier"), ["s_suppkey", "s_name", "s_nationkey"])


@query("select r_regionkey, r_name from region union all select 99, 'ATLANTIS'")
def dml_insert(spark, d):
    tx = _imported(spark, d, "region")
    tx.insert("region", {"r_regionkey": 99, "r_name": "ATLANTIS"})
    tx.commit()
    return tx.table("region")


@query("select r_regionkey, r_name from region union all select 99, ''")
def dml_insert_default(spark, d):
    tx = _imported(spark, d, "region")
    tx.insert("region", {"r_regionkey": 99})
    tx.commit()
    return tx.table("region")


@query("select n_nationkey, n_name, n_regionkey from nation")
def tx_rollback(spark, d):
    tx = _imported(spark, d, "nation")
    tx.commit()
    tx.delete("nation", Predicate())
    tx.rollback()
    return tx.table("nation")


@query("select * from (values ('tblcat', 28), ('fldcat', 56), ('viewcat', 128), ('idxcat', 64)) t(tblname, slotsize)")
def catalog_tables(spark, d):
    _t(spark, d)
    return scratch(spark).begin().table("tblcat")


@query("select 'students' as tblname, k as fldname, t::int as type, l::int as length, o::int as \"offset\" from (values ('sid', 4, 0, 4), ('sname', 12, 9, 8), ('active', -7, 0, 21)) x(k, t, l, o)")
def catalog_fields(spark, d):
    _t(spark, d)
    tx = scratch(spark).begin()
    tx.create_table("students", {"sid": Type("int"), "sname": Type("varchar", 9), "active": Type("boolean")})
    return select(tx.table("fldcat"), equals(Field("tblname"), "students"))


@query("select * from (values ('busy', 'select c_name from customer where c_nationkey = 3 and c_mktsegment = ''BUILDING''')) t(viewname, viewdef)")
def catalog_views(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_typed_view("busy", ["c_name"], ["customer"], all_of(equals(Field("c_nationkey"), 3), equals(Field("c_mktsegment"), "BUILDING")))
    return tx.table("viewcat")


@query("select * from (values ('segment_idx', 'customer', 'c_mktsegment'), ('nation_idx', 'customer', 'c_nationkey')) t(indexname, tablename, fieldname)")
def catalog_indexes(spark, d):
    tx = _imported(spark, d, "customer")
    tx.create_index("segment_idx", "customer", "c_mktsegment")
    tx.create_index("nation_idx", "customer", "c_nationkey")
    return tx.table("idxcat")


@query("select c_name, n_name from customer, nation where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING'")
def view_typed(spark, d):
    """In a typed view as in predicates, a number never equals a string."""
    tx = _imported(spark, d, "customer", "nation")
    where = all_of(equals(Field("c_nationkey"), Field("n_nationkey")), is_in(Field("c_mktsegment"), ["BUILDING", 7]))
    tx.create_typed_view("v", ["c_name", "n_name"], ["customer", "nation"], where)
    return tx.table("v")


@query("select n_nationkey, n_name from nation where n_regionkey = '0' and 1 = 0")
def view_typed_mismatch(spark, d):
    tx = _imported(spark, d, "nation")
    tx.create_typed_view("v", ["n_nationkey", "n_name"], ["nation"], equals(Field("n_regionkey"), "0"))
    return tx.table("v")


def _indexed(spark, d) -> Transaction:
    tx = _imported(spark, d, "nation")
    tx.create_index("region_idx", "nation", "n_regionkey")
    tx.commit()
    return tx


@query("select n_name from nation where n_regionkey = 1 union all select 'ATLANTIS'")
def index_after_insert(spark, d):
    tx = _indexed(spark, d)
    tx.insert("nation", {"n_nationkey": 99, "n_name": "ATLANTIS", "n_regionkey": 1})
    tx.commit()
    return project(index_select(tx.table("nation"), "n_regionkey", 1), ["n_name"])


@query("select n_name from nation where n_regionkey = 1 and n_nationkey <> 2")
def index_after_delete(spark, d):
    tx = _indexed(spark, d)
    tx.delete("nation", equals(Field("n_nationkey"), 2))
    tx.commit()
    return project(index_select(tx.table("nation"), "n_regionkey", 1), ["n_name"])


@query("select n_name from nation where n_regionkey in (1, 2)")
def index_after_update(spark, d):
    tx = _indexed(spark, d)
    tx.update("nation", "n_regionkey", 1, equals(Field("n_regionkey"), 2))
    tx.commit()
    return project(index_select(tx.table("nation"), "n_regionkey", 1), ["n_name"])


@query("select r_regionkey, r_name from region where r_regionkey <> 0")
def tx_conflict(spark, d):
    """Of two transactions that change a table from the same snapshot the first one holds."""
    tx = _imported(spark, d, "region")
    tx.commit()
    first, second = tx.database.begin(), tx.database.begin()
    first.delete("region", equals(Field("r_regionkey"), 0))
    second.delete("region", equals(Field("r_regionkey"), 1))
    first.commit()
    try:
        second.commit()
    except Conflict:
        return tx.database.begin().table("region")
    raise RuntimeError("the second transaction should have failed")
