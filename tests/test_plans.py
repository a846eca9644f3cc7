"""Plans: what reaches the readers, and how patterns are joined."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from positdb.engine import Engine
from positdb.functions import values
from positdb.queries import QUERIES
from positdb.sources.store import PositStore, Shred

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("time_range", ["GreaterThanOrEqual(ts,2024-01-10", "LessThanOrEqual(ts,2024-01-20"]),
        ("time_month", ["GreaterThanOrEqual(o_orderdate,1998-0", "LessThanOrEqual(o_orderdate,1998-05-31"]),
        ("time_slot", ["GreaterThanOrEqual(o_orderdate,1998-10-03", "LessThanOrEqual(o_orderdate,1998-10-03"]),
        ("snapshot_literal", ["LessThanOrEqual(ts,2024-01-15T23:59"]),
        ("int_where", ["GreaterThanOrEqual(p_size,40)"]),
        ("dec_where", ["GreaterThanOrEqual(p_retailprice,1500.4"]),
        ("string_where", ["EqualTo(c_mktsegment,BUILDING)"]),
    ],
)
def test_conditions_reach_the_reader(spark, name, pushed):
    filters = " ".join(re.findall(r"PushedFilters: \[(.*?)\]\n", plan(spark, name)))
    for condition in pushed:
        assert condition in filters, filters


@pytest.mark.parametrize("name", ["numeric_var_eq", "identity_join", "meta_join", "union_var", "value_var_reuse", "shared_time_var"])
def test_shared_things_are_equi_joins(spark, name):
    found = plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in found and "CartesianProduct" not in found and re.search("(SortMerge|BroadcastHash|ShuffledHash)Join", found)


def test_settled_history_is_carried_without_a_join(spark):
    found = plan(spark, "asof_variable")
    assert "Join" not in found and "Window" in found


def test_certainties_of_a_table_reach_the_reader(spark, tmp_path):
    spark.createDataFrame([(i, i % 100, i) for i in range(200)], "thing long, sure int, id long").write.parquet(f"{tmp_path}/t")
    store = PositStore.in_memory(spark).shred(Shred(spark.read.parquet(f"{tmp_path}/t"), {"ascertains": F.col("thing")}, values.CERTAINTY, F.col("sure"), F.col("id")), unique=True)
    found = Engine(store).run("search [{(+x, ascertains)}, +c, *] where c >= 95% return x, c;")[0].typed
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain("formatted")
    assert "GreaterThanOrEqual(sure,95)" in out.getvalue() and found.count() == 10


def test_union_members_share_one_plan(spark):
    """The resident posits are read once, however many members ask."""
    found = plan(spark, "union_var")
    assert len(re.findall(r"ReadSchema: .*c_nationkey", found)) == 1 and re.search(r"\(\d+\) Generate", found)


def test_snapshots_shuffle_on_numbers(spark):
    found = plan(spark, "snapshot_literal")
    assert re.search(r"hashpartitioning\(\w*_w\d+#\d+L|hashpartitioning\(.*#\d+L", found)
