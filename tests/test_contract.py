from functools import cache

import pytest

import __spark_entry__ as contract
from glyphflow.operators import jobs, metrics, normalise
from glyphflow.plans import skew
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@cache
def larger():
    return connect("/root/testdata/sf0.01")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    if name in ORACLE:
        assert differences(df, duck, ORACLE[name]) == []
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", list(ORACLE))
def test_no_answer_is_empty(name):
    assert larger().sql(f"SELECT count(*) FROM ({ORACLE[name].rstrip().rstrip(';')})").fetchall()[0][0] > 0


@pytest.mark.parametrize("name", ["r_image_summary", "b_batch_results", "j_fold", "m_queue_depth", "v_blank"])
def test_answers_do_not_depend_on_the_number_of_partitions(spark, duck, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert differences(contract.queries()[name](spark, FOLDER), duck, ORACLE[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def everything_is_hot(monkeypatch):
    """Keys with a handful of rows count as hot."""
    small = {"min_rows": 6, "bucket_rows": 20}
    for module in (skew, jobs, metrics, normalise):
        for function in vars(module).values():
            defaults = getattr(function, "__kwdefaults__", None)
            for name in small.keys() & (defaults or {}).keys():
                monkeypatch.setitem(defaults, name, small[name])


@pytest.mark.parametrize(
    "name",
    ["r_image_summary", "r_bbox", "r_response_parts", "r_error_rows", "j_transitions", "m_queue_depth",
     "m_queue_depth_literal", "m_exposition"],
)
def test_answers_do_not_depend_on_the_skew_plan(spark, duck, everything_is_hot, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert differences(contract.queries()[name](spark, FOLDER), duck, ORACLE[name]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["r_bbox", "r_response_parts"])
def test_polygons_do_not_travel_to_their_image(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = [below for line, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in line]
    assert sent and not [below for below in sent if "polygon#" in below.replace("include_polygon#", "")]
