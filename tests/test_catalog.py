"""Every registered query against DuckDB on the smallest tables."""

import pytest
from conftest import duck, same_rows

import __spark_entry__
from kinlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, small, name):
    got = duck(small).execute(catalog.SQL[name])
    same_rows(catalog.QUERIES[name](spark, small), got.fetchall(), [d[0] for d in got.description])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_export_names_of_every_photo(spark):
    folder = "/root/testdata/sf0.01"
    got, n = catalog.QUERIES["export_names_all"](spark, folder), catalog.photos(spark, folder).count()
    assert got.count() == got.select("name").distinct().count() == n


def test_face_lines_of_every_face(spark, small):
    got, every = catalog.QUERIES["face_lines_all"](spark, small), catalog.faces(spark, small)
    assert got.count() == every.count() > every.where("photo_id % 50 = 0").count()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "relative_path"] and df.count() > 0


def test_plans_push_down_and_prune(spark, small):
    plan = catalog.QUERIES["photos_for_person"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan
    pairs = catalog.QUERIES["hamming_pairs"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in pairs and "CartesianProduct" not in pairs
