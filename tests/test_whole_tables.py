"""Queries over clusters and references on more vectors than the smallest tables hold, against their SQL over every id."""

import glob
import os

import pytest
from oracle import counted, duck_rows
from pyspark.sql import functions as F

from tideline.plans import catalog

WITH_SQL = ["fragment_pairs", "trial_spread", "trial_error_rates", "trial_equal_error", "trial_exclusions", "awarded_names", "prompt_queue", "picked_voices", "one_speaker_cost", "group_members", "unanswered_voices"]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide"))
    spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id < 730").coalesce(1).write.parquet(f"{path}/all")
    os.rename(glob.glob(f"{path}/all/part-*.parquet")[0], f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_takes_the_whole_table(spark, wide, name):
    sql = catalog.oracle_sql()[name]
    assert "vec_id <" not in sql.replace(f"vec_id < {catalog.REFERENCES}", "")
    got = catalog.queries()[name](spark, wide)
    columns, want = duck_rows(sql, wide)
    assert sorted(got.columns) == sorted(columns) and counted(got.collect(), got.columns) == counted(want, columns)


def test_labels_and_groups_take_every_cluster(spark, wide):
    ids = set(range(100, 730))
    assert {r.id for r in catalog.effective_labels(spark, wide).collect()} == ids
    assert {r.id for r in catalog.linkage_groups(spark, wide).collect()} == {i for i in ids if i % 13 + 0.5 < 6}
    for name in ("tentative_names", "labels_without_a_name"):
        assert catalog.queries()[name](spark, wide).filter(F.col("id") >= 500).count() > 0, name
