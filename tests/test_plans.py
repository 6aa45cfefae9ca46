"""What the physical plans must and must not contain."""

import pytest

from rolecast.operators import rank as R
from rolecast.operators import retrieve as Q
from rolecast.operators.features import feature_table
from rolecast.operators.screen import validate_batch
from rolecast.plans.bindings import CONFIG, POSTING, profiles
from rolecast.plans import flow
from samples import VALID, load, profile

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_work_needs_no_shuffle_and_no_python(spark, tmp_path):
    df = load(spark, tmp_path, VALID, profile())
    for work in (validate_batch(df), feature_table(df, POSTING.criteria())):
        text = plan(work)
        for word in ("Exchange", "Python", "Arrow", "Join", "SortAggregate"):
            assert word not in text, word


def test_parsed_arrays_are_projections_of_their_own(spark, tmp_path):
    """Dates of roles are parsed in an earlier projection than the rules."""
    text = plan(validate_batch(load(spark, tmp_path, VALID)))
    rules = next(line for line in text.splitlines() if "missing_candidate_id" in line)
    # Only the two activity dates are parsed among the rules.
    assert rules.count("gettimestamp") == 2 and text.count("gettimestamp") == 4


def test_topk_is_taken_before_the_window(spark):
    text = plan(flow.build_ranking(feature_table(profiles(spark, SF), POSTING.criteria(), CONFIG), config=CONFIG))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_deduplication_limits_groups_before_the_exchange(spark):
    df = spark.range(10).selectExpr("CAST(id % 3 AS STRING) AS candidate_id", "0.5D AS final_score", "id AS ingest_ordinal")
    text = plan(R.dedupe_first(df))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_keyword_scan_ships_only_keys(spark, tmp_path):
    text = plan(Q.keyword_topn(load(spark, tmp_path, VALID), ["spark"], 5))
    assert "TakeOrderedAndProject(limit=5, orderBy=[hits" in text and "output=[candidate_id" in text


def test_checkpoint_folder_comes_from_the_session():
    from unittest.mock import MagicMock

    from rolecast.session import checkpoint_root

    def fake(setting, current, master):
        spark = MagicMock()
        spark.conf.get.return_value = setting
        spark.sparkContext.getCheckpointDir.return_value = current
        spark.sparkContext.master = master
        return spark

    cluster = fake("s3://shared/ckpt", None, "yarn")
    assert checkpoint_root(cluster) == "s3://shared/ckpt"
    cluster.sparkContext.setCheckpointDir.assert_called_once_with("s3://shared/ckpt")
    assert checkpoint_root(fake(None, "hdfs://set", "yarn")) == "hdfs://set"
    with pytest.raises(RuntimeError):
        checkpoint_root(fake(None, None, "yarn"))


def test_lines_are_parsed_once(spark, tmp_path):
    text = plan(load(spark, tmp_path, VALID).where("profile.headline = 'x' AND size(skills) > 1"))
    # The line is opened by one expression (and a second time only where a bare NaN kept it from being JSON) and taken apart by another.
    assert text.count("parseJson") == 2 and text.count("$[0]") == 1
