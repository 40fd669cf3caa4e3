"""Physical plans: pruned scans, no cross products, Python only where it is meant to be."""

import contextlib
import io

import pytest
from sqlcheck import DATA

from hypomill.plans.queries import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


#: Joins without keys against a fixed handful of rows: cut-offs.
CROSSED = {"oracle_by_n", "nbest_evaluation"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert name in CROSSED or "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["wer_by_system", "lambda_curve", "serialize_literal", "average_unique"])
def test_scans_leave_out_maps_and_token_arrays(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES[name](spark, DATA))
    assert "metadata:string" not in text and "token_ids:array" not in text and "token_logprobs:array" not in text


@pytest.mark.parametrize("name", ["serialize_literal", "alignment_counts", "exchange_messages", "normalize_text", "p6_found"])
def test_no_shuffle_where_rows_stand_alone(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, DATA))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(decoding_strategy), EqualTo(decoding_strategy,unconstrained)]" in plan(QUERIES["unconstrained_outputs"](spark, DATA))
