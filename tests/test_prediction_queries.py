"""Queries of reduction use every dimension of the embeddings."""

import pytest

from lingmill.queries import QUERIES


@pytest.mark.parametrize("name, column", [("l3_factors", "term"), ("l7_without_main_components", "feat"), ("l9_varimax", "term")])
def test_all_dimensions_of_the_embeddings(spark, name, column):
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(column).distinct().collect()
    assert {r[0] for r in got} == {str(i) for i in range(64)}


def test_passes_over_folds_do_not_cut_texts_again(spark):
    from lingmill.queries import prediction

    assert "regexp_extract_all" not in prediction._toxic(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
