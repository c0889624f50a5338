"""Scores that are equal once rounded are ranked by id, as in the SQL, though the larger ids are nearer."""

from __future__ import annotations

import pytest

from tests.test_same_as_sql import same  # noqa: F401

ROWS = "select i as vec_id, [1, (100 - i) * 5e-6]::float[] as embedding, (i % 4)::int as label from range(101) t(i)"


@pytest.mark.parametrize("name", ["dense_topk", "dense_topk_per_label", "dense_index_all_lists", "dense_index_scoped"])
def test_rounded_scores_are_ranked(same, name):  # noqa: F811
    assert len(same(name, embeddings=ROWS)) >= 15
