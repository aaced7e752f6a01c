"""The report on assembled vectors reads stored entries; its plan widens no vector."""

import io
from contextlib import redirect_stdout

from pairgrid.plans import feature_plans as FP
from tests.conftest import SF_SMALL


def test_stack_blocks_widens_no_vector(spark):
    text = io.StringIO()
    df = FP.q_stack_blocks(spark, SF_SMALL)
    with redirect_stdout(text):
        df.explain(True)
    assert "vector_to_array" not in text.getvalue() and "UDF(features" not in text.getvalue()
    rows = df.limit(50).collect()
    assert rows and all(0 < r.nnz < r.width and r.total > 0 for r in rows)


def test_vectors_are_built_once_a_value(spark, monkeypatch):
    """Python builds a vector for each species, chemical, bin and text, not four for each row."""
    made = []
    whole = FP.FT.vectors_from_long
    monkeypatch.setattr(FP.FT, "vectors_from_long", lambda lg, *a, **k: (made.append(lg.select("idx").distinct().count()), whole(lg, *a, **k))[1])
    rows = FP.q_stack_blocks(spark, SF_SMALL).count()
    assert len(made) == 4 and sum(made) < rows / 4
