"""Long forms of vectors (F8) and interaction features beyond 31 bits."""

from pyspark.ml.linalg import Vectors

from pairgrid.operators import features as FT


def test_sparse_and_dense_vectors_to_long_form(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(1 << 30, [5, 70_000_000], [0.0, 2.5])), (2, Vectors.dense([0.0, -1.0, 3.0])), (3, Vectors.sparse(4, [], []))], ["row", "v"])
    assert sorted(map(tuple, FT.to_long_sparse(df, "row", "v").collect())) == [(1, 70_000_000, 2.5), (2, 1, -1.0), (2, 2, 3.0)]


def test_interactions_of_many_species(spark):
    rows = spark.createDataFrame([(1, 3_000_000, "a")], "idx long, code int, chem string")
    fp = spark.createDataFrame([("a", 7, 0.5)], "chem string, bit int, val double")
    assert [tuple(r) for r in FT.interaction_terms(rows, "idx", "code", "chem", fp, 1024).collect()] == [(1, 3_000_000 * 1024 + 7, 0.5)]
