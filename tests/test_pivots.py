"""The search by pivots gives the rows of the plain exact search."""

import numpy as np
import pytest

from faultline.operators import memory, pivots

SCHEMA = "id int, failure_class string, embedding array<double>"
COLUMNS = ("query_id", "rank", "incident_id", "failure_class", "similarity_score")


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8))
    rows = [(i, [None, "", "a", "b", "unknown"][i % 5], (centres[i % 12] + 0.05 * draw.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, "a", rows[7][2]) for i in range(20)]  # ties
    rows += [(900, "a", None), (901, "b", [0.0] * 8), (902, "only query", [1.0] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("by_class,block,most", [(True, 4096, 16), (True, 7, 16), (False, 50, 30), (True, 50, 1)])
def test_equal_to_the_plain_search(vectors, by_class, block, most):
    queries = vectors.withColumnRenamed("id", "query_id")
    store = vectors.withColumnRenamed("id", "incident_id").where("incident_id <> 902")
    plain = rows_of(memory.search_similar(queries, store, k=5, by_class=by_class))
    assert plain and rows_of(pivots.search_by_pivots(queries, store, k=5, by_class=by_class, block_rows=block, pivots=most)) == plain
    assert rows_of(pivots.search_by_pivots(queries, store.limit(0), k=5)) == []
    assert rows_of(pivots.search_by_pivots(queries.limit(0), store, k=5)) == []


def test_far_cells_are_left_out(spark, vectors):
    store = memory.normalize_vectors(vectors.where("failure_class = 'a' and embedding is not null")).select("unit")
    matrix = np.array([r.unit for r in store.limit(12).collect()])
    spread = spark.sparkContext.broadcast(matrix)
    cells = [{"cell": c, "radius": 0.1} for c in range(len(matrix))]
    asked = spark.createDataFrame([("a", i, matrix[i].tolist(), i, 0.99, cells) for i in range(12)],
                                  "_part string, _id int, unit array<double>, cell int, least double, cells array<struct<cell: int, radius: double>>")
    wanted = {(r._id, r.cell) for r in pivots._wanted(asked, spread).collect()}
    apart = np.arccos(np.clip(matrix @ matrix.T, -1, 1))
    assert wanted == {(i, j) for i in range(12) for j in range(12) if i != j and apart[i, j] - 0.1 <= np.arccos(0.99) + pivots.SLACK}
    assert len(wanted) < 12 * 11 / 2


def test_a_query_goes_once_to_a_bin_of_small_cells(spark, vectors):
    """Cells that share a bin cost a query one copy, not one for each cell."""
    spread = spark.sparkContext.broadcast(np.eye(8))
    cells = [{"cell": c, "radius": 3.0, "first": c // 4, "last": c // 4} for c in range(8)]
    asked = spark.createDataFrame([("a", i, np.eye(8)[i].tolist(), i, -1.0, cells) for i in range(8)],
                                  "_part string, _id int, unit array<double>, cell int, least double, cells array<struct<cell: int, radius: double, first: int, last: int>>")
    rows = [(r._id, r.bin) for r in pivots._wanted(asked, spread, bins=True).collect()]
    assert sorted(rows) == [(i, b) for i in range(8) for b in range(2)]
