"""Retrieval with ties, and in blocks of queries."""

from tessella.operators import embedding


def test_ties_go_by_id_whatever_the_row_order(spark, monkeypatch):
    rows = [(i, "b", [1.0, 0.0]) for i in range(40, 0, -1)] + [(i, "a", [0.0, 0.0]) for i in (100, 101, 102)]
    table = spark.createDataFrame(rows, "vec_id long, label string, v array<double>").coalesce(1)
    for block in (100_000, 2):
        monkeypatch.setattr(embedding, "_BLOCK", block, raising=False)
        got = embedding.retrieve(table.where("vec_id >= 100"), table, "v", 3, "vec_id", "label").collect()
        assert sorted((r.query, r.found, r["rank"]) for r in got) == [(q, f, f) for q in (100, 101, 102) for f in (1, 2, 3)]
