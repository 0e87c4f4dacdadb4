"""The pipeline's stages on odd rows: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessella.llm import common

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
ROWS = [(0, None, "en"), (1, "", "en"), (2, LONG, "de"), (3, LONG, None), (3, LONG, None), (None, LONG + " x", "en"), (None, None, "en"), (4, "x" * 200_000, "en"), (5, LONG[:3000] + " password=b7db7aa4a5fcc783059", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("mine") for c in ("kept", "fp", "id", "digest_", "id_", "mark_", "stats_", "keep_id_", "gdigest_", "node", "n", "piece")})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_odd_rows_and_empty_tables(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    rows = got.collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if name != "packing":
        assert got.columns == odd.columns
    kept = sorted(str(r.doc_id) for r in rows)
    want = {
        "quality_rules": {"2", "3", "5", "None"},  # too few words go: nulls, empty ones, one long word
        "exact_dedup": {"1", "3", "4", "5", "None"},  # of equal texts the largest id; null is empty
        "near_dedup": {"0", "2", "4", "5"},  # the smallest id of similar texts
        "secret_scan": {"0", "1", "2", "3", "4", "5", "None"},
        "packing": {"0", "1", "2", "3", "4", "5", "None"},
    }[name]
    assert set(kept) <= want if name == "quality_rules" else set(kept) == want
    if name in ("exact_dedup", "near_dedup"):
        assert len(kept) == len(want)
    if name == "secret_scan":
        assert len(rows) == len(ROWS) and not any(r.text and "b7db7aa4" in r.text for r in rows)


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Fake)
