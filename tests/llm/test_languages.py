"""No language is left out of training."""

import pytest

from tessella.llm import language


def test_every_language_is_trained_or_an_error_raised(spark, monkeypatch):
    docs = spark.createDataFrame([(f"word{i} text{i}", f"l{i:02}") for i in range(66)] + [("more of this", "l00")] * 3, "text string, lang string")
    langs, logs = language.train(docs)
    assert langs == [f"l{i:02}" for i in range(66)] and logs.shape == (66, language.BUCKETS)
    monkeypatch.setattr(language, "LANGUAGES", 65)
    with pytest.raises(ValueError):
        language.train(docs)
