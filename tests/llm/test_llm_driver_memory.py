"""What learning holds on the driver."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noteloom.llm import language_id


def test_language_sample_stays_narrow_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèàñ"))
    rows = [("".join(rng.choice(letters, 4000)), ("de", "fr")[n % 2]) for n in range(300)]
    texts = spark.createDataFrame(rows, "content string, language string").repartition(4)
    grams = sum(len(language_id.counts(text)[0]) for text, _ in rows)
    collected, before = [], type(texts).toArrow

    def watched(df: DataFrame) -> pa.Table:
        collected.append(before(df))
        tracemalloc.start()
        return collected[-1]

    monkeypatch.setattr(type(texts), "toArrow", watched)
    try:
        model = language_id.fit(texts, texts)
        # Beside the model itself: its two tables, its weights and what they are made with.
        beside = 12 * len(model.languages) * language_id.BUCKETS * 8
        assert tracemalloc.get_traced_memory()[1] < beside + 4 * grams
    finally:
        tracemalloc.stop()
    sample = max(collected, key=lambda table: table.nbytes)
    assert sample.num_rows == len(rows)
    assert sample.nbytes < 7 * grams
    assert model.languages == ("de", "fr")
