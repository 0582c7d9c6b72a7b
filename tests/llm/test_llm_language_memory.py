"""What the language model's fit holds in the driver."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import language_id


def test_fit_holds_no_features_of_all_rows():
    draw = np.random.default_rng(1)
    where, counts = np.sort(draw.choice(language_id.BUCKETS, 1000, replace=False)).astype(np.int32), np.ones(1000, np.int32)
    model = language_id.Model(["de", "en"], np.ones(language_id.BUCKETS), np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2), 1.0)
    tracemalloc.start()
    try:
        language_id.fit_ftrl(model, [(i % 2, where, counts) for i in range(2000)], epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20  # features of all rows are 32 MB


@pytest.mark.parametrize("rows", [[("1", "-", "en")], [("1", "good words here", "en"), ("2", "gute Worte hier", "de"), ("3", None, "de")] * 20])
def test_fit_on_few_rows(spark, rows):
    """Also where no text has a letter, so that no row is drawn."""
    docs = spark.createDataFrame(rows, "key string, text string, lang string")
    model = language_id.fit(docs.where(F.lit(True)))
    assert model.langs == sorted({r[2] for r in rows}) and (len(rows) == 1 or model.predict("gute Worte")[0] == "de")
