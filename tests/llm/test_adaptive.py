import itertools

import pytest

from tests.llm.helpers import DOCS, corpus, documents


def test_adaptive_code(spark):
    from strandline.llm.lm_adaptive import adaptive_log10, adaptive_scores

    # Texts of one byte and the empty one: at most all of the probability, and the first symbol is one of 257.
    short = 10.0 ** adaptive_log10(b"") + sum(10.0 ** adaptive_log10(bytes([s])) for s in range(256))
    assert 0 < short < 1
    assert adaptive_log10(b"") == pytest.approx(-2.40993, abs=1e-4)  # one of 257 symbols
    assert adaptive_log10(b"na" * 200) / 400 > 5 * adaptive_log10(bytes(itertools.islice(itertools.cycle(range(7, 250, 3)), 80))) / 80
    rows = corpus(9, 10)
    got = adaptive_scores(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)
    assert adaptive_scores(spark.createDataFrame([], DOCS)).count() == 0
