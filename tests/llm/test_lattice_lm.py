import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.llm import lattice_lm
from broadloom.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


def plain_sum(word, surfaces, p):
    """All segmentations by recursion over prefixes, in ordinary arithmetic."""
    w = b" " + word
    weight = dict(zip(surfaces, p))
    a = [1.0] + [0.0] * len(w)
    for e in range(1, len(w) + 1):
        a[e] = sum(a[s] * weight.get(w[s:e], 0.0) for s in range(e))
    return a[-1]


def test_forward_sums_all_segmentations():
    surfaces, p = lattice_lm.read_pieces(PATH)
    model = lattice_lm.Lattice(surfaces, np.log(p))
    words = [w.encode() for w in ["the", "a", "worthless", "über", "漢字", "xqzj", "internationalisation", "the"]] + [b"\xff"]
    assert np.allclose(model.log_likelihood(words), [math.log(plain_sum(w, surfaces, p)) for w in words])
    long = model.log_likelihood([b"ab" * 5000])
    assert np.isfinite(long).all()


def test_expected_counts_spell_the_words():
    surfaces, p = lattice_lm.read_pieces(PATH)
    model = lattice_lm.Lattice(surfaces, np.log(p))
    n = model.expected([b"hello", b"there"], np.array([2.0, 3.0]))
    assert sum(x * len(s) for x, s in zip(n, surfaces)) == pytest.approx(2 * 6 + 3 * 6)


DOCS = [(i, t, g, "x") for i, (t, g) in enumerate([("the cat sat", "en"), ("The dog sat down", "en"), ("le chat dort", "fr"), (None, None), ("", "en"),
                                                  ("new wörds only", "fr"), ("the the the", "en"), ("cat " * 3000, "en"), ("the cat sat", "en")])] + [
    (0, "the cat sat", "en", "x"), (None, "the end", "en", "x")]


@pytest.mark.parametrize("frequent", [100_000, 2, 0])
def test_base_and_counts(spark, frequent):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, score string")
    train = F.coalesce(F.col("doc_id") % 3, F.lit(1)) != 2
    rows = lattice_lm.score_documents(df, train, PATH, group="lang", frequent=frequent, most_groups=2).collect()
    c, ends = Counter(), 0
    for i, t, *_ in DOCS:
        if (1 if i is None else i % 3) != 2:
            c.update((t or "").lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for i, t, *_ in DOCS:
        w = (t or "").lower().split()
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[x] for x in w), ends])
        want.append((i, (1 if i is None else i % 3) == 2, len(w) + 1, 1 + sum(c[x] > 0 for x in w), n, round(base, 6)))
    assert sorted(((*r[:5], round(r[5], 6)) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_untrained_and_empty(spark):
    df = spark.createDataFrame(DOCS[:3], "doc_id bigint, text string, lang string, score string")
    rows = lattice_lm.score_documents(df, F.lit(False), PATH).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    assert lattice_lm.score_documents(df.limit(0), F.lit(True), PATH).collect() == []
