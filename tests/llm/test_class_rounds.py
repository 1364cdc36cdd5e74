"""Rounds of exchange: each kept one raises the likelihood, one that lowers it is undone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import class_lm


@pytest.fixture(scope="module")
def counted(spark):
    """Words with counts after history classes, in three blocks that like three histories; first classes at random."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(600):
        history = np.unique(np.concatenate([rng.choice(np.arange(1 + 20 * (k % 3), 21 + 20 * (k % 3)), 6), rng.integers(1, 61, 1)]))
        counts = rng.integers(1, 30, len(history))
        rows.append((k + 1, int(rng.integers(0, class_lm.GROUPS)), int(counts.sum()), int(rng.integers(1, class_lm.CLASSES)), history.tolist(), counts.tolist()))
    rows.append((class_lm.END, 0, 50, 0, [1, 30], [25, 25]))
    return spark.createDataFrame(rows, "hash long, grp int, n long, cls int, history array<int>, counts array<long>").repartition(3)


def test_rounds_end_where_they_gain_little(counted):
    before = class_lm.likelihood(class_lm.table_of(counted))
    groups = np.ones(class_lm.GROUPS, np.int64)
    loose, _, some = class_lm.exchange_words(counted, groups, 10.0, "loose")  # ends after one round
    tight, _, table = class_lm.exchange_words(counted, groups, 0.0, "tight")  # as long as a round gains
    assert before < class_lm.likelihood(some) <= class_lm.likelihood(table)
    assert np.array_equal(table, class_lm.table_of(tight)) and tight.count() == 601
    assert tight.where(F.col("hash") == class_lm.END).first().cls == 0
    again, _, same = class_lm.exchange_words(tight, groups, 0.0, "again")  # no round gains: the words stay, none was lost
    assert np.array_equal(same, table) and sorted(map(tuple, again.select("hash", "cls").collect())) == sorted(map(tuple, tight.select("hash", "cls").collect()))


def test_likelihood_is_that_of_class_bigrams():
    """Against the sum over tokens of log P(class | history) + log P(word | class), up to what no exchange changes."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, (6, 10)).astype(float)  # history by word

    def plain(cls):
        total = 0.0
        for h in range(6):
            for w in range(10):
                if counts[h, w]:
                    in_class = counts[:, cls == cls[w]]
                    total += counts[h, w] * (np.log(in_class[h].sum() / counts[h].sum()) + np.log(counts[:, w].sum() / in_class.sum()))
        return total

    def ours(cls):
        return class_lm.likelihood(np.stack([counts[:, cls == c].sum(1) for c in range(3)], 1))

    a, b = rng.integers(0, 3, 10), rng.integers(0, 3, 10)
    assert plain(a) - plain(b) == pytest.approx(ours(a) - ours(b))
