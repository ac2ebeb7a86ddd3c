import numpy as np
import pytest

from panelforge.llm import toxicity


def marked(n_toxic, n_clean, hits, slips, weight=1.0):
    """Whether a word in so many toxic and clean documents, each time between other words, is a mark."""
    docs = [np.array([3 * k + 1, 0 if k < hits or n_toxic <= k < n_toxic + slips else 3 * k + 2, 3 * k + 3], np.int32) for k in range(n_toxic + n_clean)]
    found = [[w] for w in range(3 * (n_toxic + n_clean) + 4)]
    return 0 in toxicity._marks(docs, [1] * n_toxic + [0] * n_clean, found, weight)


def test_one_clean_neighbourhood_in_a_balanced_sample():
    assert marked(600, 600, 129, 1)
    assert not marked(600, 600, 40, 3)


@pytest.mark.parametrize(("hits", "slips"), [(80, 0), (80, 1), (20, 1), (60, 3)])
def test_the_rule_is_that_of_the_whole_table(hits, slips):
    assert marked(100, 800, hits, 4 * slips) == marked(100, 200, hits, slips, 4.0)
