import random
from collections import Counter

import numpy as np
import pytest
from conftest import prose  # tests/llm comes first on the path

from corpusmill.llm import chosen_path
from corpusmill.llm.chosen_path import (Sets, choose_trees, least_labels, linked_components, linked_pairs, sketch_bound,
                                        tree_recall)

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = (text or "").translate(ASCII).encode().split()
    return frozenset(tuple(words[i:i + 3]) for i in range(max(len(words) - 2, 1))) if words else frozenset()


def brute(rows):
    """(id, set size, component, kept) per row by comparing all pairs."""
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (a == b or min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b))
                            and 100 * len(a & b) >= 85 * len(a | b)):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        g = root(i)
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    return Counter((r[0], len(s), least[root(i)], r[0] == least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def family(seed, n, words, edits, case=False):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"new{rng.randrange(9)}"
        text = " ".join(copy)
        out.append(text.upper() if case and rng.random() < 0.5 else text)
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [prose(100 + i, 20 + i) for i in range(30)]
    texts += family(1, 90, 120, 6, True) + family(2, 10, 300, 20) + family(3, 1, 40, 0) * 25 + family(4, 10, 30, 1)
    texts += family(5, 60, 40, 4) + [prose(300, 60) + " " + prose(400 + i, 25) for i in range(40)]
    texts += ["one", "ONE", "one two", "two one", "one two three", "", None, " \n ", "a b c d", "É x y", "é x y"]
    return [(1000 - i, t) for i, t in enumerate(texts)]


def found(docs, **options):
    return Counter(tuple(r) for r in linked_components(docs, **options).collect())


@pytest.mark.parametrize("options", [{}, {"small": 12}, {"small": 5, "most_counts": 1}, {"small": 5, "most_counts": 2}])
def test_agrees_with_all_pairs(make_docs, rows, options):
    assert found(make_docs(rows), **options) == brute(rows)


def test_messy_rows(messy, messy_rows):
    assert found(messy) == brute([r[:2] for r in messy_rows])


def test_empty_table(empty):
    assert not found(empty)


def test_only_empty_texts(make_docs):
    rows = [(1, ""), (2, None), (2, " "), (None, "")]
    assert found(make_docs(rows)) == brute(rows)


def test_trees_reach_the_recall():
    kept = tree_recall(0.85)
    assert 1 - (1 - kept) ** choose_trees(0.85, 0.9999) >= 0.9999
    assert tree_recall(0.5) < 1e-6
    with pytest.raises(ValueError):
        choose_trees(0.5, 0.9)


def test_sketches_estimate_similarity():
    sets_of = Sets(3)
    rng = random.Random(4)
    base = prose(9, 400).split()
    for edits in (5, 20, 60):
        other = list(base)
        for i in rng.sample(range(400), edits):
            other[i] = f"x{i}"
        a, b = sets_of([" ".join(base).encode(), " ".join(other).encode()])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        values = sets_of.minwise([a, b])
        assert abs((values[0] == values[1]).mean() - truth) < 0.15
    assert 85 <= sketch_bound(0.85) <= 90


def test_links_are_exact_at_the_threshold():
    base = np.arange(1000, dtype=np.uint64)
    sets = [base[:85], base[:100], base[:101], base[:0], base[:0]]
    want = np.zeros((5, 5), bool)
    for a, b in ((0, 1), (1, 2)):
        want[a, b] = want[b, a] = True
    assert (linked_pairs(sets, 85) == want).all()


def test_least_labels():
    a, b = np.array([5, 4, 3, 7]), np.array([4, 1, 2, 6])
    assert least_labels(9, a, b).tolist() == [0, 1, 2, 2, 1, 1, 6, 6, 8]
    path = np.arange(400)
    assert (least_labels(401, path[::-1] + 1, path[::-1]) == 0).all()


def test_texts_sent_for_a_hot_group(spark, make_docs, monkeypatch):
    """Near copies of one text: cells are sent for the shell of a pivot only, so texts go in proportion to the group."""
    sent = []
    join = chosen_path._Texts.join

    def counted(self, rows):
        sent.append(rows.count())
        return join(self, rows)

    monkeypatch.setattr(chosen_path._Texts, "join", counted)
    for size in (150, 600):
        rows = [(i, t) for i, t in enumerate(dict.fromkeys(family(6, 4 * size, 400, 3)))][:size]
        sent.clear()
        got = found(make_docs(rows), small=32)
        assert len(got) == size and {c for _, _, c, _ in got} == {0}
        assert sum(sent) < 4 * size
