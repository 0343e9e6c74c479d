import random
from collections import Counter

import numpy as np
import pytest
from conftest import prose  # tests/llm comes first on the path

from corpusmill.llm.components import components
from corpusmill.llm.ngram_join import (choose_bands, drop_near_duplicates, links_between, near_duplicates, roots_of)


def grams(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows):
    """(links, smallest connected id) per row by comparing all pairs."""
    sets = [grams(r[1]) for r in rows]
    linked = [[j for j in range(len(rows)) if j != i and (
        sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)]
        for i in range(len(rows))]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(linked):
            least = min([group[i], *[group[j] for j in others]])
            if least < group[i]:
                group[i], changed = least, True
    members = {g: [rows[i][0] for i in range(len(rows)) if group[i] == g] for g in set(group)}
    smallest = {g: min((d for d in m if d is not None), default=None) for g, m in members.items()}
    return [len(x) for x in linked], [smallest[g] for g in group]


def family(seed, n, words, edits):
    """Texts of one origin with a few words replaced."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"new{rng.randrange(9)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [prose(100 + i, 20 + i) for i in range(30)]
    texts += family(1, 60, 90, 3) + family(2, 8, 300, 20) + [family(3, 1, 40, 0)[0]] * 25 + family(4, 10, 30, 1)
    texts += [prose(300, 60) + " " + prose(400 + i, 40) for i in range(6)]  # a shared passage, no near copies
    return [(1000 - i, t) for i, t in enumerate(texts)]


def test_bands_reach_the_recall():
    bands, per = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** per) ** bands >= 0.9999 and bands * per <= 128
    assert choose_bands(1.0, 0.9)[0] == 1
    with pytest.raises(ValueError):
        choose_bands(0.01, 0.9999, 4)


@pytest.mark.parametrize("block", [512, 7])
def test_agrees_with_all_pairs(make_docs, rows, block):
    links, smallest = brute(rows)
    got = {r.doc_id: r for r in near_duplicates(make_docs(rows), block_classes=block).collect()}
    assert len(got) == len(rows)
    assert [got[d].n_links for d, _ in rows] == links
    assert [got[d].class_id for d, _ in rows] == smallest


def test_drops_all_but_one_of_each_group(make_docs, rows):
    docs = make_docs(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows)[1]))


def test_messy_rows(messy, messy_rows):
    links, smallest = brute([r[:2] for r in messy_rows])
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(messy).collect())
    ids = [(d, c if c is not None else d) for (d, *_), c in zip(messy_rows, smallest)]
    assert got == Counter((d, c, n) for (d, c), n in zip(ids, links))
    kept = Counter((r.doc_id, r.text) for r in drop_near_duplicates(messy).collect())
    assert max(kept.values()) == 1
    # one blank text, one of the copies, both texts of a repeated id, the row without an id
    assert sorted(kept, key=str) == sorted(
        {(0, "")} | {(d, t) for d, t, _ in messy_rows if t and t.strip() and d != 6}, key=str)


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_link_matrix_in_small_slices(monkeypatch):
    monkeypatch.setattr("corpusmill.llm.ngram_join.MATRIX_CELLS", 64)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(5, 25)).astype(np.uint64)) for _ in range(20)]
    want = np.array([[len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5 for b in sets] for a in sets])
    assert (links_between(sets, None, 0.5) == want).all()
    assert (links_between(sets[:7], sets[7:], 0.5) == want[:7, 7:]).all()


def test_roots():
    linked = np.zeros((6, 6), bool)
    for a, b in ((5, 4), (4, 1), (3, 2)):
        linked[a, b] = linked[b, a] = True
    assert roots_of(linked).tolist() == [0, 1, 2, 2, 1, 1]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
