import hashlib

import numpy as np
from conftest import prose

from corpusmill.llm.fingerprints import Fingerprinter, edited_fingerprints, fingerprint_documents
from corpusmill.llm.words import shingles, word_hashes


def grams(text):
    words = text.encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_bins_and_densification_by_hand():
    prints = Fingerprinter(16, 8)
    text = prose(1, 12).encode()
    words = text.split()
    hashes, counts = shingles(word_hashes(words), np.array([len(words)]))
    assert counts.tolist() == [8]
    least = {}
    for h in hashes.tolist():
        least[h >> 60] = min(least.get(h >> 60, 1 << 64), h & ((1 << 60) - 1))
    values, some = prints.values([text])
    assert some.all()
    for b in range(16):
        at, attempt = b, 0
        while at not in least:
            at, attempt = int(prints._drawn(np.array([b]), attempt)[0]), attempt + 1
        assert values[0, b] == least[at]


def test_likeness_estimates_jaccard():
    prints = Fingerprinter()
    base = prose(5, 600).split()
    for keep in (600, 540, 450, 300, 0):
        a, b = " ".join(base), " ".join(base[:keep] + prose(9, 600 - keep).split())
        x, y = prints([a.encode(), b.encode()])
        assert abs(prints.likeness([x], [y])[0] - len(grams(a) & grams(b)) / len(grams(a) | grams(b))) < 0.09
    assert len(prints([a.encode()])[0]) == 512 * 4 // 8


def test_packing_widths_and_empty_texts():
    for bits in (1, 2, 4, 8):
        prints = Fingerprinter(64, bits)
        a, b, c = prints([prose(1, 50).encode(), prose(2, 50).encode(), b" "])
        assert len(a) == 64 * bits // 8 and c == b""
        assert prints.likeness([a, a, c, c], [a, b, c, a]).tolist()[::2] == [1.0, 1.0]
        assert prints.likeness([c], [a]).tolist() == [0.0]


def expected(rows):
    """Edited texts, rows in descending id, nulls last; equal ids in any order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        cut = len(text) // 3
        yield doc, len(text), hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()


def test_edited_texts_over_many_ranges(make_docs):
    rows = [(i * 7 % 997, prose(i, 5 + i % 60) + " é中") for i in range(300)]
    for ranges in (1, 3, 40):
        got = edited_fingerprints(make_docs(rows).repartition(5), ranges=ranges).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected(rows))
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_messy_rows(messy, messy_rows):
    got = edited_fingerprints(messy).collect()
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(
        str((d, len(t or ""))) for d, t, _ in messy_rows)
    prints = {}
    texts = {d: t for d, t, _ in messy_rows if d not in (7, None)}
    for r in got:
        if r.doc_id in texts:
            assert prints.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    alone = fingerprint_documents(messy).collect()
    assert sorted(bytes(r.fingerprint).hex() for r in alone) == sorted(r.fingerprint for r in got)


def test_one_row_and_none(make_docs, empty):
    one = edited_fingerprints(make_docs([(4, "abcdef")])).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [
        (6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert edited_fingerprints(empty).count() == 0 and fingerprint_documents(empty).count() == 0
