from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.token_counts import BETWEEN, RULES, allocate, count_tokens, offset_tokenizer, sections_of

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def spans(draw_sizes):
    """Neighbouring spans with gaps from (gap, size) pairs."""
    starts, ends, at = [], [], 0
    for gap, size in draw_sizes:
        starts.append(at + gap)
        ends.append(at + gap + size)
        at = ends[-1]
    return np.array(starts, np.int64), np.array(ends, np.int64)


pairs = st.lists(st.tuples(st.integers(0, 3), st.integers(1, 6)), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), pairs, st.sampled_from(RULES))
def test_allocation_is_the_rule_applied_to_every_pair(sizes, sections, rule):
    start, end = spans([(0, n) for n in sizes])
    s_start, s_end = spans(sections)
    token, section, share, touched = allocate(start, end, s_start, s_end, rule)
    got = {(int(t), int(s)): float(x) for t, s, x in zip(token, section, share)}
    want = {}
    for t in range(len(sizes)):
        common = {s: min(end[t], s_end[s]) - max(start[t], s_start[s]) for s in range(len(sections))}
        common = {s: int(c) for s, c in common.items() if c > 0}
        assert touched[t] == len(common)
        if not common:
            continue
        if rule == "split":
            want |= {(t, s): c / sum(common.values()) for s, c in common.items()}
        else:
            want[t, min(common, key=(lambda s: s) if rule == "start" else (lambda s: (-common[s], s)))] = 1.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_offsets_cover_the_text():
    text = "Ein Wörterbuch 中文 \U0001f600\U0001f468‍ end\n\n x"
    ids, start, end = offset_tokenizer(PATH)(text.encode())
    assert len(ids) == len(start) and start[0] == 0 and end[-1] == len(text)
    assert (end > start).all() and (start[1:] <= end[:-1]).all()


def test_sections_are_fields_and_lines():
    names, starts, ends = sections_of(["s1", "", "ab\n\ncd\n"], ["source", "lang", "text"], " ")
    assert names == ["source", "lang", "text", "text", "text"]
    assert list(zip(starts, ends)) == [(0, 2), (3, 3), (4, 7), (7, 8), (8, 11)]


def test_tokens_of_a_record_sum_up(messy, messy_rows):
    encode = offset_tokenizer(PATH)
    for rule in RULES:
        got = Counter()
        for r in count_tokens(messy, PATH, rule=rule).collect():
            got[r.doc_id] += r.tokens
        want = Counter()
        for doc, text, source in messy_rows:
            want[doc] += len(encode(f"{source or ''} en {text or ''}".encode())[0])
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_boundary_tokens_and_gaps(make_docs):
    rows = count_tokens(make_docs([(1, "word\n\n\nnext", "src")]), PATH).orderBy("section").collect()
    # " en" and " word" cross the separator, and belong to the field that holds most of them; of the two
    # line feeds in one token the first one's line gets it
    assert [(r.field, r.crossing) for r in rows][:3] == [("source", 0), ("lang", 1), ("text", 2)]
    assert BETWEEN not in {r.field for r in rows}
    lone = count_tokens(make_docs([(1, "a", "b")]), PATH, fields=("source", "text"), separator="\n\n").collect()
    assert [r.tokens for r in lone if r.field == BETWEEN] == [2.0]


def test_empty_table(empty):
    assert count_tokens(empty, PATH).count() == 0
