from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tokenizers
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.packing import PieceTokenizer, assign, pack_documents, power_sizes

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = tokenizers.Tokenizer.from_file(PATH)

awkward = st.text(st.one_of(st.characters(max_codepoint=0x17F), st.characters(exclude_categories=["Cs"]),
                            st.sampled_from(" \n\t'|<>sStTmMdDlLrReEvV0123İßΣς")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(awkward, max_size=8))
def test_chunks_equal_whole_texts(texts):
    got = PieceTokenizer(PATH, 50)([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_keeps_the_ids_right():
    encode = PieceTokenizer(PATH, 12)
    for i in range(40):
        text = prose(i % 7, 9) + f" the of, {i} x\u4e2d{i}"
        for _ in range(2):
            assert encode([text.encode()])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids
        assert len(encode._codes) < 12 // 2 + 30
    assert encode([]) == []


def test_special_tokens_in_texts():
    text = "a <|endoftext|> b<|startoftext|>c it's THEY'LL"
    assert PieceTokenizer(PATH)([text.encode()])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 16), min_size=1, max_size=30))
def test_pieces_fill_the_sequences(lengths):
    total = sum(lengths)
    sizes = [16] * (total // 16) + power_sizes(total % 16)
    held = assign(lengths, sizes, 1.0, 0.1)
    taken = Counter()
    for sequence, size in zip(held, sizes):
        at = 0
        for piece, start, length, offset in sequence:
            assert offset == at and length > 0
            at += length
            taken.update((piece, i) for i in range(start, start + length))
        assert at == size
    assert taken == Counter((p, i) for p, n in enumerate(lengths) for i in range(n))


def test_goes_to_the_cheapest_sequence_with_room():
    held = assign([8, 6, 5, 3, 2], [12, 12], 1.0, 1.0)
    # 8 and 6 to a sequence each, then 5 to the cheaper, the rest where room is left
    assert held[1][:2] == [(1, 0, 6, 0), (2, 0, 5, 6)] and held[0][:2] == [(0, 0, 8, 0), (3, 0, 3, 8)]


def check(rows, pieces, capacity):
    want = Counter()
    for doc, text in rows:
        want[doc, tuple(WHOLE.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    have, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        have[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc, total), parts in have.items():
        texts = [t for (d, t), n in want.items() if d == doc and len(t) == total for _ in range(n)]
        counted = Counter((s + i, int(x)) for s, ids in parts for i, x in enumerate(ids))
        assert counted == Counter((i, x) for t in texts for i, x in enumerate(t))
    assert sum(r.length for r in pieces) == sum(len(t) * n for (_, t), n in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_every_id_is_in_one_piece_and_nothing_is_padded(messy, messy_rows):
    check([r[:2] for r in messy_rows], pack_documents(messy, PATH).collect(), 2048)


def test_blocks_and_odd_capacities(make_docs):
    rows = [(i, prose(i, 1 + i * 7 % 400)) for i in range(120)]
    for capacity, block in ((64, 256), (100, 50), (2048, 4096)):
        check(rows, pack_documents(make_docs(rows).repartition(3), PATH, capacity, block_tokens=block).collect(),
              capacity)


def test_empty_table(empty):
    assert pack_documents(empty, PATH).count() == 0
