import os
from collections import Counter

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from corpusmill.llm.secrets import find_spans
from corpusmill.llm.toxicity import sigmoid, train_toxicity, word_features
from corpusmill.llm.words import WordTable

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def grams(text):
    words = text.encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(base / name))
        after = spark.read.parquet(str(base / name))
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_return_documents(outputs):
    for name, before, after in outputs[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name
    assert [n for n, *_ in outputs] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_toxicity_follows_the_model(spark, outputs):
    _, before, after = outputs[0]
    model = train_toxicity(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    every = before.collect()
    scores = sigmoid(model.logits(WordTable(word_features), [r.text.encode() for r in every]))
    assert rows(after) == {r.doc_id: r for r, s in zip(every, scores) if s < 0.5}


def test_one_of_each_group_stays(outputs):
    _, before, after = outputs[1]
    docs = before.collect()
    sets = [grams(r.text) for r in docs]
    group = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        if all(group[group[i]] == group[i] for i in range(len(docs))):
            break
    first = {}
    for i, r in enumerate(docs):
        first[group[i]] = min(first.get(group[i], r.doc_id), r.doc_id)
    assert set(rows(after)) == set(first.values())


def test_secrets_are_blotted_out_and_nothing_else(outputs):
    _, before, after = outputs[2]
    a, b = rows(before), rows(after)
    assert a.keys() == b.keys()
    for i, r in a.items():
        spans = find_spans(r.text, 200)
        assert (b[i].text == r.text) == (not spans) and b[i].n_chars == len(b[i].text)
        assert not any(r.text[s:e] in b[i].text for s, _, e in spans)


def test_mixing_repeats_and_drops_whole_documents(outputs):
    _, before, after = outputs[3]
    a = rows(before)
    copies = Counter()
    for r in after.collect():
        assert r == a[r.doc_id]
        copies[r.doc_id] += 1
    assert max(copies.values()) == 2 and len(copies) < len(a)


def test_packing_holds_every_token_once(outputs):
    _, before, after = outputs[4]
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(r.length for r in after.collect()) == want


def test_run_is_the_stages_in_turn(spark, outputs):
    key = lambda df: sorted((r.doc_id, r.start, r.length) for r in df.collect())
    run = corpus_pipeline.run(spark, SF_DIR)
    assert run.columns == outputs[-1][2].columns
    assert sum(n for _, _, n in key(run)) == sum(n for _, _, n in key(outputs[-1][2]))


def tables(spark, folder, docs, labels):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_messy_tables(spark, messy, messy_rows, tmp_path):
    """Nulls, blanks, copies, repeated ids and very long texts pass all stages; what is clean and alone is packed."""
    labels = [(None, 1, 1), (5, None, None), (4, 1, 0), (4, 0, 1), (4, 0, 1), *[(100 + i, 1, 0) for i in range(30)]]
    folder = tables(spark, tmp_path, messy, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
    kept = [r.doc_id for r in docs.collect()]
    # of copies one stays; 4 is labelled toxic
    assert len({0, 1, 2} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1 and kept.count(6) <= 1
    assert {3, -9, 2**60} <= set(kept) and kept.count(7) == 2
    packed = corpus_pipeline.run(spark, folder).collect()
    assert packed and {r.doc_id for r in packed} <= set(kept) and all(0 < r.length <= 2048 for r in packed)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 0, 0)]])
def test_empty_tables(spark, empty, tmp_path, labels):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, empty, labels)).count() == 0
