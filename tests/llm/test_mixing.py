from collections import defaultdict

import pytest
from conftest import prose
from pyspark.sql import functions as F

from corpusmill.llm.mixing import (SCHEDULES, mix_sources, mixed_documents, position, source_targets, stretches,
                                   training_order)


def targets_by_rounds(sizes, weights=(3, 1, 2), budget=1.5, repeats=2.0):
    """Share, cut what is above, share the rest among the others, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > repeats * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = repeats * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 900, "c": 40, "d": 5, "é": 70, "Z": 3, None: 11}, {None: 10},
    {"a": 0, "b": 10, "c": 0}, {"a": 0, "b": 0}, {f"s{i:02}": (i * 37) % 101 for i in range(40)}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = targets_by_rounds(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("knots", [*SCHEDULES, ((0.0, 0.0), (0.3, 4.0), (0.6, 1.0), (1.0, 0.0)),
                                   ((0.0, 2.0), (0.5, 0.0), (1.0, 2.0))])
def test_position_inverts_the_integral(spark, knots):
    def due(time):
        """Share due by a time, by the trapezoid rule on each stretch."""
        total = part = 0.0
        for (a, ra), (b, rb) in zip(knots, knots[1:]):
            total += (ra + rb) / 2 * (b - a)
            if time > a:
                end = min(time, b)
                rate = ra + (rb - ra) * (end - a) / (b - a)
                part += (ra + rate) / 2 * (end - a)
        return part / total

    times = spark.range(101).select((F.col("id") / 100).alias("due")).select(
        "due", position(F.col("due"), stretches(knots)).alias("at")).collect()
    assert all(abs(due(r["at"]) - r["due"]) < 1e-9 for r in times)
    assert [r["at"] for r in times] == sorted(r["at"] for r in times)


def mixed(docs, **options):
    return mix_sources(docs, **options).collect()


def holds(rows, out):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    want, taken = targets_by_rounds(sizes), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert (r.taken > 0) == bool(r.positions) and all(0 <= p <= 1 for p in r.positions)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


@pytest.fixture(scope="module")
def rows():
    return [(i, prose(i, 3 + i * 13 % 70), f"s{i % 7 * (i % 3)}" if i % 11 else None) for i in range(400)]


@pytest.mark.parametrize("bucket_rows", [1000, 5])
def test_sources_meet_their_targets(make_docs, rows, bucket_rows):
    holds(rows, mixed(make_docs(rows), bucket_rows=bucket_rows))


def test_buckets_and_reruns_agree(make_docs, rows):
    a, b = (sorted((r.doc_id, r.taken, r.positions) for r in mixed(make_docs(x), bucket_rows=n))
            for x, n in ((rows, 1000), (rows[::-1], 5)))
    assert a == b


def test_repeated_rows_share_evenly(make_docs):
    rows = [(1, "a b c", "s")] * 90 + [(2, "d e f", "s")] * 10 + [(3, "g " * 500, "t")]
    out = mixed(make_docs(rows))
    holds(rows, out)
    assert max(r.taken for r in out if r.doc_id == 1) - min(r.taken for r in out if r.doc_id == 1) <= 1


def test_messy_and_empty_tables(make_docs, messy, messy_rows, empty):
    holds(messy_rows, mixed(messy))
    assert mixed(empty) == [] and mixed_documents(empty).count() == 0


def test_training_order_is_sorted_and_has_every_copy(make_docs, rows):
    out = mix_sources(make_docs(rows))
    copies = sum(len(r.positions) for r in out.collect())
    times = [r.position for r in training_order(out).collect()]
    assert len(times) == copies and times == sorted(times)


def test_whole_copies(make_docs, rows, messy):
    docs = make_docs(rows)
    kept = mixed_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixed(docs)}
    got = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in kept.collect():
        got[r.doc_id] += 1
        assert r.text == texts[r.doc_id]
    assert dict(got) == {d: n for d, n in want.items() if n}
    assert mixed_documents(messy).columns == messy.columns
    blank = [r for r in mixed_documents(messy).collect() if not (r.text or "").strip()]
    assert len(blank) == 4  # texts without words stay


def test_copies_stand_in_training_order(make_docs, rows, spark, tmp_path):
    docs = make_docs(rows)
    due = {r.doc_id: r.positions[:int(r.taken / r.size + 0.5)] for r in mixed(docs)}
    want = [d for _, d in sorted((p, d) for d, times in due.items() for p in times)]
    got = [r.doc_id for r in mixed_documents(docs).collect()]
    assert got == want and max(due.values(), key=len)[1:]
    mixed_documents(docs).write.parquet(str(tmp_path / "mix"))
    files = sorted((tmp_path / "mix").glob("part-*.parquet"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == want


def test_the_query_follows_training_order(spark, make_docs, rows, tmp_path):
    from corpusmill.llm.bindings import QUERIES

    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    times = [r.first_position for r in QUERIES["op9_mix_sources"](spark, str(tmp_path)).collect()]
    known = [t for t in times if t is not None]
    assert len(times) == len(rows) and known == sorted(known) and times[:len(known)] == known


def test_no_python_in_the_plan(make_docs, rows):
    plan = mix_sources(make_docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
