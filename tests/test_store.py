import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.lexical import build_index
from corpusmill.plans.search import search
from corpusmill.runtime import CLEANUP, folder_of, scratch_dir, stored, write_parquet
from corpusmill.sources import index_store as store
from corpusmill.sources.index_store import as_corpus

CHANGE = "seq long, op string, doc_id string, content string"


def state(index):
    docs = {r.doc_id: r.content for r in index.corpus.collect()}
    terms = {r.term: r.n for r in index.lexical.terms.groupBy("term").agg(F.sum("df").alias("n")).collect() if r.n}
    totals = index.lexical.totals
    postings = sorted((r.doc_id, r.term, r.tf, r.dl) for part in index.lexical.postings for r in part.collect())
    return docs, terms, postings, totals["n"], totals["total_dl"], round(totals["mean_idf"], 9)


def rebuilt(spark, docs):
    corpus = as_corpus(spark.createDataFrame(docs, "doc_id string, content string"))
    lexical = build_index(corpus)
    return state(store.Index(corpus, lexical))


@pytest.fixture(scope="module")
def path(spark):
    return scratch_dir(spark, "store")


def test_incremental_equals_rebuild(spark, path):
    base = spark.createDataFrame([("a", "x y z"), ("b", "x x w"), ("c", "y q")], "doc_id string, content string")
    store.save_index(base, path)
    changes = spark.createDataFrame([
        (5, "add", "b", "x new"), (6, "add", "d", "w z new"), (7, "delete", "a", None), (4, "add", "d", "old text"),
    ], CHANGE)
    index = store.commit_changes(spark, path, changes, "one")
    want = rebuilt(spark, [("b", "x new"), ("c", "y q"), ("d", "w z new")])
    assert state(index) == want

    # a replayed batch, an older add after a delete, and an older change are all ignored
    index = store.commit_changes(spark, path, changes, "one")
    late = spark.createDataFrame([(6, "add", "a", "back again"), (2, "delete", "b", None)], CHANGE)
    index = store.commit_changes(spark, path, late, "two")
    assert state(index) == want

    again = spark.createDataFrame([(8, "add", "a", "x y z"), (8, "add", "b", "x x w"), (8, "delete", "d", None)], CHANGE)
    index = store.commit_changes(spark, path, again, "three")
    assert state(index) == rebuilt(spark, [("a", "x y z"), ("b", "x x w"), ("c", "y q")])

    assert len(index.lexical.postings) == 4
    more = spark.createDataFrame([(9, "add", "e", "x q q"), (9, "delete", "c", None)], CHANGE)
    index = store.commit_changes(spark, path, more)
    before = rebuilt(spark, [("a", "x y z"), ("b", "x x w"), ("e", "x q q")])
    assert state(index) == before
    index = store.compact(spark, path)
    assert state(index) == before
    assert len(index.lexical.postings) == 1
    late = spark.createDataFrame([(3, "add", "d", "must stay deleted")], CHANGE)
    assert state(store.commit_changes(spark, path, late)) == before


def test_search_sees_committed_documents(spark, path):
    docs = spark.createDataFrame([("n1", "brand fresh words")], "doc_id string, content string")
    store.commit_changes(spark, path, docs.withColumn("op", F.lit("add")))
    query = spark.createDataFrame([(1, "fresh", None)], "query_id long, query string, query_vec array<float>")
    assert search(query, store.load_index(spark, path), k=1).first().doc_id == "n1"


def scans(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "FileScan parquet [" in line and column in line.split("]")[0]]


def partition_filters(scan):
    return scan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_short_query_reads_only_its_terms(spark, path):
    from corpusmill.operators.lexical import score_bm25

    index = store.compact(spark, path, folders=64)
    query = spark.createDataFrame([(1, "x y")], "query_id long, query string")
    found = scans(score_bm25(query, index.lexical), "tf#")
    assert found and all("In(term, [" in line and "dynamicpruning" in partition_filters(line) for line in found)


def test_a_batch_of_many_terms_reads_the_folders_of_its_terms(spark, path):
    from corpusmill.operators.lexical import score_bm25

    index = store.load_index(spark, path)
    query = spark.range(50).select(F.col("id").alias("query_id"), F.concat_ws(
        " ", F.lit("x"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("t"), "id", F.lit("_"), i))
    ).alias("query"))
    found = scans(score_bm25(query, index.lexical), "tf#")
    assert found and all("folder#" in partition_filters(x) and "dynamicpruning" in partition_filters(x) for x in found)


def test_a_commit_reads_the_folders_of_its_ids(spark, path):
    index = store.load_index(spark, path)
    for ids in (2, 3000):
        wanted = spark.range(ids).select(F.col("id").cast("string").alias("doc_id"))
        found = scans(store.near(index.corpus, "doc_id", wanted, index.folders), "content#")
        assert found and all("dynamicpruning" in partition_filters(line) for line in found)
        assert ("In(doc_id, [" in found[0]) == (ids == 2)


def test_ids_given_twice_are_stored_once(spark):
    docs = [("a", "x y"), ("a", "x z"), ("b", "x"), (None, "n n")]
    for rows in (docs, docs[::-1]):
        index = store.stored_index(spark.createDataFrame(rows, "doc_id string, content string"))
        kept = {r.doc_id: r.content for r in index.corpus.collect()}
        assert len(kept) == 3 and kept["b"] == "x" and index.lexical.totals["n"] == 3
        assert kept["a"] == kept.setdefault("first", kept["a"])
    assert sorted(kept) and "n n" in kept.values()


def test_a_version_is_written_once(spark):
    folder = scratch_dir(spark, "store")
    store.save_index(spark.createDataFrame([("a", "x")], "doc_id string, content string"), folder)
    with pytest.raises(FileExistsError, match="another writer"):
        store._append_log(spark, folder, 0, "elsewhere", "delta", None, [], 0, 1, None)
    assert [r["kind"] for r in store._commits(spark, folder)] == ["base"]


def test_two_writers_of_one_version(spark):
    """Both prepare version 1 on what they saw; one row counts and the other writer is told."""
    from concurrent.futures import ThreadPoolExecutor

    folder = scratch_dir(spark, "store")
    store.save_index(spark.createDataFrame([("a", "x")], "doc_id string, content string"), folder)

    def append(i):
        try:
            store._append_log(spark, folder, 1, f"segment-{i}", "delta", None, [], 0, 1, None)
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(append, range(8)) if i is not None]
    assert len(won) == 1
    assert [r["segment"] for r in store._commits(spark, folder)][1:] == [f"segment-{won[0]}"]


def test_a_commit_that_dies_in_its_log_write_blocks_nothing(spark, monkeypatch):
    folder = scratch_dir(spark, "store")
    one = spark.createDataFrame([("a", "x")], "doc_id string, content string")
    store.save_index(one, folder)
    added = spark.createDataFrame([("b", "y")], "doc_id string, content string").withColumn("op", F.lit("add"))

    def dies(spark, path, version, *_):  # the folder and a torn draft are left behind
        row = f"{path.removeprefix('file:')}/log/version={version}"
        os.makedirs(f"{row}/_temporary/0")
        with open(f"{row}/.draft", "w") as torn:
            torn.write('{"segment": "no')
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(store, "_append_log", dies)
        with pytest.raises(KeyboardInterrupt):
            store.commit_changes(spark, folder, added, "job 0")
    assert state(store.load_index(spark, folder))[0] == {"a": "x"}
    index = store.commit_changes(spark, folder, added, "job 0")
    assert state(index) == rebuilt(spark, [("a", "x"), ("b", "y")])
    assert state(store.commit_changes(spark, folder, added.withColumn("content", F.lit("z")), "job 0")) == state(index)


def test_replayed_batches_are_known_after_compact(spark):
    folder = scratch_dir(spark, "store")
    store.save_index(spark.createDataFrame([("a", "x")], "doc_id string, content string"), folder)

    def commit(text, batch):
        rows = spark.createDataFrame([("a", text)], "doc_id string, content string").withColumn("op", F.lit("add"))
        store.commit_changes(spark, folder, rows, batch)
        return state(store.load_index(spark, folder))[0]["a"]

    assert commit("one", "job 9") == "one" and commit("two", "job 10") == "two"
    assert commit("by name", "load") == "by name"
    for _ in range(2):
        store.compact(spark, folder)
        assert commit("again", "job 10") == commit("again", "job 9") == commit("again", "load") == "by name"
    assert commit("other", "other 3") == "other" and commit("next", "job 11") == "next"


def test_zeros_outrank_negative_scores(spark):
    from corpusmill.operators.lexical import bm25_topk

    docs = [(f"{i:03}", "common word" if i < 40 or i % 2 else f"rare{i}") for i in range(60)]
    index = store.stored_index(spark.createDataFrame(docs, "doc_id string, content string"))
    assert index.lexical.totals["mean_idf"] is not None
    query = spark.createDataFrame([(1, "common word")], "query_id long, query string")
    found = [(r.doc_id, r.score) for r in bm25_topk(query, index.lexical, 5).orderBy("rank").collect()]
    from corpusmill.operators.lexical import score_bm25

    scores = {r.doc_id: r.score for r in score_bm25(query, index.lexical).collect()}
    want = sorted(((d, scores.get(d, 0.0)) for d, _ in docs), key=lambda r: (-round(r[1], 9), r[0]))[:5]
    assert [d for d, _ in found] == [d for d, _ in want]


def test_vector_lists_follow_commits(spark):
    folder = scratch_dir(spark, "store")
    schema = "doc_id string, content string, embedding array<float>"
    base = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0]), ("c", "z", None)], schema)
    store.save_index(base, folder, vector_lists=2)
    changes = spark.createDataFrame([("b", "y", [1.0, 0.1]), ("d", "w", [0.9, 0.0])], schema)
    store.commit_changes(spark, folder, changes.withColumn("op", F.lit("add")))
    gone = spark.createDataFrame([("a",)], "doc_id string").withColumn("op", F.lit("delete"))
    index = store.commit_changes(spark, folder, gone)
    query = spark.createDataFrame([(1, "none", [1.0, 0.0])], "query_id long, query string, query_vec array<float>")
    exact, near = (sorted(map(tuple, search(query, index, 2, by_lists=b).drop("metadata").collect())) for b in (False, True))
    assert exact == near and {r[2] for r in near} == {"b", "d"}
    assert store.compact(spark, folder).lists.codes.select("doc_id").distinct().count() == 2


def test_vector_lists_of_a_store_that_began_without_vectors(spark):
    folder = scratch_dir(spark, "store")
    schema = "doc_id string, content string, embedding array<float>"
    store.save_index(spark.createDataFrame([("a", "x", None)], schema), folder, vector_lists=0)
    query = spark.createDataFrame([(1, "none", [1.0, 0.0])], "query_id long, query string, query_vec array<float>")
    from corpusmill.operators.vector_lists import search_lists

    assert search_lists(query, store.load_index(spark, folder).lists, 2).count() == 0
    for doc, vector in (("b", [0.0, 1.0]), ("d", [1.0, 0.5])):
        rows = spark.createDataFrame([(doc, "y", vector)], schema).withColumn("op", F.lit("add"))
        index = store.commit_changes(spark, folder, rows)
    assert [r.doc_id for r in search_lists(query, index.lists, 2).orderBy("rank").collect()] == ["d", "b"]
    with pytest.raises(ValueError, match="vector_lists"):
        search(query, store.stored_index(spark.createDataFrame([("a", "x", None)], schema)), by_lists=True)


def test_build_in_turns_holds_a_bounded_share(spark, monkeypatch):
    """F2-F7, F14, F17, F19, F20: postings are placed in turns, by tasks whose share doesn't grow with the corpus."""
    shares, places = [], []

    def placed(postings, mean, counts):
        shares.append(max(r["count"] for r in postings.groupBy(F.spark_partition_id().alias("task")).count().collect()))
        places.append(with_blocks(postings, mean, counts))
        return places[-1]

    with_blocks = store.with_blocks
    monkeypatch.setattr(store, "TASK_ROWS", 50)
    monkeypatch.setattr(store, "with_blocks", placed)
    docs = [(f"d{i}", " ".join(["all", f"w{i % 7}", *(f"t{i}x{j}" for j in range(18))])) for i in range(200)]
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    index = store.save_index(spark.createDataFrame(docs, "doc_id string, content string"), scratch_dir(spark, "store"))
    assert len(places) == store.TURNS and max(shares) <= 150  # 4,000 postings
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffled
    assert state(index) == rebuilt(spark, docs)
    blocks = {(r.term, r.block): r.n for r in index.lexical.blocks[0].collect()}
    assert blocks["all", 0] == 128 and sum(n for (term, _), n in blocks.items() if term == "all") == 200


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    """F2-F7, F14: they stayed until the driver collected garbage, those of all steps beside each other."""
    rows = spark.range(100_000).groupBy((F.col("id") % 70_000).alias("k")).count().withColumn("part", F.col("k") % 2)
    before = shuffle_files(spark)
    table = stored(rows, "counts")
    write_parquet(rows, scratch_dir(spark, "by-part"), "part")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) is None and table.count() == 70_000


def test_a_build_uses_its_first_tables_up(spark, monkeypatch):
    """F3-F6: what documents and postings are placed from lay beside all that was made of it, to the end."""
    shared = scratch_dir(spark, "x").rpartition("/")[0].removeprefix("file:")
    before, left = set(os.listdir(shared)), {"entries": [], "postings": []}

    def rows_left(kind):
        tables = [f for f in os.listdir(shared) if f not in before and f.startswith(f"{kind}-")]
        left[kind].append(sum(spark.read.parquet(f"{shared}/{f}").count() for f in tables))

    def watched(name, kind):
        act = getattr(store, name)

        def run(*args, **more):
            rows_left(kind)
            return act(*args, **more)
        monkeypatch.setattr(store, name, run)

    watched("newest_change", "entries")
    watched("with_blocks", "postings")
    monkeypatch.setattr(store, "TASK_ROWS", 50)
    monkeypatch.setattr(store, "TURN_BYTES", 1)
    docs = [(f"d{i}", " ".join(f"t{i}x{j}" for j in range(20))) for i in range(100)]
    twice = [*docs, *docs[:30]]
    path = scratch_dir(spark, "store")
    index = store.save_index(spark.createDataFrame(twice, "doc_id string, content string"), path)
    for kind, rows in (("entries", 130), ("postings", 2000)):
        assert len(left[kind]) == store.TURNS and left[kind][0] == rows
        assert all(b < a for a, b in zip(left[kind], left[kind][1:])) and left[kind][-1] < rows / 2
    assert state(index) == rebuilt(spark, docs)
    names = [f for _, _, files in os.walk(path.removeprefix("file:")) for f in files if f.endswith(".parquet")]
    assert any(f.endswith(".zstd.parquet") for f in names)


def test_few_folders_are_placed_in_as_many_turns(spark, monkeypatch):
    """a turn was a folder at least and a quarter of the postings at most, however many they were."""
    shares = []

    def placed(postings, mean, counts):
        shares.append(postings.count())
        return with_blocks(postings, mean, counts)

    with_blocks = store.with_blocks
    monkeypatch.setattr(store, "TASK_ROWS", 50)
    monkeypatch.setattr(store, "with_blocks", placed)
    docs = [(f"d{i}", " ".join(f"t{i}x{j}" for j in range(20))) for i in range(200)]
    path = scratch_dir(spark, "store")
    index = store.save_index(spark.createDataFrame(docs, "doc_id string, content string"), path, folders=3)
    assert sum(shares) == 4000 and max(shares) < 4000 / 8
    assert state(index) == rebuilt(spark, docs)
    assert {r.folder for r in index.lexical.postings[0].select("folder").distinct().collect()} == {0, 1, 2}


def test_a_build_places_each_row_once(spark, monkeypatch):
    """F1-F20: ranges were found by a pass of their own over all that is placed."""
    plans, write = [], store.write_parquet

    def noted(df, path, *args, **more):
        plans.append((path, df._jdf.queryExecution().executedPlan().toString()))
        write(df, path, *args, **more)

    monkeypatch.setattr(store, "write_parquet", noted)
    monkeypatch.setattr(store, "TASK_ROWS", 500)
    docs = [(f"d{i}", " ".join(["all", f"w{i % 7}", *(f"t{i}x{j}" for j in range(18))])) for i in range(200)]
    path = scratch_dir(spark, "store")
    index = store.save_index(spark.createDataFrame(docs, "doc_id string, content string"), path, folders=3)
    assert {p.rpartition("/")[2] for p, _ in plans} == {"docs", "postings", "blocks", "terms"}
    assert not [p for p, plan in plans if "rangepartitioning" in plan]
    assert state(index) == rebuilt(spark, docs)
    for table in (index.corpus, index.lexical.postings[0], index.lexical.blocks[0]):
        key = "doc_id" if "content" in table.columns else "term"
        assert table.filter(F.col("folder") != folder_of(key, 3)).count() == 0
        files = table.groupBy(F.input_file_name().alias("file")).agg(F.count_distinct("folder").alias("n")).collect()
        assert all(r.n == 1 for r in files)
