"""The stored corpus with its lexical index, kept in step commit by commit.

A store is a folder of Parquet tables, written by one job at a time. A commit writes one segment: the
documents it adds, replaces or deletes, their postings, and signed changes of the term counts; a line
in the log makes it count. That line is a file that is there whole or not at all, and is never replaced, so a
commit that dies leaves nothing that counts and of two writers of one version the second is refused.
Readers take, for each id, its newest entry; ``newest`` lists those that are not in the first segment.
Folding all segments into one is ``compact``.

Documents lie in folders by a hash of their id, postings and term counts in folders by a hash of the
term, sorted by term, so few ids or few terms are read without the rest. The number of folders is a
parameter of the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager
from dataclasses import dataclass
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import lexical
from corpusmill.operators.bounded import BLOCK_POSTINGS, directory_by_counts, term_counts, with_blocks
from corpusmill.operators.lexical import LexicalIndex
from corpusmill.operators.vector_lists import VectorLists, read_codes, train_centroids, vector_codes, write_codes
from corpusmill.runtime import (BROADCAST_BYTES, BROADCAST_ROWS, configured, folder_of, in_pieces, is_small, lookup_join,
                                measure, near, scratch_dir, scratch_scope, stored, write_parquet)
from corpusmill.schema import CORPUS, STRING_MAP

# ``done`` of a base: the last batch of each job before it. ``lists``: vector lists wanted (0: by size), if any are kept.
LOG = ("segment string, kind string, batch string, done array<string>, last_seq long, folders int, lists int, "
       "version long")
DOCS = ("doc_id string, doc_key string, seq long, op string, content string, "
        "metadata map<string,string>, embedding array<float>, folder int")
POSTINGS = "doc_id string, term string, tf long, dl long, block int, folder int"
BLOCKS = "term string, block int, n long, tf long, dl long, weight double, mean double, folder int"
TERMS = "term string, df long, folder int"
HISTOGRAM = "df long, words long"
NEWEST = "doc_id string, version long"
FILES = "file_name string"
STATS = "n long, total_dl long, mean_idf double"
CENTROIDS = "list int, centre array<double>"
# Postings that a task sorts, about.
TASK_ROWS = 2_000_000
# Documents and postings are placed in at most so many turns, each of some folders (or a part of one, if folders are
# few), so only a part of them is in a shuffle.
TURNS = 12
# Bytes of documents, as written, that a turn places at least.
TURN_BYTES = 32 << 20
# Of the tables that grow with the texts.
CODEC = "zstd"


@dataclass(frozen=True)
class Index:
    corpus: DataFrame       # doc_id, doc_key, content, metadata, embedding: live documents
    lexical: LexicalIndex
    folders: int | None = None  # of a stored corpus, which then has the column ``folder`` too
    lists: VectorLists | None = None  # for vector search by lists, if the store keeps them


def as_corpus(df: DataFrame) -> DataFrame:
    """Bring documents to the corpus shape: drop those without content, fill the rest.

    A document without an id is known by its key.
    """
    have = df.columns
    if "doc_id" not in have and "id" in have:
        df = df.withColumnRenamed("id", "doc_id")
    if "metadata" not in have:
        df = df.withColumn("metadata", F.lit(None).cast(STRING_MAP))
    if "embedding" not in have:
        df = df.withColumn("embedding", F.lit(None).cast("array<float>"))
    empty = F.create_map().cast(STRING_MAP)
    kept = df.filter(F.col("content").isNotNull()).withColumn("metadata", F.coalesce("metadata", empty))
    key = text.doc_key("metadata", "content")
    return kept.select(F.coalesce(F.col("doc_id").cast("string"), key).alias("doc_id"), key.alias("doc_key"), "content",
                       "metadata", F.col("embedding").cast("array<float>").alias("embedding"))


def in_memory_index(corpus: DataFrame) -> Index:
    """An index whose tables are plans over ``corpus``, nothing stored."""
    shaped = as_corpus(corpus)
    return Index(shaped, lexical.build_index(shaped))


# --- log and segment tables ---------------------------------------------------------------------


def _commits(spark: SparkSession, path: str) -> list:
    """The commits since the last base, in order: one small row each."""
    try:
        rows = spark.read.schema(LOG).json(f"{path}/log").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    rows.sort(key=lambda r: r["version"])
    bases = [i for i, r in enumerate(rows) if r["kind"] == "base"]
    return rows[bases[-1]:] if bases else rows


def _append_log(spark: SparkSession, path: str, version: int, segment: str, kind: str, batch: str | None,
                done: list[str], last_seq: int, folders: int, lists: int | None) -> None:
    """The commit itself: one small file that appears whole. A version that another writer has taken is refused."""
    row = json.dumps({"segment": segment, "kind": kind, "batch": batch, "done": done, "last_seq": last_seq,
                      "folders": folders, "lists": lists})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/log/version={version}")
    row_file = jvm.org.apache.hadoop.fs.Path(folder, "row.json")
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    files = folder.getFileSystem(conf)
    files.mkdirs(folder)
    out = files.create(draft, False)
    out.write(bytearray(row.encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # a rename would replace a local file that appears meanwhile
            local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (row_file, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
            context.rename(draft, row_file, spark.sparkContext._gateway.new_array(
                jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        raise FileExistsError(f"another writer has committed version {version} of {path}") from error
    finally:
        files.delete(draft, False)


def _done(commits: list) -> list[str]:
    """The last batch of every job: names are a job's and a number."""
    last: dict[str, str] = {}
    for name in (x for r in commits for x in [*(r["done"] or []), r["batch"]] if x):
        last[name.rpartition(" ")[0] or name] = name
    return list(last.values())


def _repeated(batch: str | None, commits: list) -> bool:
    """Whether a batch was committed: by its name, or by a later number of its job before the last base."""
    if batch is None:
        return False
    if batch in {r["batch"] for r in commits}:
        return True
    job, _, number = batch.rpartition(" ")
    for name in (x for r in commits for x in r["done"] or []):
        before, _, last = name.rpartition(" ")
        if name == batch or job and before == job and number.isdigit() and last.isdigit() and int(number) <= int(last):
            return True
    return False


def _table(spark: SparkSession, commits: list, name: str, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{r['segment']}/{name}") for r in commits])


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """Ledger of processed files: one row ``file_name`` per file of any commit."""
    return _ledger(spark, _commits(spark, path))


def _ledger(spark: SparkSession, commits: list) -> DataFrame:
    return _table(spark, commits, "files", FILES).distinct() if commits else spark.createDataFrame([], FILES)


def _cells(folders: int) -> int:
    """Folders, or equal parts of them if they are fewer than TURNS."""
    return folders * -(-TURNS // folders)


def _piece(key: str, folders: int) -> Column:
    """One of TURNS pieces. Fewer folders than that are split, else a piece holds whole folders."""
    return folder_of(key, _cells(folders)) % TURNS


def _write_by_folder(df: DataFrame, key: str, path: str, folders: int, order: list[str], rows: int = 0, turns: int = 1,
                     stretch: Column | None = None) -> None:
    """Folders by a hash of ``key``, files sorted; rows of one key may span files. Adds to what is there.

    ``df`` is one of ``turns`` turns, or all. ``rows`` is given where known, so a task sorts a bounded share. Rows of a
    key go to one task, or one for each ``stretch`` of it.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    cells, cell, held = _cells(folders), folder_of(key, _cells(folders)), -(-TURNS // turns)
    # the cells of a turn in a row; a task writes a part of one, so it has one folder
    place = F.floor(cell / TURNS) * held + F.floor(cell % TURNS / turns)
    least = -(-cells // TURNS) * held
    parts = -(-tasks // least)
    part = F.pmod(F.shiftright(F.xxhash64(key), 33) + (F.lit(0) if stretch is None else stretch), F.lit(parts))
    # the folder is told by the key, so it is not sent
    dealt = df.repartitionById(least * parts, (place * parts + part).cast("int")).withColumn("folder", folder_of(key, folders))
    write_parquet(dealt.sortWithinPartitions(*order), path, "folder", "append", codec=CODEC, pieces=1)


def _bounded_tasks(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within, a task reads or is dealt about TASK_ROWS of ``rows`` postings, however many there are."""
    tasks, shuffle, files = -(-rows // TASK_ROWS), "spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"
    least = int(spark.conf.get(files, None) or spark.sparkContext.defaultParallelism)
    return configured(spark, {shuffle: str(max(tasks, int(spark.conf.get(shuffle)))), files: str(max(tasks, least))})


# --- build and load -----------------------------------------------------------------------------


def save_index(corpus: DataFrame, path: str, seq: int = 0, folders: int | None = None,
               vector_lists: int | None = None) -> Index:
    """Write a corpus as the first segment of a store and open it.

    With ``vector_lists`` the store also keeps codes of the vectors in so many lists (0: by their number), in
    step with all commits, for searches that don't scan the vectors. Their centroids are trained again by ``compact``.

    ``folders`` is kept with the store; it should let a folder's documents be read by a few tasks, and
    defaults to the shuffle partitions. Of documents with one id one stays, as in a commit.
    """
    changes = as_corpus(corpus).withColumns({"seq": F.lit(seq).cast("long"), "op": F.lit("add")})
    spark = corpus.sparkSession
    commits = _commits(spark, path)
    return _write_base(spark, path, commits, changes.drop("doc_key"), None, _ledger(spark, commits), folders, seq,
                       vector_lists, lambda part: _as_entries(newest_change(part)))


def _write_base(spark: SparkSession, path: str, commits: list, docs: DataFrame, batch: str | None,
                files: DataFrame | None, folders: int | None, last_seq: int | None = None,
                lists: int | None = None, entries: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """``entries`` makes the stored form of ``docs``; all rows of one id are given to it together."""
    version = commits[-1]["version"] + 1 if commits else 0
    lists = commits[-1]["lists"] if commits and lists is None else lists
    if folders is None:
        folders = commits[-1]["folders"] if commits else int(spark.conf.get("spark.sql.shuffle.partitions"))
    segment = f"{path}/segment-{version:08d}-{uuid.uuid4().hex}"
    with scratch_scope(spark):
        landed = in_pieces(docs, _piece("doc_id", folders), TURNS, "entries")
        turns = max(1, min(TURNS, landed.size() // TURN_BYTES))
        parts = landed.turns(turns)
        added = _write_docs(spark, segment, map(entries, parts) if entries else parts, files, folders, turns)
    with scratch_scope(spark):
        _write_index(spark, segment, added, folders, lists)
    _append_log(spark, path, version, segment, "base", batch, _done(commits),
                _last_seq(spark, segment, commits, last_seq), folders, lists)
    return load_index(spark, path)


def _write_index(spark: SparkSession, segment: str, added: DataFrame, folders: int, lists: int | None) -> None:
    """Vectors, postings, terms and statistics of a base."""
    if lists is not None:
        _write_vectors(spark, segment, added, folders, lists, None)
    counts = _write_postings(spark, segment, added, folders)
    _write_terms(counts.select("term", F.col("n").alias("df")), segment, folders)
    terms = spark.read.schema(TERMS).parquet(f"{segment}/terms")
    lexical.df_histogram(terms).write.parquet(f"{segment}/histogram")
    spark.createDataFrame([], NEWEST).write.parquet(f"{segment}/newest")
    # Every token is counted in exactly one posting, so the tf add up to the total length.
    totals = added.agg(F.count(F.lit(1)).alias("n")).withColumn(
        "total_dl", counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).scalar())
    histogram = spark.read.schema(HISTOGRAM).parquet(f"{segment}/histogram")
    lexical.with_mean_idf(totals, histogram).coalesce(1).write.parquet(f"{segment}/stats")


def _write_docs(spark: SparkSession, segment: str, entries: Iterable[DataFrame], files: DataFrame | None,
                folders: int, turns: int = 1) -> DataFrame:
    """Write a segment's entries, which come in turns, and file names; returns the added documents as stored."""
    columns = [c.split()[0] for c in DOCS.split(", ") if not c.startswith("folder")]
    for part in entries:
        _write_by_folder(part.select(*columns), "doc_id", f"{segment}/docs", folders, ["doc_id"], turns=turns)
    ledger = spark.createDataFrame([], FILES) if files is None else files.select("file_name")
    ledger.write.parquet(f"{segment}/files")
    return spark.read.schema(DOCS).parquet(f"{segment}/docs").filter("op = 'add'")


def _write_vectors(spark: SparkSession, segment: str, docs: DataFrame, folders: int, lists: int,
                   centroids: np.ndarray | None) -> None:
    """Codes of a segment's vectors around given centroids, or around its own if there are none yet."""
    own = centroids is None or not len(centroids)
    centres = train_centroids(docs, lists or None) if own else centroids
    rows = [(i, c.tolist()) for i, c in enumerate(centres)] if own else []
    spark.createDataFrame(rows, CENTROIDS).write.parquet(f"{segment}/centroids")
    write_codes(vector_codes(docs, centres), f"{segment}/codes", folders)


def _centroids(spark: SparkSession, commits: list) -> np.ndarray:
    """Centroids of the store: those of the first segment that had vectors."""
    rows = _table(spark, commits, "centroids", CENTROIDS).orderBy("list").collect()
    return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))


def _write_terms(terms: DataFrame, segment: str, folders: int) -> None:
    """One row per term, so a hash of the term deals them evenly."""
    parted = terms.withColumn("folder", folder_of("term", folders))
    write_parquet(parted.repartition("folder").sortWithinPartitions("folder", "term"), f"{segment}/terms", "folder",
                  codec=CODEC)


def _write_postings(spark: SparkSession, segment: str, docs: DataFrame, folders: int) -> DataFrame:
    """Write a segment's postings in blocks, and their directory; returns the counts per term (term, n, tf).

    If they are many, the postings of some folders at a time are counted, placed and sent, and deleted where they were
    first written. A task gets a bounded share of them, however many there are.
    """
    raw = in_pieces(lexical.count_terms(docs), _piece("term", folders), TURNS, "postings", file_rows=TASK_ROWS)
    whole = raw.table.agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).first()
    rows, counts = whole["n"], []
    turns = max(1, min(TURNS, rows // TASK_ROWS))
    mean = (whole["tf"] or 0) / max(docs.count(), 1) or 1.0
    with _bounded_tasks(spark, min(rows, 2 * rows // turns)):  # turns differ
        for part in raw.turns(turns):
            counts.append(stored(term_counts(part, mean), "term-counts"))
            placed = with_blocks(part, mean, counts[-1])
            stretch = F.floor(F.col("block") / max(1, TASK_ROWS // 4 // BLOCK_POSTINGS))
            _write_by_folder(placed, "term", f"{segment}/postings", folders, ["term", "block", "doc_id"], rows // turns,
                             turns, stretch)
            # a term's postings are all in one turn
            _write_by_folder(directory_by_counts(placed, mean, counts[-1]), "term", f"{segment}/blocks", folders,
                             ["term", "block"], turns=turns, stretch=stretch)
    return reduce(DataFrame.unionByName, counts)


def _last_seq(spark: SparkSession, segment: str, commits: list, own: int | None = None) -> int:
    if own is None:
        own = spark.read.schema(DOCS).parquet(f"{segment}/docs").agg(F.max("seq").alias("s")).first()["s"]
    return max(commits[-1]["last_seq"] if commits else -1, -1 if own is None else own)


def _entries(spark: SparkSession, commits: list) -> DataFrame:
    """All stored document entries of the given commits with their version."""
    return reduce(DataFrame.unionByName, [
        _table(spark, [r], "docs", DOCS).withColumn("version", F.lit(r["version"])) for r in commits])


def segments(spark: SparkSession, path: str) -> int:
    """Number of segments that make up the store."""
    return len(_commits(spark, path))


def load_index(spark: SparkSession, path: str) -> Index:
    """Open a store: live documents and their lexical index."""
    commits = _commits(spark, path)
    if not commits:
        raise FileNotFoundError(f"no committed index at {path}")
    return _open(spark, commits)


def _open(spark: SparkSession, commits: list) -> Index:
    base, *later = commits
    columns = ["doc_id", "doc_key", "content", "metadata", "embedding", "folder"]
    corpus = _entries(spark, [base]).filter("op = 'add'").select(*columns)
    postings = [_table(spark, [base], "postings", POSTINGS)]
    kept = base["lists"] is not None
    codes = [read_codes(spark, f"{r['segment']}/codes") for r in commits] if kept else []
    if later:
        newest = _table(spark, commits[-1:], "newest", NEWEST)
        small = is_small(newest)
        changed = newest.select("doc_id")
        corpus = lookup_join(corpus, changed, ["doc_id"], "left_anti", small=small)
        postings = [lookup_join(postings[0], changed, ["doc_id"], "left_anti", small=small)]
        live = lookup_join(_entries(spark, later).filter("op = 'add'"), newest, ["doc_id", "version"], "left_semi",
                           small=small)
        corpus = corpus.unionByName(live.select(*columns))
        codes = [lookup_join(part, changed, ["doc_id"], "left_anti", small=small) for part in codes[:1]] + codes[1:]
        for i, r in enumerate(later, 1):
            own = newest.filter(F.col("version") == r["version"]).select("doc_id")
            if codes:
                codes[i] = lookup_join(codes[i], own, ["doc_id"], "left_semi", small=small)
            postings.append(lookup_join(_table(spark, [r], "postings", POSTINGS), own, ["doc_id"], "left_semi",
                                        small=small))
    terms = _table(spark, commits, "terms", TERMS)
    stats = _table(spark, commits[-1:], "stats", STATS)
    folders = base["folders"]
    lists = VectorLists(_centroids(spark, commits), reduce(DataFrame.unionByName, codes),
                        corpus.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding"),
                        folders) if kept else None
    # a directory also counts documents that were replaced later: its bounds hold for the rest
    blocks = tuple(_table(spark, [r], "blocks", BLOCKS) for r in commits)
    return Index(corpus, LexicalIndex(corpus.select("doc_id"), tuple(postings), terms, stats, folders, blocks), folders,
                 lists)


def scan_corpus(index: Index) -> DataFrame:
    """Text and metadata of every live document."""
    return index.corpus.select("doc_id", "content", "metadata")


def stored_index(corpus: DataFrame, vector_lists: int | None = None) -> Index:
    """Store a corpus in the shared scratch folder and open it: each text is read and tokenised once."""
    return save_index(corpus, scratch_dir(corpus.sparkSession, "index"), vector_lists=vector_lists)


# --- commits ------------------------------------------------------------------------------------


def newest_change(changes: DataFrame) -> DataFrame:
    """Last change per id; partial maxima combine before the shuffle, so a hot id is no problem.

    Changes with equal ``seq`` go by the column ``place`` if there is one (the later place wins), then
    by a hash of what they hold, so the choice is the same on every run.
    """
    fields = [f for f in ("op", "content", "metadata", "embedding") if f in changes.columns]
    held = [F.to_json(F.struct(f)) if f == "metadata" else F.col(f).cast("string") for f in fields]
    order = F.struct("seq", *[c for c in ("place",) if c in changes.columns], F.xxhash64(*held))
    latest = changes.groupBy("doc_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*fields), order).alias("c"))
    return latest.select("doc_id", "seq", "c.*")


def commit_changes(spark: SparkSession, path: str, changes: DataFrame, batch: str | None = None,
                   files: DataFrame | None = None, seq: int | None = None) -> Index:
    """Apply add/delete changes (seq, op, doc_id, content, metadata, embedding) as one commit.

    A change older than what is stored for its id is ignored, also an add after a later delete.
    Changes without ``seq`` get ``seq``, or the next one after all stored. A batch name that was
    committed before is skipped, so a replay changes nothing. ``files`` joins the ledger with it.

    Of what is stored, the folders of the changed ids are read, and the term counts in the folders of
    the terms that come or go. Those that go come from the replaced texts; postings are not read.
    """
    commits = _commits(spark, path)
    if _repeated(batch, commits):
        return load_index(spark, path)
    if "seq" not in changes.columns:
        following = commits[-1]["last_seq"] + 1 if commits else 0
        changes = changes.withColumn("seq", F.lit(following if seq is None else seq).cast("long"))
    for name in ("content", "metadata", "embedding"):
        if name not in changes.columns:
            changes = changes.withColumn(name, F.lit(None).cast(CORPUS[name].dataType))
    wanted = stored(newest_change(changes), "changes")
    if not commits:
        return _write_base(spark, path, commits, _as_entries(wanted), batch, files, None)

    rows, size = measure(wanted)
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    folders, version = commits[-1]["folders"], commits[-1]["version"] + 1
    segment = f"{path}/segment-{version:08d}-{uuid.uuid4().hex}"
    ids = wanted.select("doc_id")
    stored_entries = near(_entries(spark, commits).select("doc_id", "seq", "folder"), "doc_id", ids, folders)
    known = lookup_join(stored_entries, ids, ["doc_id"], "left_semi", small=small).groupBy("doc_id").agg(
        F.max("seq").alias("known_seq"))
    fresh = wanted.join(known, "doc_id", "left").filter(F.col("seq") > F.coalesce("known_seq", F.lit(-1)))
    lists = commits[-1]["lists"]
    added = _write_docs(spark, segment, [_as_entries(fresh.drop("known_seq"))], files, folders)
    if lists is not None:
        _write_vectors(spark, segment, added, folders, lists, _centroids(spark, commits))
    touched = spark.read.schema(DOCS).parquet(f"{segment}/docs").select("doc_id")
    older = lookup_join(_table(spark, commits[-1:], "newest", NEWEST), touched, ["doc_id"], "left_anti", small=small)
    older.unionByName(touched.withColumn("version", F.lit(version).cast("long"))).write.parquet(f"{segment}/newest")

    before = _open(spark, commits)
    replaced = stored(lookup_join(near(before.corpus, "doc_id", touched, folders), touched, ["doc_id"], "left_semi",
                                  small=small).select("doc_id", "content", "metadata"), "replaced")
    gone = lexical.count_terms(replaced)
    counts = _write_postings(spark, segment, added, folders)
    signed = stored(counts.select("term", F.col("n").alias("df"), "tf")
                    .unionByName(gone.groupBy("term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("tf")))
                    .groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "moved-terms")
    _write_terms(signed.filter("df <> 0").select("term", "df"), segment, folders)

    moved = signed.filter("df <> 0").select("term", F.col("df").alias("change"))
    old = lookup_join(near(before.lexical.terms, "term", moved, folders).drop("folder"), moved, ["term"], "inner"
                      ).groupBy("term", "change").agg(F.sum("df").alias("old"))
    both = moved.join(old.select("term", "old"), "term", "left").withColumn("old", F.coalesce("old", F.lit(0)))
    steps = both.select(F.explode(F.array(
        F.struct(F.col("old").alias("df"), F.lit(-1).alias("words")),
        F.struct((F.col("old") + F.col("change")).alias("df"), F.lit(1).alias("words")))).alias("s")).select("s.*")
    steps.filter("df > 0").groupBy("df").agg(F.sum("words").alias("words")).write.parquet(f"{segment}/histogram")

    old_totals = before.lexical.totals
    totals = added.agg(F.count(F.lit(1)).alias("added")).select(
        (F.lit(old_totals["n"]) + F.col("added") - replaced.agg(F.count(F.lit(1)).alias("c")).scalar()).alias("n"))
    length = signed.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).scalar()
    totals = totals.withColumn("total_dl", F.lit(old_totals["total_dl"]) + length)
    histogram = _table(spark, commits, "histogram", HISTOGRAM).unionByName(
        spark.read.schema(HISTOGRAM).parquet(f"{segment}/histogram"))
    merged = histogram.groupBy("df").agg(F.sum("words").alias("words"))
    lexical.with_mean_idf(totals, merged).coalesce(1).write.parquet(f"{segment}/stats")
    _append_log(spark, path, version, segment, "delta", batch, [], _last_seq(spark, segment, commits), folders, lists)
    return load_index(spark, path)


def _as_entries(changes: DataFrame) -> DataFrame:
    """Stored form of changes: an add without content is dropped, a delete keeps only its id and seq."""
    add = F.col("op") == "add"
    empty = F.create_map().cast(STRING_MAP)
    metadata = F.when(add, F.coalesce("metadata", empty))
    kept = changes.filter(~add | F.col("content").isNotNull()).withColumn("metadata", metadata)
    return kept.select("doc_id", F.when(add, text.doc_key("metadata", "content")).alias("doc_key"), "seq", "op",
                       F.when(add, F.col("content")).alias("content"), "metadata",
                       F.when(add, F.col("embedding")).alias("embedding"))


def compact(spark: SparkSession, path: str, folders: int | None = None) -> Index:
    """Fold all commits into a new first segment; deletions stay as entries without content."""
    commits = _commits(spark, path)
    entries = _entries(spark, commits).drop("folder")
    newest = entries.groupBy("doc_id").agg(F.max("version").alias("version"))
    live = entries.join(newest, ["doc_id", "version"], "left_semi").drop("version")
    return _write_base(spark, path, commits, live, None, _ledger(spark, commits), folders)
