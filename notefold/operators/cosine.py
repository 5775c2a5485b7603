"""Exact nearest passages by meaning: top-k for each wording, best passage of each note.

Questions go to the executors in blocks of at most ``BLOCK``, so what is broadcast has a fixed
size however many there are. Each Arrow batch of passages is one matrix product in double
precision; a task keeps what can still be among a question's first k and hands it on when it has
seen all of its passages, so what is shuffled is k rows a question and task, whatever a task read.
A passage's vector is never shuffled. A window over those candidates ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.vectors import vector_ok
from notefold.storage import write_table

BLOCK = 2_048
DEFAULT_COUNT, MOST_COUNT = 8, 50


def clamp_count(count: int | None) -> int:
    return max(1, min(MOST_COUNT, DEFAULT_COUNT if count is None else count))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Usable vectors as rows of length 1, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best_of_task(block, k: int, dims: int, types: pa.Schema):
    def pruned(held: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
        """The first k of each question, those that tie with the k-th too, and the k-th scores."""
        asked, score = held["asked"].to_numpy(), held["score"].to_numpy()
        order = np.lexsort((-score, asked))
        start = np.searchsorted(asked[order], np.arange(n))
        end = np.append(start[1:], len(order))
        bar = np.full(n, -np.inf)
        full = end - start >= k
        bar[full] = score[order[start[full] + k - 1]] - 1e-8
        return held.filter(pa.array(score >= bar[asked])), bar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordings, q = block.value
        bar, held, many = np.full(len(q), -np.inf), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            s = np.clip(_matrix(b.column("vector"), dims) @ q.T, 0.0, 1.0)
            least = bar
            if len(s) > k:  # ties with the k-th go on, the window decides among them
                least = np.maximum(bar, np.partition(s, len(s) - k, axis=0)[len(s) - k] - 1e-8)
            rows, asked = np.nonzero(s >= least)
            at = pa.array(rows)
            new = pa.table({"asked": asked, "path": b.column("path").take(at), "n": b.column("n").take(at), "score": s[rows, asked]})
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows > max(2 * many, 4 * k * len(q), 10_000):
                held, bar = pruned(held, len(q))
                many = held.num_rows
        if held is not None:
            held, _ = pruned(held, len(q))
            out = pa.table([pa.array(wordings[held["asked"].to_numpy()]).cast(types.field("wording").type), held["path"], held["n"], held["score"]], schema=types)
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def _blocks(questions: DataFrame | list[tuple[int, list[float]]], dims: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], str]:
    """(wordings, unit vectors) of the questions that can be asked, in blocks; and the wordings' type."""
    if isinstance(questions, list):  # one call's
        good = [(w, v) for w, v in questions if len(v) == dims and np.isfinite(v).all() and np.any(v)]
        q = np.array([v for _, v in good], dtype=np.float64).reshape(-1, dims)
        return ([(np.array([w for w, _ in good], dtype=np.int64), q / np.sqrt((q * q).sum(axis=1, keepdims=True)))] if good else []), "int"
    asked = questions.where(vector_ok("vector", dims)).select("wording", "vector")
    n = -(-asked.count() // BLOCK)
    out = []
    for i in range(n):
        some = asked.where(F.pmod(F.xxhash64("wording"), F.lit(n)) == i) if n > 1 else asked
        some = some.toArrow()
        if some.num_rows:
            out.append((some["wording"].to_numpy(), _matrix(pc.cast(some["vector"].combine_chunks(), pa.list_(pa.float64())), dims)))
    return out, asked.schema["wording"].dataType.simpleString()


def top_k(vectors: DataFrame, questions: DataFrame | list[tuple[int, list[float]]], k: int, dims: int) -> DataFrame:
    """(wording, path, n, score, rank): the ``k`` most similar passages of each question.

    ``vectors`` holds (path, n, vector), ``questions`` (wording, vector), as a table or, of one
    call, as a list. Vectors of no use are left out on both sides. Ties go to the smaller path, then n.
    """
    spark = vectors.sparkSession
    rows = vectors.where(vector_ok("vector", dims)).select("path", "n", "vector")
    blocks, wording = _blocks(questions, dims)
    kind = {f: rows.schema[f].dataType.simpleString() for f in ("path", "n")}
    names = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    types = pa.schema([("wording", names[wording]), ("path", names[kind["path"]]), ("n", names[kind["n"]]), ("score", pa.float64())])
    schema = f"wording {wording}, path {kind['path']}, n {kind['n']}, score DOUBLE"
    scored = spark.createDataFrame([], schema)
    for i, block in enumerate(blocks):
        found = rows.mapInArrow(_best_of_task(spark.sparkContext.broadcast(block), k, dims, types), schema)
        scored = found if i == 0 else scored.unionByName(found)
    w = Window.partitionBy("wording").orderBy(F.desc(F.round("score", 9)), "path", "n")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def known(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """The hits whose passage the manifest (path, passages) lists."""
    m = manifest.select("path", F.col("passages").alias("_passages"))
    return hits.join(m, (hits["path"] == m["path"]) & (hits["n"] >= 0) & (hits["n"] < m["_passages"]), "left_semi")


def collapse(hits: DataFrame) -> DataFrame:
    """(path, n, score, more_passages): each note's best passage over all wordings, and how many others matched.

    Equal scores go to the earlier wording, then the smaller n.
    """
    best = F.max_by(F.struct("n", "score"), F.struct(F.round("score", 9), -F.col("wording"), -F.col("n")))
    return hits.groupBy("path").agg(best.alias("b"), (F.count_distinct("n") - 1).alias("more_passages")).select("path", "b.n", "b.score", "more_passages")


def best_notes(notes: DataFrame, count: int) -> DataFrame:
    w = Window.orderBy(F.desc(F.round("score", 9)), "path")
    return notes.orderBy(F.desc(F.round("score", 9)), "path").limit(count).withColumn("rank", F.row_number().over(w))


def held(df: DataFrame) -> DataFrame:
    """A result of bounded size (a call's wordings, hits or notes) computed once and kept as a local table."""
    return local_table(df.sparkSession, df.toArrow())


def local_table(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """A few rows that the driver holds, as a table that needs no job."""
    rows = rows.combine_chunks() if rows.num_rows else pa.Table.from_batches([pa.RecordBatch.from_pylist([], schema=rows.schema)])
    return spark.createDataFrame(rows)


def fetch_notes(vectors: DataFrame, questions: DataFrame | list[tuple[int, list[float]]], manifest: DataFrame, count: int, dims: int) -> DataFrame:
    """The ``count`` best notes. One long note may crowd the first fetch: then four times as much is fetched, once.

    For the wordings of one call: at most 1,600 hits for each are held.
    """
    k = max(8 * count, 50)
    for fetch in (k, 4 * k):
        hits = top_k(vectors, questions, fetch, dims).toArrow()
        full = pc.max(pc.value_counts(hits["wording"]).field("counts")).as_py() >= fetch if hits.num_rows else False
        notes = best_notes(collapse(known(local_table(vectors.sparkSession, hits), manifest)), count).toArrow()
        if not full or notes.num_rows >= count:
            break
    return local_table(vectors.sparkSession, notes)


def fetch_each(vectors: DataFrame, questions: DataFrame, manifest: DataFrame, count: int, dims: int) -> DataFrame:
    """As ``fetch_notes`` for many questions, each on its own: (wording, rank, path, n, score, more_passages).

    Which questions need the second fetch is decided by a join; only they are asked again.
    """
    k = max(8 * count, 50)
    hits = write_table(top_k(vectors, questions, 4 * k, dims), "hits")
    first = hits.where(F.col("rank") <= k)
    got = known(first, manifest).groupBy("wording").agg(F.count_distinct("path").alias("notes"))
    sizes = first.groupBy("wording").agg(F.count(F.lit(1)).alias("hits")).join(got, "wording", "left")
    more = sizes.where((F.col("hits") >= k) & (F.coalesce("notes", F.lit(0)) < count)).select("wording", F.lit(True).alias("more"))
    used = hits.join(more, "wording", "left").where((F.col("rank") <= k) | F.col("more")).drop("more")
    best = F.max_by(F.struct("n", "score"), F.struct(F.round("score", 9), -F.col("n")))
    notes = known(used, manifest).groupBy("wording", "path").agg(best.alias("b"), (F.count_distinct("n") - 1).alias("more_passages")).select("wording", "path", "b.n", "b.score", "more_passages")
    w = Window.partitionBy("wording").orderBy(F.desc(F.round("score", 9)), "path")
    return notes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
