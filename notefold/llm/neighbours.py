"""The k most similar vectors of every vector, by an inverted multi-index.

Fit: the vectors are scaled to length 1 and cut into two halves, and each half is quantised by a
codebook of its own, fitted by k-means on a bounded sample (at most ``SAMPLE`` vectors, chosen by
hash, so the same ones every time). A pair of centroids is a cell. Every vector is indexed. A half has
``CENTROIDS`` centroids, and from some 260 million vectors on as many more as keep about
``CELL`` vectors in a cell, up to ``MOST_CENTROIDS``.

Routing: occupied cells are grouped into blocks of about ``BLOCK`` vectors (by k-means in two levels
where there are many). For each block the centroid pairs are traversed in the order of their summed
distance from the block's centre, with a heap over the two sorted distance lists, until the cells
passed hold ``CANDIDATES`` vectors; the executors do that. A vector goes to its own block as a query
and to the blocks that reached its cell as an entry, so it is sent a bounded number of times on
average (``CANDIDATES`` / ``BLOCK``), and a block compares about ``BLOCK`` x ``CANDIDATES`` vectors,
at every size of the input. What each block will hold is known, so blocks are dealt to tasks by
size (each row names its task) and a task holds one block at a time. Reranking is exact: cosines of
the full vectors, in matrix products.

What the driver holds follows the cells: their counts, their blocks, and the pairs that the
traversals passed, as arrays; at most ``MOST_CENTROIDS`` squared cells.

``exact`` compares every vector with every other, by the same plan with traversals that don't end
before the last cell: for small collections, and to measure recall.

Copies: equal vectors are one row with a list of their positions before anything is shuffled (in
each Arrow batch) and one class in the block; a class of any size is then as dear as one vector. Of a
class with more than k + 1 positions in a batch only the least k + 1 are sent: the others' neighbours
are the least k positions of the class, which a join gives them; no task holds all positions of a class.

Defined results: a vector is usable if it has as many finite numbers as ``dims``, not all zero;
others have no row and are nobody's neighbour; a position counts once however often it is stored
(of different vectors for one position each is compared, and the best cosine counts); equal
cosines go to the smaller position; a single usable vector or an empty table yields no rows.

Measured recall against brute force is in the README; the test holds it to 0.9.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.storage import write_table

DIMS = 64
CENTROIDS, MOST_CENTROIDS, CELL = 512, 2_048, 1_000
SAMPLE = 40_000
ROUNDS = 8
BLOCK = 3_000
ENTRIES_A_TASK = 4 * 12_000
MOST_PARTITIONS = 20_000
HOT_BLOCKS = 4  # a block with more queries than this many blocks should have is split
MOST_PRODUCTS = 16_000_000  # of one matrix product
FEW_BLOCKS = 512  # up to here blocks are found in one level, and the driver traverses the cells for them itself
CANDIDATES = 12_000

FOUND = "vec LONG, other LONG, cosine DOUBLE"


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column scaled to length 1, and which rows they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = np.array(pc.equal(pc.fill_null(pc.list_value_length(column), -1), dims))
    rows = np.flatnonzero(right)
    values = column.take(pa.array(rows)).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(all="ignore"):
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x, rows = x[ok], rows[ok]
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x.astype(np.float32), rows


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.zeros(0, dtype=np.int64)] + [(x[i : i + 8192] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 8192)])


def kmeans(x: np.ndarray, k: int, rounds: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows, the same for the same input; empty centres stay."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    w = np.ones(len(x), dtype=np.float32) if weights is None else weights.astype(np.float32)
    for _ in range(rounds):
        a = nearest(x, centres)
        order = np.argsort(a, kind="stable")
        some, first = np.unique(a[order], return_index=True)
        sums = np.add.reduceat((x * w[:, None])[order], first, axis=0)
        centres[some] = sums / np.add.reduceat(w[order], first)[:, None]
    return centres


def traverse(d1: np.ndarray, d2: np.ndarray, occupied: dict[int, int] | np.ndarray, enough: float) -> list[int]:
    """Cells (i * len(d2) + j) in ascending d1[i] + d2[j] until they hold ``enough`` vectors.

    The multi-sequence walk: a heap holds the pairs of places in the two sorted lists whose
    predecessors have been passed.
    """
    vectors_in = (lambda c: occupied.get(c, 0)) if isinstance(occupied, dict) else occupied.item
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    n1, n2 = len(s1), len(s2)
    passed = [0] * n1  # in each row the places passed are a prefix
    heap = [(s1[0] + s2[0], 0, 0)]
    cells, held = [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        passed[i] = j + 1
        cell = o1[i] * n2 + o2[j]
        if n := vectors_in(cell):
            cells.append(cell)
            held += n
        if j + 1 < n2 and (i == 0 or passed[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < n1 and passed[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return cells


class MultiIndex:
    """The two codebooks; later the cells' blocks as well. Its size is bounded by its parameters."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def blocks(self, cells: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Occupied cells in blocks of about ``block`` vectors: (the blocks' centres, each cell's own block)."""
        k2 = len(self.second)
        centres = np.concatenate([self.first[cells // k2], self.second[cells % k2]], axis=1)
        n = max(1, -(-int(counts.sum()) // block))
        if n <= FEW_BLOCKS:
            middle = kmeans(centres, n, 6, counts)
            return middle, nearest(centres, middle)
        # In two levels: each cell is compared with the groups' centres and those of its own group only.
        rough = nearest(centres, kmeans(centres, int(np.sqrt(n)), 6, counts))
        middles, own, so_far = [], np.zeros(len(cells), dtype=np.int64), 0
        for g in np.unique(rough):
            here = np.flatnonzero(rough == g)
            m = kmeans(centres[here], max(1, -(-int(counts[here].sum()) // block)), 6, counts[here])
            own[here] = so_far + nearest(centres[here], m)
            middles.append(m)
            so_far += len(m)
        return np.concatenate(middles), own

    def reached(self, middle: np.ndarray, occupied: dict[int, int] | np.ndarray, candidates: float) -> list[int]:
        """The cells that a block's traversal passes."""
        h = self.first.shape[1]
        d1 = ((self.first - middle[:h]) ** 2).sum(axis=1)
        d2 = ((self.second - middle[h:]) ** 2).sum(axis=1)
        return traverse(d1, d2, occupied, candidates)


class Routes:
    """Where a cell's vectors go. Its size is bounded by the cells and what the traversals passed."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, own: np.ndarray, blocks: np.ndarray, reached: np.ndarray, n_cells: int, block: int, least_tasks: int):
        """``blocks`` and ``reached`` are the pairs that the traversals passed: block and cell."""
        self.place = np.full(n_cells, -1, dtype=np.int32)
        self.place[cells] = np.arange(len(cells), dtype=np.int32)
        self.own = own
        at, to = np.concatenate([np.arange(len(cells)), self.place[reached]]), np.concatenate([own, blocks])
        n_blocks = int(to.max()) + 1
        once = np.unique(at * np.int64(n_blocks) + to)
        at, to = once // n_blocks, once % n_blocks
        # A block with many queries of its own is several parts: each has a part of the queries and all entries.
        homes = np.bincount(own, weights=counts, minlength=n_blocks)
        self.parts = np.maximum(1, np.ceil(homes / (HOT_BLOCKS * block))).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.parts)])
        entries = np.bincount(to, weights=counts[at], minlength=n_blocks)
        many = self.parts[to]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.targets = (np.repeat(self.start[to], many) + nth).astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(at, weights=many, minlength=len(cells)))]).astype(np.int64)
        # The largest parts first, each to the task that has least so far.
        weights = np.repeat(entries, self.parts)
        self.tasks = max(1, min(MOST_PARTITIONS, max(least_tasks, -(-int(weights.sum()) // ENTRIES_A_TASK)), len(weights)))
        self.task_of = np.zeros(len(weights), dtype=np.int32)
        load = [(0.0, t) for t in range(self.tasks)]
        for i in np.argsort(-weights, kind="stable").tolist():
            held, t = load[0]
            self.task_of[i] = t
            heapq.heapreplace(load, (held + float(weights[i]), t))

    def of(self, cell: int, vec: int) -> np.ndarray:
        """Parts for a vector: its own first, where it is a query, then those where it is an entry only."""
        i = self.place[cell]
        b = self.own[i]
        home = self.start[b] + (vec * 0x9E3779B1 >> 7) % self.parts[b]
        every = self.targets[self.ends[i] : self.ends[i + 1]]
        return np.concatenate([[home], every[every != home]])


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows: (a representative of each class, the class of each row)."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return first, of


def _distinct(ids: pa.Array, column: pa.Array, dims: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct usable vectors of a batch and the positions that have each, rising."""
    x, rows = unit_rows(column, dims)
    ids = np.asarray(ids.to_numpy(zero_copy_only=False))[rows]
    if not len(x):
        return x, []
    first, of = _classes(x)
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    once = np.ones(len(ids), dtype=bool)
    once[1:] = (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])
    ids, of = ids[once], of[once]
    return x[first], np.split(ids, np.flatnonzero(np.diff(of)) + 1)


def top_of_block(x: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query row of ``x`` its ``k`` nearest other rows: (rows, cosines), -1 where there are fewer."""
    n = len(x)
    k = min(k, n - 1)
    best, cos = np.full((len(queries), max(k, 0)), -1, dtype=np.int64), np.full((len(queries), max(k, 0)), -2.0, dtype=np.float32)
    if k < 1:
        return best, cos
    few = min(n, 1_500)
    step = max(16, min(1024, MOST_PRODUCTS // n))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        # A bound for the k-th best from a part of the columns; then only what reaches it is ranked.
        bound = np.partition(s[:, :few], few - k, axis=1)[:, few - k] if few > k else np.full(len(q), -2, dtype=np.float32)
        r, c = np.nonzero(s >= bound[:, None])
        v = s[r, c]
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        start = np.searchsorted(r, np.arange(len(q)))
        rank = np.arange(len(r)) - start[r]
        keep = rank < k
        best[i + r[keep], rank[keep]] = c[keep]
        cos[i + r[keep], rank[keep]] = v[keep]
    return best, cos


def _search(k: int, dims: int):
    schema = pa.schema([("vec", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group["unit"].to_pylist()), dtype=np.float32).reshape(-1, dims)
        first, of = _classes(raw)
        lists = group["vecs"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        ids = lists.flatten().to_numpy()
        cls = np.repeat(of, sizes)
        order = np.lexsort((ids, cls))
        ids, cls = ids[order], cls[order]
        once = np.ones(len(ids), dtype=bool)
        once[1:] = (ids[1:] != ids[:-1]) | (cls[1:] != cls[:-1])
        ids, cls = ids[once], cls[once]
        at = np.searchsorted(cls, np.arange(len(first) + 1))  # ids[at[c]:at[c + 1]] are the members of class c
        x = raw[first]
        home = np.zeros(len(first), dtype=bool)
        home[of[group["home"].to_numpy(zero_copy_only=False)]] = True
        queries = np.flatnonzero(home)
        # Smaller ids first among equal cosines: classes in the order of their least id.
        by_id = np.argsort(ids[at[:-1]], kind="stable")
        back = np.empty_like(by_id)
        back[by_id] = np.arange(len(by_id))
        best, cos = top_of_block(x[by_id], back[queries], k)
        best = np.where(best >= 0, by_id[best], -1)
        members = np.diff(at)
        plain = members[queries] == 1
        if best.shape[1]:
            plain &= ((best < 0) | (members[best] == 1)).all(axis=1)
        q, j = np.nonzero((best >= 0) & plain[:, None])
        out_vec, out_other, out_cos = [ids[at[queries[q]]]], [ids[at[best[q, j]]]], [cos[q, j].astype(np.float64)]
        for row in np.flatnonzero(~plain):  # a class or one of its neighbours has several members
            c = queries[row]
            own = ids[at[c] : at[c + 1]]
            near = [(-1.0, int(v)) for v in own[: k + 1]]
            near += [(-float(s), int(v)) for b, s in zip(best[row], cos[row]) if b >= 0 for v in ids[at[b] : at[b + 1]][: k + 1]]
            near.sort()
            head_v = np.array([v for _, v in near[: k + 1]])
            head_s = np.array([-s for s, _ in near[: k + 1]])
            for v in own.tolist():
                keep = np.flatnonzero(head_v != v)[:k]
                out_vec.append(np.full(len(keep), v))
                out_other.append(head_v[keep])
                out_cos.append(head_s[keep])
        cat = lambda a, t: pa.array(np.concatenate(a).astype(t))
        return pa.Table.from_arrays([cat(out_vec, np.int64), cat(out_other, np.int64), cat(out_cos, np.float64)], schema=schema)

    return run


def centroids_for(vectors: int, centroids: int = CENTROIDS) -> int:
    while centroids < MOST_CENTROIDS and centroids * centroids * CELL < vectors:
        centroids *= 2
    return centroids


def fit(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, centroids: int = CENTROIDS, sample: int = SAMPLE) -> MultiIndex | None:
    """The codebooks, fitted on the driver to at most ``sample`` vectors."""
    total = vectors.count()
    rows = vectors.where(F.size(vector_col) == dims).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    share = 0.9 * sample / max(1, total)  # by hash, so that the same rows are taken every time and nothing is sorted
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    taken = rows.limit(sample).toArrow().sort_by("id")
    x, _ = unit_rows(taken.column("v"), dims)
    if not len(x):
        return None
    h, centroids = dims // 2, centroids_for(total, centroids)
    return MultiIndex(kmeans(x[:, :h], centroids, ROUNDS), kmeans(x[:, h:], centroids, ROUNDS))


def _by_block(search):
    """``search`` for each block of a task's rows, which come in the order of their blocks; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            blocks = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and blocks[i] != current:
                    yield from search(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)
                    held = []
                current = blocks[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from search(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)

    return run


def neighbours(vectors: DataFrame, id_col: str = "vec", vector_col: str = "embedding", k: int = 10, dims: int = DIMS, centroids: int = CENTROIDS, sample: int = SAMPLE, block: int = BLOCK, candidates: float = CANDIDATES, exact: bool = False) -> DataFrame:
    """(vec, other, cosine): the ``k`` most similar vectors of other positions for every usable vector."""
    spark = vectors.sparkSession
    candidates = np.inf if exact else candidates
    index = fit(vectors, id_col, vector_col, dims, centroids, sample)
    if index is None:
        return spark.createDataFrame([], FOUND)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("embedding"))

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for b in batches:
            x, ids = _distinct(b.column(0), b.column(1), dims)
            for c, n in zip(*np.unique(index.cells(x), return_counts=True)):
                held[int(c)] = held.get(int(c), 0) + int(n)
            if any(len(v) > k + 1 for v in ids):
                held[-1] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["cell", "n"])

    # At most centroids squared rows, whatever the input.
    held = rows.mapInArrow(count_cells, "cell LONG, n LONG").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(held["cell"].to_numpy())
    cells, counts = held["cell"].to_numpy()[order], held["n"].to_numpy()[order]
    copies = len(cells) > 0 and cells[0] == -1  # some vector has many copies
    if copies:
        cells, counts = cells[1:], counts[1:]
    if not len(cells):
        return spark.createDataFrame([], FOUND)
    middle, own = index.blocks(cells, counts, block)
    n_cells = len(index.first) * len(index.second)
    occupied = np.zeros(n_cells, dtype=np.int64)
    occupied[cells] = counts
    if len(middle) <= FEW_BLOCKS:
        passed = [index.reached(m, occupied, candidates) for m in middle]
        blocks, reached = np.repeat(np.arange(len(middle)), [len(p) for p in passed]), np.concatenate([np.asarray(p, dtype=np.int64) for p in passed])
    else:
        shared = spark.sparkContext.broadcast((index, middle, cells, counts))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, middle, cells, counts = shared.value
            occupied = np.zeros(n_cells, dtype=np.int64)
            occupied[cells] = counts
            for batch in batches:
                some = batch.column(0).to_pylist()
                passed = [index.reached(middle[b], occupied, candidates) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, [len(p) for p in passed]), pa.int64()), pa.array([c for p in passed for c in p], pa.int64())], names=["block", "cell"])

        found = spark.range(0, len(middle), 1, -(-len(middle) // 64)).mapInArrow(reach, "block LONG, cell LONG").toArrow()
        blocks, reached = found["block"].to_numpy(), found["cell"].to_numpy()
    routing = Routes(cells, counts, own, blocks, reached, n_cells, block, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routes, tasks = spark.sparkContext.broadcast(routing), routing.tasks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = routes.value
        for b in batches:
            x, ids = _distinct(b.column(0), b.column(1), dims)
            if not len(x):
                continue
            to = [r.of(c, int(v[0])) for c, v in zip(index.cells(x), ids)]
            size = dims * 4
            raw = x.tobytes()
            units = [raw[i : i + size] for i in range(0, len(raw), size)]
            tasks = [r.task_of[t] for t in to]
            if copies:  # the rest of a large class goes its own way, to a block of no vectors
                large = [i for i, v in enumerate(ids) if len(v) > k + 1]
                units += [_key(units[i]) for i in large]
                to += [np.array([-1]) for _ in large]
                tasks += [np.array([int(ids[i][0]) % r.tasks]) for i in large]
                ids = [v[: k + 1] for v in ids] + [ids[i][k + 1 :] for i in large]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(to, pa.list_(pa.int32())), pa.array(tasks, pa.list_(pa.int32()))], names=["unit", "vecs", "blocks", "tasks"])

    sent = rows.mapInArrow(send, "unit BINARY, vecs ARRAY<LONG>, blocks ARRAY<INT>, tasks ARRAY<INT>")
    sent = sent.select("unit", "vecs", F.posexplode(F.arrays_zip("blocks", "tasks")).alias("nth", "to")).select("unit", "vecs", "to.blocks", "to.tasks", (F.col("nth") == 0).alias("home")).withColumnsRenamed({"blocks": "block", "tasks": "task"})
    laid = sent.repartitionById(tasks, "task").sortWithinPartitions("block").select("unit", "vecs", "block", "home")
    if not copies:
        return laid.mapInArrow(_by_block(_search(k, dims)), FOUND)
    out = write_table(laid.mapInArrow(_by_block(_with_classes(_search(k, dims), k, dims)), f"{FOUND}, key BINARY"), "neighbours")
    rest = out.where("other IS NULL").select("vec", "key")
    least = out.where("vec IS NULL").select("key", "other").distinct()
    least = least.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("other")), 1, k).alias("others"))  # a class has k + 1 of each batch that went to one part at most
    rest = rest.join(least, "key").select("vec", F.explode("others").alias("other"), F.lit(1.0).alias("cosine"))
    return out.where("vec IS NOT NULL AND other IS NOT NULL").select("vec", "other", "cosine").unionByName(rest)


def _key(unit: bytes) -> bytes:
    """A vector's name in 16 bytes."""
    return hashlib.blake2b(unit, digest_size=16).digest()


def _with_classes(search, k: int, dims: int):
    """As ``search``, with what large classes need: rows without ``other`` are positions that wait, rows without ``vec`` a class's least positions."""
    schema = pa.schema([("vec", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64()), ("key", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        if group["block"][0].as_py() < 0:
            lists = group["vecs"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            keys = group["unit"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            n = len(keys)
            return pa.table([lists.flatten(), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), keys], schema=schema)
        found = search(group)
        classes: dict[bytes, set[int]] = {}
        full = group.filter(pc.greater(pc.list_value_length(group["vecs"]), k))
        for unit, vecs in zip(full["unit"].to_pylist(), full["vecs"].to_pylist()):
            mine = classes.setdefault(unit, set())
            mine.update(vecs)
            if len(mine) > 4 * k:
                classes[unit] = set(sorted(mine)[:k])
        pairs = [(v, _key(u)) for u, vs in classes.items() for v in sorted(vs)[:k]]
        heads = pa.table([pa.nulls(len(pairs), pa.int64()), pa.array([v for v, _ in pairs], pa.int64()), pa.nulls(len(pairs), pa.float64()), pa.array([u for _, u in pairs], pa.binary())], schema=schema)
        return pa.concat_tables([found.append_column("key", pa.nulls(found.num_rows, pa.binary())).cast(schema), heads])

    return run


def ranked(found: DataFrame, k: int = 10) -> DataFrame:
    """With ``rank``; where a position is stored with several vectors, its best cosine to each other counts."""
    best = found.groupBy("vec", "other").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("vec").orderBy(F.desc("cosine"), F.asc("other"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """(vec_a, vec_b) with vec_a < vec_b: one among the nearest of the other, and of that cosine at least."""
    # Cosines are of 32-bit vectors; the least bit of slack keeps pairs that lie on the limit itself.
    near = found.where((F.col("cosine") >= least - 1e-6) & (F.col("vec") != F.col("other")))
    return near.select(F.least("vec", "other").alias("vec_a"), F.greatest("vec", "other").alias("vec_b")).distinct()
