"""Most similar vectors for every vector.

Method: permutation index, completed by an exact pass.  The index alone may lose neighbours, as a vector is posted in few
files and a query visits few; so it only gives every query a lower bound, the cosine of its k-th best partner there (or
``least``), and the exact pass finds all partners that reach the bound.  Whatever the index drops, nothing is lost.

Exact pass: the distinct vectors are packed into blocks of some ``block_rows``, written once, and every pair of blocks is
compared by matrix products, tile by tile.  Where a tile's bounds are high (``short_from``), a product over fewer dimensions,
those of most variance, rules most pairs out first: what is missing of a cosine is at most the product of the lengths of the
rests (Cauchy-Schwarz).  Both tests are passed with room for single precision, and what passes is computed anew in double.
Comparisons are as many as pairs (searched vectors times all), so this pass grows with the square of the collection.

The index.  A vector is represented by the order of its nearest pivots.  It is posted in the inverted
files of its ``posts`` nearest pivots together with that order; a query visits the files of its own ``visits`` nearest
pivots, ranks the postings there by the Spearman footrule distance of the orders (a pivot missing from an order counts
as placed behind it) and reranks the best ``shortlist`` by exact cosine.

Pivots are fitted on a bounded sample: ``16 sqrt(n)`` vectors, but no more than one in 8 (or pivots would be closer to
each other than the neighbours of a vector are), at least 16 and at most ``max_pivots``, taken by the smallest hashes of
their bytes, so the choice doesn't depend on row order.  Every vector is indexed.  The pivot matrix (at most 16,384
vectors, 4 MB at 64 numbers) and one number per pivot are all that is broadcast.

A file longer than ``file_rows`` isn't searched as a whole, or the work would grow with the square of the collection once
the pivots no longer do.  Its vectors are posted under pairs of such long files among their own (a vector with only one
under that file alone), so there are at most ``posts (posts - 1) / 2`` postings of a vector, whatever the size.  A pair's
postings are sorted by their orders of pivots and searched block by block, each query in its own block and the one
before and after it.  No file is capped, and the number of comparisons of a query is bounded.

A dense group of vectors has so many pivots that near ones share few files.  Pivots with a cosine of ``dense`` or more, and
chains of such pivots, therefore have one file together, in which a vector is posted once and all postings are reranked.
If that file is long, it is cut into blocks and every pair of blocks is a task of its own: around one direction distances
differ so little that only comparing finds the nearest.  In other files the shortlist is at least an eighth of the file.

The result doesn't depend on the order of rows: postings are sorted by order of pivots and class, and equal footrule
distances are ranked by that.

Equal vectors are one class; classes are searched, and copies come back through the membership table.  Cosines are
computed in double precision for all reported pairs; equal cosines are ordered by id.

Defined results: vectors that are null, of another length, all zero or not finite take no part; repeated rows of an id
count once; fewer than k others give fewer rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    """Parameters of the permutation index."""

    dim: int = 64
    k: int = 5
    posts: int = 4  #: inverted files in which a vector is posted
    visits: int = 4  #: inverted files that a query visits
    deep: int = 8  #: nearest files of a query of which it visits the pairs, if they are long
    order: int = 8  #: pivots in a permutation, as it is posted
    shortlist: int = 64  #: postings of a file that are reranked for one query, at least
    dense: float = 0.9  #: cosine from which pivots share a file
    least: float = -1.0  #: smallest cosine reported
    file_rows: int = 4096
    max_pivots: int = 16_384  #: at most 65,536: their numbers travel in two bytes
    block_rows: int = 16_384  #: vectors of a block of the exact pass
    short_from: float = 0.8  #: bound of cosines from which fewer dimensions are compared first

    def pivots(self, n: int) -> int:
        return int(min(self.max_pivots, max(16, min(16 * n**0.5, n / 8)), max(1, n)))


def usable(col: Column, dim: int) -> Column:
    """Only arrays of ``dim`` finite numbers, not all zero."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(col) == dim) & fine & F.exists(col, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


class _Orders:
    """Orders of pivots, prepared for footrule distances to all of them."""

    def __init__(self, orders: np.ndarray) -> None:
        self.known, flat = np.unique(orders, return_inverse=True)
        self.at = flat.reshape(orders.shape)

    def closeness(self, asked: np.ndarray) -> np.ndarray:
        """Footrule distances of all rows of ``asked`` and the orders, up to a factor and constant, as closeness.

        A pivot that both orders have, at places i and j, saves twice the lesser distance from the places behind the end.
        """
        m = asked.shape[1]
        place = np.searchsorted(self.known, asked)
        here = self.known[np.minimum(place, len(self.known) - 1)] == asked
        saved = np.zeros((len(asked), len(self.known)), np.int16)
        rows, ranks = np.nonzero(here)
        saved[rows, place[rows, ranks]] = m - ranks
        close = np.zeros((len(asked), len(self.at)), np.int32)
        for j in range(m):
            close += np.minimum(saved.take(self.at[:, j], axis=1), np.int16(m - j))
        return close


def block_rows(pivots: int) -> int:
    """Vectors that are compared with all pivots at once: some 4 million similarities, whatever the number of pivots."""
    return max(32, 4_000_000 // max(pivots, 1))


def shared_files(base: np.ndarray, dense: float) -> np.ndarray:
    """The file of every pivot: the smallest pivot that it is linked to by cosines of ``dense`` or more."""
    block = block_rows(len(base))
    linked = np.concatenate([np.count_nonzero(base[lo : lo + block] @ base.T >= dense, axis=1) > 1 for lo in range(0, len(base), block)])
    files = np.arange(len(base))
    free = linked.copy()
    for start in np.flatnonzero(linked):
        if not free[start]:
            continue
        free[start] = False
        front = np.array([start])
        while len(front):
            files[front] = start
            rest = np.flatnonzero(free)
            near = np.zeros(len(rest), bool)
            for lo in range(0, len(front), block):
                near |= (base[front[lo : lo + block]] @ base[rest].T >= dense).any(axis=0)
            front = rest[near]
            free[front] = False
    return files


def _first(files: np.ndarray) -> np.ndarray:
    """Which entries are the first of their file in their row."""
    fresh = np.ones(files.shape, bool)
    for r in range(1, files.shape[1]):
        fresh[:, r] = (files[:, :r] != files[:, r : r + 1]).all(axis=1)
    return fresh


def _pairs_of_long(files: np.ndarray, fresh: np.ndarray, long: np.ndarray, posts: int, visits: int) -> tuple[np.ndarray, ...]:
    """Rows, smaller file, larger file and kind (1: posted, 2: visited, 3: both) of the pairs of long files in ``files``.

    A row with a single long file has it paired with itself.
    """
    is_long = long[files] & fresh
    rows, low, high, kind = [], [], [], []
    for r in range(files.shape[1]):
        for q in range(r):
            k = (1 if r < posts else 0) + (2 if r < visits else 0)
            at = np.flatnonzero(is_long[:, r] & is_long[:, q]) if k else np.zeros(0, np.int64)
            rows.append(at)
            low.append(np.minimum(files[at, q], files[at, r]))
            high.append(np.maximum(files[at, q], files[at, r]))
            kind.append(np.full(len(at), k))
    for k, depth in ((1, posts), (2, visits)):
        one = np.flatnonzero(is_long[:, :depth].sum(axis=1) == 1)
        only = files[one, is_long[one, :depth].argmax(axis=1)]
        rows.append(one)
        low.append(only)
        high.append(only)
        kind.append(np.full(len(one), k))
    return tuple(np.concatenate(x).astype(np.int64) for x in (rows, low, high, kind))


def _post(how: Index, pivots, lengths):
    """Vectors (cls, query, embedding) to postings; ``lengths`` has the number of blocks of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (base, file_of), blocks = pivots.value, lengths.value
        merged = np.bincount(file_of, minlength=len(base)) > 1
        long = (blocks > 1) & ~merged
        order, posts, visits = (min(x, len(base)) for x in (how.order, how.posts, how.visits))
        widest = max(order, posts, visits)
        block = block_rows(len(base))
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                vectors = _matrix(part.column("embedding"), how.dim)
                near = _unit(vectors).astype(np.float32) @ base.T
                top = np.argpartition(-near, widest - 1, axis=1)[:, :widest]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
                cls, query = part.column("cls").to_numpy(), part.column("query").to_numpy(zero_copy_only=False)
                rows, files, kinds = [], [], []
                used = file_of[top[:, : max(posts, visits)]]
                fresh = _first(used)
                for r in range(used.shape[1]):
                    posted, visiting = r < posts, query & (r < visits)
                    take = np.flatnonzero((visiting | posted) & fresh[:, r] & ~long[used[:, r]])
                    rows.append(take)
                    files.append(used[take, r])
                    kinds.append(posted + 2 * visiting[take] + 4 * merged[used[take, r]])
                rows, files, kinds = np.concatenate(rows), np.concatenate(files), np.concatenate(kinds)
                # A row of block x of a file meets every block y: it goes to all cells (x, y) and (y, x).
                n = blocks[files]
                own = (cls[rows].view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
                times = np.repeat(np.arange(len(rows)), n)
                other = np.arange(len(times)) - np.repeat(np.cumsum(n) - n, n)
                own = own[times]
                cells = np.minimum(own, other) * 65_536 + np.maximum(own, other)
                rows, files, kinds = rows[times], files[times], kinds[times]
                subs = np.full(len(rows), -1)
                if long.any():
                    p_rows, low, high, p_kinds = _pairs_of_long(used, fresh, long, posts, min(visits, how.deep))
                    p_kinds = np.where(query[p_rows], p_kinds, p_kinds & 1)
                    some = np.flatnonzero(p_kinds)
                    rows, files, subs = np.concatenate([rows, p_rows[some]]), np.concatenate([files, low[some]]), np.concatenate([subs, high[some]])
                    kinds, none = np.concatenate([kinds, p_kinds[some]]), np.zeros(len(some), np.int64)
                    cells, own = np.concatenate([cells, none]), np.concatenate([own, none])
                sel = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(files.astype(np.int32)),
                        pa.array(subs.astype(np.int32)),
                        pa.array(cells),
                        part.column("cls").take(sel),
                        pa.array(kinds.astype(np.int8)),
                        pa.array(own.astype(np.int32)),
                        _fixed(top[rows, :order].astype(">u2"), 2 * order),
                        _fixed(vectors[rows], 4 * how.dim),
                    ],
                    ["file", "sub", "cell", "cls", "kind", "block", "pivots", "vector"],
                )

    return run


def _fixed(values: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


_POSTING = "file int, sub int, cell bigint, cls bigint, kind tinyint, block int, pivots binary, vector binary"


def _search_cell(how: Index, group: pa.Table, asking: slice = slice(None)) -> list[np.ndarray]:
    """One cell of one inverted file: for its queries (those in ``asking``) the best postings by footrule distance, reranked by cosine."""
    n = group.num_rows
    cls = group.column("cls").to_numpy()
    kind, block = group.column("kind").to_numpy(), group.column("block").to_numpy()
    pivots = np.frombuffer(b"".join(group.column("pivots").to_pylist()), ">u2").reshape(n, -1)
    unit = _unit(np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float32).reshape(n, how.dim))
    across = len(np.unique(block)) > 1
    mine = np.zeros(n, bool)
    mine[asking] = True
    asked, posted = np.flatnonzero((kind & 2 > 0) & mine), np.flatnonzero(kind & 1)
    found: list[np.ndarray] = []
    shortlist = max(how.shortlist, len(posted) // 8)
    step = max(16, min(256, 65_536 // shortlist))
    shorten = len(posted) > shortlist + 1 and len(asked) and not kind[0] & 4
    orders = _Orders(pivots[posted]) if shorten else None
    for lo in range(0, len(asked), step):
        q = asked[lo : lo + step]
        if shorten:
            close = orders.closeness(pivots[q]).astype(np.int64)
            close[cls[q][:, None] == cls[posted][None, :]] = -1
            if across:  # pairs of one block meet in that block's own cell
                close[block[q][:, None] == block[posted][None, :]] = -1
            # Equal distances rank by place, which is that of the order of pivots and the class.
            close = close * len(posted) - np.arange(len(posted))
            short = posted[np.argpartition(-close, shortlist - 1, axis=1)[:, :shortlist]]
            sims = np.einsum("qsd,qd->qs", unit[short], unit[q])
        else:
            short = np.broadcast_to(posted, (len(q), len(posted)))
            sims = unit[q] @ unit[posted].T
        wrong = cls[q][:, None] == cls[short]
        if across:
            wrong |= block[q][:, None] == block[short]
        # Digits beyond these depend on what is multiplied together.
        sims = np.where(wrong, -2.0, np.round(sims, 13))
        keep = min(how.k, sims.shape[1])
        if not keep:
            continue
        best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        score = np.take_along_axis(sims, best, 1)
        # Ties with the last place are kept, so that the order by id can decide.
        edge = score.min(axis=1, keepdims=True)
        qi, si = np.nonzero((sims >= edge) & (sims >= how.least) & (sims > -1.5))
        found.append(np.rec.fromarrays([cls[q][qi], cls[short[qi, si]], sims[qi, si]], names="q,c,s"))
    return found


class _Files:
    """Sorted postings, batch by batch, to the answers of each cell, or of each block of a pair of long files."""

    def __init__(self, how: Index) -> None:
        self.how, self.key = how, None
        self.held: list[pa.RecordBatch] = []
        self.rows = self.before = 0  # rows held, and how many of them were asked already

    def _answer(self, until: int) -> Iterator[np.ndarray]:
        yield from _search_cell(self.how, pa.Table.from_batches(self.held), slice(self.before, until))

    def close(self) -> Iterator[np.ndarray]:
        if self.held:
            yield from self._answer(self.rows)
        self.held, self.rows, self.before = [], 0, 0

    def add(self, key: tuple, part: pa.RecordBatch) -> Iterator[np.ndarray]:
        if key != self.key:
            yield from self.close()
            self.key = key
        size = self.how.file_rows
        for lo in range(0, part.num_rows, size) if key[1] >= 0 else [0]:
            piece = part.slice(lo, size) if key[1] >= 0 else part
            self.held.append(piece)
            self.rows += piece.num_rows
            while key[1] >= 0 and self.rows >= self.before + 2 * size:
                # A block is asked once the one behind it is there; the one before it is still held.
                yield from self._answer(self.before + size)
                table = pa.Table.from_batches(self.held).slice(self.before)
                self.held, self.rows, self.before = table.combine_chunks().to_batches(), table.num_rows, size


def _search(how: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("sim", pa.float64())])

        def told(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for f in found:
                yield pa.RecordBatch.from_arrays([pa.array(f.q), pa.array(f.c), pa.array(f.s)], schema=schema)

        files = _Files(how)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("file", "sub", "cell")], axis=1)
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield from told(files.add(tuple(keys[s].tolist()), batch.slice(s, e - s)))
        yield from told(files.close())

    return run


def neighbours(vectors: DataFrame, how: Index, cut) -> tuple[DataFrame, DataFrame]:
    """``vectors`` (id, embedding, and query: whether it is searched for) to members (cls, id, query) and the nearest
    classes of every searched class (q, c, sim): at least the k best of all that have ``least``."""
    spark = vectors.sparkSession
    valid = vectors.filter(usable(F.col("embedding"), how.dim)).select("id", F.coalesce("query", F.lit(False)).alias("query"), F.col("embedding").cast("array<float>").alias("embedding"))
    keyed = valid.withColumn("cls", F.xxhash64("embedding"))
    members = cut(keyed.groupBy("cls", "id").agg(F.max("query").alias("query")))
    classes = members.groupBy("cls").agg(F.max("query").alias("query"))
    n = classes.count()
    wanted = how.pivots(n)
    # The classes with the smallest hashes are a sample without regard to row order and to numbers of copies.
    least = classes.select("cls").orderBy("cls").limit(wanted).agg(F.max("cls")).first()[0]
    picked = keyed.filter(F.col("cls") <= F.lit(least)).dropDuplicates(["cls"]).orderBy("cls").select("embedding").toPandas()["embedding"] if n else []
    sample = list(picked)
    base = _unit(np.stack(sample).astype(np.float32)).astype(np.float32) if len(sample) else np.zeros((0, how.dim), np.float32)
    if not len(base):
        return members, spark.createDataFrame([], "q bigint, c bigint, sim double")
    pivots = spark.sparkContext.broadcast((base, shared_files(base, how.dense)))
    one = keyed.groupBy("cls").agg(F.max("query").alias("query"), F.first("embedding").alias("embedding"))
    sizes = one.select("cls", "query", "embedding").mapInArrow(_count_posts(how, pivots), "file int, n bigint").groupBy("file").agg(F.sum("n").alias("n"))
    blocks = np.ones(len(base), np.int64)
    for r in sizes.filter(F.col("n") > how.file_rows).collect():
        blocks[r["file"]] = -(-r["n"] // how.file_rows)
    postings = one.mapInArrow(_post(how, pivots, spark.sparkContext.broadcast(blocks)), _POSTING)
    placed = postings.repartition("file", "sub", "cell").sortWithinPartitions("file", "sub", "cell", "pivots", "cls")
    found = placed.mapInArrow(_search(how), "q bigint, c bigint, sim double").groupBy("q", "c").agg(F.max("sim").alias("sim"))
    return members, _all_pairs(keyed, found, n, _axes(base), how, cut)


#: Partitions of the blocks at most; every pair of partitions is a task.
_SIDES = 64
#: Rows and columns of a tile of cosines, which stays in the processor's cache.
_TILE = (512, 1024)
#: What single precision may be wrong by.
_ROOM = 1e-5
#: The bound of a vector that isn't searched for: no cosine reaches it.
_NEVER = 2.0


def _axes(base: np.ndarray) -> np.ndarray:
    """Orthonormal axes, those along which the sample varies most first."""
    wide = base.astype(np.float64)
    return np.linalg.eigh(wide.T @ wide)[1][:, ::-1]


def _all_pairs(keyed: DataFrame, found: DataFrame, n: int, axes: np.ndarray, how: Index, cut) -> DataFrame:
    """All pairs (q, c, sim) of a searched class and another one that are as similar as the k-th best of ``found`` of that
    class, if it has as many, and ``least`` at least; far more than the k best of a class may be left out."""
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    lows = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= how.k).groupBy("q").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == how.k)
    rows = keyed.select("cls", "query", "embedding", F.lit(None).cast("double").alias("low")).unionByName(
        lows.select(F.col("q").alias("cls"), F.lit(False).alias("query"), F.lit(None).cast("array<float>").alias("embedding"), "low")
    )
    parts = int(min(_SIDES, max(1, -(-n // how.block_rows))))
    one = rows.repartition(parts, "cls").groupBy("cls").agg(F.max("query").alias("query"), F.first("embedding", ignorenulls=True).alias("embedding"), F.max("low").alias("low"))
    # The index may have rounded the same cosine the other way.
    low = F.when(F.col("query"), F.greatest(F.lit(float(how.least)), F.coalesce(F.col("low") - 1e-12, F.lit(float(how.least))))).otherwise(F.lit(_NEVER))
    packed = cut(one.select("cls", low.alias("low"), "embedding", F.spark_partition_id().alias("part")).mapInArrow(_pack(how, parts), "block bigint, cls binary, low binary, vector binary"))
    a, b = (packed.select(*(F.col(c).alias(side + c) for c in packed.columns)) for side in "ab")
    # Every pair of blocks meets once, and each task has about half of its pairs.
    x, y = F.col("ablock"), F.col("bblock")
    met = a.hint("shuffle_replicate_nl").join(b, (x == y) | ((x != y) & ((x < y) == ((x + y) % 2 == 0))))
    return met.mapInArrow(_compare(how, axes), "q bigint, c bigint, sim double")


def _pack(how: Index, parts: int):
    """Vectors to blocks of a quarter more than ``block_rows`` at most, in each the lowest bounds first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = how.block_rows + how.block_rows // 4 + 1
        held: list[pa.RecordBatch] = []
        rows = made = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            low, cls = table.column("low").to_numpy(), table.column("cls").to_numpy()
            order = np.lexsort((cls, low))
            number = table.column("part")[0].as_py() + parts * made
            content = (cls[order].astype(np.int64), low[order].astype(np.float64), _matrix(table.column("embedding"), how.dim)[order])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in content)], ["block", "cls", "low", "vector"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - rows)
                held.append(piece)
                at, rows = at + piece.num_rows, rows + piece.num_rows
                if rows == most:
                    yield block(pa.Table.from_batches(held))
                    held, rows, made = [], 0, made + 1
        if rows:
            yield block(pa.Table.from_batches(held))

    return run


class _Block:
    """A block as it is compared: classes, bounds, vectors in double and single precision, and their short forms."""

    def __init__(self, number: int, cls: bytes, low: bytes, vector: bytes, how: Index, axes: np.ndarray) -> None:
        self.number, self.cls, self.low = number, np.frombuffer(cls, np.int64), np.frombuffer(low, np.float64).copy()
        self.unit = _unit(np.frombuffer(vector, np.float32).reshape(-1, how.dim))
        self.single = self.unit.astype(np.float32)
        # Most variance first; the length of the rest is one more number.
        head = self.unit @ axes[:, : max(1, 3 * how.dim // 8)]
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", head, head)))
        self.short = np.column_stack([head, rest]).astype(np.float32)


def _reached(a: np.ndarray, b: np.ndarray, low: np.ndarray | float, sims: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the products of ``a`` and ``b`` that reach ``low``; ``sims`` and ``flags`` are room to work in."""
    rows, columns = len(a), len(b)
    if sims.shape != (rows, columns):
        return np.nonzero(a @ b.T >= low)
    np.matmul(a, b.T, out=sims)
    np.greater_equal(sims, low, out=flags)
    # Few are: eight flags at a time are looked through first.
    eights = np.flatnonzero(flags.reshape(-1).view(np.uint64) != 0)
    at, bit = np.nonzero(flags.reshape(-1, 8)[eights])
    return np.divmod(eights[at] * 8 + bit, columns)


class _Best:
    """Pairs found for the rows of one block, cut back to the k best of a row, equal ones kept, whenever they are many."""

    def __init__(self, block: _Block, k: int) -> None:
        self.low, self.k = block.low, k
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows, self.after = 0, 200_000

    def add(self, q: np.ndarray, c: np.ndarray, sim: np.ndarray) -> None:
        enough = sim >= self.low[q]
        if enough.any():
            self.held.append((q[enough], c[enough], sim[enough]))
            self.rows += int(np.count_nonzero(enough))
            if self.rows > self.after:
                self.cut_back()
                self.after = max(self.after, 2 * self.rows)

    def cut_back(self) -> None:
        if not self.held:
            return
        q, c, sim = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((-sim, q))
        q, c, sim = q[order], c[order], sim[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        size = np.diff(np.append(first, len(q)))
        full = size >= self.k
        # The bounds rise: only what is as good as the k-th best is looked for from here on.
        self.low[q[first[full]]] = np.maximum(self.low[q[first[full]]], sim[first[full] + self.k - 1])
        keep = sim >= self.low[q]
        self.held, self.rows = [(q[keep], c[keep], sim[keep])], int(np.count_nonzero(keep))


def _compare_blocks(how: Index, a: _Block, b: _Block) -> Iterator[tuple[np.ndarray, ...]]:
    """(q, c, sim) of all pairs of the two blocks that reach the bound of q, but for those behind k better ones."""
    same = a.number == b.number
    for_a = _Best(a, how.k)
    for_b = for_a if same else _Best(b, how.k)
    sims, flags = np.empty(_TILE, np.float32), np.empty(_TILE, bool)
    for i in range(0, len(a.cls), _TILE[0]):
        rows = slice(i, i + _TILE[0])
        for j in range(0, len(b.cls), _TILE[1]):
            columns = slice(j, j + _TILE[1])
            # Of one block, what lies under the diagonal is left out.
            low = min(a.low[rows].min(), b.low[columns].min())
            if low > 1.5 or (same and j + _TILE[1] <= i):
                continue
            x = y = None
            if low >= how.short_from:
                x, y = _reached(a.short[rows], b.short[columns], np.float32(low - _ROOM), sims, flags)
            if x is None or len(x) > sims.size // 50:
                lows = np.minimum(a.low[rows][:, None], b.low[columns][None, :])
                x, y = _reached(a.single[rows], b.single[columns], (lows - _ROOM).astype(np.float32), sims, flags)
            if same:
                above = x + i < y + j
                x, y = x[above], y[above]
            for lo in range(0, len(x), 32_768):
                p, q = x[lo : lo + 32_768] + i, y[lo : lo + 32_768] + j
                # Digits beyond these depend on what is multiplied together.
                exact = np.round(np.einsum("ij,ij->i", a.unit[p], b.unit[q]), 13)
                for_a.add(p, b.cls[q], exact)
                for_b.add(q, a.cls[p], exact)
    for block, best in ((a, for_a),) if same else ((a, for_a), (b, for_b)):
        best.cut_back()
        for q, c, sim in best.held:
            yield block.cls[q], c, sim


def _compare(how: Index, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("sim", pa.float64())])
        kept = None
        for batch in batches:
            for r in range(batch.num_rows):
                sides = []
                for s in "ab":
                    number = batch.column(f"{s}block")[r].as_py()
                    if s == "b" and number == sides[0].number:
                        sides.append(sides[0])
                    elif s == "a" and kept is not None and kept.number == number:
                        sides.append(kept)
                    else:
                        sides.append(_Block(number, *(batch.column(s + c)[r].as_buffer() for c in ("cls", "low", "vector")), how, axes))
                kept = sides[0]
                for q, c, sim in _compare_blocks(how, *sides):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(sim)], schema=schema)

    return run


def _count_posts(how: Index, pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, file_of = pivots.value
        posts = min(how.posts, len(base))
        total = np.zeros(len(base), np.int64)
        block = block_rows(len(base))
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                unit = _unit(_matrix(batch.column("embedding").slice(lo, block), how.dim)).astype(np.float32)
                files = file_of[np.argpartition(-(unit @ base.T), posts - 1, axis=1)[:, :posts]]
                total += np.bincount(files[_first(files)], minlength=len(base))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["file", "n"])

    return run


def most_similar(vectors: DataFrame, how: Index, cut) -> DataFrame:
    """The k most similar other vectors of every searched one: id, rank, other, sim.

    Copies have cosine 1 and come by id like any tie; k + 1 members of a class are all that can be needed of it.
    """
    members, found = neighbours(vectors, how, cut)
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).filter(F.col("place") <= how.k + 1)
    best = found.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("sim")))).filter(F.col("r") <= how.k).select("q", "c", "sim")
    askers = members.filter("query").select(F.col("cls").alias("q"), F.col("id").alias("asker"))
    shared = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("cls").alias("q"), F.col("cls").alias("c"), F.lit(1.0).alias("sim"))
    others = best.unionByName(shared).join(first.select(F.col("cls").alias("c"), F.col("id").alias("other")), "c")
    # Per class, the k + 1 best others are enough: at most one of them is the asker itself.
    enough = others.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "other"))).filter(F.col("r") <= how.k + 1)
    per_asker = Window.partitionBy("asker").orderBy(F.desc("sim"), "other")
    return (
        enough.select("q", "other", "sim")
        .join(askers, "q")
        .filter("asker <> other")
        .withColumn("rank", F.row_number().over(per_asker))
        .filter((F.col("rank") <= how.k) & (F.col("sim") >= how.least))
        .select(F.col("asker").alias("id"), "rank", "other", "sim")
    )
