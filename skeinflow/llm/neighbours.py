"""Problem 2: for every chunk the k others of highest cosine similarity, by a block matrix join.

Vectors are brought to unit norm, rows with the same vector (to six decimals) are put together as one class, and the classes are dealt into blocks of at most a fixed
size, each within one cell around a centre. Each block is one task, which meets all blocks one after the other: int8 product tiles (exact integers, multiplied in float32, where sums stay below
2^24) give each similarity up to a bound known from the rows' own quantisation errors. A pair survives if its upper bound reaches the row's threshold,
which is the greater of ``least`` and the k-th best lower bound met so far; survivors are computed anew in float and kept in bounded heaps. As a task holds
the heaps of its rows over all blocks, k pairs a class leave it, however many blocks there are. Classes are expanded to ids at the end, of
which never more than k + 1 are needed.

No pair is left out that may count, so recall is 1 up to rounding. Vectors of similarity ``least`` are at most sqrt(2 - 2 ``least``) apart, and so are their
projections on any direction: of blocks in different cells, both sorted along the line between the centres, only the rows within that reach of each other are
multiplied, first in the few dimensions of most variance, where the product with that of the norms of the rest is an upper bound. Where ``least`` is 0.5 or
lower nothing of this is done, and in any case work grows with the square of the number of distinct vectors, in tiles that run at the speed of a matrix
product. ``least`` only lets a caller ask for no neighbours below it.

Cases: null, zero and non-finite vectors and those of another length take no part; a null id takes no part; ids delivered twice count once (of differing vectors one is
taken); ties among copies go to the smaller id; classes of any number of copies yield k neighbours a row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.session import cut, kept, small, written

K, DIM = 10, 64
#: Rows of a block, and of a tile within a pair of blocks; the same at every size.
BLOCK_ROWS, TILE_ROWS, TILE_COLUMNS = 16_384, 512, 2_048
#: Cells and the rows a cell below which there are fewer, the most cells, and the rows from which centres and dimensions are learned. These decide where
#: a row is kept and how soon a pair is ruled out, never whether it is found.
CELLS, CELL_ROWS, MOST_CELLS, LEARNED = 64, 2_048, 1_024, 65_536
#: Dimensions of the first product, rows of its tiles, and the share of a tile's pairs above which all dimensions are multiplied at once.
SIEVE, SIEVE_ROWS, MANY = 20, 256, 0.01
#: A bound of the error of a product of two unit vectors in float32, and of a projection.
ROUNDING = np.float32(2e-5)


def keyed(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, key, vector) of each row with a usable vector: its direction as float32, and a hash of it that is equal where directions are to six decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("embedding")
            at = np.flatnonzero(e.is_valid().to_numpy(zero_copy_only=False) & (np.nan_to_num(e.value_lengths().to_numpy(zero_copy_only=False).astype(float)) == dim) & b.column("id").is_valid().to_numpy(zero_copy_only=False))
            x = e.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)  # a null number reads as NaN
            at, x = at[fine], _unit(x[fine])
            steps = np.rint(x * 1e6).astype(np.int32)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in steps]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["id", "key", "vector"])

    return rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "id string, key binary, vector binary")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of float64, none of them zero, brought to norm 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 digits, the scale of the block, and a bound of the norm of each row's error."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-30) / 127
    digits = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - digits.astype(np.float64) * scale) ** 2).sum(axis=1))
    return digits, scale, (error + 1e-6).astype(np.float32)


class Heaps:
    """For each row the k best pairs met so far, as unordered arrays that are cut to k when full."""

    def __init__(self, rows: int, k: int, least: float):
        self.k, self.room = k, 4 * k
        self.value = np.full((rows, self.room), -9.0, dtype=np.float64)
        self.other = np.full((rows, self.room), -1, dtype=np.int64)
        self.fill = np.zeros(rows, dtype=np.int64)
        self.least = np.full(rows, least, dtype=np.float32)

    def push(self, row: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        """Pairs grouped by row."""
        keep = value >= self.least[row]
        row, other, value = row[keep], other[keep], value[keep]
        while len(row):
            first = np.r_[True, row[1:] != row[:-1]]
            start = np.flatnonzero(first)
            rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
            slot = self.fill[row] + rank
            now = slot < self.room
            self.value[row[now], slot[now]], self.other[row[now], slot[now]] = value[now], other[now]
            np.add.at(self.fill, row[now], 1)
            full = np.unique(row[now][slot[now] >= 2 * self.k])
            if len(full):
                self.shrink(full)
            row, other, value = row[~now], other[~now], value[~now]

    def shrink(self, rows: np.ndarray) -> None:
        best = np.argpartition(-self.value[rows], self.k - 1, axis=1)[:, : self.k]
        v, o = np.take_along_axis(self.value[rows], best, 1), np.take_along_axis(self.other[rows], best, 1)
        self.value[rows], self.other[rows] = -9.0, -1
        self.value[rows, : self.k], self.other[rows, : self.k] = v, o
        self.fill[rows] = np.minimum(self.fill[rows], self.k)
        full = self.fill[rows] == self.k
        self.least[rows[full]] = np.maximum(self.least[rows[full]], v[full].min(axis=1).astype(np.float32) - np.float32(1e-6))


def _survivors(dots: np.ndarray, need: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the products that may belong to the k best of their row; all in units of the product.

    A row with many of them first takes the k-th best lower bound of this tile as its threshold.
    """
    hot = np.flatnonzero(dots.max(axis=1) >= need)
    if not len(hot):
        return hot, hot
    part = dots[hot]
    fine = part >= need[hot][:, None]
    many = np.flatnonzero(fine.sum(axis=1) > 4 * k)
    if len(many):
        kth = np.partition(part[many], -k, axis=1)[:, -k]
        fine[many] &= part[many] >= (kth - 2 * slack[hot[many]])[:, None]
    i, j = np.nonzero(fine)
    return hot[i], j


def join_blocks(heaps: Heaps, a: np.ndarray, b: np.ndarray | None, k: int, first: int = 0) -> None:
    """The pairs of block a with block b (None: with itself, no row with its own) into the heaps of a's rows; the rows of b are numbered from ``first`` on."""
    own = b is None
    b = a if own else b
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    unit = np.float32(sa * sb)
    fa, fb = qa.astype(np.float32), qb.astype(np.float32)
    for y in range(0, len(b), TILE_COLUMNS):
        ty = np.ascontiguousarray(fb[y : y + TILE_COLUMNS].T)
        worst = float(eb[y : y + TILE_COLUMNS].max())
        for x in range(0, len(a), TILE_ROWS):
            dots = fa[x : x + TILE_ROWS] @ ty  # exact integers
            rows = slice(x, x + len(dots))
            slack = (ea[rows] + worst * (1 + ea[rows])) / unit
            i, j = _survivors(dots, heaps.least[rows] / unit - slack, slack, k + own)
            r, c = i + x, j + y
            if own:
                r, c = r[r != c], c[r != c]
            for s in range(0, len(r), 1 << 17):
                rr, cc = r[s : s + (1 << 17)], c[s : s + (1 << 17)]
                heaps.push(rr, cc + first, np.einsum("ij,ij->i", a[rr], b[cc], dtype=np.float64))


def _sieved(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The rows of x in the dimensions ``axes`` (orthonormal columns), and the norm of what is left of each: products of these are upper bounds of the rows' products."""
    low = x @ axes
    return np.column_stack([low, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", low, low)) + ROUNDING)])


def join_apart(heaps: Heaps, a: np.ndarray, b: np.ndarray, k: int, first: int, least: float, direction: np.ndarray, axes: np.ndarray) -> int:
    """As ``join_blocks``, for pairs of at least ``least`` only, with a lying ahead of b in ``direction`` (a unit vector, or zero); the number of products made.

    A row of b whose projection is further behind than the reach of ``least`` can't be a neighbour.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least) + ROUNDING)) + float(ROUNDING)
    ta, tb = a @ direction, b @ direction
    i, j = np.flatnonzero(ta <= tb.max() + reach), np.flatnonzero(tb >= ta.min() - reach)
    i, j = i[np.argsort(ta[i])], j[np.argsort(-tb[j])]
    if not len(i) or not len(j):
        return 0
    far = b[j]
    low, high = _sieved(a[i], axes), np.ascontiguousarray(_sieved(far, axes).T)
    ends = np.searchsorted(-tb[j], reach - ta[i[::SIEVE_ROWS]], "right")  # for the row of a tile that is furthest back
    for x, end in zip(range(0, len(i), SIEVE_ROWS), ends, strict=True):
        rows = i[x : x + SIEVE_ROWS]
        for y in range(0, end, TILE_COLUMNS):
            stop, need = min(y + TILE_COLUMNS, end), heaps.least[rows] - ROUNDING
            bounds = low[x : x + SIEVE_ROWS] @ high[:, y:stop]
            hot = np.flatnonzero(bounds.max(axis=1) >= need)
            if not len(hot):
                continue
            r, c = np.nonzero(bounds[hot] >= need[hot][:, None])
            if len(r) > MANY * bounds.size:
                r, c = _survivors(a[rows[hot]] @ far[y:stop].T, need[hot], np.full(len(hot), ROUNDING), k)
            r, c = rows[hot[r]], j[c + y]
            for s in range(0, len(r), 1 << 17):
                rr, cc = r[s : s + (1 << 17)], c[s : s + (1 << 17)]
                heaps.push(rr, cc + first, np.einsum("ij,ij->i", a[rr], b[cc], dtype=np.float64))
    return int(np.minimum(SIEVE_ROWS, len(i) - np.arange(0, len(i), SIEVE_ROWS)) @ ends)


def _cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row of x the number of the centre next to it."""
    return np.concatenate([np.zeros(0, np.int32), *[(x[s : s + 4096] @ centres.T).argmax(axis=1).astype(np.int32) for s in range(0, len(x), 4096)]])


def learn_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """At most ``cells`` unit vectors, in float32, around which the rows of x lie."""
    c = x[:cells]
    for _ in range(10):
        cell = _cells(x, c)
        sums = np.zeros(c.shape)
        np.add.at(sums, cell, x)
        sums = sums[(sums != 0).any(axis=1)]
        c = _unit(sums).astype(np.float32) if len(sums) else c
    return c


def _emit(heaps: Heaps, first: int, k: int) -> pa.RecordBatch:
    top = np.argsort(-heaps.value, axis=1, kind="stable")[:, :k]
    v, o = np.take_along_axis(heaps.value, top, 1), np.take_along_axis(heaps.other, top, 1)
    row, _ = np.nonzero(o >= 0)
    return pa.RecordBatch.from_arrays([pa.array(first + row), pa.array(o[o >= 0]), pa.array(v[o >= 0])], names=["a", "b", "similarity"])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop address and the path in it; the schemes of Hadoop's object stores have other names here."""
    for theirs, ours in (("s3[an]?", "s3"), ("wasbs?", "abfs"), ("abfss", "abfs"), ("gs|gcs", "gs")):
        uri = re.sub(rf"^(?:{theirs})://", f"{ours}://", uri)
    return fs.FileSystem.from_uri(uri)


def block_join(distinct: DataFrame, rows: int, k: int = K, least: float = -2.0, dim: int = DIM, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((key, place) of each vector, (a, b, similarity) of the k best places for each place).

    ``rows`` is about the number of vectors; ``distinct`` is read three times. A place is block * 2^32 + position. Blocks are written once to the shared
    folder, where the tasks read them, so the vectors aren't shuffled once for every pair.
    """
    spark = distinct.sparkSession
    learned = distinct.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, rows // LEARNED))) == 0).select("key", "vector").toArrow().sort_by("key").slice(0, 2 * LEARNED)
    x = np.frombuffer(b"".join(learned.column("vector").to_pylist()), np.float32).reshape(-1, dim)
    centres = learn_centres(x, min(MOST_CELLS, max(-(-rows // block_rows), min(CELLS, -(-rows // CELL_ROWS))))) if len(x) else np.eye(1, dim, dtype=np.float32)
    axes = np.linalg.eigh(x.T.astype(np.float64) @ x)[1][:, ::-1][:, :SIEVE].astype(np.float32)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([t.column("key"), t.column("vector"), pa.array(_cells(v, centres))], names=["key", "vector", "cell"])

    cells = distinct.select("key", "vector").mapInArrow(located, "key binary, vector binary, cell int")
    counts = {r.cell: r["count"] for r in cells.groupBy("cell").count().collect()}
    parts = [-(-counts.get(c, 0) // block_rows) for c in range(len(centres))]
    cell_of = np.repeat(np.arange(len(centres)), parts)  # of each block
    n = len(cell_of)
    lots = spark.createDataFrame([(c, sum(parts[:c]), parts[c]) for c in range(len(centres)) if parts[c]], "cell int, before int, parts int")
    blocked = cells.join(F.broadcast(lots), "cell").select("key", "vector", (F.col("before") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("block"))  # a row a cell

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "keys": pa.array([table.column("key").to_pylist()], pa.list_(pa.binary())), "data": pa.array([b"".join(table.column("vector").to_pylist())], pa.binary())})

    schema = "block int, keys array<binary>, data binary"
    path = written(blocked.groupBy("block").applyInArrow(pack, schema), "block")
    packed = spark.read.schema(schema).parquet(path)
    places = packed.select(F.col("block"), F.posexplode("keys").alias("at", "key")).select("key", (F.shiftleft(F.col("block").cast("long"), 32) + F.col("at")).alias("place"))

    def block(i: int) -> np.ndarray | None:
        files, folder = _open(f"{path}/block={i}")
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return None
        return np.frombuffer(pq.read_table(folder, columns=["data"], filesystem=files, partitioning=None).column("data")[0].as_py(), np.float32).reshape(-1, dim)

    def tiles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for p in part.column("id").to_pylist():
                a = block(p)
                if a is None:
                    continue
                heaps = Heaps(len(a), k, least)
                join_blocks(heaps, a, None, k, p << 32)
                for q in [*range(p + 1, n), *range(p)]:  # the rest of the own cell first, and tasks begin at different blocks
                    if (b := block(q)) is None:
                        continue
                    apart = centres[cell_of[p]] - centres[cell_of[q]]
                    if least > 0.5:
                        join_apart(heaps, a, b, k, q << 32, least, apart / max(np.linalg.norm(apart), np.float32(1e-6)), axes)
                    else:
                        join_blocks(heaps, a, b, k, q << 32)
                yield _emit(heaps, p << 32, k)

    return places, spark.range(0, n, 1, max(1, n)).mapInArrow(tiles, "a long, b long, similarity double")


def nearest(rows: DataFrame, k: int = K, least: float = -2.0, dim: int = DIM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(chunk_id, neighbour_id, similarity, rank): the k best others of similarity at least ``least`` of every id."""
    vectors = kept(keyed(rows, dim), "none")
    ids = cut(vectors.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("last")))
    members, differing = ids.select("id", "key"), ids.filter("key <> last").select("id", F.col("key").alias("kept"))
    vectors = vectors.join(small(differing), "id", "left").filter(F.col("kept").isNull() | (F.col("kept") == F.col("key")))
    distinct = kept(vectors.groupBy("key").agg(F.min("vector").alias("vector")), "none")  # copies go map-side
    places, top = block_join(distinct, distinct.count(), k, least, dim, block_rows)  # copies make no blocks
    top = kept(top, "none")  # evaluated once, and joined by its true size
    # in each class the k + 1 least ids are enough, for any member and from any other class
    first = Window.partitionBy("key").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = places.join(heads, "key").select("place", "key", "ids")
    across = (
        top.join(named.select(F.col("place").alias("b"), "ids"), "b")
        .join(named.select(F.col("place").alias("a"), "key"), "a")
        .select("key", "similarity", F.explode(F.slice("ids", 1, k)).alias("other"))
    )
    copies = heads.filter(F.size("ids") > 1).filter(F.lit(least <= 1.0)).select("key", F.lit(1.0).alias("similarity"), F.explode("ids").alias("other"))
    offered = across.unionByName(copies)
    few = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
    offered = offered.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "similarity", "other"))).alias("best"))
    mine = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)
    return (
        members.join(offered, "key")
        .select("id", F.posexplode(mine).alias("at", "n"))
        .select(F.col("id").alias("chunk_id"), F.col("n.other").alias("neighbour_id"), F.col("n.similarity").alias("similarity"), (F.col("at") + 1).alias("rank"))
    )


def similar_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """Distinct (chunk_a, chunk_b), chunk_a < chunk_b, of neighbours of at least ``least``."""
    return (
        neighbours.filter(F.col("similarity") >= least)
        .select(F.least("chunk_id", "neighbour_id").alias("chunk_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_b"))
        .distinct()
    )
