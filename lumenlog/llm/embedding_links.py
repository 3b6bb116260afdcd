"""Near-duplicate vectors by cosine: an exact subspace pigeonhole join.

Unit vectors with cosine of at least ``cosine`` are at most 2 - 2 * cosine apart in squared distance, and a
rotation keeps that. Rotated vectors are cut into blocks; in at least one block two such vectors are apart by no
more than the block's share of that distance. So each block is range-joined under its share alone, and the union
of what the blocks find is verified on the given components in double precision. Nothing is missed.

By default one block has all dimensions: its boxes are bound by the whole distance, vectors go to the tasks once and
not once a block, and a product of 32 bits decides all pairs but those close to the bound.

The rotation flips signs and applies a Walsh-Hadamard transform, which spreads the distance evenly over blocks and
only adds and subtracts, so that every task gets the same bits.

Range join of a block: a k-d tree fitted on a bounded sample deals all vectors to tiles; tiles whose bounding boxes
are farther apart than the share never meet. Large tiles are cut into chunks by hash, and a task compares two
chunks. A task returns each vector's number of links and a spanning forest of the links, never the pairs, so a
group of near copies costs no more rows than its members. A pair that several blocks find belongs to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import stored
from lumenlog.llm.simhash import components

COSINE = 0.9
#: Dimensions of a block, at most: all that a vector has, unless it is very long.
BLOCK = 1 << 16
#: Vectors of one side of a task, at most about.
CHUNK = 8192
#: Vectors that the tree is fitted on, at most, and its leaves at most.
SAMPLE = 50_000
MAX_LEAVES = 1024
#: Comparisons made at once; their products fit a core's cache.
AREA = 1 << 18
#: Room for the rounding of 32-bit products of unit vectors, far above it.
SLACK = 1e-4
_EXACT = 1e-9


def rotate(units: np.ndarray) -> np.ndarray:
    """Unit rows, filled up with zeros to a power of two, after sign flips and a Walsh-Hadamard transform."""
    n, dims = units.shape
    size = 1 << max(0, dims - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :dims] = units * np.random.default_rng(size).choice((-1.0, 1.0), size)[:dims]
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return out / np.sqrt(size)


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def unpacked(raw: pd.Series) -> np.ndarray:
    """Rows of packed vectors of equal length, as doubles."""
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, raw): components as little-endian doubles; null if the vector can't link with any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = []
            for vector in batch["embedding"]:
                x = None if vector is None else np.asarray([np.nan if v is None else v for v in vector] if vector.dtype == object else vector, np.float64)
                raws.append((x + 0.0).astype("<f8").tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "raw": raws})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInPandas(run, "vec_id long, raw binary")


class Trees:
    """For every block of every length a k-d tree: medians, level by level, of the coordinate of the widest spread."""

    def __init__(self, sample: list[bytes], leaves: int, block: int = BLOCK):
        self.block = block
        self.levels = max(0, min(leaves, MAX_LEAVES) - 1).bit_length()
        self.cuts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[bytes]] = {}
        for raw in sample:
            by_length.setdefault(len(raw), []).append(raw)
        for length, raws in by_length.items():
            rotated = rotate(units(unpacked(pd.Series(raws)))).astype(np.float32)
            for b in range(-(-rotated.shape[1] // block)):
                self.cuts[length, b] = self._fit(rotated[:, b * block : (b + 1) * block])

    def _fit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = (1 << self.levels) - 1
        axis, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf, np.float32)
        place = np.zeros(len(x), np.int64)
        for node in range(nodes):
            mine = np.flatnonzero(place == node)
            if len(mine):
                axis[node] = np.argmax(x[mine].std(axis=0))
                cut[node] = np.median(x[mine, axis[node]])
            place[mine] = 2 * node + 1 + (x[mine, axis[node]] > cut[node])
        return axis, cut

    def leaf(self, length: int, b: int, x: np.ndarray) -> np.ndarray:
        """The tile of each row in block ``b``; lengths that the sample lacks have one tile."""
        place = np.zeros(len(x), np.int64)
        if (length, b) in self.cuts:
            axis, cut = self.cuts[length, b]
            for _ in range(self.levels):
                place = 2 * place + 1 + (x[np.arange(len(x)), axis[place]] > cut[place])
        return place


def tiled(nodes: DataFrame, trees: Trees) -> DataFrame:
    """(key, length, b, tile): the tile of each node in each block; one row of each tile of a batch has its box in ``low`` and ``high``, and its size."""
    shared = nodes.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = shared.value
        for batch in batches:
            for length, rows in batch.groupby(batch["raw"].str.len(), sort=False):
                x = rotate(units(unpacked(rows["raw"]))).astype(np.float32)
                for b in range(-(-x.shape[1] // forest.block)):
                    part = x[:, b * forest.block : (b + 1) * forest.block]
                    leaf = forest.leaf(length, b, part)
                    out = pd.DataFrame({"key": rows["key"].to_numpy(), "length": length, "b": b, "tile": leaf})
                    first = ~out["tile"].duplicated().to_numpy()
                    lows, highs, sizes = [None] * len(out), [None] * len(out), [None] * len(out)
                    for i in np.flatnonzero(first):
                        inside = part[leaf == leaf[i]]
                        lows[i], highs[i], sizes[i] = inside.min(axis=0).tolist(), inside.max(axis=0).tolist(), len(inside)
                    yield out.assign(low=lows, high=highs, n=pd.array(sizes, "Int64"))

    return nodes.select("key", "raw").mapInPandas(run, "key binary, length int, b int, tile int, low array<float>, high array<float>, n long")


def boxes(places: DataFrame) -> DataFrame:
    """(length, b, tile, n, low, high): the size and the box of each tile, from those of its batches."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = np.stack(list(rows["low"])).min(axis=0), np.stack(list(rows["high"])).max(axis=0)
        return pd.DataFrame([[*key, int(rows["n"].sum()), low, high]], columns=["length", "b", "tile", "n", "low", "high"])

    some = places.where("n is not null").select("length", "b", "tile", "n", "low", "high")
    return some.groupBy("length", "b", "tile").applyInPandas(merge, "length int, b int, tile int, n long, low array<float>, high array<float>")


def share(length: int, b: int, block: int, limit: float) -> float:
    """A block's part of the squared distance ``limit``, by its dimensions."""
    size = 1 << max(0, length // 8 - 1).bit_length()
    return limit * min(block, size - b * block) / size


def meetings(places: DataFrame, chunk: int, block: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """Chunks of each tile, and the pairs of tiles (x, y), x <= y, whose boxes are within the block's share.

    There are at most MAX_LEAVES tiles a block; only these, not the vectors, are paired here.
    """
    tiles = boxes(places).select("length", "b", "tile", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), "low", "high")
    tiles = stored(tiles, "vector-tiles")
    left = tiles.withColumnsRenamed({"tile": "x", "chunks": "cx", "low": "lx", "high": "hx"})
    right = tiles.withColumnsRenamed({"tile": "y", "chunks": "cy", "low": "ly", "high": "hy"})
    gaps = F.transform(
        F.arrays_zip("lx", "hx", "ly", "hy"),
        lambda d: F.coalesce(F.greatest(d["lx"] - d["hy"], d["ly"] - d["hx"], F.lit(0.0)).cast("double"), F.lit(0.0)),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, d: total + d * d)
    padded = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("length") / 8))))
    budget = F.lit(limit) * F.least(F.lit(float(block)), padded - F.col("b") * block) / padded
    near = left.join(right, ["length", "b"]).where("x <= y").where(apart <= budget + SLACK)
    return tiles.select("length", "b", "tile", "chunks"), near.select("length", "b", "x", "y", "cx", "cy")


class Groups:
    """Spanning forest of links that come in portions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while len(i):
            x, y = parent[i], parent[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            moved, first = np.unique(high, return_index=True)  # one link for each root that moves
            self.links.append(np.stack([low[first], moved], 1))
            parent[moved] = low[first]
            while not ((above := parent[parent]) == parent).all():
                parent[:] = above


class Comparison:
    """Links between the vectors of a task that belong to block ``b``."""

    def __init__(self, raw: pd.Series, b: int, block: int, cosine: float):
        self.vectors = unpacked(raw)
        self.units = units(self.vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.cosine, self.b = cosine, b
        length = self.vectors.shape[1] * 8
        self.whole = share(length, 0, block, 1.0) == 1  # one block, to which every link belongs
        if self.whole:
            self.single = self.units.astype(np.float32)
            return
        self.rotated = rotate(self.units)
        self.blocks = [slice(c * block, (c + 1) * block) for c in range(b + 1)]
        self.shares = [share(length, c, block, 2 - 2 * cosine) for c in range(b + 1)]
        self.single = self.rotated[:, : (b + 1) * block].astype(np.float32)

    def _apart(self, c: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances in block ``c``, in products of 32 bits."""
        x, y = self.single[i, self.blocks[c]], self.single[j, self.blocks[c]]
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)

    def _exactly(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs link and belong to the block, each decided from the same sums in every task."""
        x, y = self.vectors[i], self.vectors[j]
        ok = (x * y).sum(axis=1) / (self.norms[i] * self.norms[j]) >= self.cosine
        if self.whole:
            return ok
        difference = self.rotated[i, : self.blocks[-1].stop] - self.rotated[j, : self.blocks[-1].stop]
        for c, part in enumerate(self.blocks):
            inside = np.zeros(len(i))
            for d in range(part.start, min(part.stop, difference.shape[1])):
                inside += difference[:, d] ** 2
            inside = inside <= self.shares[c] + _EXACT
            ok &= inside if c == self.b else ~inside
        return ok

    def links(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Portions (rows, columns, matrix) of which vectors of ``left`` link with which of ``right``."""
        step = max(1, AREA // max(1, len(right)))
        others = np.ascontiguousarray(self.single[right].T) if self.whole else None
        for top in range(0, len(left), step):
            i = left[top : top + step]
            if self.whole:
                yield from self._whole_links(i, right, self.single[i] @ others)
                continue
            near = self._apart(self.b, i, right) <= self.shares[self.b] + SLACK
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            i, j = i[rows], right[columns]
            near = near[np.ix_(rows, columns)]
            if near.sum() * 8 < near.size:  # few: one by one
                x, y = np.nonzero(near)
                hit = np.concatenate([self._exactly(i[x[k : k + 65_536]], j[y[k : k + 65_536]]) for k in range(0, len(x), 65_536)])
                near[x, y] = hit
            else:  # many: products, and one by one only what lies close to a bound
                cos = self.units[i] @ self.units[j].T
                near &= cos >= self.cosine - _EXACT
                doubtful = near & (cos < self.cosine + _EXACT)
                for c in range(self.b + 1):
                    apart = self._apart(c, i, j)
                    doubtful |= near & (np.abs(apart - self.shares[c]) <= SLACK)
                    near &= (apart <= self.shares[c] + SLACK) if c == self.b else (apart > self.shares[c] - SLACK)
                doubtful &= near
                x, y = np.nonzero(doubtful)
                for k in range(0, len(x), 65_536):
                    near[x[k : k + 65_536], y[k : k + 65_536]] = self._exactly(i[x[k : k + 65_536]], j[y[k : k + 65_536]])
            near &= i[:, None] != j[None, :]
            if near.any():
                yield i, j, near

    def _whole_links(self, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What ``links`` yields, by cosines in products of 32 bits; one by one only what lies close to the bound."""
        near = cos >= self.cosine - SLACK
        if not near.any():
            return
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        i, j, cos = i[rows], j[columns], cos[np.ix_(rows, columns)]
        near = cos >= self.cosine - SLACK
        near &= i[:, None] != j[None, :]
        x, y = np.nonzero(near & (cos < self.cosine + SLACK))
        for k in range(0, len(x), 65_536):
            some = x[k : k + 65_536], y[k : k + 65_536]
            near[some] = self._exactly(i[some[0]], j[some[1]])
        if near.any():
            yield i, j, near


def compare(rows: pd.DataFrame, b: int, own: bool, block: int, cosine: float) -> pd.DataFrame:
    """(a, b, n): links of a forest, with n null, and the numbers n of vectors that each ``a`` links with, with b null."""
    left = rows["left"].to_numpy(bool)
    mine, its = np.flatnonzero(left), np.flatnonzero(~left)
    copies = rows["copies"].to_numpy(np.int64)
    work, groups, counts = Comparison(rows["raw"], b, block, cosine), Groups(len(rows)), np.zeros(len(rows), np.int64)
    for i, j, near in work.links(mine, mine if own else its):
        counts[i] += near @ copies[j]
        if not own:
            counts[j] += copies[i] @ near
        x, y = np.nonzero(near)
        groups.add(i[x], j[y])
    keys = rows["key"].to_numpy()
    some = np.flatnonzero(counts)
    pairs = np.concatenate(groups.links) if groups.links else np.empty((0, 2), np.int64)
    return pd.DataFrame(
        {
            "a": np.concatenate([keys[some], keys[pairs[:, 0]]]),
            "b": np.concatenate([np.full(len(some), None, object), keys[pairs[:, 1]]]),
            "n": pd.array([*counts[some].tolist(), *[None] * len(pairs)], "Int64"),
        }
    )


def found(nodes: DataFrame, trees: Trees, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n) of the distinct vectors ``nodes`` (key, raw, copies), as ``compare`` returns them for each task."""
    block = trees.block
    places = stored(tiled(nodes, trees), "vector-places")
    tiles, near = meetings(places, chunk, block, 2 - 2 * cosine)
    near = stored(near, "vector-meetings")
    at = places.select("key", "length", "b", "tile").join(F.broadcast(tiles), ["length", "b", "tile"])
    at = at.withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    # chunk i of a tile meets chunks i.. of the tile itself and every chunk of the tiles after it
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("other")
    task = lambda x, i, y, j: F.struct("length", "b", F.col(x).alias("x"), F.col(i).alias("i"), F.col(y).alias("y"), F.col(j).alias("j"))
    ahead = at.join(near.withColumn("tile", F.col("x")).drop("cx"), ["length", "b", "tile"]).select("*", numbers("cy"))
    ahead = ahead.where("x < y or chunk <= other").select(task("x", "chunk", "y", "other").alias("task"), F.lit(True).alias("left"), "key")
    behind = at.join(near.withColumn("tile", F.col("y")).drop("cy"), ["length", "b", "tile"]).select("*", numbers("cx"))
    behind = behind.where("x < y or other < chunk").select(task("x", "other", "y", "chunk").alias("task"), F.lit(False).alias("left"), "key")
    work = ahead.unionByName(behind).join(nodes, "key")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = key[0]
        return compare(rows, one["b"], (one["x"], one["i"]) == (one["y"], one["j"]), block, cosine)

    return work.select("task", "left", "key", "raw", "copies").groupBy("task").applyInPandas(run, "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors
    of different lengths. Equal vectors are compared once and counted as often as they occur. Rows with a null
    vec_id take part, come out with a null vec_id and aren't kept; component_id is the smallest vec_id that is not
    null, null if there is none. No rows give no rows. Other columns are ignored.
    """
    rows = stored(packed(vectors).withColumn("key", F.unhex(F.md5("raw"))), "vectors")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nodes = rows.where("raw is not null").groupBy("key", "raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = stored(nodes, "vector-nodes")
    total = nodes.count()
    sample = nodes.select("raw").sample(min(1.0, SAMPLE / max(1, total)), seed=1).limit(2 * SAMPLE)
    trees = Trees([bytes(r.raw) for r in sample.toLocalIterator()], -(-total // chunk), block)
    pairs = stored(found(nodes.select("key", "raw", "copies"), trees, cosine, chunk), "vector-links")
    others = pairs.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    roots = components(pairs.where("n is null").select("a", "b"), "vector-forest").withColumnsRenamed({"node": "key"})
    placed = nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    per = placed.join(named, "root").join(others, "key", "left")
    per = per.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("raw is not null").select("vec_id", "key").join(per, "key").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
