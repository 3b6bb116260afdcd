"""Near-duplicates by SimHash: 64-bit fingerprints, exact tiled comparison, connected components.

Two fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of the differences of the
population counts of their parts, however they are cut into parts. Tiles hold fingerprints with equal counts
in both halves; tile pairs beyond the radius never meet. Inside a task, tiles are cut further by the counts
of quarters, bytes and half bytes, and what remains is compared by numpy exclusive-or and bit counts.

Only distinct fingerprints are compared, and a task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import frame, stored, texts

#: Fingerprints of one side of a task, at most.
CHUNK = 65_536
#: Comparisons made at once, at most: 4 million exclusive-ors of 8 bytes.
AREA = 1 << 22
#: Links that a task joins at once, about.
EDGES = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit, bit 0 first.

    Eight bits, one of each byte, are added at once in the bytes of one word, 255 words at a time.
    """
    out = np.empty((8, 8), np.int64)
    starts = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        out[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - words + 1
    if n < 1:
        hashes = np.array([digest(b" ".join(tokens), seed)], np.uint64)
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)
    set_bits = np.flatnonzero(2 * bit_counts(hashes) > len(hashes))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, words: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, fp): the signed 64-bit value of each row's fingerprint. Null texts count as empty.

    A binary ``key`` of the row comes out as a third column.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, fingerprint(text, words)) for key, text in texts(batch)]
            out = frame([(key, 0) for key, _ in rows], ["doc_id", "fp"])
            out["fp"] = np.array([fp for _, fp in rows], np.uint64).view(np.int64)
            for name in batch.columns[2:]:
                out[name] = batch[name].to_numpy()
            yield out

    keys = [] if key is None else [key.alias("key")]
    return docs.select(F.col("doc_id").cast("long"), "text", *keys).mapInPandas(run, "doc_id long, fp long" + ", key binary" * len(keys))


def _part_counts(fps: np.ndarray, bits: int) -> np.ndarray:
    """Population counts of the parts of ``bits`` bits, one row a fingerprint."""
    kind = {32: np.uint32, 16: np.uint16, 8: np.uint8}.get(bits)
    if kind:
        return np.bitwise_count(fps.astype("<u8").view(kind)).reshape(len(fps), -1).astype(np.int8)
    halves = fps.astype("<u8").view(np.uint8)
    return np.bitwise_count(np.stack([halves & 15, halves >> 4], 1)).reshape(len(fps), -1).astype(np.int8)


def _tiles(fps: np.ndarray, at: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions ``at`` grouped by equal part counts."""
    counts = _part_counts(fps[at], bits)
    keys = np.ascontiguousarray(counts).view(f"V{counts.shape[1]}").ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    return list(zip(counts[first].astype(np.int16), np.split(at[order], np.cumsum(np.bincount(inverse))[:-1])))


def _close(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, bits: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, one of ``a`` and one of ``b``, within the radius, in bounded portions."""
    if bits and len(a) * len(b) > AREA:
        tiles_a, tiles_b = _tiles(fps, a, bits[0]), _tiles(fps, b, bits[0])
        counts_b = np.array([c for c, _ in tiles_b])
        for count, mine in tiles_a:
            for k in np.flatnonzero(np.abs(counts_b - count).sum(axis=1) <= radius):
                yield from _close(fps, mine, tiles_b[k][1], radius, bits[1:])
        return
    for top in range(0, len(b), 4096):
        right = b[top : top + 4096]
        step = max(1, AREA // len(right))
        for left in range(0, len(a), step):
            mine = a[left : left + step]
            i, j = np.nonzero(np.bitwise_count(fps[mine][:, None] ^ fps[right][None, :]) <= radius)
            yield mine[i], right[j]


def forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int = 3) -> np.ndarray:
    """Links of positions that join the same groups as all pairs of ``a`` and ``b`` within the radius do."""
    parent = np.arange(len(fps))
    links = []
    for i, j in _close(fps, a, b, radius, (16, 8, 4)):
        while len(i):
            x, y = parent[i], parent[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            roots, first = np.unique(high, return_index=True)  # one link for each root that moves
            links.append(np.stack([low[first], roots], 1))
            parent[roots] = low[first]
            while True:
                above = parent[parent]
                if (above == parent).all():
                    break
                parent = above
    return np.concatenate(links) if links else np.empty((0, 2), np.int64)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join the same groups as all links do."""
    ones = lambda x: F.bit_count(x).cast("int")
    tiled = fps.select("fp", ones(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), ones(F.shiftrightunsigned("fp", 32)).alias("hi"))
    # at most 33 x 33 tiles, so this table has a fixed bound
    sizes = tiled.groupBy("lo", "hi").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = F.broadcast(stored(sizes.coalesce(1), "simhash-tiles"))
    tiled = tiled.join(sizes, ["lo", "hi"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    # each tile meets itself and the neighbours after it; a chunk meets all chunks of the other tile
    near = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) > (0, 0)]
    other = sizes.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("chunks").alias("chunks2"))

    def meetings(steps: list[tuple[int, int]], first: bool) -> DataFrame:
        shift = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("step")
        moved = tiled.select("*", shift).withColumns({"lo2": F.col("lo") + F.col("step.x"), "hi2": F.col("hi") + F.col("step.y")})
        moved = moved.join(F.broadcast(other), ["lo2", "hi2"]).withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
        mine, its = F.struct("lo", "hi", "chunk"), F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("chunk2").alias("chunk"))
        pair = (mine, its) if first else (its, mine)
        return moved.select(F.concat_ws("/", pair[0].cast("string"), pair[1].cast("string")).alias("task"), F.lit(first).alias("left"), "fp")

    back = [(-x, -y) for x, y in near]
    own = F.concat_ws("/", F.struct("lo", "hi").cast("string"), F.lit("own"))
    chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    # chunk i of a tile meets chunks i.. of the same tile: rows go to the tasks (i, k) and (k, i)
    inside = tiled.select(own.alias("tile"), "fp", "chunk", F.explode(chunks).alias("k")).select(
        F.concat_ws("/", "tile", F.least("chunk", "k"), F.greatest("chunk", "k")).alias("task"), (F.col("chunk") <= F.col("k")).alias("left"), "fp"
    )
    work = inside.unionByName(meetings(near, True)).unionByName(meetings(back, False))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy(np.int64)
        fps, left = values.view(np.uint64), rows["left"].to_numpy(bool)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        if "/own/" in key[0] and not len(b):
            b = a
        found = forest(fps, a, b, radius)
        return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})

    return work.groupBy("task").applyInPandas(compare, "a long, b long")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` numbers reaches over the links (i, j)."""
    parent = np.arange(n)
    while True:
        x, y = parent[i], parent[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return parent
        i, j, low, high = i[apart], j[apart], low[apart], high[apart]
        order = np.lexsort((low, high))
        moved, first = np.unique(high[order], return_index=True)  # each root that moves takes its smallest neighbour
        parent[moved] = low[order[first]]
        while not ((above := parent[parent]) == parent).all():
            parent = above


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of each node to the smallest it reaches over at most about EDGES links of its partition; they join what ``links`` join."""

    def star(held: list[pd.DataFrame]) -> pd.DataFrame:
        links = pd.concat(held, ignore_index=True)
        numbers, names = pd.factorize(pd.concat([links["a"], links["b"]], ignore_index=True).to_numpy(), sort=True)
        roots = _roots(len(names), numbers[: len(links)], numbers[len(links) :])
        moved = np.flatnonzero(roots != np.arange(len(names)))
        return pd.DataFrame({"a": names[roots[moved]], "b": names[moved]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= EDGES:
                yield star(held)
                held, size = [], 0
        if size:
            yield star(held)

    return links.mapInPandas(run, links.schema)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), by large-star and small-star rounds.

    Each round makes every node point to the smallest of its neighbours; degrees are never gathered, the
    smallest neighbour is a partial aggregate and is joined back. Before the first round tasks join what links of
    their own reach, so that few rounds are left: each is several jobs whose plans and results the driver keeps.
    """
    edges = stored(_stars(_pairs(links)), name)
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = _pairs(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        # small-star: of each node the smaller neighbours, and itself, point to the smallest
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        edges = stored(_pairs(small), name)
        # settled when every larger node has one link and no root is anyone's larger node
        state = _state(edges)
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _pairs(links: DataFrame) -> DataFrame:
    """Distinct links with a < b."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def rooted(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """``nodes``, one row a fingerprint ``fp``, with the ``root`` of the group of each."""
    roots = components(links(nodes.select("fp"), radius), "simhash-links").withColumnsRenamed({"node": "fp"})
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Nulls and texts without words have fingerprint zero and link like any other. Rows with a null doc_id take
    part and come out with a null doc_id; component_id is the smallest doc_id that is not null, null if there
    is none. Repeated rows come out as often as they came in. No rows give no rows. Other columns are ignored.
    """
    marked = stored(fingerprints(docs, words), "simhash-fps")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    placed = rooted(nodes, radius)
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(groups, "root").select("fp", "component_id"), "simhash-groups")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
