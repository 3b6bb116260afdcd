"""Token counts by scanning flat token files for end-of-document ids.

A flat token file is one stream of fixed-width ids with an end id after each document and no index. It is
stored in blocks of equally many ids, cut wherever they fall; the id of a document lies with the block that
holds its last id. Blocks are scanned alone, by a vectorised search for the end id; a document that runs over
several blocks is put together by a prefix scan over what the blocks before leave open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import frame, stored, texts
from lumenlog.llm.token_files import coder

#: Ids of a block.
BLOCK = 1 << 20
#: An id above those of the vocabulary, so that no text gets it.
END = 65_535
SCHEMA = "part int, block long, ids binary, doc_ids array<long>"


def flat(docs: DataFrame, tokenizer: str, end: int = END, block: int = BLOCK, name: str = "flat-tokens") -> DataFrame:
    """Blocks (part, block, ids, doc_ids) of the flat token files of ``docs`` (doc_id, text), in the order read.

    Ids are little-endian unsigned 16-bit integers, so the vocabulary has at most 65,536. Null texts count as
    empty; ``doc_ids`` are null where ids are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        encode, last = coder(tokenizer).encode, np.array([end], "<u2")
        waiting: list[np.ndarray] = []
        keys: list[tuple[int, int | None]] = []  # the place of each document's last id in what waits, and its doc_id
        size = 0

        def cut(full: bool) -> Iterator[pd.DataFrame]:
            nonlocal waiting, keys, size, at
            if size < block and not (full and size):
                return
            stream, start, done = np.concatenate(waiting), 0, 0
            while size - start >= block or (full and start < size):
                stop = min(start + block, size)
                first = done
                while done < len(keys) and keys[done][0] < stop:
                    done += 1
                yield frame([(part, at, stream[start:stop].tobytes(), [k for _, k in keys[first:done]])], columns, ())
                start, at = stop, at + 1
            waiting, keys, size = [stream[start:]], [(p - start, k) for p, k in keys[done:]], size - start

        for batch in batches:
            for key, text in texts(batch):
                ids = np.frombuffer(encode(text), "<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("the vocabulary does not fit 16 bits")
                waiting += [ids.astype("<u2"), last]
                size += len(ids) + 1
                keys.append((size - 1, key))
                yield from cut(False)
        yield from cut(True)

    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA), name)


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """(part, block, n_ids, ends, tail, doc_ids): what each block holds alone.

    ``ends`` are the ids from one end id to the next, the end id included, the first counted from the block's
    start; ``tail`` counts the ids after the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part, block, ids in zip(batch["part"], batch["block"], batch["ids"]):
                stream = np.frombuffer(ids, "<u2")
                places = np.flatnonzero(stream == end)
                gaps = np.diff(places, prepend=-1)
                rows.append((part, block, len(stream), gaps.tolist(), len(stream) - (int(places[-1]) + 1 if len(places) else 0)))
            yield pd.DataFrame(rows, columns=["part", "block", "n_ids", "ends", "tail"])

    return blocks.select("part", "block", "ids").mapInPandas(run, "part int, block long, n_ids long, ends array<long>, tail long")


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """(doc_id, n_tokens) of every document of flat ``blocks``; n_tokens leaves the end id out.

    A stream's last document may lack its end id: it has no doc_id of its own and isn't counted.
    """
    seen = scan(blocks, end)
    before = Window.partitionBy("part").orderBy("block")
    # the open tail before a block: all ids up to it, less those up to the last end id before it
    closed = F.when(F.size("ends") > 0, F.sum("n_ids").over(before) - F.col("tail"))
    carried = seen.withColumn("closed", closed).withColumn(
        "open",
        F.sum("n_ids").over(before) - F.col("n_ids")
        - F.coalesce(F.max("closed").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    rows = carried.join(blocks.select("part", "block", "doc_ids"), ["part", "block"])
    pair = F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("place", "doc")
    return rows.select("open", pair).select(
        F.col("doc.doc_ids").alias("doc_id"),
        (F.col("doc.ends") - 1 + F.when(F.col("place") == 0, F.col("open")).otherwise(0)).alias("n_tokens"),
    )


def totals(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text), by way of flat token files.

    Null and empty texts have 0 tokens; rows with a null id and repeated rows come out one by one; no rows give
    no rows; a text may be longer than a block. An end id that the tokenizer gives for a text's own words would
    end its document, so ``end`` must be an id that texts don't get. Other columns are ignored.
    """
    return count_tokens(flat(docs, tokenizer, end), end)
