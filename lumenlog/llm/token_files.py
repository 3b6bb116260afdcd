"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a Parquet container, so that Spark's committer makes a lost executor harmless and any store that
Spark writes to will do. Its rows are blocks of whole documents in ascending doc_id order:

    part, block   place of the block; parts are in doc_id order
    first         ids of the part before the block
    doc_ids       ids of the documents, null allowed
    lengths       ids of each document, the end id included
    ranks         the block's distinct ids, most frequent first, little-endian unsigned 32-bit
    control       two bits a value, four values a byte, lowest bits first: bytes of the value, less one
    data          the lowest bytes of each value, which is the rank of an id in the block

Frequent ids have small ranks and so take one byte. Each block carries the ranks of its own counts: one pass
over the texts writes the files, and a block can be read alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlog.llm.common import frame, texts
from lumenlog.llm.pieces import PieceCoder
from lumenlog.session import run_dir

#: Ids of a block, about: a block ends with the document that reaches this number.
BLOCK = 1 << 20
END = 2
SCHEMA = "part int, block long, first long, n_ids long, doc_ids array<long>, lengths array<long>, ranks binary, control binary, data binary"

_VALUES = np.arange(256)
#: Bytes of each of the four values of a control byte, and which of their sixteen bytes are stored.
LENGTHS = (np.stack([_VALUES >> (2 * k) & 3 for k in range(4)], 1) + 1).astype(np.uint8)
STORED = (np.arange(4)[None, None, :] < LENGTHS[:, :, None]).reshape(256, 16)

#: How byte-level vocabularies spell bytes: printable ones as themselves, the others, in order, from character 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPELT = [ALPHABET.get(b, chr(b)) for b in range(256)]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    width = 2 if not len(values) or values.max() <= 0xFFFF else 4  # bytes that any value takes, at most
    values = values.astype(f"<u{width}")
    short = (values > 0xFF).astype(np.uint8)
    if width > 2:
        short += (values > 0xFFFF).astype(np.uint8) + (values > 0xFFFFFF)
    codes = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    codes[: len(values)] = short
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    stored = np.arange(width, dtype=np.uint8)[None, :] <= short[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, width)[stored].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes, by table lookup."""
    codes = np.frombuffer(control, np.uint8)
    width = 4 if (codes & 0xAA).any() else 2  # bytes that any value takes, at most
    stored = STORED.reshape(256, 4, 4)[:, :, :width].reshape(256, -1)[codes]
    if n % 4:
        stored[-1, width * (n % 4) :] = False
    out = np.zeros((len(codes), 4 * width), np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view(f"<u{width}")[:n].astype("<u4", copy=False)


def rank(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, most frequent first and smaller before larger, and the place of each of ``ids`` there."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    order = distinct[np.argsort(-counts[distinct], kind="stable")]
    places = np.zeros(len(counts), "<u4")
    places[order] = np.arange(len(order))
    return order.astype("<u4"), places[ids]


class TextCoder:
    """Ids of whole texts as the library gives them: strings of the file's added tokens are found first, and what
    stands between them is encoded alone."""

    def __init__(self, tokenizer: Tokenizer):
        tokenize = tokenizer.model.tokenize  # of one piece, spelt in the byte alphabet
        packed = {key: key.to_bytes(4, "little") for key in tokenizer.get_vocab().values()}

        def piece(text: str) -> bytes:
            if text.isascii() and text.isprintable():  # of these bytes only the space is spelt otherwise
                spelt = text.replace(" ", ALPHABET[32])
            else:
                spelt = "".join([_SPELT[b] for b in text.encode("utf-8", "replace")])
            return b"".join([packed[token.id] for token in tokenize(spelt)])

        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in what stands around them are not supported")
        self.added = {t.content: np.array([key], "<u4").tobytes() for key, t in added.items() if t.content}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None
        self.parts = PieceCoder(public_tokenizers.PATTERN, piece, limit=1_200_000)

    def encode(self, text: str) -> bytes:
        if self.split is None or not any(x in text for x in self.added):
            return self.parts.encode(text)
        cut = self.split(text)  # every second one is an added token
        return b"".join([self.added[x] if k % 2 else self.parts.encode(x) for k, x in enumerate(cut)])


@functools.cache
def coder(path: str) -> TextCoder:
    """The cached coder of a tokenizer file; one for each Python worker."""
    return TextCoder(Tokenizer.from_file(path))


def _block(part: int, block: int, first: int, keys: list[int | None], ids: list[np.ndarray]) -> tuple:
    order, places = rank(np.concatenate(ids))
    control, data = pack(places)
    return part, block, first, len(places), keys, [len(x) for x in ids], order.tobytes(), control, data


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> str:
    """Write the ids of every whole text of ``docs`` (doc_id, text), ``end`` after each, in doc_id order.

    Null texts count as empty; null ids come first; rows of one id are in the order of their texts' XXH64, then of
    the texts. Tasks get ranges of ids and hashes, so that an id on very many rows is not one task's. Every row is
    written, repeated rows as well. No rows give files without blocks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, first, size = TaskContext.get().partitionId(), 0, 0, 0
        encode, last = coder(tokenizer).encode, np.array([end], "<u4").tobytes()
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for key, text in texts(batch):
                keys.append(key)
                ids.append(np.frombuffer(encode(text) + last, "<u4"))
                size += len(ids[-1])
                if size >= BLOCK:
                    yield frame([_block(part, block, first, keys, ids)], columns, ())
                    keys, ids, first, size, block = [], [], first + size, 0, block + 1
        if keys:
            yield frame([_block(part, block, first, keys, ids)], columns, ())

    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("deal"))
    # with a number, so that small partitions are not put together again
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(tasks, "doc_id", "deal").sortWithinPartitions("doc_id", "deal", "text")
    ordered.select("doc_id", "text").mapInPandas(run, SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of written files; start counts the ids of all before it.

    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # one row a part: as many as there were tasks
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                places = unpack(row.control, row.data, int(row.n_ids))
                ids = np.frombuffer(row.ranks, "<u4")[places]
                ends = np.cumsum(np.asarray(row.lengths, np.int64))
                rows = [
                    (key, int(row.start + b - n), ids[b - n : b].tobytes())
                    for key, n, b in zip(_keys(row.doc_ids), row.lengths, ends.tolist())
                ]
                yield frame(rows, ["doc_id", "start", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("first"))
    return placed.select("doc_ids", "lengths", "ranks", "control", "data", "n_ids", "start").mapInPandas(
        run, "doc_id long, start long, ids binary"
    )


def _keys(values: object) -> list[int | None]:
    return [None if x is None or x != x else int(x) for x in values]


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, ids) of ``docs`` as read back from files written to the shared folder; see ``write``."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer, run_dir(spark, "token-files")))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, start, ids)."""

    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
