"""How far the word use of every two sources of a language lies apart, in exact integers.

Terms of a text are runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased. A language keeps
the terms that stand in at least ``min_docs`` of its documents. Each source prices each kept term,

    p = 1 + floor(SCALE * (count + 1) / (N + V))

for N kept occurrences in the source and V kept terms of the language, and f(p, q) = floor((p - q)^2 / q).

Kept terms are dealt to slices by their hash and numbered inside their slice. A group's slice is one pair of
sorted arrays of numbers and counts. For each unordered pair of sources and each slice both arrays are
co-grouped; a galloping search of the shorter in the longer finds the overlap. Terms that only one side has are
priced against the other's price of an absent term, and the terms that neither has are counted, not listed. So a
task holds two slices however large a source is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import stored

SCALE = 1_000_000_000
#: Kept terms of a slice, about.
SLICE = 1 << 16
#: Distinct terms that a task counts before it hands them on.
HELD = 400_000

#: Bytes of terms as lower case, all others as spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split()


def price(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division so that counts may pass 2^33."""
    rest = count.astype(np.int64) + 1
    out = np.zeros(len(rest), np.int64)
    for _ in range(3):
        out = out * 1000 + rest // total * 1000
        rest = rest % total * 1000
        out += rest // total
        rest = rest % total
    return out + 1


def absent(total: int) -> int:
    return SCALE // total + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f(p, q); prices are at most SCALE + 1, so squares fit 64 bits."""
    return (p - q) * (p - q) // q


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in each source, and its documents there.

    Counted in the task that reads the texts, then summed. Null text, lang and source count as empty ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for group, words in counts.items():
                keys = list(words)
                if not keys:
                    continue
                there = seen[group]
                yield pd.DataFrame(
                    {
                        "lang": group[0],
                        "source": group[1],
                        "term": [k.decode("utf-8") for k in keys],
                        "count": np.fromiter(words.values(), np.int64, len(keys)),
                        "docs": np.fromiter((there[k] for k in keys), np.int64, len(keys)),
                    }
                )
            counts.clear()
            seen.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                words = terms(text)
                mine = counts.setdefault((lang, source), Counter())
                held -= len(mine)
                mine.update(words)
                held += len(mine)
                seen.setdefault((lang, source), Counter()).update(set(words))
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInPandas(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


class Audit:
    """The tables that pair and term reports share; ``build`` makes them."""

    def __init__(self, counts: DataFrame, langs: DataFrame, groups: DataFrame):
        self.counts = counts  # lang, source, term, count, total (over the language)
        self.langs = langs  # lang, v, n
        self.groups = groups  # lang, source, n, m: all groups, also those without terms

    @staticmethod
    def build(docs: DataFrame, min_docs: int = 3) -> "Audit":
        raw = stored(term_counts(docs), "audit-counts")
        over = raw.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("in_docs"))
        kept = stored(over.where(F.col("in_docs") >= min_docs).select("lang", "term", "total"), "audit-kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
        counts = stored(raw.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total"), "audit-terms")
        sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        zero = F.lit(0).cast("long")
        groups = named.join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"))
        groups = groups.withColumn("m", F.col("n") + F.col("v"))
        return Audit(counts, langs, stored(groups, "audit-groups"))

    def arrays(self, slice_size: int = SLICE) -> DataFrame:
        """(lang, source, m, slice, ids, counts): each group's slice as sorted arrays."""
        sized = self.langs.select("lang", F.ceil(F.col("v") / slice_size).cast("int").alias("slices"))
        ids = self.counts.join(sized, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
        place = F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")).cast("int")
        numbered = ids.withColumn("id", place)
        entries = F.sort_array(F.collect_list(F.struct("id", "count")))
        rows = numbered.groupBy("lang", "source", "slice").agg(entries.alias("entries"))
        rows = rows.join(self.groups.select("lang", "source", "m"), ["lang", "source"])
        return rows.select("lang", "source", "m", "slice", F.col("entries.id").alias("ids"), F.col("entries.count").alias("counts"))

    def pairs(self, slice_size: int = SLICE) -> DataFrame:
        """(lang, source, other, value): summed f of every ordered pair of sources of a language."""
        rows = stored(self.arrays(slice_size), "audit-slices")
        other = self.groups.select("lang", F.col("source").alias("other"), F.col("m").alias("other_m"))
        met = rows.join(other, "lang")
        names = ("lang", "a", "b", "slice", "m", "other_m", "ids", "counts")
        first = met.where("source < other").withColumnsRenamed({"source": "a", "other": "b"}).select(*names)
        second = met.where("source > other").withColumnsRenamed({"source": "b", "other": "a"}).select(*(F.col(c).alias(c) for c in names))
        key = ("lang", "a", "b", "slice")
        merged = first.groupBy(*key).cogroup(second.groupBy(*key)).applyInPandas(_merge, "lang string, a string, b string, ab long, ba long, terms long")
        sums = merged.groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"), F.sum("terms").alias("terms"))
        left = self.groups.select("lang", F.col("source").alias("a"), F.col("m").alias("ma"), "v")
        right = self.groups.select("lang", F.col("source").alias("b"), F.col("m").alias("mb"))
        every = left.join(right, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
        zero = F.lit(0).cast("long")
        rest = F.col("v") - F.coalesce("terms", zero)
        pa, pb = (F.when(F.col(c) > 0, F.expr(f"{SCALE}L div {c} + 1")).otherwise(1) for c in ("ma", "mb"))
        gaps = every.withColumns({"pa": pa, "pb": pb, "rest": rest}).withColumns(
            {
                "ab": F.coalesce("ab", zero) + F.col("rest") * F.expr("(pa - pb) * (pa - pb) div pb"),
                "ba": F.coalesce("ba", zero) + F.col("rest") * F.expr("(pa - pb) * (pa - pb) div pa"),
            }
        )
        both = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("other"), F.col(v).alias("value")) for x, y, v in (("a", "b", "ab"), ("b", "a", "ba")))))
        return gaps.select("lang", both.alias("row")).select("lang", "row.*")

    def marked(self) -> DataFrame:
        """(lang, source, term, value): f of the terms that a source has and prices above its language."""
        rows = self.counts.join(self.groups.select("lang", "source", "m"), ["lang", "source"])
        rows = rows.join(self.langs.select("lang", (F.col("n") + F.col("v")).alias("lang_m")), "lang")
        scaled = lambda c, m: F.expr(f"CAST((CAST({SCALE} AS DECIMAL(10, 0)) * ({c} + 1)) div {m} AS BIGINT) + 1")
        priced = rows.withColumns({"p": scaled("count", "m"), "q": scaled("total", "lang_m")}).where("p > q")
        return priced.select("lang", "source", "term", F.expr("(p - q) * (p - q) div q").alias("value"))


def _merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Both directions' f over one slice of a pair of groups, and how many terms either side has there."""
    one = left if len(left) else right
    row = one.iloc[0]
    ma, mb = (row["m"], row["other_m"]) if len(left) else (row["other_m"], row["m"])
    a_ids, a = _side(left)
    b_ids, b = _side(right)
    pa, pb = price(a, int(ma)), price(b, int(mb))
    # each id of the shorter array is looked for in the longer one
    short, long_ = (a_ids, b_ids) if len(a_ids) <= len(b_ids) else (b_ids, a_ids)
    at = np.searchsorted(long_, short)
    hit = np.zeros(len(short), bool)
    inside = at < len(long_)
    hit[inside] = long_[at[inside]] == short[inside]
    in_short, in_long = np.flatnonzero(hit), at[hit]
    ia, ib = (in_short, in_long) if short is a_ids else (in_long, in_short)
    only_a, only_b = np.ones(len(a_ids), bool), np.ones(len(b_ids), bool)
    only_a[ia] = False
    only_b[ib] = False
    p = np.concatenate([pa[ia], pa[only_a], np.full(int(only_b.sum()), absent(int(ma)))])
    q = np.concatenate([pb[ib], np.full(int(only_a.sum()), absent(int(mb))), pb[only_b]])
    return pd.DataFrame(
        [(row["lang"], row["a"], row["b"], int(gap(p, q).sum()), int(gap(q, p).sum()), len(p))], columns=["lang", "a", "b", "ab", "ba", "terms"]
    )


def _side(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.asarray(rows["ids"].iloc[0], np.int32), np.asarray(rows["counts"].iloc[0], np.int64)


def report(docs: DataFrame, min_docs: int = 3, top: int = 200, slice_size: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source uses
    more than its language. Ranks go by value, largest first, then by item in byte order. Null text, lang and
    source count as empty ones; a source without kept terms still has its pairs; a language without kept terms
    has value 0 everywhere; a language of one source has no pairs. Repeated rows count as often as they occur.
    No rows give no rows. Other columns are ignored.
    """
    audit = Audit.build(docs, min_docs)
    order = [F.col("value").desc(), F.col("item").asc()]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    pairs = audit.pairs(slice_size).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    words = audit.marked().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pairs.select("*", rank).unionByName(words.select("*", rank).where(F.col("rank") <= top))
