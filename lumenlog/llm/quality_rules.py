"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

A rule rejects a document when a share exceeds a cutoff. Cutoffs come from labelled documents, per stratum: of a
fixed grid, those whose share of falsely rejected good documents is at most the rule's limit, by the exact
binomial bound: with k of n good documents rejected, P(Bin(n, limit) <= k) is at most the error level divided by
the number of rules and strata tested. Stricter cutoffs reject more, so along the grid the bound is one test
sequence and needs no further correction. The limits of the rules add up to ``risk``, so with probability
1 - ``error`` no stratum loses more than that share of its good documents.

Of the cutoffs that hold, the one that rejects most bad documents net of good ones is taken, the most lenient
if several do; a rule that gains nothing, or a stratum with too few labels, rejects nothing.
"""

from __future__ import annotations

import functools
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import stored

#: White space that separates words, and symbols (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Cutoffs in thousandths: a rule with cutoff c rejects shares above c.
GRID = tuple(range(25, 1000, 25))
RISK = 0.02
ERROR = 0.05


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures of each whole text, named with ``prefix``; a null text counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_lines (lines with a word), n_upper.
    """
    p = f"{prefix}m_"
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns({
        f"{p}words": F.array_remove(F.split(whole, "[\\x20\\x09-\\x0D]+"), ""),
        f"{p}lines": F.array_compact(F.transform(F.split(whole, "\n"), lambda x: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), x))),
        f"{p}chars": F.length(whole),
        f"{p}word_chars": F.length(_without(whole, SPACE)),
        f"{p}symbols": F.length(whole) - F.length(_without(whole, SYMBOLS)),
        f"{p}upper": F.length(whole) - F.length(_without(whole, UPPER)),
    })
    words = F.col(f"{p}words")
    # all windows of three words by hash and place; equal ones become neighbours
    step = step.withColumn(
        f"{p}windows",
        F.when(
            F.size(words) >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))),
        ),
    )
    windows = F.col(f"{p}windows")
    repeated = F.filter(
        windows, lambda x, k: ((k > 0) & (windows[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False))
    )
    step = step.withColumn(f"{p}places", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    places = F.col(f"{p}places")
    covered = F.aggregate(
        F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    out = {
        "n_words": F.size(words), "word_chars": F.col(f"{p}word_chars"), "n_symbols": F.col(f"{p}symbols"),
        "n_dup_lines": F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_chars": F.col(f"{p}chars"),
        "n_lines": F.size(f"{p}lines"), "n_upper": F.col(f"{p}upper"),
    }
    # a generator, so that later filters aren't pushed below and the measures aren't worked out twice
    once = F.inline(F.array(F.struct(*[c.cast("long").alias(prefix + n) for n, c in out.items()])))
    return step.select(*[F.col(f"`{c}`") for c in docs.columns], once)


def _share(part: Column, whole: Column) -> Column:
    """part / whole in whole thousandths, 0 without a whole."""
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")


def rules(prefix: str = "") -> dict[str, Column]:
    """The shares that rules are about, in thousandths."""
    c = lambda name: F.col(prefix + name)
    return {
        "symbols": _share(c("n_symbols"), c("n_chars")),
        "dup_lines": _share(c("n_dup_lines"), c("n_lines")),
        "repeats": _share(c("n_repeat_words"), c("n_words")),
        "upper": _share(c("n_upper"), c("word_chars")),
    }


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (F.col(f"{prefix}n_repeat_words") * 100 > n * 50)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from the logarithms of its terms; 1 where k reaches the mean."""
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct((n * log(1 - p)).alias("t"), F.exp(n * log(1 - p)).alias("s")),
        lambda acc, j: F.when(j > k, acc).otherwise(
            F.struct(
                (acc["t"] + F.log((n - j + 1) / j) + log(p / (1 - p))).alias("t"),
                (acc["s"] + F.exp(acc["t"] + F.log((n - j + 1) / j) + log(p / (1 - p)))).alias("s"),
            )
        ),
        lambda acc: acc["s"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(terms)


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff) from rows (stratum, good, and a share of each rule); see above."""
    names = list(rules())
    long = labelled.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in names])).alias("x"))
    # counts by share: at most 1001 rows a rule and stratum, whatever the number of documents
    counts = long.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.share").alias("share")).agg(
        F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad")
    )
    grid = counts.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in GRID])))
    over = F.col("share") > F.col("cutoff")
    tests = grid.groupBy("stratum", "rule", "cutoff").agg(
        F.sum("good").alias("n"), F.sum(F.when(over, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(over, F.col("bad")).otherwise(0)).alias("caught")
    )
    strata = tests.where("n > 0").agg(F.greatest(F.countDistinct("stratum"), F.lit(1)).alias("strata"))
    limit = risk / len(names)
    held = tests.join(F.broadcast(strata), F.lit(True)).where(  # one row
        (F.col("n") > 0) & (binomial_cdf(F.col("k"), F.col("n"), limit) * F.col("strata") * len(names) <= error)
    )
    best = F.row_number().over(Window.partitionBy("stratum", "rule").orderBy((F.col("caught") - F.col("k")).desc(), F.col("cutoff").desc()))
    return held.where("caught > k").withColumn("place", best).where("place = 1").select("stratum", "rule", "cutoff")


def _hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash")


def learned(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, c_<rule> of each rule) of the strata with cutoffs, from ``measures`` (id, stratum, hash, measures).

    Labels are those of ``labels`` (doc_id, quality); of rows labelled twice the smaller counts. The bound holds for
    independent trials, so a labelled id on several rows counts once, by the row with the smallest text hash, and
    equal texts of a stratum count once, as rejected if any label says so. Documents that fail the base rules are
    not calibrated on. Labels meet measures and not texts, so that no text is shuffled.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    some = measures.where(~base_failed()).select("id", "stratum", "hash", *[c.alias(n) for n, c in rules().items()]).join(known, "id")
    once = some.groupBy("id").agg(F.min(F.struct("hash", "stratum", "quality", *rules())).alias("row")).select("row.*")
    distinct = once.groupBy("stratum", "hash").agg(F.min(F.struct("quality", *rules())).alias("row"))
    labelled = distinct.select("stratum", (F.col("row.quality") == 1).alias("good"), *[f"row.{r}" for r in rules()])
    chosen = stored(cutoffs(stored(labelled, "quality-labelled")).coalesce(1), "quality-cutoffs")
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in rules()])


def decided(rows: DataFrame, chosen: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """Measured ``rows`` with ``base_failed`` and ``kept`` by the cutoffs of :func:`learned`. A null stratum is one of its own."""
    p = prefix
    wide = chosen.select(
        F.coalesce("stratum", F.lit("")).alias(f"{p}key"), F.col("stratum").isNull().alias(f"{p}none"), *[F.col(f"c_{r}").alias(f"{p}c_{r}") for r in rules()]
    )
    keyed = rows.withColumns({f"{p}key": F.coalesce(F.col(stratum).cast("string"), F.lit("")), f"{p}none": F.col(stratum).isNull()})
    joined = keyed.join(wide, [f"{p}key", f"{p}none"], "left")
    rejected = functools.reduce(lambda a, b: a | b, [F.coalesce(c > F.col(f"{p}c_{r}"), F.lit(False)) for r, c in rules(p).items()])
    out = joined.withColumn(f"{p}base_failed", base_failed(p)).withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~rejected)
    return out.drop(f"{p}key", f"{p}none", *[f"{p}c_{r}" for r in rules()])


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with all its columns, its measures, ``base_failed`` and ``kept``, the new ones named with ``prefix``.

    Texts are measured twice, to learn and to decide: neither a shuffle nor a stored table holds them.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"), _hash(text))
    return decided(measured(docs, text, prefix), learned(measured(narrow), labels), stratum, prefix)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, measures, base_failed, kept) of every row of ``docs`` (doc_id, text, ``stratum``).

    Null texts count as empty and fail the base rules, as all texts under 50 words do. Null ids and repeated rows
    come out as they are. Without labels only the base rules reject. Other columns are ignored. Texts are measured
    once and the measures stored.
    """
    narrow = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text", _hash("text"))
    rows = stored(measured(narrow).drop("text"), "quality-measures")
    chosen = learned(rows.withColumn("id", F.col("doc_id").cast("long")), labels)
    return decided(rows, chosen, "stratum").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
