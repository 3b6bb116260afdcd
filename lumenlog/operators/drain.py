"""Log template mining with a fixed-depth tree of templates.

A leaf holds the messages of one token count and first concrete token; leaves never interact.
Within a leaf a message joins the most similar template, making differing positions
wildcards, or starts a new template.

A message that fully matches some template changes nothing, and it matches from its first
occurrence on. So templates depend only on the first occurrence of each distinct masked
message, and the group of any row is the lowest-numbered template that fully matches it at the
row's time. Learning therefore runs over distinct messages in bounded rounds, and assignment
is a join with the log of template changes.

A leaf of few rows is learnt whole in one task, which also says what its messages belong to at which time; many such
leaves share a task. Texts cross the shuffle once for it and once as templates: rows are joined by digests, and
templates are numbered until the end.

In larger leaves, which templates a message fully matches is looked up in an index. A template is stored by the positions that
are wildcards in it or in the message and by its words at all others, so a message meets the templates with
its own words there and no others. Leaves are salted, so one that holds most rows is spread over many tasks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import WILDCARD, masked, prefix_token, tokens
from lumenlog.session import checkpointed, run_dir

SIMILARITY = 0.5
MAX_GROUPS = 128
ROUND_SIZE = 5_000
#: Messages of a task's group of leaves, about.
GROUP = 1_000
#: Time (us, tie) of templates known from before.
BEFORE = (-(1 << 63), None)
#: Rows of leaves that are learnt whole at once, about.
WHOLE = 8_000
#: Tasks that one leaf is spread over in sorts and joins, and distinct messages from which on it is in joins.
SALTS, SPREAD = 32, 1_000


def with_leaf(logs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Add the masked message, its tokens and the leaf it belongs to."""
    rows = logs.withColumn("masked", masked(F.col("message")))
    rows = rows.withColumn("tokens", tokens(F.col("masked")))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in scope or []]
    return rows.withColumns(
        {
            "prefix": prefix_token(F.col("tokens")),
            "leaf": F.sha1(
                F.concat_ws("\x1f", *parts, F.size("tokens").cast("string"), prefix_token(F.col("tokens")))
            ),
        }
    )


def _open(words: Column) -> Column:
    """Which positions are wildcards, a character each."""
    return F.array_join(F.transform(words, lambda w: F.when(w == WILDCARD, "1").otherwise("0")), "")


def _closed(words: Column, *shapes: str) -> Column:
    """The words at positions that no shape leaves open."""

    def word(w: Column, i: Column) -> Column:
        held = [F.substr(F.col(x), i + 1, F.lit(1)) == "0" for x in shapes]
        return F.when(held[0] & held[1], w).otherwise("")

    return F.array_join(F.transform(words, word), " ")


def _salt(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64("masked"), F.lit(SALTS)).cast("int").alias("_salt")


def full_matches(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """Every distinct message (leaf, masked, tokens, ...) with every template (leaf, template, ...) that it fully matches.

    The shapes of a leaf, not its messages, are paired; a pair of shapes says which positions must agree.
    """
    counts = messages.groupBy("leaf").agg(F.when(F.count(F.lit(1)) > SPREAD, SALTS).otherwise(1).alias("_salts"))
    salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")
    asked = messages.join(counts, "leaf").withColumn("_own", _open(F.col("tokens"))).withColumn("_salt", F.pmod(F.xxhash64("masked"), "_salts").cast("int"))
    held = templates.withColumn("_free", _open(F.col("template")))
    shapes = asked.select("leaf", "_own", "_salts").distinct().join(held.select("leaf", "_free").distinct(), "leaf")
    asked = asked.drop("_salts").join(shapes.select("leaf", "_own", "_free", salts), ["leaf", "_own", "_salt"]).withColumn("_words", _closed(F.col("tokens"), "_own", "_free"))
    held = held.join(shapes, ["leaf", "_free"]).withColumn("_words", _closed(F.col("template"), "_own", "_free")).select("*", salts).drop("_salts")
    return asked.join(held, ["leaf", "_own", "_free", "_words", "_salt"]).drop("_own", "_free", "_words", "_salt")


def _leaf_pass(similarity: float, max_groups: int | None):
    """Function: messages of a leaf (lists of words in the order of time) and the templates known there to changes and ordinals.

    Template changes (place of the message, ordinal, template), and the ordinal that each message joins. What tasks call
    is nested, so that they need not import this module.
    """

    def leaf_pass(messages: list, known: list) -> tuple[list[tuple], list[int]]:
        codes: dict[str, int] = {WILDCARD: 0}

        def encode(words) -> np.ndarray:
            return np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)

        known = [encode(t) for t in known]
        length = len(known[0]) if known else len(messages[0])
        table = np.zeros((max(16 if len(messages) > 16 else len(messages), 2 * len(known)), length), np.int64)  # templates, in the order of their numbers
        size = len(known)
        if known:
            table[:size] = np.stack(known)
        changes, joined = [], []
        for place, words in enumerate(messages):
            row = encode(words)
            best, share = -1, -1.0
            if size:
                held = table[:size]
                hits = ((held == row) | (held == 0) | (row == 0)).sum(axis=1)
                best = int(hits.argmax())
                share = float(hits[best] / length)
            if share < 1.0:
                if share < similarity and (max_groups is None or size < max_groups):
                    if size == len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[size] = row
                    best, size = size, size + 1
                else:
                    table[best] = np.where((table[best] == row) | (row == 0), table[best], 0)
                changes.append((place, best, table[best].copy()))
            joined.append(best)
        words_of = list(codes)
        return [(place, best, [words_of[i] for i in codes_]) for place, best, codes_ in changes], joined

    return leaf_pass


def _learner(similarity: float, max_groups: int | None):
    """Pandas function: distinct messages of some leaves, and the templates known there, to the leaves' template changes."""
    leaf_pass = _leaf_pass(similarity, max_groups)

    def leaf_changes(leaf: str, messages: list[tuple], known: list) -> list[tuple]:
        changes, _ = leaf_pass([words for _, _, words in messages], known)
        return [(leaf, *messages[place][:2], best, template) for place, best, template in changes]

    def learn(messages: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, list] = {}
        for leaf, template in known.sort_values(["leaf", "ordinal"])[["leaf", "template"]].itertuples(index=False):
            held.setdefault(leaf, []).append(template)
        asked: dict[str, list[tuple]] = {}
        rows = messages.sort_values(["first_us", "first_tie"])[["leaf", "first_us", "first_tie", "tokens"]]
        for leaf, *row in rows.itertuples(index=False):
            asked.setdefault(leaf, []).append(tuple(row))
        changes = [c for leaf, mine in asked.items() for c in leaf_changes(leaf, mine, held.get(leaf, []))]
        kinds = {"leaf": object, "since_us": "int64", "since_tie": object, "ordinal": "int32", "template": object}
        # Plain object columns: there may be no changes at all.
        return pd.DataFrame({name: pd.Series([c[k] for c in changes], dtype=kind) for k, (name, kind) in enumerate(kinds.items())})

    return learn


def current_templates(changes: DataFrame) -> DataFrame:
    """Newest template of each group."""
    return changes.groupBy("leaf", "ordinal").agg(
        F.max_by("template", F.struct("since_us", "since_tie")).alias("template")
    )


def _uncovered(pending: DataFrame, templates: DataFrame) -> DataFrame:
    """The pending messages that no template fully matches; the others change nothing any more."""
    covered = full_matches(pending.select("leaf", "masked", "tokens"), templates.select("leaf", "template"))
    return pending.join(covered.select("leaf", "masked").distinct(), ["leaf", "masked"], "left_anti")


def learn_templates(
    distinct: DataFrame, *, known: DataFrame | None = None, similarity: float = SIMILARITY,
    max_groups: int | None = MAX_GROUPS, round_size: int = ROUND_SIZE,
) -> DataFrame:
    """All template changes as (leaf, since_us, since_tie, ordinal, template), those of ``known`` included.

    ``distinct`` has one row per leaf and masked message with its first occurrence. A round hands
    the first ``round_size`` messages of a leaf to one task; before the next round every message
    the templates already cover is dropped in parallel, so a huge leaf shrinks quickly. The result is that
    of one pass in the order of time, whatever ``round_size`` is. ``max_groups`` None sets no limit to the
    templates of a leaf.
    """
    tie_type = distinct.schema["first_tie"].dataType.simpleString()
    schema = f"leaf string, since_us bigint, since_tie {tie_type}, ordinal int, template array<string>"
    learn = _learner(similarity, max_groups)
    spark = distinct.sparkSession
    pending = distinct.select("leaf", "masked", "tokens", "first_us", "first_tie")
    changes = spark.createDataFrame([], schema) if known is None else known.select("leaf", "since_us", F.col("since_tie").cast(tie_type), "ordinal", "template")
    pending = checkpointed(pending if known is None else _uncovered(pending, current_templates(changes)))
    while True:
        counts = pending.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        largest, held = counts.agg(F.max("n"), F.sum(F.least("n", F.lit(round_size)))).first()
        if not largest:
            return changes
        batch = _heads(pending, round_size)
        # many leaves have a few messages only, so a group has about a round of messages, not one leaf
        deal = F.pmod(F.xxhash64("leaf"), F.lit(math.ceil(held / min(round_size, GROUP)))).alias("deal")
        known_there = current_templates(changes).join(batch.select("leaf").distinct(), "leaf", "left_semi")
        new = batch.groupBy(deal).cogroup(known_there.groupBy(deal)).applyInPandas(learn, schema)
        changes = checkpointed(changes.unionByName(new))
        if largest <= round_size:
            return changes
        rest = pending.join(batch.select("leaf", "masked"), ["leaf", "masked"], "left_anti")
        pending = checkpointed(_uncovered(rest, current_templates(changes)))


def _heads(pending: DataFrame, size: int) -> DataFrame:
    """The first ``size`` messages of each leaf: first of each salt of a leaf, then of those that are left."""
    rows = pending.select("*", _salt(pending))
    for keys in (["leaf", "_salt"], ["leaf"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("first_us", "first_tie"))
        rows = rows.withColumn("_rn", place).where(F.col("_rn") <= size).drop("_rn")
    return rows.drop("_salt")


def _whole_leaf(similarity: float, max_groups: int | None):
    """Function: all rows (us, tie, masked, key) of a leaf and the templates known there, by number, to versions and steps.

    Versions (us, tie, ordinal, template, newest of its ordinal, new), and (key, steps) of each distinct message: from
    when on (us, tie) its rows belong to which version (ordinal, open places). That is the lowest ordinal that matched.
    """
    leaf_pass = _leaf_pass(similarity, max_groups)

    def open_places(template: list[str]) -> int:
        """A template's changes open places, so this tells its versions apart."""
        return sum(w == WILDCARD for w in template)

    def time_of(us, tie) -> tuple:
        """A row's time as Spark orders it: null comes first."""
        return us is not None, us or 0, tie is not None, 0 if tie is None else tie

    def whole_leaf(rows: list[tuple], known: list) -> tuple[list[tuple], list[tuple]]:
        first: dict[bytes, tuple] = {}
        last: dict[bytes, tuple] = {}
        for us, tie, masked_, key in rows:
            at = time_of(us, tie)
            if key not in first or at < first[key][0]:
                first[key] = (at, masked_, us, tie, key)
            if key not in last or at > last[key]:
                last[key] = at
        order = sorted(first.values(), key=lambda x: x[:2])
        messages = [masked_.split(" ") if masked_ else [WILDCARD] for _, masked_, *_ in order]
        alone = len(order) == 1 and not known
        changes, joined = ([(0, 0, messages[0])], [0]) if alone else leaf_pass(messages, known)
        versions = [(*BEFORE, k, list(t)) for k, t in enumerate(known)] + [(*order[place][2:4], ordinal, t) for place, ordinal, t in changes]
        newest = {ordinal: k for k, (_, _, ordinal, _) in enumerate(versions)}
        wide = [open_places(t) for _, _, t in changes]
        now = {k: open_places(t) for k, t in enumerate(known)}
        found, done = [], 0
        for place, (at, _, us, tie, key) in enumerate(order):
            while done < len(changes) and changes[done][0] <= place:
                now[changes[done][1]] = wide[done]
                done += 1
            steps = [(us, tie, joined[place], now[joined[place]])]
            if last[key] > at or (place + 1 < len(order) and order[place + 1][0] == at):
                for (where, ordinal, template), places in zip(changes[done:], wide[done:]):
                    then = order[where][0]
                    if then > last[key]:
                        break
                    if ordinal <= steps[-1][2] and all(a == b or WILDCARD in (a, b) for a, b in zip(template, messages[place])):
                        step = (*order[where][2:4], ordinal, places)
                        steps = [step] if then == at else [*steps, step]
            found.append((key, steps))
        return [(*v, newest[v[2]] == k, k >= len(known)) for k, v in enumerate(versions)], found

    return whole_leaf


def _learn_whole(rows: DataFrame, known: DataFrame | None, groups: int, similarity: float, max_groups: int | None) -> DataFrame:
    """Versions (leaf, since_us, since_tie, ordinal, template, newest, new) and, with a null leaf, (key, steps), stored.

    ``rows`` (leaf, us, tie, masked, key) and ``known`` (leaf, ordinal, template) are dealt to ``groups`` of leaves.
    """
    tie_type = rows.schema["tie"].dataType.simpleString()
    schema = (
        f"leaf binary, since_us bigint, since_tie {tie_type}, ordinal int, template array<string>, newest boolean, new boolean, "
        f"key binary, steps array<struct<since_us: bigint, since_tie: {tie_type}, ordinal: int, open: int>>"
    )
    names = ["leaf", "since_us", "since_tie", "ordinal", "template", "newest", "new", "key", "steps"]
    step = ["since_us", "since_tie", "ordinal", "open"]
    whole_leaf = _whole_leaf(similarity, max_groups)

    def learn(messages: pa.Table, held: pa.Table | None = None) -> pa.Table:
        tie = messages.schema.field("tie").type
        ours: dict[bytes, list] = {}
        for leaf, *row in zip(*(messages[c].to_pylist() for c in ("leaf", "us", "tie", "masked", "key"))):
            ours.setdefault(leaf, []).append(row)
        theirs: dict[bytes, list] = {}
        if held is not None:
            for leaf, ordinal, template in zip(*(held[c].to_pylist() for c in ("leaf", "ordinal", "template"))):
                theirs.setdefault(leaf, []).append((ordinal, template))
        out: list[list] = [[] for _ in names]
        for leaf, mine in ours.items():
            versions, found = whole_leaf(mine, [t for _, t in sorted(theirs.get(leaf, []))])
            for row in [(leaf, *v, None, None) for v in versions] + [(*[None] * 7, k, [dict(zip(step, s)) for s in x]) for k, x in found]:
                for column, value in zip(out, row):
                    column.append(value)
        steps = pa.list_(pa.struct([("since_us", pa.int64()), ("since_tie", tie), ("ordinal", pa.int32()), ("open", pa.int32())]))
        kinds = [pa.binary(), pa.int64(), tie, pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.binary(), steps]
        return pa.table([pa.array(column, kind) for column, kind in zip(out, kinds)], names=names)

    deal = F.pmod(F.xxhash64("leaf"), F.lit(max(1, groups))).alias("deal")
    if known is None:
        learnt = rows.groupBy(deal).applyInArrow(lambda messages: learn(messages), schema)
    else:
        learnt = rows.groupBy(deal).cogroup(known.groupBy(deal)).applyInArrow(lambda messages, held: learn(messages, held), schema)
    return _stored(learnt, "drain-leaves")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_rounds(rows: DataFrame, known: DataFrame | None, **options) -> tuple[DataFrame, DataFrame]:
    """Template changes and (key, steps) of large leaves, stored; ``rows`` (leaf, masked, _us, _tie, _key)."""
    distinct = rows.groupBy("leaf", "masked").agg(F.min(F.struct("_us", "_tie")).alias("_first"), F.first("_key").alias("key"))
    distinct = distinct.select(
        "leaf", "masked", tokens(F.col("masked")).alias("tokens"), "key",
        F.col("_first._us").alias("first_us"), F.col("_first._tie").alias("first_tie"),
    )
    distinct = checkpointed(distinct)
    changes = _stored(learn_templates(distinct, known=known, **options), "drain-changes")
    log = changes.select("leaf", F.struct("since_us", "since_tie").alias("since"), "ordinal", "template", _wide(F.col("template")).alias("open"))
    step = F.struct(F.col("since.since_us").alias("since_us"), F.col("since.since_tie").alias("since_tie"), "ordinal", "open")
    steps = full_matches(distinct.select("leaf", "masked", "tokens", "key"), log).groupBy("key")
    return changes, _stored(steps.agg(F.array_sort(F.collect_list(step)).alias("steps")), "drain-steps")


def _wide(template: Column) -> Column:
    return F.size(F.filter(template, lambda w: w == WILDCARD))


def _cluster(leaf: Column, ordinal: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", leaf, ordinal.cast("string"))), 1, 16)


def mined(
    logs: DataFrame, *, scope: list[str] | None = None, tie: str | None = None, known: DataFrame | None = None,
    similarity: float = SIMILARITY, max_groups: int | None = MAX_GROUPS, round_size: int = ROUND_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """Every log row with cluster_id, ordinal, template_at (as of the row's time) and template_final, and the template changes.

    ``known`` holds templates (leaf, ordinal, template) from before: they are older than all rows, whatever the
    rows' times are. Leaves of at most ``round_size`` rows are learnt whole, others in rounds.
    """
    tie = tie or ("log_id" if "log_id" in logs.columns else "masked")
    rows = with_leaf(logs, scope)
    # never null, and said to be so: else a filter on it would mask each message over and over
    key = F.coalesce(F.unhex(F.sha1(F.concat_ws("\x1f", "leaf", "masked"))), F.lit(b""))
    rows = rows.withColumns({"_us": F.unix_micros("timestamp"), "_tie": F.col(tie), "_key": key})
    masked_once = _stored(rows.select("leaf", "masked", "_us", "_tie", "_key"), "drain-rows")
    sizes = masked_once.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") <= round_size
    sizes = _stored(sizes.groupBy(F.when(small, None).otherwise(F.col("leaf")).alias("leaf")).agg(F.sum("n").alias("n")), "drain-leaf-sizes")
    large = sizes.where("leaf IS NOT NULL").select("leaf")
    few, hot = sizes.agg(F.sum(F.when(F.col("leaf").isNull(), F.col("n"))), F.count("leaf")).first()
    tie_type = rows.schema["_tie"].dataType.simpleString()
    old = None
    if known is not None:
        before = [F.lit(x).cast(kind).alias(name) for x, kind, name in zip(BEFORE, ("long", tie_type), ("since_us", "since_tie"))]
        known = known.select("leaf", "ordinal", "template")
        old = known.select("leaf", *before, "ordinal", "template")
    parts, versions, finals, new = [], [], [], []
    if few:
        whole = masked_once.join(large, "leaf", "left_anti") if hot else masked_once
        held = known.join(large, "leaf", "left_anti") if known is not None and hot else known
        whole = whole.select(F.unhex("leaf").alias("leaf"), F.col("_us").alias("us"), F.col("_tie").alias("tie"), "masked", F.col("_key").alias("key"))
        held = None if held is None else held.withColumn("leaf", F.unhex("leaf"))
        learnt = _learn_whole(whole, held, math.ceil(few / WHOLE), similarity, max_groups)
        parts.append(learnt.where("leaf IS NULL").select("key", "steps"))
        learnt = learnt.where("leaf IS NOT NULL").withColumn("leaf", F.lower(F.hex("leaf")))
        versions.append(learnt.select("leaf", "ordinal", "template"))
        finals.append(learnt.where("newest").select("leaf", "ordinal", "template"))
        new.append(learnt.where("new").select("leaf", "since_us", "since_tie", "ordinal", "template"))
    if hot or not few:
        held = None if old is None else old.join(large, "leaf", "left_semi")
        changes, steps = _in_rounds(
            masked_once.join(large, "leaf", "left_semi"), held, similarity=similarity, max_groups=max_groups, round_size=round_size
        )
        parts.append(steps)
        versions.append(changes.select("leaf", "ordinal", "template"))
        finals.append(current_templates(changes))
        new.append(changes.where(~F.col("since_us").eqNullSafe(BEFORE[0])))

    def union(tables: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, tables)

    changes = union([*new, *([] if old is None else [old])]).select("leaf", "since_us", "since_tie", "ordinal", "template")
    text = F.array_join("template", " ")
    cluster = _cluster(F.col("leaf"), F.col("ordinal")).alias("cluster_id")
    final = union(finals).select(cluster, text.alias("text")).groupBy("cluster_id").agg(F.first("text").alias("template_final"))
    then = union(versions).select(cluster, _wide(F.col("template")).alias("_open"), text.alias("text"))
    then = then.groupBy("cluster_id", "_open").agg(F.first("text").alias("template_at"))
    at = F.struct(F.col("_us").alias("since_us"), F.col("_tie").alias("since_tie"))
    joined = rows.drop("tokens", "prefix").join(union(parts).withColumnRenamed("key", "_key"), "_key")
    past = F.filter("steps", lambda e: F.struct(e["since_us"].alias("since_us"), e["since_tie"].alias("since_tie")) <= at)
    lowest = joined.withColumn("_past", past).withColumn("ordinal", F.array_min(F.transform("_past", lambda e: e["ordinal"])))
    hit = F.element_at(F.filter("_past", lambda e: e["ordinal"] == F.col("ordinal")), -1)["open"]
    out = lowest.withColumns({"_open": hit, "cluster_id": _cluster(F.col("leaf"), F.col("ordinal"))})
    out = out.join(then, ["cluster_id", "_open"], "left").join(final, "cluster_id", "left")
    kept = [c for c in rows.columns if c not in ("leaf", "masked", "tokens", "prefix", "_us", "_tie", "_key")]
    return out.select("leaf", "masked", *kept, "ordinal", "cluster_id", "template_at", "template_final"), changes


def assign_templates(logs: DataFrame, **options) -> DataFrame:
    """Add cluster_id, template_at (as of the row's time) and template_final to every log row; see :func:`mined`."""
    return mined(logs, **options)[0].drop("ordinal")


def top_templates(assigned: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent templates."""
    counts = assigned.groupBy("cluster_id").agg(
        F.first("template_final").alias("template"), F.count(F.lit(1)).alias("count")
    )
    return counts.orderBy(F.desc("count"), "template", "cluster_id").limit(n)
