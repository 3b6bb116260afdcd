"""Similar past incidents by a weighted mix of exact, prefix, token and ordinal matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.enrich import SEVERITIES
from lumenlog.session import checkpointed

# Weights, token pattern and stop words.
WEIGHTS = {
    "service_match": 0.25,
    "category_match": 0.15,
    "severity_exact": 0.10,
    "environment_match": 0.05,
    "fingerprint_prefix": 0.15,
    "title_jaccard": 0.20,
    "severity_distance": 0.10,
}
PREFIX_LENGTH = 16
TOKEN_PATTERN = "[a-zA-Zа-яА-Я0-9_-]+"
STOP_WORDS = ["anomaly", "incident", "error", "alert", "warning"]

#: Classes in one block, on average.
BLOCK = 256
#: Title words that more classes have are common.
COMMON = 64
#: Tasks that blocks and slices are dealt to at most.
MAX_TASKS = 4096

TRAITS = ["service", "category", "severity", "environment"]


def title_tokens(title: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    words = F.transform(F.filter(words, lambda w: F.length(w) > 2), F.lower)
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS])))


def jaccard(a: Column, b: Column, sizes: tuple[Column, Column] | None = None) -> Column:
    """Shared part of two lists of words; ``sizes`` count words that are left out of the lists as well."""
    shared = F.size(F.array_intersect(a, b))
    m, n = sizes or (F.size(a), F.size(b))
    return F.when((m == 0) | (n == 0), F.lit(0.0)).otherwise(shared / (m + n - shared))


def prefix_score(a: Column, b: Column) -> Column:
    """Length of the common prefix of the first 16 characters, as a share of 16."""
    same = [
        ((F.length(a) >= i) & (F.length(b) >= i) & (F.substring(a, 1, i) == F.substring(b, 1, i))).cast("int")
        for i in range(1, PREFIX_LENGTH + 1)
    ]
    return F.coalesce(sum(same, F.lit(0)) / F.lit(PREFIX_LENGTH), F.lit(0.0))


def severity_closeness(a: Column, b: Column) -> Column:
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    pa = F.array_position(order, F.lower(F.coalesce(a, F.lit("info"))))
    pb = F.array_position(order, F.lower(F.coalesce(b, F.lit("info"))))
    return F.when((pa == 0) | (pb == 0), F.lit(0.0)).otherwise(
        1.0 - F.abs(pa - pb) / F.lit(len(SEVERITIES) - 1)
    )


def exact(a: Column, b: Column) -> Column:
    return F.coalesce((F.lower(a) == F.lower(b)).cast("double"), F.lit(0.0))


def _breakdown(a, b, sized: bool = False) -> dict[str, Column]:
    """Weighted parts; ``a`` and ``b`` map a trait name to a column of either side, if ``sized`` their numbers of words too."""
    parts = {
        "service_match": exact(a("service"), b("service")),
        "category_match": exact(a("category"), b("category")),
        "severity_exact": exact(a("severity"), b("severity")),
        "environment_match": exact(a("environment"), b("environment")),
        "fingerprint_prefix": prefix_score(a("fingerprint"), b("fingerprint")),
        "title_jaccard": jaccard(a("tokens"), b("tokens"), (a("size"), b("size")) if sized else None),
        "severity_distance": severity_closeness(a("severity"), b("severity")),
    }
    return {name: part * WEIGHTS[name] for name, part in parts.items()}


def similar_to(incidents: DataFrame, source_id: str, k: int = 5, min_score: float = 0.1) -> DataFrame:
    """The ``k`` incidents most similar to one incident, out of all incidents.

    The source is one row and enters the plan as constants; the table is then read once without
    a shuffle until the final top-k.
    """
    cards = incidents.withColumn("tokens", title_tokens(F.col("title")))
    fields = [*TRAITS, "fingerprint", "tokens"]
    found = cards.where(F.col("incident_id") == source_id).select(*fields).first()
    if found is None:
        raise ValueError(f"no incident {source_id!r}")

    def constant(c):
        if c == "tokens":
            return F.array(*[F.lit(t) for t in found[c]]).cast("array<string>")
        return F.lit(found[c]).cast("string")

    rows = cards.where(F.col("incident_id") != source_id).withColumns(
        _breakdown(constant, lambda c: F.col(c))
    )
    total = sum((F.col(p) for p in WEIGHTS), F.lit(0.0))
    rows = rows.withColumn("score", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    # The threshold follows the top-k: before it, the filter would be pushed below the projection
    # and score every row twice.
    best = rows.orderBy(F.desc(F.round("score", 9)), "incident_id").limit(k)
    return best.where(F.col("score") >= min_score).select("incident_id", "score", *WEIGHTS)


def _smallest_ids(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The rows of the ``k`` smallest incident ids of each key; Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("incident_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _near_classes(classes: DataFrame, pool: DataFrame, k: int, min_score: float) -> DataFrame:
    """(cid, other, base, floor): for each kind the kinds of the pool that can hold one of its top ``k`` incidents.

    ``pool`` (cid, t, n) is dealt into blocks of about ``BLOCK`` kinds, each an array. A kind meets a block in
    one row, which keeps only what can still reach the ``k``-th best base of that block plus the fingerprint's
    weight; the best such floor over all blocks then cuts again.
    """
    blocks, slices = (-(-max(side.count(), 1) // BLOCK) for side in (pool, classes))
    lists = pool.groupBy(F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("cid", "t", "n")).alias("list"))
    # a block and a slice of classes meet in one key: the rows are small and their work is not, so tasks are dealt by number
    tasks = min(blocks * slices, MAX_TASKS)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    lists = lists.withColumn("slice", all_of(slices)).repartition(tasks, "block", "slice")
    met = classes.withColumn("slice", F.pmod(F.xxhash64("cid"), F.lit(slices))).withColumn("block", all_of(blocks))
    met = met.repartition(tasks, "block", "slice").join(lists, ["block", "slice"])

    def mine(c: str) -> Column:
        return F.lit(None).cast("string") if c == "fingerprint" else F.col(f"a.{c}")

    def rated(b: Column) -> Column:
        other = lambda c: F.lit(None).cast("string") if c == "fingerprint" else b["t"][c]
        base = sum(_breakdown(mine, other, sized=True).values(), F.lit(0.0))
        return F.struct((-base).alias("minus"), b["cid"].alias("other"), b["n"].alias("n"))

    def count_up(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        here = F.struct(seen.alias("seen"), F.when(seen >= k, -x["minus"]).otherwise(F.lit(-1.0)).alias("floor"))
        return F.when(acc["seen"] >= k, acc).otherwise(here)

    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1.0).alias("floor"))
    kth = F.aggregate(F.slice("list", 1, k), start, count_up, lambda acc: acc["floor"])
    reach = WEIGHTS["fingerprint_prefix"]
    short = F.filter("list", lambda x: F.lit(reach) - x["minus"] >= F.col("floor"))
    local = checkpointed(
        met.select("cid", F.array_sort(F.transform("list", rated)).alias("list"))
        .withColumn("floor", F.greatest(kth, F.lit(float(min_score))) - 1e-9)
        .select("cid", "floor", short.alias("short"))
    )
    floors = local.groupBy("cid").agg(F.max("floor").alias("floor"))
    rows = local.select("cid", F.inline("short")).join(floors, "cid").withColumn("base", -F.col("minus"))
    return rows.where(F.col("base") + reach >= F.col("floor")).select("cid", "other", "base", "floor")


def _kinds(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, a, kid, t) of the classes (cid, a), and (cid, token) of the rare words of their titles.

    A kind holds the classes that differ in rare words only: its traits ``t`` have the common words and the number of
    all words. Two classes without a common rare word are as similar as their kinds.
    """
    words = classes.select("cid", F.explode("a.tokens").alias("token"))
    common = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("token")
    words = checkpointed(words.join(common.withColumn("common", F.lit(True)), "token", "left"))
    kept = words.groupBy("cid").agg(F.array_sort(F.collect_list(F.when(F.col("common"), F.col("token")))).alias("kept"), F.count("*").alias("size"))
    rows = classes.join(kept, "cid", "left")
    some = F.coalesce("kept", F.array().cast("array<string>"))
    parts = F.struct(*[f"a.{c}" for c in TRAITS], some.alias("tokens"), F.coalesce("size", F.lit(0)).alias("size"))
    rows = rows.select("cid", "a", parts.alias("t"))
    return rows.withColumn("kid", F.md5(F.to_json("t"))), words.where(F.col("common").isNull()).select("cid", "token")


def _alike(classes: DataFrame, held: DataFrame, words: DataFrame) -> DataFrame:
    """(cid, other, base): classes that share a rare word, at most ``COMMON`` a word, and how alike they are without fingerprints."""
    pairs = words.join(words.withColumnRenamed("cid", "other"), "token").select("cid", "other").distinct()
    pairs = pairs.join(classes.select("cid", "a"), "cid").join(held.select(F.col("cid").alias("other"), "t"), "other")
    side = lambda name: lambda c: F.lit(None).cast("string") if c == "fingerprint" else F.col(f"{name}.{c}")
    return pairs.select("cid", "other", sum(_breakdown(side("a"), side("t")).values(), F.lit(0.0)).alias("base"))


def similar_to_recent(
    incidents: DataFrame, pool_size: int | None = None, k: int = 5, min_score: float = 0.1
) -> DataFrame:
    """For every incident the ``k`` most similar ones of all incidents, or of the newest ``pool_size`` if given.

    Incidents with equal traits and title words form a class; classes that differ in words of at most ``COMMON``
    classes form a kind. Kinds are compared, block by block, without the fingerprint, which can add at most its
    weight; classes that share a rare word are compared one by one. Of each kind or class and fingerprint prefix of
    0 to 16 characters the smallest k+1 ids are indexed; an incident that shares exactly n characters and belongs to
    the top is among those indexed under its n characters, so lookups by prefix find the whole top without meeting
    other members. As members of its kind an incident with a common rare word counts too low, never too high.
    Work grows with the square of distinct kinds, not of incidents or classes.
    """
    traits = [*TRAITS, "tokens"]
    prefix = F.substring("fingerprint", 1, PREFIX_LENGTH).alias("fp16")
    tokened = incidents.withColumn("tokens", title_tokens(F.col("title")))
    cards = checkpointed(
        tokened.select("incident_id", "updated_at", *traits, prefix, F.md5(F.to_json(F.struct(*traits))).alias("cid"))
    )
    classes, words = _kinds(cards.groupBy("cid").agg(F.first(F.struct(*traits)).alias("a")))
    classes = checkpointed(classes)
    cards = checkpointed(cards.select("cid", "fp16", "incident_id", "updated_at").join(classes.select("cid", "kid"), "cid"))
    pool = cards if pool_size is None else cards.orderBy(F.desc("updated_at"), "incident_id").limit(max(1, pool_size))
    most = k + 1  # the incident itself may be among them
    held = classes if pool_size is None else classes.join(pool.select("cid").distinct(), "cid", "left_semi")
    kinds = classes.groupBy("kid").agg(F.first("t").alias("a")).select(F.col("kid").alias("cid"), "a")
    known = pool.groupBy("kid").agg(F.count("*").alias("n")).join(kinds.select(F.col("cid").alias("kid"), F.col("a").alias("t")), "kid")
    near = checkpointed(_near_classes(kinds, known.select(F.col("kid").alias("cid"), "t", "n"), most, min_score))
    pairs = _alike(classes, held.select("cid", F.col("a").alias("t")), words)
    floors = classes.select("cid", "kid").join(near.groupBy(F.col("cid").alias("kid")).agg(F.max("floor").alias("floor")), "kid", "left")
    pairs = pairs.join(floors.select("cid", F.coalesce("floor", F.lit(float(min_score) - 1e-9)).alias("floor")), "cid")

    best = Window.partitionBy("cid", "fp16").orderBy(F.desc("key"), "id")
    found = _looked_up(cards, pool, near, "kid", most).unionByName(_looked_up(cards, pool, pairs, "cid", most))
    found = found.groupBy("cid", "fp16", "id").agg(F.max("score").alias("score"))
    top = found.withColumn("key", F.round("score", 9)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    rated = top.groupBy("cid", "fp16").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))

    mine = cards.select("cid", "fp16", "incident_id")
    others = F.filter("best", lambda m: m["id"] != F.col("incident_id"))
    return (
        mine.join(rated, (mine["cid"] == rated["cid"]) & mine["fp16"].eqNullSafe(rated["fp16"]))
        .select("incident_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "m"))
        .select("incident_id", F.col("m.id").alias("similar_id"), "m.score", (F.col("pos") + 1).alias("rank"))
    )


def _looked_up(cards: DataFrame, pool: DataFrame, near: DataFrame, group: str, most: int) -> DataFrame:
    """(cid, fp16, id, score): for each class and prefix of ``cards`` the incidents of ``near`` (cid, other, base, floor) groups.

    ``group`` names the column that the groups of ``near`` stand in: an incident's class or kind.
    """
    levels = F.explode(F.sequence(F.lit(0), F.coalesce(F.length("fp16"), F.lit(0)))).alias("shared")
    start = F.when(F.col("shared") > 0, F.expr("substring(fp16, 1, shared)")).otherwise("").alias("start")
    members = _smallest_ids(pool.select(F.col(group).alias("other"), "fp16", "incident_id"), ["other", "fp16"], most).select("*", levels)
    index = _smallest_ids(members.select("other", start, "incident_id"), ["other", "start"], most)
    index = index.groupBy("other", "start").agg(F.collect_list("incident_id").alias("ids"))

    # Incidents of one class and prefix have the same scores: rate each prefix once.
    score = F.least(F.col("base") + WEIGHTS["fingerprint_prefix"] * (F.col("shared") / F.lit(PREFIX_LENGTH)), F.lit(1.0))
    mine = cards.select("cid", "fp16", F.col(group).alias("_group")).distinct()
    least = F.greatest(F.lit(0), F.ceil((F.col("floor") - F.col("base")) / F.lit(WEIGHTS["fingerprint_prefix"]) * PREFIX_LENGTH - 1e-6).cast("int"))
    some = F.when(F.coalesce(F.length("fp16"), F.lit(0)) >= least, F.sequence(least, F.coalesce(F.length("fp16"), F.lit(0))))
    asked = mine.join(near.withColumnRenamed("cid", "_group"), "_group").select("*", F.explode(some).alias("shared")).withColumn("score", score)
    asked = asked.where(F.col("score") >= F.col("floor")).select("cid", "fp16", "other", start, "score")
    return asked.join(index, ["other", "start"]).select("cid", "fp16", F.explode("ids").alias("id"), "score")
