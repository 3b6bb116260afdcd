"""Template mining against a plain sequential pass."""

import os
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lumenlog.functions import text as tx
from lumenlog.operators import drain as dr
from lumenlog.session import shared_dir

WILD = "<*>"


def sequential(rows, threshold=0.5, cap=128):
    """One message after the other, written independently of the operator."""
    leaves, out = {}, []
    for words in rows:
        first = next((w for w in words if w != WILD), "<no-prefix>")
        groups = leaves.setdefault((len(words), first), [])

        def share(t):
            return sum(a == b or a == WILD or b == WILD for a, b in zip(t, words)) / len(words)

        best = max(range(len(groups)), key=lambda i: (share(groups[i]), -i)) if groups else None
        if best is not None and (share(groups[best]) >= threshold or len(groups) >= cap):
            groups[best] = [a if a == b or WILD in (a, b) else WILD for a, b in zip(groups[best], words)]
        else:
            groups.append(list(words))
            best = len(groups) - 1
        out.append(((len(words), first, best), " ".join(groups[best])))
    final = {(*leaf, i): " ".join(t) for leaf, groups in leaves.items() for i, t in enumerate(groups)}
    return out, final


def _messages(n=400, seed=5):
    rnd = random.Random(seed)
    verbs, things = ["open", "close", "read"], ["file", "socket", "queue", "pipe", "lock"]
    return [
        f"{rnd.choice(verbs)} {rnd.choice(things)} {rnd.choice('abcdefgh')} {rnd.choice('xyz')} {rnd.choice(['ok', 'bad', str(rnd.random())])}"
        for _ in range(n)
    ]


def _check(make, messages, **options):
    df = make([(i, m, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}") for i, m in enumerate(messages)],
              "log_id bigint, message string, timestamp timestamp")
    got = {r["log_id"]: r for r in dr.assign_templates(df, **options).collect()}
    masked = [m for m in dr.with_leaf(df).orderBy("log_id").select("tokens").toPandas()["tokens"]]
    cap = options.get("max_groups", 128) or len(messages)
    want, final = sequential([list(t) for t in masked], cap=cap)
    assert len(got) == len(messages)
    assert [got[i]["template_at"] for i in range(len(messages))] == [t for _, t in want]
    assert [got[i]["template_final"] for i in range(len(messages))] == [final[k] for k, _ in want]
    ids = {}
    for i, (key, _) in enumerate(want):
        assert ids.setdefault(key, got[i]["cluster_id"]) == got[i]["cluster_id"]
    assert len(set(ids.values())) == len(ids)


def test_equals_sequential_pass(make):
    _check(make, _messages())


def test_rounds_give_the_same_result(make):
    _check(make, _messages(300), round_size=7)


def test_full_leaf_merges_into_the_closest_group(make):
    _check(make, _messages(300, seed=9), max_groups=3, round_size=11)


def test_units_collapse(make):
    rows = [(i, f"took {v}", f"2024-01-01 00:00:0{i}") for i, v in enumerate(["100ms", "7", "3s", "2.5"])]
    df = make(rows, "log_id bigint, message string, timestamp timestamp")
    got = dr.top_templates(dr.assign_templates(df)).collect()
    assert [(r["template"], r["count"]) for r in got] == [("took <*>", 4)]


def test_a_hot_leaf_is_spread(spark):
    """A leaf with four fifths of the distinct messages: sorts and joins deal it to many tasks."""
    rows = spark.range(20_000).selectExpr(
        "id AS log_id", "timestamp_micros(id) AS timestamp",
        "concat(CASE WHEN id % 5 < 4 THEN 'get' ELSE concat('verb', char(97 + id % 26)) END, ' part ', char(97 + id % 7), char(97 + id % 11), ' k', hex(id), 'z') AS message",
    )
    messages = dr.with_leaf(rows).select("leaf", "masked", "tokens").distinct()
    hot = messages.groupBy("leaf").count().orderBy("count", ascending=False).first()
    assert hot["count"] > 15_000
    assert messages.where(messages.leaf == hot["leaf"]).select(dr._salt(messages)).distinct().count() == dr.SALTS
    pending = messages.selectExpr("*", "1L AS first_us", "masked AS first_tie")
    heads = dr._heads(pending, 100)
    assert heads.groupBy("leaf").count().agg({"count": "max"}).first()[0] == 100


def test_full_matches_equal_all_pairs(spark):
    rnd = random.Random(2)
    words = lambda: [rnd.choice(["a", "b", WILD]) for _ in range(4)]
    messages = {" ".join(w): w for w in (words() for _ in range(60))}
    templates = [words() for _ in range(30)]
    left = spark.createDataFrame([("l", m, w) for m, w in messages.items()], "leaf string, masked string, tokens array<string>")
    right = spark.createDataFrame([("l", i, w) for i, w in enumerate(templates)] + [("other", 99, words())], "leaf string, ordinal int, template array<string>")
    got = {(r.masked, r.ordinal) for r in dr.full_matches(left, right).collect()}
    want = {
        (m, i) for m, w in messages.items() for i, t in enumerate(templates) if all(x == y or WILD in (x, y) for x, y in zip(w, t))
    }
    assert got == want


def test_no_limit_to_the_templates_of_a_leaf(make):
    messages = [f"start {chr(97 + i // 26)}{chr(97 + i % 26)} q{chr(97 + i % 26)}{chr(97 + i // 26)}x {chr(98 + i % 20)}{chr(97 + i // 20)}y" for i in range(200)]
    _check(make, messages, max_groups=None, round_size=50)


def test_a_task_learns_many_leaves():
    """Each leaf as if it were alone, though one call gets messages and known templates of several."""
    rows = [("x", 1, 1, ["a", "b", "c"]), ("y", 2, 2, ["a", "b"]), ("x", 3, 3, ["a", "b", "d"]), ("y", 4, 4, ["k", "z"]), ("z", 5, 5, ["o"])]
    messages = pd.DataFrame(rows, columns=["leaf", "first_us", "first_tie", "tokens"])
    known = pd.DataFrame([("y", 0, ["a", "b"])], columns=["leaf", "ordinal", "template"])
    learn = dr._learner(0.6, 128)
    got = sorted((r.leaf, r.since_us, r.ordinal, list(r.template)) for r in learn(messages, known).itertuples())
    assert got == [("x", 1, 0, ["a", "b", "c"]), ("x", 3, 0, ["a", "b", WILD]), ("y", 4, 1, ["k", "z"]), ("z", 5, 0, ["o"])]


def test_matches_are_the_same_spread_or_not(spark, monkeypatch):
    left = spark.createDataFrame([(f"l{k}", f"m{k}", ["m", str(k)]) for k in range(50)], "leaf string, masked string, tokens array<string>")
    right = left.selectExpr("leaf", "0 AS ordinal", "tokens AS template")
    for spread in (0, 1_000):
        monkeypatch.setattr(dr, "SPREAD", spread)
        assert sorted(r.leaf for r in dr.full_matches(left, right).collect()) == sorted(f"l{k}" for k in range(50))


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path.removeprefix("file:")) for f in files)


def test_lines_of_prose_take_little_disk(spark):
    """Texts that are nearly all templates of their own are kept once and compressed, not once a step."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("aeioustrnl", k=rnd.randint(2, 8))) for _ in range(3000)]
    lines = [" ".join(rnd.choices(words, k=rnd.randint(5, 60))) for _ in range(6000)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "log_id bigint, message string").withColumn("timestamp", F.timestamp_seconds("log_id"))
    before = _bytes(shared_dir(spark))
    assert len(dr.top_templates(dr.assign_templates(df), 5).collect()) == 5
    assert _bytes(shared_dir(spark)) - before < 2 * sum(map(len, lines))


def test_known_templates_whole_or_in_rounds(make):
    """Leaves learnt whole and in rounds give the same rows and changes, with templates from before and repeated rows."""
    messages = [m for m in _messages(120, seed=8) for _ in range(2)]
    random.Random(1).shuffle(messages)
    df = make([(i, m, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}") for i, m in enumerate(messages)], "log_id bigint, message string, timestamp timestamp")
    known = dr.with_leaf(df).where("log_id < 3").selectExpr("leaf", "row_number() over (partition by leaf order by log_id) - 1 AS ordinal", "tokens AS template")

    def result(round_size):
        rows, changes = dr.mined(df, known=known, round_size=round_size)
        return (
            sorted((r.log_id, r.ordinal, r.cluster_id, r.template_at, r.template_final) for r in rows.collect()),
            sorted((r.leaf, r.since_us, str(r.since_tie), r.ordinal, " ".join(r.template)) for r in changes.collect()),
        )

    whole, rounds, mixed = result(1000), result(1), result(80)
    assert len(whole[0]) == len(messages) and whole == rounds == mixed


def test_messages_without_variable_parts_are_masked_alike(spark):
    texts = ["plain  words", "tab\tx", "a\u2003b c", "\u0663 x", "it's 'so'", 'say "a  b"', "dead-beef", " 12ms  left ", "\x1c\x1fx\ty  z", "", None, "a\n\n b\x85c", "0xff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(tx.masked(F.col("t")), tx.strip(tx._apply(tx.safe_lower(F.col("t")), tx.MASK_RULES))).collect()]
    assert [a for a, _ in got] == [b for _, b in got]
    assert got[0][0] == "plain words" and got[2][0] == "a b c" and re.fullmatch(r"it<\*>so'", got[4][0])
