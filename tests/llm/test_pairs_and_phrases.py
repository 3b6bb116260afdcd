"""Source divergence, vector links and phrases against brute force, and on odd tables."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest

from lumenlog.llm import collocations, divergence, embedding_links

SMALL = "/root/testdata/sf0.001"
LONG = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do. " * 3000) + "x" * 50_000
ODD = [
    (1, "The quick brown fox. The QUICK brown fox; the quick-brown fox", "en", "a"),
    (1, "The quick brown fox. The QUICK brown fox; the quick-brown fox", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "the fox is Étranger K\x85 the\tfox", "en", None),
    (4, LONG, "en", "c"),
    (5, "  \n\t .,;:!? ", "fr", "a"),
    (6, "eins zwei drei " * 30, "de", "a"),
    (6, "zwei drei eins " * 12, "de", "b"),
    (7, "eins zwei", "de", "c"),
    (8, "the fox \x1c\x00 fox", "", ""),
    (9, "und so weiter " * 20, None, "a"),
    (10, "und so weiter " * 20, "und", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 0.5, 1, "x", 2, "y", 3, 4) for r in ODD]
    names = "doc_id long, text string, lang string, source string, value double, rank int, term string, n int, phrase string, a int, id int"
    return spark.createDataFrame(rows, names).repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table_of(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


# --- source divergence


def divergence_rows(docs, top=200, min_docs=3):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in docs]
    seen = collections.Counter((lang, w) for lang, _, ws in docs for w in set(ws))
    count = collections.Counter((lang, source, w) for lang, source, ws in docs for w in ws if seen[lang, w] >= min_docs)
    whole = collections.Counter()
    for (lang, _, w), n in count.items():
        whole[lang, w] += n
    groups = sorted({(lang, source) for lang, source, _ in docs})
    out = []
    for lang, source in groups:
        kept = [w for x, w in whole if x == lang]

        def prices(get):
            total = sum(get(w) for w in kept) + len(kept)
            return {w: 1 + 10**9 * (get(w) + 1) // total for w in kept}

        mine = prices(lambda w: count[lang, source, w])
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                its = prices(lambda w: count[lang, other, w])
                pairs.append((-sum((mine[w] - its[w]) ** 2 // its[w] for w in kept), other.encode()))
        base = prices(lambda w: whole[lang, w])
        words = [(-((mine[w] - base[w]) ** 2 // base[w]), w.encode()) for w in kept if count[lang, source, w] and mine[w] > base[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
            out += [(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return collections.Counter(out)


REPORT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("size", [divergence.SLICE, 50])
def test_divergence_is_exact(spark, odd, size):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
        got = divergence.report(docs, slice_size=size)
        assert table_of(got, *REPORT) == divergence_rows(rows)
        assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_divergence_of_nothing(spark, odd):
    assert divergence.report(odd.limit(0)).count() == 0
    lone = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert table_of(divergence.report(lone), *REPORT) == {("en", "x", "pair", "y", 0, 1): 1, ("en", "y", "pair", "x", 0, 1): 1}


def test_prices_are_exact_at_any_size():
    draw = random.Random(3)
    for _ in range(3000):
        total = draw.randint(1, 10 ** draw.randint(1, 15))
        count = draw.randint(0, total - 1)
        assert divergence.price(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total
    assert divergence.price(np.array([0]), 7)[0] == divergence.absent(7)


# --- vector links


def link_rows(vectors, cosine=0.9):
    n = len(vectors)
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            x, y = vectors[i][1], vectors[j][1]
            if fine[i] and fine[j] and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                near[i, j] = near[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    least = {}
    for i, (key, _) in enumerate(vectors):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    return collections.Counter(
        (key, int(near[i].sum()), least.get(root[i]), key is not None and key == least.get(root[i])) for i, (key, _) in enumerate(vectors)
    )


def vectors_of(draw, n, dims, centres=6, spread=0.3):
    middle = draw.normal(size=(centres, dims))
    x = middle[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dims)) * draw.choice([0.1, 0.6, 1, 1.2], (n, 1))
    return [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]


LINKS = ("vec_id", "n_links", "component_id", "kept")


@pytest.mark.parametrize("dims,chunk,block", [(64, 40, 16), (5, 60, 2), (1, 8192, 16)])
def test_links_equal_all_pairs(spark, dims, chunk, block):
    vectors = vectors_of(np.random.default_rng(dims), 260, dims)
    vectors += [(900 + k, v) for k, v in vectors[:20]]  # equal vectors
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    want = link_rows(vectors)
    got = embedding_links.near_duplicates(df, chunk=chunk, block=block)
    assert table_of(got, *LINKS) == want
    assert dims == 1 or 0 < sum(n for _, n, _, _ in want) < 280 * 279  # some link, some don't


@pytest.mark.parametrize("block", [3, 6, 8])  # vectors of six are filled up to eight
def test_links_of_filled_up_blocks(spark, block):
    vectors = vectors_of(np.random.default_rng(3), 120, 6)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert table_of(embedding_links.near_duplicates(df, chunk=50, block=block), *LINKS) == link_rows(vectors)


def test_a_vector_has_one_tile(spark):
    raws = [np.array(v, "<f8").tobytes() for _, v in vectors_of(np.random.default_rng(9), 80, 64)]
    nodes = spark.createDataFrame([(k.to_bytes(2, "big"), raw) for k, raw in enumerate(raws)], "key binary, raw binary").repartition(3)
    places = embedding_links.tiled(nodes, embedding_links.Trees(raws, 4)).collect()
    assert len(places) == 80 and len({r.tile for r in places}) == 4 and sum(r.n or 0 for r in places) == 80


def test_a_dense_group_is_counted_whole(spark):
    draw = np.random.default_rng(5)
    x = np.ones((300, 64)) + 0.05 * draw.normal(size=(300, 64))
    vectors = [(int(k), [float(v) for v in row]) for k, row in enumerate(np.concatenate([x, draw.normal(size=(60, 64))]))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = embedding_links.near_duplicates(df, chunk=64)
    assert table_of(got, *LINKS) == link_rows(vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.1]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
        (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0, 0.0]), (None, [-1.0, 5.0, 0.0]),
        (None, [-1.0, 5.0, 0.01]), (11, [1e200, 2e200, 3e200]), (12, [-1.0, -2.0, -3.0]), (None, None), (3, None),
    ]
    rows = [(k, v, 1, True, "x", 2) for k, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, kept boolean, key string, copies int")
    assert table_of(embedding_links.near_duplicates(df), *LINKS) == link_rows(vectors)
    assert embedding_links.near_duplicates(df.limit(0)).count() == 0
    assert embedding_links.near_duplicates(df.where("vec_id = 3")).count() == 2


# --- phrases


def phrase_rows(docs, least=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        scored = []
        for p, a in found.items():
            if len(p) == 3 or 100 * longer[p] < 50 * a:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, r, n[lang], -s) for k, (s, a, p, left, r) in enumerate(sorted(scored)[:top], 1)]
    return collections.Counter(out)


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("shard,least,top", [(collocations.SHARD, 10, 2000), (100, 3, 40)])
def test_phrases_equal_full_counts(spark, odd, shard, least, top):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = collocations.mine(docs, least=least, top=top, shard=shard)
        want = phrase_rows([(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()], least, top)
        assert table_of(got, *PHRASES) == want
        assert want


def test_phrases_need_one_pass_however_many(odd, monkeypatch):
    """No tries, whose number grows with the phrases, unless hashes of different phrases meet."""
    monkeypatch.setattr(collocations, "phrase_counts", None)
    docs = odd.sparkSession.createDataFrame([(f"a b{k} c{k % 7}. " * 3, "en") for k in range(200)], "text string, lang string")
    got = collocations.mine(docs, least=3, top=50, shard=10)
    assert table_of(got, *PHRASES) == phrase_rows([(r["text"], r["lang"]) for r in docs.collect()], 3, 50)


def test_phrases_of_one_hash_are_doubtful(monkeypatch):
    texts = ["a b c a b x y. a b", "a b"]

    def counts():
        places = collocations.Places(["en", "de"], texts)
        return pd.concat(collocations.portion_counts(places, collocations.Filter([]), 3)).astype({"a": object})

    want = collections.Counter()
    for lang, text in zip(["en", "de"], texts):
        for piece in text.split(". "):
            ws = piece.split()
            want.update((lang, " ".join(ws[i : i + k])) for k in (2, 3) for i in range(len(ws) - k + 1))
    assert {(r.lang, r.phrase): r.a for r in counts().itertuples()} == want
    monkeypatch.setattr(collocations, "_mix", lambda h, other: np.zeros(len(other), np.uint64))  # everything meets
    found = counts()
    assert {(r.lang, r.phrase) for r in found.itertuples()} == set(want) and found["a"].isna().all()


def test_doubtful_phrases_are_counted_by_tries(odd, monkeypatch):
    found = collocations.candidates
    doubt = lambda docs, tables, longest: found(docs, tables, longest).selectExpr("lang", "phrase", "if(phrase like 'a %', null, a) AS a")
    monkeypatch.setattr(collocations, "candidates", doubt)
    docs = odd.sparkSession.createDataFrame([(f"a b{k % 5} c{k % 7}. a b", "en") for k in range(200)], "text string, lang string")
    got = collocations.mine(docs, least=3, top=50, shard=10)
    assert table_of(got, *PHRASES) == phrase_rows([(r["text"], r["lang"]) for r in docs.collect()], 3, 50)


def test_phrases_of_nothing(odd):
    assert collocations.mine(odd.limit(0)).count() == 0
    assert collocations.mine(odd.where("doc_id = 3")).count() == 0


def test_trie_counts_like_a_dictionary():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    phrases = sorted({("en" if draw.random() < 0.7 else "de", " ".join(draw.choices(words, k=draw.choice((2, 3, 3, 5))))) for _ in range(2500)})
    trie = collocations.Trie(phrases)
    texts = [(draw.choice(("en", "de", "fr")), " ".join(draw.choices([*words, ".", "other"], k=400))) for _ in range(30)]
    want = collections.Counter()
    for lang, text in texts:
        mine = collocations.words(text)
        for k in (2, 3, 5):
            want.update((lang, b" ".join(mine[i : i + k]).decode()) for i in range(len(mine) - k + 1) if b"." not in mine[i : i + k])
    counts = trie.count([lang for lang, _ in texts], [text for _, text in texts])
    assert counts.tolist() == [want[p] for p in phrases]
    assert counts.sum() > 0


def test_tries_hold_nodes_with_very_many_children():
    phrases = sorted({("en", f"{a} w{k}") for a in ("the", "of", "and") for k in range(20_000)})
    trie = collocations.Trie(phrases)
    assert trie.count(["en", "en"], ["the w7 of w9 of", "w19999. the w19999 the w19999"]).sum() == 4


def test_places_are_those_of_the_words():
    texts = ["A b.c  d\te;", "", "\n\n", "x" * 9000 + " é É\x85z\x1cw", "b b b"]
    places = collocations.Places(["en", "de", "en", "de", "en"], texts)
    found = places.phrases(np.arange(len(places.starts)), 1)
    assert places.phrases(np.array([2]), 2) == ["c d"]
    assert found == [w.decode() for t in texts for w in collocations.words(t) if w != b"."]
    same = {(places.langs[t], w): h for t, w, h in zip(places.text, found, places.hashes.tolist())}
    assert len(set(same.values())) == len(same)
    assert all(same[places.langs[t], w] == h for t, w, h in zip(places.text, found, places.hashes.tolist()))
