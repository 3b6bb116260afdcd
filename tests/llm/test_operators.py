"""Operators against brute force, and their defined results on odd rows: nulls, empty and very long texts,
repeated rows, empty tables and extra columns with clashing names."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlog.llm import (
    byte_pairs, decontamination, html_text, language_model, license_scan, pieces, quality_classifier, quality_rules, queries, simhash,
    token_counts, token_files, varints,
)

SMALL = "/root/testdata/sf0.001"
LONG = ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do. " * 3000) + "x" * 50_000
PASSAGE = "one two three four five six seven eight nine ten eleven"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. All rights reserved.", "en", 1),
    (1, "The quick brown fox jumps over the lazy dog. All rights reserved.", "en", 1),
    (2, None, None, 2),
    (3, "", "en", 3),
    (None, "a row without id", "de", 4),
    (4, LONG, "en", 5),
    (5, "  \n\t  ", "fr", 6),
    (6, f"Before. {PASSAGE.upper()}! after it", "en", 7),
    (7, f"Éa  ü\n b {PASSAGE} K don't", "xx", 8),
    (8, "two words", "en", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 0.5, 1, "x", 2, True, "y", 3) for r in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n_chars long, score double, n_words int, labels string, fp int, kept boolean, ids string, n_tokens int"
    ).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def some(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


# --- quality rules


def measures(text):
    w = white(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if white(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), base


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_measure_whole_texts(spark, odd):
    labels = some(spark, "labels")
    for docs in (odd, some(spark)):
        want = collections.Counter((k, *measures(t)) for k, t in pairs(docs))
        assert rows(quality_rules.apply_rules(docs, labels), "doc_id", *MEASURES) == want


def test_cutoffs_hold_the_exact_bound(spark):
    good = [("en", True, 10, 0, 0, 0)] * 2000 + [("en", True, 300, 0, 0, 0)] * 2
    bad = [("en", False, 200, 0, 0, 0)] * 100
    few = [("de", True, 0, 0, 0, 0)] * 20 + [("de", False, 900, 0, 0, 0)] * 20
    names = "stratum string, good boolean, symbols int, dup_lines int, repeats int, upper int"
    found = quality_rules.cutoffs(spark.createDataFrame(good + bad + few, names)).collect()
    # 2 of 2002 at a limit of 0.005: 8 tests at 0.05 / 8; the smallest group of labels rejects nothing
    assert [(r.stratum, r.rule, r.cutoff) for r in found] == [("en", "symbols", 175)]
    p = spark.range(1).select(quality_rules.binomial_cdf(F.lit(2).cast("long"), F.lit(2002).cast("long"), 0.005).alias("p")).first().p
    assert math.isclose(p, sum(math.comb(2002, j) * 0.005**j * 0.995 ** (2002 - j) for j in range(3)), rel_tol=1e-9)


def test_a_label_counts_once_however_often_its_row_occurs(spark):
    base = " ".join(f"w{k}" for k in range(60))
    often = [(1, base)] * 1500 + [(k, base + " again") for k in range(100, 1500)]  # two texts, not 2900
    noisy = [(k, base + f" {k} " + "#" * 200) for k in range(2, 8)]
    docs = spark.createDataFrame([(*r, "en") for r in often + noisy], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k not in range(2, 8))) for k in (*range(1, 8), *range(100, 1500))], "doc_id long, quality int")
    assert rows(quality_rules.apply_rules(docs, labels), "kept") == {(True,): 2906}
    distinct = [(k, base + f" number {k}") for k in range(100, 1500)]
    docs = spark.createDataFrame([(*r, "en") for r in distinct + noisy], "doc_id long, text string, lang string")
    assert rows(quality_rules.apply_rules(docs, labels), "kept") == {(True,): 1400, (False,): 6}


def test_rules_without_labels_or_rows(spark, odd, empty):
    none = some(spark, "labels").limit(0)
    kept = quality_rules.apply_rules(odd, none)
    assert rows(kept, "kept") == collections.Counter((not measures(t)[-1],) for _, t in ODD_PAIRS)
    assert quality_rules.apply_rules(empty, none).count() == 0


ODD_PAIRS = [(r[0], r[1]) for r in ODD]


# --- page text


def test_main_text():
    page = (
        '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy &amp; sell.</div>'
        "<article><h1>A &lt;title&gt;</h1><p><b>First  part\nhere<br>and more.<br><p>Short.</p><!-- no --><p>Last &amp; &copy;</article>"
        "<div class=comments><p>I say so</p></div><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == "A <title>\n\nFirst part here and more.\n\nShort.\n\nLast & ©"
    assert html_text.main_text("") == "" == html_text.main_text("<script>never closed <p>x")
    assert html_text.main_text("<article><p>cut off here</p><p>rest &am") == "cut off here\n\nrest &am"


def test_wrappers_around_the_article():
    words = "A long enough sentence of the article with many plain words in it, and no links at all in there."
    body = f"<header><h1>The title</h1></header><p>{words}</p><p>{words}</p>"
    want = f"The title\n\n{words}\n\n{words}"
    for before, after in (
        ('<div class="content has-sidebar"><article>', "</article></div>"), ("<form action=/><article>", "</article></form>"),
        ('<div class="page no-share"><main>', "</main></div>"), ('<div id="sidebar-left-layout"><article>', "</article></div>"),
    ):
        assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav>{before}{body}{after}<footer>us</footer></body>") == want
    plain = f'<div class="content has-sidebar"><p>{words}</p><p>{words}</p></div>'
    assert html_text.main_text(plain) == f"{words}\n\n{words}"
    assert html_text.main_text(f"<article><p>{words}</p></article><div class=comments><article><p>{words}</p></article></div>") == words


def test_a_deep_and_a_long_page():
    words = "A long enough sentence of the article with many plain words in it, and no links at all in there."
    assert html_text.main_text("<div>" * 5000 + f"<article><p>{words}</p></article>" + "</div>" * 5000) == words
    assert html_text.main_text("<article>" + f"<p>{words}</p>" * 20_000 + "</article>") == "\n\n".join([words] * 20_000)


def test_extract_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "u", "", "b"), (3, "v", "<article><p>é😀 x</p>", "c"), (3, "v", "<article><p>é😀 x</p>", "c")], "page_id long, url string, html string, text string")
    got = rows(html_text.extract(pages), "page_id", "url", "text", "n_chars")
    assert got == collections.Counter({(1, None, "", 0): 1, (None, "u", "", 0): 1, (3, "v", "é😀 x", 4): 2})
    assert html_text.extract(pages.limit(0)).count() == 0


# --- near-duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, prints, radius=3):
    """Smallest key of each key's class over all pairs."""
    label = list(range(len(keys)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(keys))]


def test_near_duplicates(spark, odd, empty):
    for docs in (odd, some(spark)):
        found = pairs(docs)
        prints = [brute_fingerprint(t) for _, t in found]
        own = classes([k for k, _ in found], prints)
        want = collections.Counter((k, f"{p:016x}", c) for (k, _), p, c in zip(found, prints, own))
        assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_in_chunks_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = {int(h) for h in heads}
    for h in heads.tolist():
        for _ in range(8):
            h ^= 1 << int(rng.integers(0, 63))
            values.add(h)
    values = sorted(values)
    monkeypatch.setattr(simhash, "CHUNK", 4)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert [roots.get(v, v) for v in values] == classes(values, values)
    fps, at = np.array(values, np.uint64), np.arange(len(values))
    monkeypatch.setattr(simhash, "AREA", 50)  # all levels of tiles
    label = list(range(len(values)))
    for a, b in simhash.forest(fps, at, at).tolist():
        old, new = label[b], label[a]
        label = [new if x == old else x for x in label]
    groups = classes(values, values)
    assert all((label[i] == label[j]) == (groups[i] == groups[j]) for i in range(len(values)) for j in range(i))


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(chain).collect()} == {(i, 1) for i in range(2, 201)} | {(501, 500)}


# --- token ids


def library_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab é'sßT1,.漢 \n\t \x1c\x85<|>", "<|endoftext|>"]), max_size=40).map("".join))
def test_pieces_give_the_ids_of_whole_texts(text):
    ids = np.frombuffer(token_files.coder(public_tokenizers.path(queries.BYTE_BPE)).encode(text), "<u4").tolist()
    assert ids == library_ids([text])[0]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_values(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values
    packed, _ = varints.pack(np.array(values, np.uint64))
    assert varints.unpack(packed.tobytes()).tolist() == values


def test_added_tokens_are_ids_of_their_own(spark):
    path, mark = public_tokenizers.path(queries.BYTE_BPE), "<|endoftext|>"
    found = [mark, f"{mark}x", f"x {mark} y", f"x{mark}", f"{mark}{mark}", f"<|{mark}|>", f" {mark}  y"]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    want = dict(enumerate(library_ids(found)))
    assert want[1] == [50256, 87]
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in token_files.round_trip(docs, path).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts.totals(docs, path).collect()} == {k: len(v) for k, v in want.items()}


def test_components_of_few_links_take_one_round(spark, monkeypatch):
    stored, written = simhash.stored, []
    monkeypatch.setattr(simhash, "stored", lambda df, name: written.append(name) or stored(df, name))
    pairs = [(k, k + 1) for k in range(60)] + [(100 + k, 100) for k in range(1, 9)] + [(7, 7), (200, 200)]
    want = {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 109), 100)}
    for least, rounds in ((simhash.EDGES, 1), (5, 30)):  # joined by one task, or five links at a time
        monkeypatch.setattr(simhash, "EDGES", least)
        written.clear()
        found = simhash.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()
        assert sorted((r.node, r.root) for r in found) == sorted(want.items())
        assert len(written) <= rounds + 1
    assert simhash.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_the_driver_holds_the_sample_in_one_piece():
    parts = quality_classifier.in_one([3, 0, 5], np.float64)
    assert [len(x) for x in parts] == [3, 0, 5] and len({id(x.base) for x in parts}) == 1


def test_words_are_encoded_and_kept_once():
    seen = []
    parts = pieces.PieceCoder(public_tokenizers.PATTERN, lambda piece: seen.append(piece) or piece.encode())
    for text in ("a word, word word.\nword word", "  word\n word", "x. word! word-word word", " word"):
        assert parts.encode(text).decode() == text
    assert seen.count(" word") == 1 and " word" not in parts.pieces


def test_a_missing_id_is_dealt_to_many_tasks(spark, tmp_path):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = token_files.write(docs, public_tokenizers.path(queries.BYTE_BPE), str(tmp_path / "ids"))
    sizes = [r.n for r in spark.read.parquet(path).groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1800


def test_token_files(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 500)
    path = public_tokenizers.path(queries.BYTE_BPE)
    for docs in (odd, some(spark)):
        keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("deal"))
        found = [(r.doc_id, r.text) for r in keyed.orderBy("doc_id", "deal", "text").collect()]
        start, want = 0, collections.Counter()
        for (key, _), ids in zip(found, library_ids([t for _, t in found])):
            data = np.array([*ids, 2], "<u4").tobytes()
            want[key, start, len(ids) + 1, zlib.crc32(data)] += 1
            start += len(ids) + 1
        assert rows(token_files.digests(token_files.round_trip(docs, path)), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.round_trip(empty, path).count() == 0


def test_token_counts_over_block_ends(spark, odd, empty):
    path = public_tokenizers.path(queries.BYTE_BPE)
    for docs in (odd, some(spark)):
        found = pairs(docs)
        want = collections.Counter((k, len(ids)) for (k, _), ids in zip(found, library_ids([t for _, t in found])))
        for block in (7, 1 << 20):
            assert rows(token_counts.count_tokens(token_counts.flat(docs, path, block=block)), "doc_id", "n_tokens") == want
    assert token_counts.totals(empty, path).count() == 0


# --- licenses


def test_licenses(spark, odd, empty):
    own = spark.createDataFrame(
        [
            (20, "x Licensed under the\n Apache License, Version 2.0. y cc by", "", 1),
            (21, "Released under the MIT license and the GNU general Public License!", "", 1),
            (22, "Permission is hereby granted, truly free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "", 1),
            (23, "the general public. License by cc", "", 1),
        ],
        "doc_id long, text string, labels string, score int",
    )
    got = {r.doc_id: r for r in license_scan.scan(own).collect()}
    assert (got[20].labels, got[20].base_labels, got[20].n_base, got[20].first_word) == ("apache-2.0,cc-by", "cc-by", 1, 10)
    assert (got[21].labels, got[21].n_base, got[21].first_word, got[21].last_word) == ("gpl,mit", 1, 8, 8)
    assert (got[22].labels, got[22].score) == ("mit", 1.0)  # an inserted word shifts the diagonal, all words stay covered
    assert (got[23].labels, got[23].n_base, got[23].score) == ("gpl", 1, 1.0)
    for docs in (odd, some(spark)):
        want = collections.Counter()
        for k, t in pairs(docs):
            w = plain(t)
            places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
            starts = [i for i, _ in places]
            want[k, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
        assert rows(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert license_scan.scan(empty).count() == 0


# --- quality classifier


def test_classifier(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.held_out == held.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.scored(odd, model).count() == len(ODD)
    assert quality_classifier.classify(empty, labels).count() == 0
    same = rows(quality_classifier.classify(odd, labels.limit(0)), "score", "predicted")
    assert same == collections.Counter({(0.5, 1): len(ODD)})


# --- decontamination


def brute_hits(docs, items, size=10):
    windows = {}
    for key, text in items:
        w = plain(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if key is None else str(key))
    out = collections.Counter()
    for key, text in docs:
        w, hit, names = plain(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= owners
        out[key, len(w), len(hit), len(names), ",".join(sorted(names))] += 1
    return out


def test_decontamination(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (10, "two words"), (1, "lazy dog all rights"), (None, "don't")], "item_id long, text string")
    bench = some(spark, "benchmark")
    for docs, test in ((odd, items), (some(spark), bench)):
        want = brute_hits(pairs(docs), [(r.item_id, r.text) for r in test.collect()])
        for block in (12, 1_000_000):
            got = decontamination.decontaminate(docs, test.coalesce(1), block_words=block).withColumn("names", F.array_join("items", ","))
            assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "names") == want
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0


def test_near_places(spark):
    docs = spark.createDataFrame([(1, "a b alpha c beta gamma d"), (2, "alpha beta gamma"), (3, "gamma beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert rows(decontamination.decontaminate(docs, items), "doc_id", "n_hit", "n_near") == collections.Counter({(1, 0, 1): 1, (2, 3, 0): 1, (3, 0, 0): 1})


# --- byte-level BPE


def library():
    path = public_tokenizers.path(queries.MULTI_BPE)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs(spark, odd, empty):
    path, encoding = library()
    for docs in (odd, some(spark)):
        want = collections.Counter()
        for k, t in pairs(docs):
            ids = encoding.encode_ordinary(t or "")
            want[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert rows(byte_pairs.round_trip(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = byte_pairs.decode(byte_pairs.encode(odd, path), path)
    assert collections.Counter((r.doc_id, bytes(r.data)) for r in back.collect()) == collections.Counter((k, (t or "").encode()) for k, t in ODD_PAIRS)
    assert byte_pairs.round_trip(empty, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeinorst éß漢1", max_size=30), st.text(alphabet="aeinrst é", max_size=8), st.data())
def test_appends_and_edits_are_exact(first, more, data):
    path, encoding = library()
    whole = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=encoding._mergeable_ranks, special_tokens={})
    piece = byte_pairs.Piece(byte_pairs.ranks_of(path), first.encode())
    piece.append(more.encode())
    assert piece.ids() == whole.encode_ordinary(first + more)
    at = data.draw(st.integers(0, len(first)))
    stop = data.draw(st.integers(at, len(first)))
    piece.edit(len(first[:at].encode()), len(first[:stop].encode()), b"er")
    assert piece.ids() == whole.encode_ordinary(first[:at] + "er" + first[stop:] + more)


# --- language model


def test_language_model(spark, odd, empty):
    for docs, segment in ((odd, 50), (some(spark), 2_000_000), (some(spark), 3000)):
        found = pairs(docs)
        fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7
        tokens = [(k, [*white(lower(t)), None]) for k, t in found]
        count = collections.Counter(w for k, ws in tokens if fold(k) != 2 for w in ws)
        n, v = sum(count.values()), len(count)
        want = collections.Counter(
            (k, fold(k) == 2, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4)) for k, ws in tokens
        )
        got = language_model.score(docs, segment).withColumn("base", F.round("base_score", 4)).toPandas()
        assert collections.Counter(
            (None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base) for r in got.itertuples()
        ) == want
        assert np.isfinite(got.score).all() and (got.score < 0).all()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()  # better than the unigram on texts it hasn't seen
    assert language_model.score(empty).count() == 0


def test_mixture_weights_rise_with_the_likelihood():
    cell = lambda bucket, one, two: (bucket * language_model.CELLS + one) * language_model.CELLS + two
    middle = language_model.CELLS // 4
    cells, counts = np.array([cell(3, middle + 40, 0), cell(3, middle + 16, middle + 96)]), np.array([30.0, 70.0])
    weights = language_model.learn_weights(cells, counts)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0][2] == 0

    def likelihood(w):
        return 30 * math.log(w[0] + w[1] * 2**5 + 1e-12) + 70 * math.log(w[0] + w[1] * 2**2 + w[2] * 2**12)

    best = max(likelihood((max(1 - a - b, 0), a, b)) for a in np.arange(0, 1.001, 0.01) for b in np.arange(0, 1.001 - a, 0.01))
    assert likelihood(weights[3]) > best - 0.2


def test_last_tokens_try_few_lengths():
    ranks = byte_pairs.ranks_of(public_tokenizers.path(queries.MULTI_BPE))
    data = "unbelievably long-winded explanations of Größenordnungen".encode()
    for end in range(1, len(data) + 1):
        fitting = {n for n in range(1, end + 1) if data[end - n : end] in ranks.ids}
        tried = [n for n in ranks.lengths_at(data, end) if n <= end]
        assert fitting <= set(tried) and tried == sorted(tried, reverse=True)
    asked = sum(len(ranks.lengths_at(data, end)) for end in range(1, len(data) + 1))
    by_byte = sum(len({len(t) for t in ranks.ids if t[-1] == byte}) for byte in data)
    assert 2 * asked < by_byte


def test_only_prefixes_that_a_piece_rests_on_are_worked_out():
    ranks = byte_pairs.Ranks(public_tokenizers.path(queries.MULTI_BPE))
    found = [" ofthwhwhedqueesqueesja", " lañcociesèêétre", " Größenordnungslos", "4130383451285691", "\n\n\t", "ß", ""]
    whole = [ranks.walk(ranks.extend(x.encode(), [-1])) for x in found]
    assert [ranks.encode_piece(x.encode()) for x in found] == whole  # each prefix met first
    assert len(ranks.last) * 4 < sum(len(x.encode()) for x in found) * 3
    assert [ranks.encode_piece(x.encode()) for x in found] == whole == [ranks.merged(x.encode()) for x in found]


def test_pieces_are_spelt_as_the_library_spells_them():
    own = token_files.coder(public_tokenizers.path(queries.BYTE_BPE))
    library = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
    for text in [" plain", "~", "tab\tand\x7f and \x00", " é", "\u00a0x", "a  b \n", "".join(map(chr, range(1, 400)))]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
