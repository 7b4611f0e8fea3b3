"""Operators against brute force, and at nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloft.llm import chat, classifier, components, decontamination, language, minhash, packing, quality_rules, sharding, shingling, tokens, warc
from keyloft.llm.common import Scratch, tokenizer_path, semi_join, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, rid long, words string, key string, n int"


def docs_of(spark, rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1.0, "x", 7, "w", "k", 3) for i, t, lang in rows], DOCS)


ODD = [(1, None, "en"), (2, "", None), (3, " \t\n", "xx"), (4, "one", "en"), (5, "one", "en"), (5, "one", "en"), (6, "word " * 30_000, "en"), (None, "no id here", "de"), (7, "x" * 200_000, "fr"), (8, "a\x00b \x1f c", "en")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


# ------------------------------------------------------------------ near duplicates


@given(st.lists(st.text(alphabet="aAbé \n\t\x1c ", max_size=30), min_size=1, max_size=6), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_agree_with_sets_of_words(texts, width):
    found = list(shingling.shingle_sets([t.encode() for t in texts], width))
    wanted = [shingles_of(t, width) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in wanted]
    for i in range(len(texts)):
        for k in range(i):
            assert len(np.intersect1d(found[i], found[k])) == len(wanted[i] & wanted[k])


def test_long_texts_are_hashed_in_pieces():
    text = b" ".join(b"w%d" % (i % 5000) for i in range(600_000))
    whole = next(iter(shingling.word_hashes([text])))
    assert len(text) > shingling.BLOCK and len(whole) == 600_000
    assert (whole[:5000] == whole[5000:10_000]).all() and len(np.unique(whole)) == 5000


def test_circulant_signature_estimates_similarity():
    rng = np.random.RandomState(1)
    base = rng.randint(0, 2**62, 2000).astype(np.uint64)
    other = np.concatenate([base[:1600], rng.randint(0, 2**62, 400).astype(np.uint64)])
    a, b = (minhash.signature(np.unique(x), 128) for x in (base, other))
    assert abs((a == b).mean() - 1600 / 2400) < 0.15
    assert (minhash.signature(np.unique(base), 128) == a).all()


def brute_components(rows, width, percent):
    sets = [shingles_of(t, width) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            common = len(sets[i] & sets[k])
            if rows[i][0] is not None and rows[k][0] is not None and (rows[i][0] == rows[k][0] or common and 100 * common >= percent * len(sets[i] | sets[k])):
                a, b = sorted((find(rows[i][0]), find(rows[k][0])))
                root[b] = a
    return {i: find(i) for i in root}


@pytest.mark.parametrize("width", [2, 5])
def test_components_of_mutated_groups(spark, width):
    """Groups of copies at all distances from their origin, borderline ones included."""
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, 14)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary[:20] if k % 2 else vocabulary)
            rows.append((rng.randrange(10**6), " ".join(copy)))
    rows += [(i, t) for i, t, _ in ODD]
    found = minhash.near_duplicates(docs_of(spark, [(i, t, "en") for i, t in rows]), width).collect()
    assert len(found) == len(rows)
    want = brute_components(rows, width, 80)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    sizes = {i: len(shingles_of(t, width)) for i, t in rows if i != 5}
    assert all(r.n_shingles == sizes[r.doc_id] for r in found if r.doc_id in sizes)


def test_many_strays_beside_a_large_group(spark):
    """Blocks smaller than the group, so that several tasks share its comparison."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(160):
        copy = list(base)
        for k in rng.sample(range(100), rng.choice([2, 4, 6, 7, 8])):
            copy[k] = f"v{rng.randrange(12)}"
        rows.append((i, " ".join(copy)))
    old = minhash.BLOCK_X, minhash.BLOCK_Y
    minhash.BLOCK_X, minhash.BLOCK_Y = 8, 16
    try:
        found = minhash.near_duplicates(docs_of(spark, [(i, t, "en") for i, t in rows]), 2).collect()
    finally:
        minhash.BLOCK_X, minhash.BLOCK_Y = old
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, 2, 80)


def test_strays_with_a_second_text(spark):
    """Every document has an unrelated second text, whose shingles no other document holds."""
    rng = random.Random(5)
    rows = []
    for i in range(160):
        copy = [f"w{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.choice([2, 4, 6, 7, 8])):
            copy[k] = f"v{rng.randrange(12)}"
        rows += [(i, " ".join(copy)), (i, " ".join(f"u{i}x{k}" for k in range(120)))]
    found = minhash.near_duplicates(docs_of(spark, [(i, t, "en") for i, t in rows]), 2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, 2, 80)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0)]
    rng = random.Random(2)
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.v: r.root for r in components.components(df, Scratch(spark, "test")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_semi_join_is_exact(spark):
    rows, ids = spark.range(1000).withColumnRenamed("id", "doc_id"), spark.range(0, 1000, 7).withColumnRenamed("id", "doc_id")
    assert sorted(r[0] for r in semi_join(rows, ids, "doc_id").collect()) == list(range(0, 1000, 7))


# ------------------------------------------------------------------ tokens and packing


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@given(st.lists(st.lists(st.sampled_from(list("abS's  \n\t.,!<|>éİ\u0301\u3000\x1c\x85中1") + ["<|endoftext|>", "we'll ", "   "]), max_size=40).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_units_give_the_library_tokens(texts):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = tokens.worker_store().setdefault(("library", name), None) or Tokenizer.from_file(tokenizer_path(name))
        tokens.worker_store()[("library", name)] = library
        encoder = tokens.Encoder(tokenizer_path(name), list, "test")
        assert [[i for v in values for i in v] for values in encoder.values(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_odd_and_real_texts(spark, sf_dir, libraries):
    library = libraries["byte_bpe_50k.json"]
    docs = docs_of(spark, ODD).select("doc_id", "text", "n").union(table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1)))
    found = tokens.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in found] == [(len(t.encode()), n, n > 1024) for t, n in zip(texts, (len(library.encode(t, add_special_tokens=False).ids) for t in texts))]
    assert tokens.count_tokens(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_memory_of_units_is_bounded(libraries, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 50)
    encoder = tokens.Encoder(tokenizer_path("word_bpe_49k.json"), len, "bounded")
    texts = [" ".join(f"word{random.Random(i).randrange(10**6)} the" for _ in range(9)) for i in range(3000)]
    got = [sum(v) for v in encoder.values(texts)]
    assert got == [len(e.ids) for e in libraries["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known) < 20_000


def test_packing_is_whole_and_tight(spark, sf_dir, libraries, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 60)
    library = libraries["word_bpe_49k.json"]
    docs = docs_of(spark, ODD).select("doc_id", "text", "n").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 100, "text", F.lit(1)))
    found = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).toPandas()
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((-1 if r.doc_id is None else r.doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(want) == sorted(map(tuple, found[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int).itertuples(index=False)))
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all() and s.length.sum() <= 4096
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 4096) + 8
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=100, deadline=None)
def test_sum_of_squares_rule(lengths):
    """Each item, longest first, goes where the sum of squared counts becomes smallest, ties to the fullest bin."""
    bins, offsets, fills = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    gaps: dict[int, int] = {}
    for i in np.argsort(-np.array(lengths, dtype=np.int64), kind="stable"):
        size = lengths[i]

        def cost(gap, size=size):
            after = dict(gaps)
            if gap != 20:
                after[gap] -= 1
            if gap - size:
                after[gap - size] = after.get(gap - size, 0) + 1
            return sum(v * v for v in after.values())

        best = min((cost(g), g) for g in [*[g for g in gaps if gaps[g] and g >= size], 20])[1]
        assert 20 - offsets[i] == best
        if best != 20:
            gaps[best] -= 1
        if best - size:
            gaps[best - size] = gaps.get(best - size, 0) + 1
    assert all(fills[b] <= 20 for b in bins)


# ------------------------------------------------------------------ decontamination and rules


def brute_hits(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item_id, text in items:
        w = split(text)
        windows += [(item_id, w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for doc_id, text in docs:
        w, hit, ids = split(text), set(), set()
        for item_id, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= {str(item_id)} if item_id is not None else set()
        out.append((-1 if doc_id is None else doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_hits_of_short_repeated_and_overlapping_items(spark, broadcast_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "É", "é", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 13, 14, 20])))) for i in range(12)] + [(100, None), (101, "--"), (None, "b b b b"), (3, "a É"), (4, items_text := "a b é É x1 a b a b a b a b a")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), "en") for i in range(40)] + [(50, items_text + ". " + items_text.upper(), "en"), *[d for d in ODD if d[0] != 6], (60, "A, b!", "en")]
    found = decontamination.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == brute_hits([(i, t) for i, t, _ in docs], items)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_decontamination_of_empty_tables(spark, broadcast_bytes):
    docs, items = docs_of(spark, ODD[:5]), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.contamination(docs, items, broadcast_bytes=broadcast_bytes).collect()} == {0}
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), some, broadcast_bytes=broadcast_bytes).count() == 0


def test_base_counts(spark):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {k for i, t in enumerate(tri) if tri.count(t) > 1 for k in (i, i + 1, i + 2)}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab#|> \n é😀") for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None, "zz"])) for i in range(60)]
    rows += [(100, "a b c a b c a b", "en"), (101, "a b c", "en"), *[d for d in ODD if d[0] != 6 and d[0] is not None]]
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()}
    assert found == {(i, *brute(t)) for i, t, _ in rows}
    assert quality_rules.quality_rules(docs_of(spark, rows).limit(0)).count() == 0


def test_rules_keep_clean_and_drop_junk(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    rows = quality_rules.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[1] > 0.98 and share[0] < 0.2


def test_js_distance_of_equal_and_disjoint_histograms(spark):
    df = spark.createDataFrame([([1, 1, 0], [0.5, 0.5, 0.0]), ([4, 0, 0], [0.0, 1.0, 0.0]), ([0, 0, 0], [1.0, 0.0, 0.0])], "c array<long>, r array<double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("c"), F.col("r"))).collect()]
    assert got[0] == 0 and abs(got[1] - 1) < 1e-9 and got[2] is None


# ------------------------------------------------------------------ classifier, language


def auc(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    found = classifier.op2_quality_classifier(spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    out = found[found.held_out]
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.98 and (out.predicted == out.quality).mean() > 0.96
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()


def test_scores_against_plain_normal_equations(spark, sf_dir):
    """Ridge on all labelled rows and isotonic levels of out-of-fold scores, in numpy on the same statistics."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    y = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(classifier.FOLDS)).alias("fold")).collect()
    x = classifier.statistics([(r.text or "").encode() for r in rows]).astype(np.float64)
    known = np.array([r.doc_id in y for r in rows])
    target, fold = np.array([y[r.doc_id] for r in rows if r.doc_id in y]), np.array([r.fold for r in rows])[known]
    mean, std = x[known].mean(axis=0), x[known].std(axis=0)
    z = classifier.fourier(x, mean, np.where(std > 1e-6, std, 1.0), classifier.FEATURES, classifier.WIDTH, 11)

    def ridge(a, b):
        return np.linalg.solve(a.T @ a + classifier.RIDGE * max(1.0, len(a)) * np.eye(a.shape[1]) / classifier.FEATURES, a.T @ b)

    raw = np.zeros(known.sum())
    for f in range(classifier.FOLDS):
        raw[fold == f] = z[known][fold == f] @ ridge(z[known][fold != f], target[fold != f])
    bins = np.clip((raw + 0.5) * classifier.BINS / 2, 0, classifier.BINS - 1).astype(int)
    used = np.unique(bins)
    knots = np.maximum.accumulate([raw[bins == b].mean() for b in used])
    levels = classifier.isotonic(np.array([target[bins == b].mean() for b in used]), np.array([float((bins == b).sum()) for b in used]))
    score = z @ ridge(z[known], target)
    want = np.clip(0.99 * np.interp(score, knots, levels) + 0.01 * np.clip(score, 0, 1), 0, 1)
    found = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels).collect()}
    assert len(found) == len(rows)
    near = np.array([abs(found[r.doc_id] - w) for r, w in zip(rows, want)])
    assert np.median(near) < 1e-6 and (near < 1e-3).mean() > 0.98  # a raw score at a bin's edge may fall to either side


def test_long_texts_are_scored_whole(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = docs.orderBy("doc_id").first().text
    more = spark.createDataFrame([(-1, (text + " ") * 2000), (-2, (text + " ") * 2000 + "| # " * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in classifier.quality_scores(docs.select("doc_id", "text").union(more), labels).collect()}
    assert len(found) == docs.count() + 2 and found[-1] != found[-2]


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in classifier.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_classifier_on_odd_rows_and_without_labels(spark):
    docs, none = docs_of(spark, ODD), spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in classifier.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    assert classifier.quality_scores(docs, one).count() == len(ODD)
    assert classifier.quality_scores(docs.limit(0), one).count() == 0
    assert classifier.good_documents(docs, one).columns == docs.columns


def test_fourier_features_approximate_the_kernel():
    rng = np.random.RandomState(0)
    x = rng.standard_normal((40, 5))
    z = classifier.fourier(x, np.zeros(5), np.ones(5), 20_000, 2.0, 1)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_isotonic_is_monotone_and_keeps_the_mean(rows):
    v, w = np.array([a for a, _ in rows]), np.array([float(b) for _, b in rows])
    fit = classifier.isotonic(v, w)
    assert len(fit) == len(v) and (np.diff(fit) >= -1e-12).all() and abs((fit * w).sum() - (v * w).sum()) < 1e-9


def test_languages_of_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    found = language.identify(pages.withColumn("lang", F.lit("x")), docs).collect()
    assert sum(r.lang == r.declared for r in found) >= 0.97 * len(found)
    odd = spark.createDataFrame([(1, None, None), (1, "http://[bad", ""), (2, "https://a.example.fr/x", "<html lang=fr><p>12</p>"), (None, "x", "<html LANG='de'>und der die das nicht")], "page_id long, url string, html string")
    rows = language.identify(odd, docs).collect()
    assert len(rows) == 4 and all(0 < r.posterior <= 1 for r in rows) and {r.lang for r in rows if r.page_id is None} == {"de"}
    assert len(language.identify(odd, docs.limit(0)).collect()) == 4 and language.identify(odd.limit(0), docs).count() == 0


def test_host_prior_decides_where_text_is_silent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = docs.filter("lang = 'fr'").limit(30).select((F.col("doc_id")).alias("page_id"), F.lit("https://fr.example.com/a").alias("url"), F.concat(F.lit("<html><p>"), "text").alias("html"))
    rest = docs.filter("lang = 'en'").limit(60).select((F.col("doc_id") + 1000).alias("page_id"), F.lit("https://en.example.org/a").alias("url"), F.concat(F.lit("<html><p>"), "text").alias("html"))
    silent = spark.createDataFrame([(-1, "https://fr.example.com/b", "<p>123</p>"), (-2, "https://en.example.org/b", "")], "page_id long, url string, html string")
    found = {r.page_id: r.lang for r in language.identify(text.union(rest).union(silent), docs).collect()}
    assert (found[-1], found[-2]) == ("fr", "en")


@pytest.mark.parametrize("markup", ["<script>", "<html ", "<!--", "<", "<p", "</style", "<head><nav>"])
def test_long_unclosed_markup_takes_no_longer(markup):
    import time

    page = markup * (2_000_000 // len(markup)) + "lang=fr"
    began = time.perf_counter()
    language.visible_text(page)
    assert language.declared_language(page) == ("fr" if markup == "<html " else "")
    assert time.perf_counter() - began < 2


def test_visible_text_and_declared_language():
    page = "<!DOCTYPE html><HTML class=a lang = 'DE-at'><head><title>no</title></head><body><!-- <p>no</p> --><p>ja &amp; 1 < 2</p><script>var a = '<p>';</SCRIPT ><nav>no</nav><header>x</header>gut</body>"
    assert language.visible_text(page).split() == ["ja", "&", "1", "gut"]  # "< 2</p>" runs to the next mark
    assert language.declared_language(page) == "de"
    assert language.visible_text("a <script> b") == "a   b" and language.visible_text("a < b") == "a < b"
    assert language.declared_language("<html><html lang=es>") == "es" and language.declared_language("<htmlx lang=es>") == ""


def test_fusion_of_evidence_against_plain_arithmetic(spark, sf_dir):
    """Posteriors of all pages, computed page by page from the evidence."""
    import math

    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    langs, n, k = language.LANGUAGES, len(language.LANGUAGES), language.SMOOTHING
    rows = language.page_evidence(pages, language.trigram_likelihoods(docs, langs), langs).collect()
    vote = lambda r: [1.0 if r.n_grams and i == r.ll.index(max(r.ll)) else 0.0 for i in range(n)]
    levels = {"all": {}, "suffix": {}, "domain": {}, "host": {}, "declared": {}}
    of = lambda r: {"all": "", "suffix": r.suffix, "domain": (r.domain, r.suffix), "host": (r.host, r.domain, r.suffix), "declared": r.declared}
    for r in rows:
        for level, key in of(r).items():
            held = levels[level].setdefault(key, [0.0] * n)
            levels[level][key] = [a + b for a, b in zip(held, vote(r))]
    want = {}
    for r in rows:
        less = {level: [max(0.0, a - b) for a, b in zip(levels[level][key], vote(r))] for level, key in of(r).items()}
        first = p = [(x + 1) / (sum(less["all"]) + n) for x in less["all"]]
        for level in ("suffix", "domain", "host"):
            p = [(c + k * above) / (sum(less[level]) + k) for c, above in zip(less[level], p)]
        ratio = [(c + k * g) / ((sum(less["declared"]) + k) * g) for c, g in zip(less["declared"], first)]
        log = [language.TEMPER * a + math.log(b) + math.log(c) for a, b, c in zip(r.ll, p, ratio)]
        want[r.page_id] = (langs[log.index(max(log))], 1 / sum(math.exp(x - max(log)) for x in log))
    found = language.identify(pages, docs).collect()
    assert len(found) == len(want)
    for r in found:
        assert r.lang == want[r.page_id][0] and abs(r.posterior - want[r.page_id][1]) < 1e-9


# ------------------------------------------------------------------ archives, shards, dialogues


def test_archives_round_trip(spark):
    big = "é<p>" * 300_000
    rows = [(1, "http://a/%\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (None, "u", "x" * 1000), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (8, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha1 string")
    chunks = warc.archive(pages, chunk=1000)
    table_ = chunks.collect()
    assert max(len(r.data) for r in table_) <= 1000
    by = {}
    for r in sorted(table_, key=lambda r: r.chunk):
        if r.page_id == 7:
            by[r.chunk] = bytes(r.data)
    assert not by or by == {0: b""}  # 8 holds the payload of 7
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.records(chunks).collect())
    digest = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    revisit = {(1, 0): 2, (-1, 4): 2, (7, 7): 8}
    assert got == sorted((p or -1, *digest(h), "revisit" if (p or -1, i) in revisit else "response", revisit.get((p or -1, i), 0)) for i, (p, _, h) in enumerate(rows))
    eight = sorted((r for r in table_ if r.page_id == 8), key=lambda r: r.chunk)
    running, seen = hashlib.sha1(), 0
    for r in eight[::2]:  # two equal records, chunk by chunk
        running.update(bytes(r.data))
        seen += len(r.data)
        assert (r.sha1, r.bytes) == (running.hexdigest(), seen)
    assert {r.url for r in table_ if r.page_id in (1, 2)} == {"http://a/%\n", None}
    assert warc.archive(pages.limit(0)).count() == 0


def test_hot_payload_is_stored_once_and_ids_differ(spark, tmp_path):
    """One payload a thousand times, repeated page_ids, payloads longer than a batch."""
    import gzip

    hot, long = "<p>hot</p>" * 200, "é" * 3_000_000
    rows = [(i, "u", hot) for i in range(1000)] + [(999, "u", hot), (2000, "u", long), (2000, "u", "short"), (2001, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(warc.payloads(pages, Scratch(spark, "t")), f"file://{tmp_path}/w").collect()
    raw = b"".join(gzip.decompress(open(r.path.replace("file://", ""), "rb").read()) for r in archives)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert len(ids) == len(set(ids)) == sum(r.records for r in archives) == len(rows)
    assert raw.count(hot.encode()) == 2 and raw.count(long.encode()) == 1  # page 999 twice; 2001 for 2000
    found = warc.records(warc.archive(pages)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id > 997) == [(998, "revisit", 999), (999, "response", None), (999, "response", None), (2000, "response", None), (2000, "revisit", 2001), (2001, "response", None)]
    assert {r.refers_to for r in found if r.page_id < 999} == {999}


def test_archives_are_plain_warc(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "hello")], "page_id long, url string, html string")
    path = warc.write_archives(warc.payloads(pages, Scratch(spark, "t")), f"file://{tmp_path}/w").first().path
    raw = gzip.decompress(open(path.replace("file://", ""), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nhello\r\n\r\n")


def test_damaged_archives_are_noticed(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "hello")], "page_id long, url string, html string")
    path = warc.write_archives(warc.payloads(pages, Scratch(spark, "t")), f"file://{tmp_path}/w").first().path.replace("file://", "")
    raw = gzip.decompress(open(path, "rb").read())
    open(path, "wb").write(gzip.compress(raw.replace(b"hello", b"hullo")))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_chunks(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()


@given(st.lists(st.integers(0, 50), max_size=12), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_differencing_places_all_items(sizes, parts):
    placed = sharding.differencing(sizes, parts)
    sums = [sum(s for s, p in zip(sizes, placed) if p == k) for k in range(parts)]
    assert len(placed) == len(sizes) and set(placed) <= set(range(parts))
    assert max(sums, default=0) - min(sums, default=0) <= max(sizes, default=0)


@given(st.lists(st.integers(0, 50), max_size=14), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_differencing_against_a_plain_form(sizes, parts):
    """Partitions as sorted lists of (sum, items); the two of largest spread are joined, largest with smallest."""
    held = [[(0, [])] * (parts - 1) + [(s, [i])] for i, s in enumerate(sizes)]
    spread = lambda h: h[-1][0] - h[0][0]
    age = list(range(len(held)))
    while len(held) > 1:
        picked = sorted(range(len(held)), key=lambda j: (-spread(held[j]), age[j]))[:2]
        a, b = (held[j] for j in picked)
        both = sorted(((x + y, k, p + q) for k, ((x, p), (y, q)) in enumerate(zip(a, reversed(b)))), key=lambda t: t[:2])
        rest = [j for j in range(len(held)) if j not in picked]
        held, age = [held[j] for j in rest] + [[(s, items) for s, _, items in both]], [age[j] for j in rest] + [max(age) + 1]
    want = sorted(s for s, _ in held[0]) if held else []
    placed = sharding.differencing(sizes, parts)
    sums = sorted(sum(s for s, p in zip(sizes, placed) if p == k) for k in range(parts))
    assert not sizes or sums == want


def test_known_differencing_result():
    sizes = [8, 7, 6, 5, 4]
    placed = sharding.differencing(sizes, 2)
    assert sorted(sum(s for s, p in zip(sizes, placed) if p == k) for k in range(2)) == [14, 16]  # 8-7=1, 6-5=1, 4-1=3, 3-1=2


def test_shards(spark, sf_dir):
    docs = docs_of(spark, ODD).select("doc_id", "text").union(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = sharding.shard(docs).toPandas()
    texts = [r.text for r in docs.collect()]
    assert sorted(found["size"]) == sorted(len((t or "").encode()) + 8 for t in texts) and set(found.text_crc32) == {zlib.crc32((t or "").encode()) for t in texts}
    assert found.groupby("text_crc32")["shard"].nunique().max() == 1 and set(found["shard"]) <= set(range(24))
    for _, s in found.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    sums = found.groupby("shard")["size"].sum()
    group = found["text_crc32"].map(found.groupby("text_crc32")["size"].sum())
    others = sums.drop(found.loc[group > sums.mean(), "shard"].unique())  # a group above a mean shard has one alone
    assert len(others) >= 20 and others.max() - others.min() <= 0.01 * others.mean()
    assert sharding.shard(docs.limit(0)).count() == 0


def test_rotation_covers_everyone_and_masks_the_assistant(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi<|im_end|>"), (1, 2, "bob b", "yo"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, None, "first"), (1, 200, "bob_b", "late"), (1, 300, "unknown", "é"), (1, 301, "Zoë*~+%", "x"), (2, 0, "system", "only"), (None, 0, "ann", "alone"), (None, 0, "ann", "alone"), (None, 1, "bob", "other")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "conv_id long, turn long, role string, text string, chunk int, row_in_subset int")
    found = chat.rotate(df).collect()
    mine = {(r.perspective, r.chunk): r for r in found if r.conv_id == 1}
    assert set(mine) == {(p, 0) for p in ("ann", "bob b", "bob_b", None, "unknown", "Zoë*~+%")}
    ann = mine[("ann", 0)]
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["hi<|im end|><|im_end|>", "<|im_end|>", "<|im_end|>"]
    assert ann.text.startswith("<|im_start|>user\nfirst<|im_end|>\n<|im_start|>system\nbe kind") and "user name=bob%20b\nyo" in ann.text
    for name in ("bob_b\nlate", "unknown\né", "Zo%C3%AB%2A~%2B%25\nx"):  # speakers that would clash if unsafe characters went
        assert f"user name={name}" in ann.text
    assert [mine[(None, 0)].text[s.start : s.end] for s in mine[(None, 0)].spans] == ["first<|im_end|>"]
    assert sorted(r.n_turns for r in found if r.conv_id is None) == [1, 2]
    assert not [r for r in found if r.conv_id == 2] and chat.rotate(df.limit(0)).count() == 0


def test_chunks_hold_equally_many_turns_whatever_their_numbers(spark):
    rows = [(1, None, "ann", f"say {t}") for t in range(150)] + [(2, 7, f"p{t % 40}", f"say {t}") for t in range(150)] + [(3, t * 10**9, "ann", f"say {t:03d}") for t in range(150)]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.chunk, r.n_turns) for r in found} == {(c, k, n) for c in (1, 2, 3) for k, n in ((0, 64), (1, 64), (2, 22))}
    assert len({r.perspective for r in found if r.conv_id == 2}) == 40
    third = sorted((r.chunk, r.text) for r in found if r.conv_id == 3)
    assert "".join(t for _, t in third) == "".join(f"<|im_start|>assistant\nsay {t:03d}<|im_end|>\n" for t in range(150))


def test_chunks_are_joined_to_whole_dialogues(spark):
    rows = [(1, t, ("ann", "bob")[t % 2], f"say {t}") for t in range(150)] + [(2, 1_000 * t, ("ann", "bob")[t % 2], f"é {t}") for t in range(5)] + [(None, 0, "ann", "alone"), (None, 900, "ann", "too")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    of = lambda frame: sorted((r.conv_id or -1, r.perspective, r.n_turns, r.text, [tuple(s) for s in r.spans]) for r in frame.collect())
    found = of(chat.joined(chat.rotate(df)))
    assert found == of(chat.rotate(df, chunk_turns=10**6)) and len(found) == 6
    ann = next(r for r in found if r[:2] == (1, "ann"))
    assert [ann[3][a:b] for a, b in ann[4]] == [f"say {t}<|im_end|>" for t in range(0, 150, 2)]
