"""Vantage-point search, shingles, signature trees, n-gram join and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from relief.llm import ngram_join, signature_tree, vp_search
from relief.llm.components import _round, components
from relief.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def reach(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def corpus(seed, n=160):
    """Texts with exact copies, near copies, a large group of near copies and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    base = " ".join(word() for _ in range(120))
    out = ["", None, "  \n", "one", "ONE", "two words", "two  Words ", "three little words", "a b c d", "a b c d e"]
    out.append(" ".join(word() for _ in range(20_000)))
    while len(out) < n:
        kind = rng.random()
        if kind < 0.25:
            text = rng.choice(out) or "x"
            words = text.split()[:400]
            if words and rng.random() < 0.7:
                for _ in range(rng.randint(1, 3)):
                    words[rng.randrange(len(words))] = word()
            out.append(" \n".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        elif kind < 0.5:
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(1, 150))) + (" " + passage if rng.random() < 0.4 else ""))
    return out


@pytest.mark.parametrize(("seed", "words", "percent", "block"), [(1, 4, 85, 2048), (2, 5, 80, 8), (3, 3, 60, 16)])
def test_join_equals_brute_force(spark, seed, words, percent, block):
    texts = corpus(seed)
    rows = [(i * 3, t, 1, "clash") for i, t in enumerate(texts)]
    sets = {i: shingles(t, words) for i, t, _, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reach(sets, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, component string").repartition(5)
    got, found = ngram_join.ngram_join(docs, words=words, percent=percent, block=block)
    got = {r.doc_id: r for r in got.collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    same = Counter(sets.values())
    assert all(r.class_size == (same[sets[i]] if sets[i] else 1) for i, r in got.items())
    for r in found.collect():
        assert (len(sets[r.a] & sets[r.b]), len(sets[r.a] | sets[r.b])) == (r.overlap, r.union)


def test_join_empty_table_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    got, links = ngram_join.ngram_join(spark.createDataFrame([], schema))
    assert got.collect() == [] and links.collect() == []
    text = " ".join(f"w{i}" for i in range(100))
    got, _ = ngram_join.ngram_join(spark.createDataFrame([(None, "lone text"), (None, text), (4, text), (9, text + " x"), (9, "other words here too")], schema))
    state = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)
    assert state == sorted([(None, 1, None), (None, 97, 4), (4, 97, 4), (9, 98, 4), (9, 1, 9)], key=str)  # the unlike text of id 9 is a document of its own


def test_join_tells_the_rows_of_one_id_apart(spark):
    base = [f"w{i}" for i in range(100)]
    near, other = " ".join(base + ["x"]), " ".join(f"o{i}" for i in range(60))
    rows = [(1, " ".join(base), 10), (1, near, 11), (5, near + " y", 12), (5, other, 13), (5, other + " z", 14), (None, near, 15), (7, None, 16), (8, other, 17), (8, other, 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag long")
    got, _ = ngram_join.ngram_join(docs, words=5, percent=80, all_links=False, tag_col="tag")
    state = sorted(((r.tag, r.component_id, r.kept) for r in got.collect()), key=str)
    assert state == sorted([(10, 1, True), (11, 1, False), (12, 1, False), (13, 5, True), (14, 5, False), (15, 1, True), (16, 7, True), (17, 5, False), (17, 5, False)], key=str)


@pytest.mark.parametrize(("seed", "words", "percent", "block"), [(1, 4, 85, 2048), (2, 5, 80, 8), (3, 3, 60, 16)])
def test_join_counts_and_returns_every_link(spark, seed, words, percent, block):
    texts = corpus(seed)
    sets = {i * 3: shingles(t, words) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    degree = Counter(x for link in links for x in link)
    first = {}
    for i, own in sets.items():
        first.setdefault(own, i)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got, found = ngram_join.ngram_join(docs, words=words, percent=percent, block=block)
    assert {r.doc_id: r.n_links for r in got.collect()} == {i: degree[i] for i in sets}
    want = sorted((a, b) for a, b in links if first[sets[a]] == a and first[sets[b]] == b)
    assert sorted((r.a, r.b) for r in found.collect()) == want


def test_links_of_split_components_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 290)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5]), (None, texts[5]), (None, "lone text")], "doc_id long, text string")
    got, found = ngram_join.ngram_join(docs)  # over 256 sets: several blocks
    state = Counter((r.doc_id is None, r.n_links) for r in got.collect())
    assert state == {(False, 289): 291, (True, 290): 1, (True, None): 1}
    assert found.count() == 290 * 289 // 2


def test_one_large_class_is_broadcast_to_its_rows(spark, monkeypatch):
    texts = corpus(4, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "the same text again and again") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for share in (4096, 2, 0):  # all classes, the large one, none
        monkeypatch.setattr(ngram_join, "HOT_SHARE", share)
        got, _ = ngram_join.ngram_join(docs)
        got = sorted(tuple(r) for r in got.collect())
        want = want or got
        assert got == want and len(got) == 260


def test_shingles_of_whole_texts():
    texts = corpus(9, 60) + ["x" * 5000, "a\x0bb\x0cc\rd e\tf\ng", "nb sp stays one", None]
    hashes, at = shingle_sets(pa.array(texts), 4)
    seen = {}
    for k, t in enumerate(texts):
        own = hashes[at[k] : at[k + 1]]
        want = shingles(t, 4)
        assert len(own) == len(want) and (np.diff(own.astype(object)) > 0).all()
        assert seen.setdefault(want, own.tobytes()) == own.tobytes()
    assert len({v for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("seed", range(3))
def test_traversal_loses_no_similar_pair_and_prunes(seed):
    rng = np.random.default_rng(seed)
    sets, base = [], rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(300):
        own = rng.integers(0, 1 << 63, int(rng.integers(3, 900)), dtype=np.uint64)
        if k % 4 == 0:
            own = np.r_[base[: 300 - k % 7], own[: k % 11]]
        elif k % 4 == 1 and sets:
            own = np.r_[sets[-1][: int(len(sets[-1]) * 0.95)], own[:4]]
        sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    component = np.where(np.arange(300) % 16 == 0, 0, np.arange(300))  # some are joined already
    as_sets = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(300) for j in range(i) if component[i] != component[j] and 100 * len(as_sets[i] & as_sets[j]) >= 80 * len(as_sets[i] | as_sets[j])}
    marks = [signature_tree.signature(s) for s in sets]
    for side in (None, np.arange(300) % 2):
        got = set()
        for i, j, _ in signature_tree.join_group(marks, sizes, component, 80, side):
            pairs = {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
            assert not pairs & got  # each pair once
            got |= pairs
        assert got >= (want if side is None else {(i, j) for i, j in want if side[i] != side[j]})
        assert len(got) < 0.25 * 300 * 299 / 2


def test_components_equal_union_find(spark):
    cases = [[(4, 3), (4, 1), (5, 3), (5, 2)], [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)]]
    for seed in range(4):
        rng = random.Random(seed)
        cases.append([(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)])
    for links in cases:
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
        real = [(a, b) for a, b in links if a is not None and a != b]
        want = reach({x for link in real for x in link}, real)
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_a_round_over_few_edges_has_no_shuffle(spark):
    """Hundreds of tasks and threads a round filled the driver of the pipeline."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)], "u long, v long").repartition(4)
    plan = _round(edges, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" not in plan


def test_components_of_more_edges_than_one_partition_takes(spark, monkeypatch):
    monkeypatch.setattr("relief.llm.components.EDGES_PER_PARTITION", 7)
    rng = random.Random(5)
    links = [(0, i) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 280), rng.randint(200, 280)) for _ in range(60)]
    real = [(a, b) for a, b in links if a != b]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = reach({x for link in real for x in link}, real)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def brute_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        scored = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                scored.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_search_is_exact_with_factor_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) + (i % 5)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(200)]  # one very common vector: ties
    rows += [(5000 + i, (2.0 * np.array(rows[5][1])).tolist()) for i in range(3)]
    bad = [(10_000, None), (10_050, []), (10_100, [0.0] * 16), (10_150, [float("nan")] + [1.0] * 15), (10_200, [None] + [1.0] * 15), (10_250, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    other = [(20_000, [1.0, 2.0]), (20_050, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + other], "vec_id long, embedding array<double>, score string").repartition(4)
    got = vp_search.search(df, df.where("vec_id % 50 = 0"), k=5, shard_rows=300, block_rows=10).collect()
    usable = rows + other
    want = brute_nearest(usable, [(i, v) for i, v in usable if i % 50 == 0], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    scores = {(q, r): s for q, r, _, s in want}
    assert all(abs(r.score - scores[r.query_id, r["rank"]]) < 1e-9 for r in got)


def test_search_factor_trades_recall(spark):
    rng = np.random.default_rng(8)
    ids, vectors = np.arange(4000), rng.normal(size=(4000, 8))
    tree = vp_search.VantagePointTree(ids, vectors)
    exact = tree.search(ids[:200], vectors[:200], 5, 1.0)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units[:200] @ units.T
    near[np.arange(200), np.arange(200)] = -2
    want = {(q, i) for q in range(200) for i in np.argsort(-near[q])[:5].tolist()}
    assert set(zip(exact[0].tolist(), exact[1].tolist(), strict=True)) == want
    loose = tree.search(ids[:200], vectors[:200], 5, 1.5)
    recall = len(want & set(zip(loose[0].tolist(), loose[1].tolist(), strict=True))) / len(want)
    assert 0.5 < recall <= 1.0


def test_search_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.1])], "vec_id long, embedding array<float>")
    got = vp_search.search(df, df.where("vec_id = 0"), k=5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]  # of id 0 the vector (0, 1) counts
    assert vp_search.search(df.limit(0), df.limit(0)).collect() == []
