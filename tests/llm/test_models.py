"""Language identification, line quality and URL filter: held-out accuracy, brute force of the inference, edge cases."""

import itertools
import os
import random
import time
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relief.llm import language_id, line_quality, queries, url_filter

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

WORDS = {
    "en": "the of and to in is that with for was this are from have which they their would about there".split(),
    "de": "der die und das nicht mit ist ein von auf werden haben durch einer zwischen schon über können für".split(),
    "fr": "le la les des et est une dans pour que qui avec nous vous être très où français déjà après".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


# ---- language


def languages(spark, seed=1, n=360):
    rng = random.Random(seed)
    rows = [(i, prose(rng, lang := rng.choice(list(WORDS)), rng.randint(5, 80)), lang, 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_language_accuracy_and_edge_cases(spark):
    docs = languages(spark)
    model = language_id.train(docs, F.col("doc_id") % 3 != 1)
    assert model.languages == ("de", "en", "fr")
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.doc_id % 3 == 1]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert np.mean([r.rejected for r in got]) < 0.05 and all(0 <= r.score <= 1 for r in got)
    long = prose(random.Random(3), "fr", 60_000)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, long), (5, long), (None, "the of and the of and that")]
    odd = spark.createDataFrame([(i, t, "clash") for i, t in odd], "doc_id long, text string, lang_pred string")
    out = language_id.predict(odd, model).collect()
    assert len(out) == 7
    by = {r.doc_id: r for r in out}
    assert all((by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True) for k in (1, 2, 3))
    assert by[4].lang_pred in model.languages and by[5].lang_pred == "fr" and by[None].lang_pred == "en"
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {5, None}
    assert language_id.predict(odd.limit(0), model).collect() == []


def test_language_counts_equal_brute_force():
    texts = ["Ab c1d é", "", None, "x", "a-b ab", "ŒUVRE"]
    buckets, at = language_id.subword_counts(texts)
    for k, text in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
        grams = set()
        count = 0
        for w in words:
            padded = f" {w} "
            for n in language_id.GRAMS:
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    inner = g[1:-1] if n > 2 else ""
                    if g.strip() and " " not in inner and (n > 1 or g != " ") and (n <= 2 or inner):
                        grams.add(g)
                        count += 1
        # two neighbouring words share one border in the text, but border runs never join two words
        assert (at[k + 1] - at[k] >= len(grams)) and at[k + 1] - at[k] <= count
        assert len(set(buckets[at[k] : at[k + 1]].tolist())) <= len(grams)


def test_language_with_too_little_to_learn(spark):
    docs = languages(spark, n=30)
    assert language_id.train(docs.limit(0), F.lit(True)).languages == ()
    empty = language_id.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'fr'"), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"fr"}
    nulls = docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang")
    assert language_id.train(nulls, F.lit(True)).languages == ()


def test_language_sample_is_bounded_and_repeatable(spark):
    docs = languages(spark)
    a, b = (language_id.train(docs.repartition(n), F.lit(True), max_rows=100) for n in (2, 5))
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.reject_below == b.reject_below


def caught(monkeypatch, module):
    """What reaches the module's ``fit``."""
    seen, fit = [], module.fit

    def watch(*args):
        seen.append(args)
        return fit(*args)

    monkeypatch.setattr(module, "fit", watch)
    return seen


def test_language_learns_one_text_of_an_id(spark, monkeypatch):
    seen = caught(monkeypatch, language_id)
    rng = random.Random(4)
    rows = [(7, prose(rng, "en", 5 + k % 9), "en") for k in range(3000)] + [(8, "der die und das nicht", "de")] * 500 + [(i, prose(rng, "fr", 9), "fr") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(docs, F.lit(True), max_rows=16)
    assert len(seen[0][0]) == 16 and [s[0] for s in seen[0][0]].count("en") == 1 == [s[0] for s in seen[0][0]].count("de")
    assert model.languages == ("de", "en", "fr")  # the rare ones too


def test_language_draws_from_every_language(spark, monkeypatch):
    seen = caught(monkeypatch, language_id)
    rows = [(i, f"text {i}", "rare" if i in (5, 900) else "en") for i in range(2000)]
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), max_rows=20)
    assert [s[0] for s in seen[0][0]].count("rare") == 2 and len(seen[0][0]) == 20


def test_language_prediction_equals_plain_python(spark):
    model = language_id.train(languages(spark), F.lit(True))
    mask = (1 << 64) - 1

    def mix(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * c & mask
        return x ^ x >> 33

    def predict(text):
        code = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
        buckets = []
        for n in language_id.GRAMS:
            for i in range(len(code) - n + 1):
                g = code[i : i + n]
                letter = [c != 32 for c in g]
                if all(letter[1:-1]) and (n > 2 or any(letter)):
                    total = n
                    for c in g:
                        total = (total * 0x100000001B3 + c) & mask
                    buckets.append(mix(total) & (language_id.BUCKETS - 1))
        if not buckets:
            return "und", 0.0
        logits = [sum(float(model.table[b, k]) for b in buckets) / len(buckets) + model.bias[k] for k in range(len(model.languages))]
        weight = [np.exp((x - max(logits)) / model.temperature) for x in logits]
        best = int(np.argmax(logits))
        return model.languages[best], weight[best] / sum(weight)

    texts = ["the of and to", "Der, DIE und das!", "où êtes-vous déjà", "ab", "é", "x1y2 z", "", "12 !?", "über können\nfür", "mixed the und les", " a  b "]
    names, scores = model.predict(texts)
    want = [predict(t) for t in texts]
    assert names == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want], atol=1e-5)


# ---- quality


def documents(spark, seed=2, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = [prose(rng, "en", rng.randint(4, 30)).capitalize() + "." for _ in range(rng.randint(1, 12))]
        if not good:
            bad = rng.choice([lambda x: x.upper().replace(" ", "!! "), lambda x: x.replace(" ", "### "), lambda x: " ".join([x.split()[0]] * 20)])
            lines = [bad(x) if rng.random() < 0.9 else x for x in lines]
        rows.append((i, "\n".join(lines), 1.0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_accuracy_and_edge_cases(spark):
    docs, labels = documents(spark)
    model = line_quality.train(docs, labels, F.col("doc_id") % 4 != 2)
    got = line_quality.predict(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.doc_id % 4 == 2]
    assert len(got) == 300 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) > 0.95
    text = "\n".join([prose(random.Random(1), "en", 12) + "."] * 3 + ["a b c."] * 20_000)
    odd = [(1, None), (2, ""), (3, " \n\n "), (4, "x"), (5, text), (5, text), (None, "A line."), (6, "one " * 50_000)]
    odd = spark.createDataFrame([(i, t, 7) for i, t in odd], "doc_id long, text string, score int")
    out = line_quality.predict(odd, model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (1, 2, 3)} == {0.0}
    kept = line_quality.accepted(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == 8
    assert line_quality.predict(odd.limit(0), model).collect() == []


def test_quality_with_too_little_to_learn(spark):
    docs, labels = documents(spark, n=20)
    for known in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        model = line_quality.train(docs, known, F.lit(True))
        assert all(0 <= r.score <= 1 for r in line_quality.predict(docs, model).collect())
    assert line_quality.train(docs.limit(0), labels, F.lit(True)).score(pa.array(["a", None])).tolist()[1] == 0.0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    at = np.array([0, 1, 1, 5, 8])
    score, move = rng.normal(size=8), rng.normal(size=(2, 2))
    good, moves = line_quality.marginals(score, at, move)
    want, want_moves = np.zeros(8), np.zeros((2, 2))
    for lo, hi in itertools.pairwise(at):
        paths = list(itertools.product((0, 1), repeat=hi - lo))
        weight = np.array([np.exp(sum(score[lo + t] * s for t, s in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t, s in enumerate(p):
                want[lo + t] += w * s
            for a, b in itertools.pairwise(p):
                want_moves[a, b] += w
    assert np.allclose(good, want) and np.allclose(moves, want_moves)


def test_long_rows_equal_the_plain_recursion(monkeypatch):
    rng = np.random.default_rng(2)
    at = np.array([0, 3, 40, 40, 171, 400])
    score, move = 3 * rng.normal(size=400), rng.normal(size=(2, 2))
    want, want_moves = line_quality.marginals(score, at, move)
    for long in (1, 2, 36, 130):
        monkeypatch.setattr(line_quality, "LONG", long)
        good, moves = line_quality.marginals(score, at, move)
        assert np.allclose(good, want) and np.allclose(moves, want_moves)


def test_many_lines_take_time_in_proportion():
    text = "\n".join(["a b c."] * 400_000)
    start = time.perf_counter()
    features, _, at = line_quality.line_features(pa.array([text]))
    good, _ = line_quality.marginals(features[:, 2] - 0.1, at, np.array([[0.5, -0.5], [-0.5, 0.5]]))
    assert len(good) == 400_000 and time.perf_counter() - start < 15


def test_quality_learns_one_text_of_an_id(spark, monkeypatch):
    seen = caught(monkeypatch, line_quality)
    docs, labels = documents(spark, n=40)
    many = spark.range(3000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("A line number "), "id", F.lit(".")).alias("text"), F.lit(1.0).alias("score"))
    line_quality.train(docs.unionByName(many), labels, F.lit(True), max_rows=16)
    assert len(seen[0][3]) == 16


def test_line_features_do_not_depend_on_the_batch():
    texts = ["A line.\nAnother ONE!!\n\nA line.", None, "", "x", "é ü\n| a | b |", "word word word\nother"]
    features, size, at = line_quality.line_features(pa.array(texts))
    for k, t in enumerate(texts):
        own, own_size, _ = line_quality.line_features(pa.array([t]))
        assert np.array_equal(features[at[k] : at[k + 1]], own) and np.array_equal(size[at[k] : at[k + 1]], own_size)
        assert len(own) == len([x for x in (t or "").split("\n") if x.strip()])


# ---- URLs

RULES = queries.RULES


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    return host, rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x=/fr/#a", "http://example.net/en", "http://a.net", "http://a.net/", "http://a.net?x", "http://a.net#/",
        "http://x.example.com/de/1", "http://example.com/De/1", "http://badexample.com/de/", "http://example.org/fr/", "org://org/fr/x", "http://É.net/a\nb", "a://b://c/d", "http://u@h.net:80/",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name)
        assert got[i].verdict in ("allow", "block") and (best is None or got[i].verdict == best.verdict)
    assert plain("http://WWW.x.de/p?q")[0] == urlsplit("http://www.x.de/p?q").netloc


def test_model_tells_the_rest_apart_and_counts_all(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(f"http://{word('abcde')}.example.net/en/{word('abc')}") for _ in range(300)] + [(f"http://{word('vwxyz')}.net/{word('xyz')}") for _ in range(300)]
    rest = [(f"http://{word('abcde')}.example.info/en/{word('abc')}", "allow") for _ in range(50)] + [(f"http://{word('vwxyz')}.info/{word('xyz')}", "block") for _ in range(50)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows + [u for u, _ in rest])], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    right = [got[600 + i].verdict == want for i, (_, want) in enumerate(rest)]
    assert np.mean(right) > 0.9
    # counts of single symbols are those of all labelled URLs
    judged = pages.withColumn("verdict", F.when(F.col("page_id") < 300, "allow").when(F.col("page_id") < 600, "block"))
    model = url_filter.train(judged)
    want = sum(len(u) + 1 for u in rows[:300]) * (url_filter.ORDER + 1)
    assert model.grams[1].sum() == want == model.contexts[1].sum()


def test_log_ratio_equals_plain_recursion():
    rng = np.random.default_rng(5)
    train = [("http://abc.de/x", 1), ("http://abd.de/y", 1), ("http://zzz.net/", 0), ("", 0)]
    exact = [{}, {}]
    counted = [{}, {}]
    for u, side in train:
        g, c, _ = url_filter.gram_keys(pa.array([u]))
        for key in [*g.ravel().tolist(), *c.ravel().tolist()]:
            exact[side][key] = exact[side].get(key, 0) + 1
        code = [url_filter.START] * url_filter.ORDER + list(u.encode()) + [url_filter.STOP]
        for i in range(url_filter.ORDER, len(code)):
            for k in range(url_filter.ORDER + 1):
                for key in ((tuple(code[i - k : i]), code[i]), (tuple(code[i - k : i]), None)):
                    counted[side][key] = counted[side].get(key, 0) + 1
    tests = ["http://abc.net/", "", "q" * 50, "".join(chr(int(c)) for c in rng.integers(32, 900, 40)), None]

    def log_probability(u, side):
        code = [url_filter.START] * url_filter.ORDER + list((u or "").encode()) + [url_filter.STOP]
        total = 0.0
        for i in range(url_filter.ORDER, len(code)):
            p = 1 / 257
            for k in range(url_filter.ORDER + 1):
                context = tuple(code[i - k : i])
                p = (counted[side].get((context, code[i]), 0) + 4 * p) / (counted[side].get((context, None), 0) + 4)
            total += np.log(p)
        return total / (len(code) - url_filter.ORDER)

    grams, contexts, row = url_filter.gram_keys(pa.array(tests))
    held = lambda keys: lambda side, k: np.array([exact[side].get(x, 0) for x in keys[:, k].tolist()])
    got = url_filter.mean_log_ratio(held(grams), held(contexts), row, len(tests), 4.0, None)
    assert np.allclose(got, [log_probability(u, 1) - log_probability(u, 0) for u in tests])


def test_counts_are_exact_with_more_grams_than_a_fixed_table_holds(spark):
    rng = random.Random(8)
    tail = lambda: "".join(chr(rng.randint(33, 126)) for _ in range(60)).replace("/", "-")
    known = [(f"http://a.example.net/en/{tail()}", 1) for _ in range(2000)] + [(f"http://b.net/{tail()}", 0) for _ in range(2000)]
    rest = [f"http://c.info/{tail()}" for _ in range(20)] + [None, ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([u for u, _ in known] + rest)], "page_id long, url string").repartition(3)
    got = {r.page_id: r.log_ratio for r in url_filter.judge(pages, RULES).collect()}
    counted = [{}, {}]

    def grams(u):
        code = [url_filter.START] * url_filter.ORDER + list((u or "").encode()) + [url_filter.STOP]
        return [[(tuple(code[i - k : i]), code[i]) for k in range(url_filter.ORDER + 1)] for i in range(url_filter.ORDER, len(code))]

    for u, side in known:
        for orders in grams(u):
            for context, symbol in orders:
                for key in ((context, symbol), (context, None)):
                    counted[side][key] = counted[side].get(key, 0) + 1

    def log_probability(u, side):
        total = 0.0
        for orders in grams(u):
            p = 1 / 257
            for context, symbol in orders:
                p = (counted[side].get((context, symbol), 0) + 4 * p) / (counted[side].get((context, None), 0) + 4)
            total += np.log(p)
        return total / len(grams(u))

    assert np.allclose([got[4000 + i] for i in range(len(rest))], [log_probability(u, 1) - log_probability(u, 0) for u in rest], rtol=1e-9, atol=1e-12)


def test_threshold_comes_from_all_urls_of_a_rare_class(spark):
    scored = [(f"b{i}", "block", -0.5 - i / 1e6) for i in range(20_000)] + [("a", "allow", -0.25), ("c", None, None)]
    cut = url_filter.calibrated(spark.createDataFrame(scored, "url string, verdict string, own_ratio double"))
    assert -0.5 < cut <= -0.25


def test_urls_without_a_class_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.info/"), (1, "http://a.info/"), (None, "http://b.net/x")], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge(pages, RULES).collect()) == ["allow", "allow", "block"]
    assert url_filter.judge(pages.limit(0), RULES).collect() == []


# ---- registered queries on the driver's tables


@needs_data
def test_registered_models_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    got = queries.op6_line_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
