"""The pipeline: every stage against a brute-force version of its rule, over all that its predecessor kept."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = {
    "en": "the of and to in is that with for was this are from have which they their would about there".split(),
    "de": "der die und das nicht mit ist ein von auf werden haben durch einer zwischen schon über können für".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id long, _id long, _text string"


def prose(rng, lang, n):
    return ". ".join(" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 12))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        kind = i % 12
        text = "\n".join(prose(rng, lang, 3).capitalize() + "." for _ in range(rng.randint(2, 8)))
        if kind == 1 and rows:
            text = rng.choice(rows)[1].upper() if rng.random() < 0.3 else rng.choice(rows)[1]
        elif kind == 2 and rows:
            words = rng.choice(rows)[1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = text.upper().replace(" ", "!! ")
        elif kind == 4:
            text = rng.choice([None, "", "123 456 !?", text])
        rows.append((i, text, lang))
    labels = [(i, 0 if i % 12 == 3 else 1, 0) for i in range(240) if i % 12 not in (1, 4)]
    return rows, labels


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows in and out of every stage, each stage's rows written and read again."""
    sf = tmp_path_factory.mktemp("sf")
    rows, labels = corpus()
    table = [(i, t, lang, "s", 1, 0.5, 7, 8, "clash") for i, t, lang in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(sf))
        made.write.parquet(f"{sf}/stage{k}")
        after = spark.read.parquet(f"{sf}/stage{k}")
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    out["sf"] = str(sf)
    return out


def test_all_but_the_last_return_the_rows_unchanged(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        before, after, columns, kept_columns = stages[name]
        assert columns == kept_columns
        assert set(map(tuple, after)) <= set(map(tuple, before))


def test_language_drops_what_has_no_letter_and_little_else(stages):
    before, after, _, _ = stages["language"]
    kept = {r.doc_id for r in after}
    empty = {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}
    assert empty and not empty & kept
    assert len(kept) >= 0.97 * (len(before) - len(empty))


def test_quality_drops_junk_and_keeps_clean_documents(stages):
    before, after, _, _ = stages["quality"]
    kept = {r.doc_id for r in after}
    junk, clean = {r.doc_id for r in before if r.doc_id % 12 == 3}, {r.doc_id for r in before if r.doc_id % 12 in (0, 5, 6, 7)}
    assert np.mean([i in kept for i in junk]) < 0.1 and clean <= kept


def test_exact_dedup_equals_brute_force(stages):
    before, after, _, _ = stages["exact_dedup"]
    best = {}
    for r in before:
        key = (r.text or "").translate(LOWER)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert len(best) < len(before)
    assert sorted(r.doc_id for r in after) == sorted(best.values())


def test_near_dedup_equals_brute_force(stages):
    before, after, _, _ = stages["near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    reach = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and reach[a] < reach[b]:
                    reach[b], changed = reach[a], True
    want = sorted(i for i in sets if reach[i] == i)
    assert len(want) < len(before)
    assert sorted(r.doc_id for r in after) == want


def test_near_dedup_drops_only_what_something_like_it_stays_for(spark, tmp_path):
    base = [f"w{i}" for i in range(100)]
    a, near, other = " ".join(base), " ".join(base + ["x"]), " ".join(f"o{i}" for i in range(60))

    def left(rows):
        docs = spark.createDataFrame([(i, t, "en", None, None, None, None, None, None) for i, t in rows], SCHEMA)
        return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()), key=str)

    assert left([(1, a), (5, near), (5, other)]) == sorted([(1, a), (5, other)], key=str)
    assert left([(5, a), (5, near), (5, other), (None, near), (6, None)]) == sorted([(5, min((a, near), key=lambda t: [r for r in left([(5, a), (5, near)]) if r[1] == t] == [])), (5, other), (None, near), (6, None)], key=str)
    assert len(left([(5, a), (5, near)])) == 1


def test_packing_holds_every_document_once(stages):
    before, after, _, _ = stages["pack"]
    held = {}
    for r in after:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert held.keys() == {r.doc_id for r in before}
    assert all(sum(n for _, n, _ in pieces) == pieces[0][2] for pieces in held.values())


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, stages["sf"]).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in stages["pack"][1]}


def test_nulls_repeats_and_empty_tables_pass(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = "the of and to in is that with for was"
    rows = [(None, text, "en"), (1, text, None), (1, text, None), (2, None, "de"), (3, "der die und das nicht mit ist", "de"), (3, "der die und das nicht mit ist", "de")]
    for name, table in (("some", rows), ("none", [])):
        docs = spark.createDataFrame([(i, t, lang, None, None, None, None, None, None) for i, t, lang in table], SCHEMA)
        for stage, f in corpus_pipeline.STAGES:
            f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = docs if stage == "pack" else spark.read.parquet(f"{tmp_path}/{name}-{stage}")
        if name == "some":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"] or sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3"]
        else:
            assert docs.count() == 0
