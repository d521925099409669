"""Fill-in-the-middle: brute-force slicing of strings against the in-place rotation, and exact round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relief.llm import fill_middle as fim

ANY = st.text(st.one_of(st.sampled_from("ab<>PSM é中😀\ń"), st.characters(codec="utf-8")), max_size=60)


def by_slicing(text, doc_id, percent=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not n or h3 % 100 >= percent or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(ANY, st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)))
def test_rotation_equals_slicing_and_restores(text, doc_id):
    out, n, form, pre, mid = fim.transform_text(text.encode(), doc_id, fim.Plan())
    assert (n, form, pre, mid, out.decode()) == by_slicing(text, doc_id)
    assert fim.restore_text(out, form, fim.Plan()).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=40), st.data())
def test_exchange_in_small_chunks(values, data):
    lo, mid, hi = sorted(data.draw(st.tuples(*[st.integers(0, len(values))] * 3)))
    view = np.array(values, np.uint8)
    held, fim.CHUNK = fim.CHUNK, 3
    try:
        fim.exchange(view, lo, mid, hi)
    finally:
        fim.CHUNK = held
    assert view.tolist() == values[:lo] + values[mid:hi] + values[lo:mid] + values[hi:]


def test_table_with_nulls_repeats_long_texts_and_clashing_names(spark):
    long = "é<P " * 500_000 + "S>"
    rows = [(1, "abc", "x"), (1, "abc", "x"), (1, "other text", None), (None, "null id", "x"), (2, None, None), (3, "", "x"), (4, "with <M> inside", "x"), (5, long, "x"), (6, "<P" + ">", "x")]
    rows += [(100 + k, f"text number {k} é😀", "x") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fim.restore(fim.transform(df)).collect()
    assert sorted((str(r.doc_id), r.output, r.n, r.form, r.prefix_chars, r.middle_chars, r.restored) for r in got) == sorted(
        (str(i), out, n, form, pre, mid, t or "") for i, t, _ in rows for n, form, pre, mid, out in [by_slicing(t, i)]
    ), "every row, in any order"
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(df.limit(0))).collect() == []


def test_own_sentinels(spark):
    plan = fim.Plan(b"[pre]", b"[mid]", b"[suf]", 100, 50, "seed")
    rows = [(k, "x<P>y" * k) for k in range(1, 40)]
    got = fim.restore(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), plan), plan).collect()
    assert all(r.restored == "x<P>y" * r.doc_id and r.form != "plain" for r in got) and len(got) == 39
    for bad in ((b"", b"a", b"b"), (b"<a", b"<a>", b"<b>"), (b"aba", b"c", b"d"), (b"xa", b"ay", b"z"), (b"a", b"a", b"b")):
        with pytest.raises(ValueError):
            fim.Plan(*bad)
