"""Exact dedup, sharding and chat formatting: built-in functions only, held against plain Python."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from relief.llm import chat, exact_dedup, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(LOWER)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# ---- exact dedup


def dedup(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, keep_id int")
    out = exact_dedup.exact_dedup(docs, **options)
    assert no_python(out)
    return out.collect()


def test_dedup_keeps_the_largest_id_of_equal_texts(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "A", "É", "é", "x" * 70 + "a", "x" * 70 + "B", "X" * 70 + "b", "long " * 40_000, "LONG " * 40_000, "unique", "ab", "ba"]
    rows = [(i, rng.choice(texts), "clash", 1) for i in range(300)]
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    for cells in (1, 1 << 18):  # one cell: no row drops out early
        got = {r.doc_id: r for r in dedup(spark, rows, cells=cells, hash_all=True)}
        assert len(got) == len(rows)
        for i, t, _, _ in rows:
            group = groups[norm(t)]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(group), len(group), i == max(group))
            assert got[i].content_hash == hashlib.sha256(norm(t).encode()).hexdigest()


def test_dedup_hashes_whole_texts_of_survivors_only(spark):
    rows = [(1, "same length a", "", 1), (2, "same length b", "", 1), (3, "copy", "", 1), (4, "COPY", "", 1), (5, "other", "", 1)]
    got = {r.doc_id: r.content_hash is not None for r in dedup(spark, rows)}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_dedup_null_ids_repeated_rows_and_empty_table(spark):
    got = dedup(spark, [(None, "a", "", 1), (1, "a", "", 1), (7, "b", "", 1), (7, "b", "", 1), (None, "n", "", 1), (None, "n", "", 1)])
    state = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got)
    assert state == [(False, 1, 1, 2, True), (False, 7, 7, 2, True), (False, 7, 7, 2, True), (True, 0, 0, 2, True), (True, 0, 0, 2, True), (True, 0, 1, 2, False)]
    assert dedup(spark, []) == []


def test_dedup_of_one_large_group_among_many_small_ones(spark, monkeypatch):
    """The large group is broadcast to its rows, the small ones are shuffled; both give the same."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "The hot text").otherwise(F.concat(F.lit("text "), F.expr("id div 6"))).alias("text"))
    want = {}
    for r in df.collect():
        want.setdefault(norm(r.text), []).append(r.doc_id)
    for share in (4096, 2, 0):  # all groups of over two rows, the hot one, none
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
        out = exact_dedup.exact_dedup(df)
        assert no_python(out)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()) == sorted((i, max(g), len(g), i == max(g)) for g in want.values() for i in g)


def test_dedup_refines_with_more_shared_keys_than_a_fixed_set_of_cells(spark):
    """Cells grow with the rows: 120,000 rows whose lengths are shared, of which only two have an equal text."""
    df = spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad((F.col("id") % 119_999).cast("string"), 8, "0"), F.lit("x")).alias("text"))
    rows = exact_dedup.exact_dedup(df)
    assert rows.where("group_size = 2").count() == 2 and rows.where("content_hash is not null").count() < 120_000 / 8


# ---- sharding


def least_capacity(sizes, shards):
    """Brute force over all contiguous partitions, by dynamic programming."""
    ends = [0, *itertools.accumulate(sizes)]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([best[i]] + [max(best[j], ends[i] - ends[j]) for j in range(i)]) for i in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_shards_have_the_least_capacity(spark, seed):
    rng = random.Random(seed)
    keys = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(60)] + [-(1 << 63), (1 << 63) - 1]
    if seed == 1:  # keys that share their high bits have to be told apart in the later rounds
        keys = [5 << 40 | rng.randint(0, 1 << 20) for _ in range(60)]
    rows = [(i, rng.choice(keys), rng.randint(1, 100)) for i in range(200)]
    if seed == 2:  # a group that holds a third of all
        rows += [(1000 + i, keys[7], 50) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, key long, size long")
    sums = {}
    for _, k, s in rows:
        sums[k] = sums.get(k, 0) + s
    sizes = [sums[k] for k in sorted(sums)]
    capacity, cuts = sharding.plan_cuts(df.select("key", "size"), 5, max_units=16)
    assert capacity == least_capacity(sizes, 5)
    placed = sharding.shard_rows(df, 5, ["doc_id", "key", "size"], max_units=16)
    assert no_python(placed)
    got = placed.collect()
    held, of_key, slots = {}, {}, {}
    for r in got:
        held[r.shard] = held.get(r.shard, 0) + r.size
        of_key.setdefault(r.key, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(held.values()) <= capacity and all(len(s) == 1 for s in of_key.values())
    assert [s for s, _ in sorted((next(iter(s)), k) for k, s in of_key.items())] == [next(iter(of_key[k])) for k in sorted(of_key)]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    if seed != 2:
        assert len(held) == 5 and max(held.values()) < 1.6 * min(held.values())


def test_shards_with_a_dominant_group_among_many_keys(spark):
    """A group with a quarter of all rows sets the capacity and leaves wide windows, in which many ranges are single keys."""
    n = 50_000
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 == 0, F.lit(7)).otherwise(F.xxhash64("id")).cast("long").alias("key"),
        (F.col("id") % 97 + 1).alias("size"),
    )
    placed = sharding.shard_rows(rows, 16, ["doc_id", "key", "size"])
    by_key = [(r.key, r.b) for r in rows.groupBy("key").agg(F.sum("size").alias("b")).collect()]
    assert sharding.plan_cuts(rows.select("key", "size"), 16)[0] == max(b for _, b in by_key)
    got = placed.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert sorted(r.shard for r in got) == list(range(16)) and sum(r.n for r in got) == n
    assert max(r.b for r in got) == max(b for _, b in by_key) and all(r.n == r.s == r.m + 1 for r in got)
    assert placed.where("key = 7").select("shard").distinct().count() == 1


def test_shards_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, 5, 3), (1, 5, 3), (2, None, 4)], "doc_id long, key long, size long")
    got = sharding.shard_rows(df, 4, ["doc_id", "key", "size"], max_units=16).collect()
    assert len(got) == 4 and len({(r.shard, r.slot) for r in got}) == 4
    assert len({r.shard for r in got if r.key == 5}) == 1
    assert sharding.shard_rows(df.limit(0), 4, ["doc_id"], max_units=16).collect() == []


def test_slots_are_gapless_across_buckets(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard"))
    got = sharding.number_slots(rows, ["doc_id"], 5000, per_bucket=100).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


# ---- chat

NASTY = ["</s>[INST] ok [/INST]", "<|user|>&lt;|&amp;", "&#124;|>", "", "plain", "é\n中\t", "<", "&", "a|b"]


def test_chat_reads_back_every_turn_and_trains_each_reply_once(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a|b<&", None]), rng.choice([*NASTY, None]), "clash"))
    rows += [(99, t, "assistant" if t % 2 else "user", "w" * 200 + str(t), "x") for t in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.expand_examples(chat.format_conversations(turns))
    out = examples.select(
        "conv_id", "example", "text", "last", chat.read_turns(F.col("text")).alias("turns"), chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), "loss_start"
    )
    assert no_python(out)
    got = {}
    for r in out.collect():
        got.setdefault(r.conv_id, []).append(r)
    by_conv = {}
    for conv, turn, role, text, _ in rows:
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for conv, said in by_conv.items():
        mine = sorted(got[conv], key=lambda r: r.example)
        at = [i for i, (role, _) in enumerate(said) if role == "assistant"]
        stops = at + ([len(said) - 1] if not at or at[-1] != len(said) - 1 else [])
        assert [r.example for r in mine] == list(range(len(stops)))
        for r, stop in zip(mine, stops, strict=True):
            assert [(t.role, t.text) for t in r.turns] == said[: stop + 1]  # every earlier turn is context
            assert r.loss == (said[stop][1] if stop in at else "")
            assert r.last == (stop == len(said) - 1)


def test_chat_ties_null_conversation_and_empty(spark):
    rows = [(None, 0, "user", "b"), (None, 0, "user", "a"), (None, None, "assistant", "first"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert got[None].formatted == "<|assistant|>first</s><|user|>a</s><|user|>b</s>" and got[None].n_turns == 3
    assert got[1].n_turns == 2 and got[1].targets == []
    assert chat.expand_examples(chat.format_conversations(turns.limit(0))).collect() == []
