"""Merkle manifest: midstates against hashlib, whole trees against a recursive brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relief.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(digests):
    """All levels of a tree, the leaves first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, pos):
    """Per level: place in the run and the run."""
    out = []
    for level in levels[:-1]:
        run = pos // 8 * 8
        out.append((pos - run, level[run : run + 8]))
        pos //= 8
    return out


def brute(rows):
    """rows: (key, id, leaf, claimed) -> the manifest's rows."""
    by_key = {}
    for key, i, leaf, claimed in rows:
        by_key.setdefault(key, []).append((i is not None, i or 0, leaf, claimed, i))
    order = sorted(by_key, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels_of([r[2] for r in sorted(by_key[k])]) for k in order}
    forest = levels_of([trees[k][-1][0] for k in order])
    out = []
    for at, key in enumerate(order):
        for pos, (_, _, leaf, claimed, i) in enumerate(sorted(by_key[key])):
            folded, proof = claimed, []
            for slot, run in path(trees[key], pos) + path(forest, at):
                folded = H(*run[:slot], folded, *run[slot + 1 :])
                proof += run[:slot] + run[slot + 1 :]
            out.append((i, leaf, trees[key][-1][0], forest[-1][0], H(*proof), folded))
    return out


@pytest.mark.parametrize("n", [1, 2, 8])
def test_compression_equals_hashlib_and_resumes(n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 32, (8, 8, 5), dtype=np.uint64).astype(np.uint32)
    count = np.full(5, n)
    state = np.repeat(merkle.START, 5, axis=1)
    states = []
    for k in range(n):
        states.append(state)
        state = merkle.compress(state, merkle.hex_block(words[k]))
    hexes = [[d.hex() for d in merkle.raw(words[k])] for k in range(8)]
    assert [d.hex() for d in merkle.raw(merkle.finish(state, count))] == [H(*[hexes[k][j] for k in range(n)]) for j in range(5)]
    for slot in range(n):
        new = rng.integers(0, 1 << 32, (8, 5), dtype=np.uint64).astype(np.uint32)
        left_gone = words.copy()
        left_gone[: slot + 1] = 0  # what stands to the left isn't read again
        got = merkle.resume(states[slot], np.full(5, slot), count, new, left_gone)
        fresh = [d.hex() for d in merkle.raw(new)]
        assert [d.hex() for d in merkle.raw(got)] == [H(*[fresh[j] if k == slot else hexes[k][j] for k in range(n)]) for j in range(5)]


def manifest(spark, rows):
    df = spark.createDataFrame(rows, "key string, id long, leaf string, claimed string")
    got = merkle.manifest(df, F.col("key"), F.col("id"), F.unhex("leaf"), F.unhex("claimed"))
    return sorted([(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got.collect()], key=str)


def leaves(sizes, seed, tamper=0.3):
    rng = random.Random(seed)
    rows = [(key, i, H(str(rng.random())), None) for key, n in sizes.items() for i in rng.sample(range(10 * n), n)]
    rng.shuffle(rows)
    return [(k, i, d, H("x", d) if rng.random() < tamper else d) for k, i, d, _ in rows]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {None: 8},
        {"de": 1, None: 9, "en": 64, "": 65, "é": 2, "-": 7, "=": 3, "z": 513},
        {"hot": 5000, "b": 600, "c": 512},
        {f"k{k}": 1 + k % 3 for k in range(600)},
    ],
    ids=["one", "run", "mixed", "layers", "many keys"],
)
def test_manifest_equals_brute_force(spark, sizes):
    rows = leaves(sizes, len(sizes))
    got = manifest(spark, rows)
    assert got == sorted(brute(rows), key=str)
    verified = sum(r[5] == r[3] for r in got)
    assert verified == sum(r[2] == r[3] for r in rows)


def test_null_and_repeated_ids_equal_rows_and_empty(spark):
    d = [H(str(k)) for k in range(4)]
    rows = [("a", None, d[0], d[0]), ("a", None, d[1], d[0]), ("a", 1, d[2], d[2]), ("a", 1, d[2], d[2]), ("a", 1, d[2], d[2]), ("a", 1, d[1], d[1]), (None, 1, d[3], d[2])] * 3
    assert manifest(spark, rows) == sorted(brute(rows), key=str)
    assert manifest(spark, []) == []


def test_fields_are_told_apart_and_null_is_no_text(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("-", "abc"), ("", "abc"), ("1:a", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [bytes(r[0]).hex() for r in df.select(merkle.leaf_digest(F.col("x"), F.col("y"))).collect()]
    assert got == [H(*["-" if v is None else f"{len(v.encode())}:{v}" for v in row]) for row in rows] and len(set(got)) == len(rows)
