"""Packing against searches of all bins and all plans, and its independence of the input's split."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brineloom.llm import packing as P

SF = "/root/testdata/sf0.01"
CAPS = (16, 32, 64)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=40), st.sampled_from(list(itertools.product(*[[c for c in CAPS if c >= own] for own in CAPS]))))
def test_best_fit_equals_a_search_of_all_bins(sizes, plan):
    sizes = sorted(sizes, reverse=True)
    got = P.best_fit(np.array(sizes, np.int64), plan, CAPS)
    room, used, bins = [], [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(room)
            room.append(plan[next(i for i, c in enumerate(CAPS) if c >= s)]), used.append(0)
        bins.append(b)
        room[b] -= s
        used[b] += s
    assert got[0].tolist() == bins and got[2] == [min(c for c in CAPS if c >= u) for u in used]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_the_plan_is_never_worse_than_one_length_and_near_the_best_of_all(sizes):
    x = np.sort(np.array(sizes, np.int64))[::-1]
    plan, got = P.joint(x, CAPS)
    every = {p: P.total(P.best_fit(x, p, CAPS)[2]) for p in itertools.product(*[[c for c in CAPS if c >= own] for own in CAPS])}
    assert P.total(got[2]) == every[plan] <= min(every[tuple(max(c, own) for own in CAPS)] for c in CAPS)
    assert every[plan] <= 1.05 * min(every.values())


def test_lengths_are_chosen_jointly():
    """Items that fill a short and a long length together best use both; one length alone costs more."""
    x = np.sort(np.concatenate([np.full(400, 510), np.full(400, 1000), np.full(30, 3000)]))[::-1]
    plan, got = P.joint(x)
    assert {c: got[2].count(c) for c in P.CAPACITIES} == {512: 400, 1024: 370, 2048: 0, 4096: 30}  # 30 of 1000 fill up those of 3000
    for c in P.CAPACITIES[1:]:
        assert P.total(got[2]) < P.total(P.best_fit(x, tuple(max(c, own) for own in P.CAPACITIES))[2])
    assert P.joint(np.zeros(0, np.int64))[1][2] == []


def brute(rows, block_of):
    """(doc_id, piece) to (bin's contents and length) of small input that is one block."""
    items = sorted(((n, d is not None, d or 0, k, c) for d, k, n, c in rows if n), key=lambda r: (-r[0], *r[1:]))
    _, (bins, _, lengths) = P.joint(np.array([r[0] for r in items], np.int64))
    return [(r[0], r[2] if r[1] else None, f"{block_of}-{b}", lengths[b]) for r, b in zip(items, bins, strict=True)]


def test_the_query_of_a_table_equals_a_plain_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r["length"], r["doc_id"], r["bin_id"], r["bin_capacity"]) for r in P.op6(spark, SF).collect() if r["bin_id"])
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), P.word_count(F.col("text")).alias("n")).collect()
    assert len(rows) <= P.BLOCK and max(r["n"] for r in rows) > max(P.CAPACITIES)
    cut = [(r["doc_id"], (r["k"], 0, i), min(4096, r["n"] - 4096 * i), 0) for r in rows for i in range(-(-r["n"] // 4096))]
    assert got == sorted(brute(cut, 0))


def test_packing_keeps_all_and_overfills_nothing(spark, rng):
    docs = spark.createDataFrame([(i, "w " * rng.choice((0, 1, 5, 90, 100, 700, 5000))) for i in range(300)] + [(None, "a b"), (1, "a b"), (7, None), (8, "x " * 200_000)], "doc_id long, text string")
    got = P.pack(docs.repartition(3)).toPandas()
    assert got["length"].sum() == docs.select(F.sum(P.word_count(F.col("text")))).first()[0]
    assert set(got.columns) == set(P.RESULT)
    held = got[got["bin_id"].notna()].sort_values(["bin_id", "bin_offset"])
    for _, b in held.groupby("bin_id"):
        cap, at = b["bin_capacity"].iloc[0], 0
        for _, r in b.iterrows():
            assert r["bin_offset"] == at
            at += r["length"]
        assert at <= cap == min(c for c in P.CAPACITIES if c >= at)
    assert held["length"].sum() / held.drop_duplicates("bin_id")["bin_capacity"].sum() > 0.9


def test_the_split_of_the_input_does_not_matter(spark, rng, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 100)
    monkeypatch.setattr(P, "COPIES", 16)
    rows = [(rng.randint(0, 150), "w " * rng.randint(0, 900)) for _ in range(400)] + [(1, "the same row")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, P.pack(docs.repartition(n)).fillna(-1).fillna("").collect())) for n in (1, 7))
    assert a == b and sum(r[4] for r in a) == sum(len(t.split()) for _, t in rows)
    same = [r for r in a if r[0] == 1 and r[4] == 3]
    assert len(same) == 300 and len({r[5].split("-")[0] for r in same}) > 1  # copies spread over blocks


def test_carried_and_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 7, 0)], "doc_id long, text string, lang string, score int, piece int")
    row = P.pack(docs, ["lang", "score"]).first()
    assert (row["lang"], row["score"], row["length"], row["bin_capacity"]) == ("en", 7, 3, 512)
    with pytest.raises(ValueError, match="piece"):
        P.pack(docs, ["piece"])
    assert P.pack_stage(spark, docs, "").count() == 1 and P.pack(docs.where("false")).count() == 0
