"""corpus_pipeline.run against its stages done plainly, and each stage on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brineloom.llm import packing
from tests.llm.test_dedup import brute_hits, brute_repeats
from tests.llm.test_neardup import brute
from tests.llm.test_packing import brute as brute_packing

DOC = "doc_id long, text string, source string, n_words int, score double, __text string"
INSULT = "you are an idiotic fool and a "


@pytest.fixture
def folder(spark, prose, rng, tmp_path):
    passage, items = prose(60), [(i, prose(30)) for i in range(4)]
    toxic = [(i, INSULT + prose(6)) for i in range(40)]
    docs = toxic + [(100 + i, prose(rng.randint(1, 150))) for i in range(60)]
    docs += [(200 + i, prose(20) + " " + passage + " " + prose(20)) for i in range(5)]
    docs += [(300 + i, docs[45 + i][1] + " end") for i in range(10)] + [(400 + i, docs[60 + i][1].upper()) for i in range(5)]
    docs += [(500 + i, prose(30) + " " + t + " " + prose(10)) for i, t in items] + [(600, items[0][1] + " " + prose(1000)), (601, None), (602, ""), (603, prose(9000))]
    spark.createDataFrame([(d, t, "s", 1, 0.5, "c") for d, t in docs], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40)) for i, _ in docs if i < 200], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_run_equals_its_stages_done_plainly(spark, folder):
    path, docs, items = folder
    docs = [(d, t) for d, t in docs if not (t or "").startswith(INSULT)]
    classes = brute(docs)
    docs = [(d, t) for d, t in docs if classes[d] == d]
    removed = brute_repeats(docs)
    cut = plain_cut(docs)
    assert {d for d, _ in docs if removed[d][1]} == {201, 202, 203, 204, 600}
    hits = brute_hits(cut, items)
    kept = [(d, t) for d, t in cut if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    assert {500, 501, 502, 503}.isdisjoint(d for d, _ in kept) and 600 in dict(kept)
    frame = spark.createDataFrame(kept, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("k"), packing.word_count(F.col("text")).alias("n")).collect()
    pieces = [(r["doc_id"], (r["k"], 0, i), min(4096, r["n"] - 4096 * i), 0) for r in frame for i in range(-(-r["n"] // 4096))]
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["length"], r["doc_id"], r["bin_id"], r["bin_capacity"]) for r in out if r["bin_id"]) == sorted(brute_packing(pieces, 0))
    assert {r["doc_id"] for r in out} == {d for d, _ in kept}


def plain_cut(docs, k=13):
    first, out = {}, []
    split = {d: (t or "").split() for d, t in docs}
    for d, w in sorted(split.items()):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    for d, t in docs:
        w = split[d]
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out.append((d, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, folder, prose, name, stage):
    path, _, _ = folder
    t = prose(40)
    rows = [(None, None), (None, t), (None, t), (701, t), (701, t), (701, prose(12)), (702, ""), (703, None), (704, "word " * 100_000), (705, " \n ")]
    x = spark.createDataFrame([(d, u, None, None, None, None) for d, u in rows], DOC)
    out = stage(spark, x, path)
    kept = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in kept} == {None, 701, 702, 703, 704, 705} and sum(r["length"] for r in kept) == sum(len((u or "").split()) for _, u in rows)
    else:
        assert out.columns == x.columns
        assert {(r["doc_id"], r["text"]) for r in kept} == set(rows) and len(kept) == len(rows) - (name == "near_duplicates")
    assert stage(spark, x.where("false"), path).count() == 0
