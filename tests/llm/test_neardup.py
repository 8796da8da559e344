"""Near duplicates against a comparison of all pairs."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineloom.llm import neardup as N

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def similarity(a, b):
    """Longest common subsequence of 5-word k-mers, cell by cell."""
    x, y = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (a, b))
    row = [0] * (len(y) + 1)
    for p in x:
        before = 0
        for j, q in enumerate(y):
            here = row[j + 1]
            row[j + 1] = before + 1 if p == q else max(row[j + 1], row[j])
            before = here
    total = len(x) + len(y)
    return row[-1] / (total - row[-1]) if total > row[-1] else 1.0


def least_of_each(ids, links):
    parent = dict(zip(ids, ids, strict=True))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in ids}


def brute(docs):
    """doc_id to class: exact copies, and all pairs of 5 words or more at 0.8 or more."""
    split = {d: words(t) for d, t in docs}
    links = []
    for (a, x), (b, y) in itertools.combinations(sorted(split.items()), 2):
        if x and (x == y or min(len(x), len(y)) >= 5 and (min(len(x), len(y)) - 4) >= 0.8 * (max(len(x), len(y)) - 4) and similarity(x, y) >= 0.8):
            links.append((a, b))
    return least_of_each(sorted(split), links)


def test_similarities_equal_the_plain_alignment(rng, prose):
    vocab = prose(40).split()
    pairs = []
    for _ in range(150):
        a = [rng.choice(vocab) for _ in range(rng.randint(5, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 2)] = [rng.choice(vocab) for _ in range(rng.randint(0, 2))]
        if len(b) >= 5:
            pairs.append((a, b))
    code = {w: i for i, w in enumerate(vocab)}
    got = N.similarities(*([np.array([code[w] * 2654435761 % 2**32 for w in p[i]], np.uint32) for p in pairs] for i in (0, 1)))
    for own, (a, b) in zip(got, pairs, strict=True):
        want = similarity(a, b)
        assert own == pytest.approx(want) if want >= 0.8 else own < 0.8


def test_classes_equal_brute_force(spark, rng, prose):
    docs = []
    for i in range(60):
        t = prose(rng.randint(3, 90)).split()
        docs.append((10 * i, " ".join(t)))
        for j in range(rng.randint(0, 4)):
            u = list(t)
            for _ in range(rng.randint(0, 3)):
                u[rng.randrange(len(u))] = "edited"
            docs.append((10 * i + j + 1, " ".join(u).upper() if j == 2 else ", ".join(u)))
    docs += [(1000, None), (1001, ""), (1002, "!?"), (1003, "a b"), (1004, "A, b"), (1005, prose(30_000))]
    x = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(None, docs[0][1], "x", 1), docs[0] + ("x", 1)], "doc_id long, text string, class_id string, h int")
    got = N.near_duplicates(x).collect()
    assert len(got) == len(docs) + 2
    want = brute(docs)
    assert {(r["doc_id"], r["class_id"]) for r in got} == {*want.items(), (None, None)}
    assert N.near_duplicates(x.where("false")).count() == 0


def hub_and_spokes(rng, prose, n):
    """Edits of one text that are near it but often not near each other; the hub's id is in the middle."""
    t = prose(60).split()
    docs = []
    for i in range(n):
        u = list(t)
        if i != n // 2:
            for k in rng.sample(range(2, 58), rng.choice((1, 2))):
                u[k] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(u)))
    return docs


def test_a_large_group_of_near_copies_equals_brute_force(spark, rng, prose):
    docs = hub_and_spokes(rng, prose, 1000)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    code: dict[str, int] = {}
    seqs = [np.array([code.setdefault(w, len(code)) * 2654435761 % 2**32 for w in t.split()], np.uint32) for _, t in docs]
    number: dict[tuple, int] = {}
    kmers = [{number.setdefault(tuple(s[i : i + 5].tolist()), len(number)) for i in range(len(s) - 4)} for s in seqs]
    holds = np.zeros((len(docs), len(number)), np.float32)
    for i, k in enumerate(kmers):
        holds[i, list(k)] = 1
    both, size = holds @ holds.T, holds.sum(1)
    # All pairs: an alignment matches no more k-mers than both texts hold; the rest by the alignment tested above.
    near = np.argwhere(np.triu(both >= 0.8 * (size[:, None] + size[None, :] - both), 1))
    links = [(int(i), int(j)) for i, j in near if N.similarities([seqs[i]], [seqs[j]])[0] >= 0.8]
    want = least_of_each(range(len(docs)), links)
    assert len(set(want.values())) > 1
    assert got == want


def test_a_chain_of_near_copies_is_one_class(spark, prose):
    t = prose(400).split()
    docs = [(i, " ".join(t[2 * i : 2 * i + 80])) for i in range(150)]  # neighbours alike, ends not
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_texts_of_a_repeated_id_are_compared_each(spark, prose):
    a, b = prose(60), prose(60)
    a2, b2 = a + " more", b + " more"
    rows = [(5, a), (6, b), (6, a2), (7, b2), (7, b2), (8, "lone"), (8, None), (8, None), (None, a), (None, None), (9, ""), (6, "other text of six")]
    x = spark.createDataFrame([(d, t, i, "k") for i, (d, t) in enumerate(rows)], "doc_id long, text string, label int, class_id string")
    got = sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(x).where("doc_id is not null").collect())
    assert got == sorted([(5, 5), (6, 6), (6, 5), (7, 6), (7, 6), (8, 8), (8, 8), (8, 8), (9, 9), (6, 6)])
    out = N.one_of_each(spark, x, "")
    assert out.columns == x.columns
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted([(5, a), (6, b), (8, "lone"), (8, None), (None, a), (None, None), (9, ""), (6, "other text of six")], key=key)
    assert N.one_of_each(spark, x.where("false"), "").count() == 0


def test_a_crowd_under_one_id(spark, prose):
    rows = [(1, prose(30)) for _ in range(300)] + [(1, "the same words of one row again")] * 300 + [(2, "The same words, of one row again!")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    out = N.one_of_each(spark, x, "")
    assert out.count() == 301 and out.where("doc_id = 2").count() == 0 and out.agg(F.countDistinct("text")).first()[0] == 301


def test_pairs_do_not_grow_with_a_group_of_near_copies(spark, rng, prose, monkeypatch):
    """A group that shares all buckets gives each text one pair, and a class as all pairs would."""
    t, docs = prose(200).split(), []
    for i in range(400):
        u = list(t)
        for k in rng.sample(range(200), 2):
            u[k] = f"e{i}x{k}"
        docs.append((i, " ".join(u)))
    made, plain = [], N._verify
    monkeypatch.setattr(N, "_verify", lambda pairs, *rest: made.append(pairs.count()) or plain(pairs, *rest))
    joined, own = [], N._labelled
    monkeypatch.setattr(N, "_labelled", lambda rows, *rest: joined.append(rows.count()) or own(rows, *rest))
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}
    assert sum(made) <= 1.5 * len(docs) and max(joined) <= len(docs)


def test_a_text_goes_once_to_each_bucket_that_is_still_open(spark, rng, prose, monkeypatch, tmp_path):
    """Unlike edits of one text stay open in its buckets; rows sent to tasks and joined are counted."""
    t, docs = prose(150).split(), []
    for i in range(300):
        u = list(t)
        for k in rng.sample(range(150), 5):
            u[k] = f"e{i}x{k}"
        docs.append((i, " ".join(u)))
    plain, at = N._block_links, str(tmp_path)

    def counted(ids, label, bands, seqs, right, own, key, threshold):
        import os
        import uuid

        with open(os.path.join(at, uuid.uuid4().hex), "w") as f:
            f.write(f"{key} {len(ids)}")
        return plain(ids, label, bands, seqs, right, own, key, threshold)

    monkeypatch.setattr(N, "_block_links", counted)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame).collect()}
    sent = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    size = {r["key"]: r["count"] for r in N.sketch(frame).select(F.explode("bands").alias("key")).groupBy("key").count().collect()}
    assert sent and len(got) == 300 and len(set(got.values())) > 100
    assert sum(n for _, n in sent) <= sum(size[k] for k in {k for k, _ in sent})
    monkeypatch.setattr(N, "_block_links", plain)
    monkeypatch.setattr(N, "BLOCK_WORDS", 3000)  # no bucket fits into a block
    assert got == {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame).collect()}
