"""Near duplicates, repeated passages and benchmark passages against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineloom.llm import decontam, neardup, substrings

DOC = "doc_id long, text string, shard string, n_words int"


def brute_repeats(docs, k=13):
    first, out = {}, {}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    for d, w in sorted(split.items()):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    for d, w in split.items():
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.fixture
def corpus(prose, rng):
    passage, line = prose(60), prose(14)
    docs = []
    for i in range(60):
        t = prose(rng.randint(0, 120))
        if i % 3 == 0:
            t += " " + passage
        if i % 4 == 0:
            t = line + "\n" + t
        docs.append((i, t))
    docs += [(100, docs[5][1]), (101, docs[5][1]), (102, None), (103, ""), (104, " \n "), (105, prose(13)), (106, prose(9000)), (107, line)]
    return docs


def test_repeats_equal_brute_force(spark, corpus):
    x = spark.createDataFrame([(d, t, "s", 1) for d, t in corpus], DOC)
    for layout in (None, substrings.Layout(3, 5, 7, 40)):
        out = substrings.find_repeats(x, layout=layout).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))
        assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute_repeats(corpus)


def test_repeats_of_null_ids_repeated_rows_and_no_rows(spark, prose):
    t = prose(40)
    x = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.find_repeats(x).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 40)]
    assert substrings.find_repeats(x.where("false")).count() == 0


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for i, text in items:
            v = words(text)
            k = min(13, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
            for j in range(len(w) - k + 1 if k else 0):
                if tuple(w[j : j + k]) in grams:
                    own.add(str(i))
                    hit |= set(range(j, j + k))
        out[d] = (len(w), len(hit), sorted(own))
    return out


def test_decontamination_equals_brute_force(spark, corpus, prose, monkeypatch):
    items = [(1, prose(30)), (2, "Short item!"), (3, ""), (4, None), (10, prose(13)), (None, prose(20))]
    docs = [*corpus, (200, prose(5) + " " + items[0][1].upper() + " " + prose(5)), (201, "a short ITEM and more"), (202, items[4][1] + " " + items[0][1]), (203, " ".join(items[0][1].split()[3:20]))]
    x = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(x, b).collect()}
    assert got == brute_hits(docs, [i for i in items if i[0] is not None])
    monkeypatch.setattr(decontam, "PHRASE_BLOCK", 7)  # several blocks, and an index of all terms
    monkeypatch.setattr(decontam, "VOCABULARY", 0)
    full = decontam.decontaminate(x, b)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in full.collect()} == got


def brute_near(docs, items):
    """doc_id to the items near it: from one of the rarest words, all but the allowed misses within SLOP of their places."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split = {d: words(t) for d, t in docs}
    n = collections.Counter(w for own in split.values() for w in own)
    out = {d: set() for d in split}
    for i, text in items:
        v = words(text)
        k = min(13, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            phrase = v[j : j + k]
            misses = k * decontam.NEAR_MISSES // 13
            rarest = sorted(range(k), key=lambda x: (n[phrase[x]], x))[: misses + 1]
            for d, w in split.items():
                for a in rarest:
                    for at in [x for x, y in enumerate(w) if y == phrase[a]]:
                        start = at - a
                        lacks = sum(phrase[x] not in w[max(0, start + x - decontam.SLOP) : max(0, start + x + decontam.SLOP + 1)] for x in range(k) if x != a)
                        if lacks <= misses:
                            out[d].add(str(i))
    return out


def test_proximity_equals_brute_force(spark, prose, rng):
    items = [(i, prose(rng.choice((4, 9, 13, 20)))) for i in range(12)]
    docs = [(1000, prose(300)), (1001, "")]
    for i, t in items:
        w = t.split()
        for j in range(6):
            u = list(w)
            for _ in range(j // 2):
                u[rng.randrange(len(u))] = rng.choice(["unknown", "zzz", rng.choice(w)])
            if j % 2:
                u.insert(rng.randrange(len(u)), "more")
            docs.append((10 * i + j, prose(rng.randint(0, 6)) + " " + " ".join(u) + " " + prose(rng.randint(0, 6))))
    x = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: set(r["near_items"]) for r in decontam.decontaminate(x.repartition(3), b).collect()}
    want = brute_near(docs, items)
    assert got == want and sum(map(len, got.values())) > 30


def test_proximity_finds_a_changed_passage(spark, prose):
    t = prose(13).split()
    near = [*t[:6], "zzz", *t[6:]]
    other = [*t[:4], "neverseen", *t[5:]]  # a word that stands nowhere else in the corpus
    x = spark.createDataFrame([(1, " ".join(near)), (2, prose(50)), (3, " ".join(other))], "doc_id long, text string")
    item = " ".join(t[:4]) + " " + t[4] + " " + " ".join(t[5:])
    got = {r["doc_id"]: r for r in decontam.decontaminate(x, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got[1]["n_hit"] == 0 and got[1]["near_items"] == ["5"] and got[2]["near_items"] == [] and got[3]["near_items"] == ["5"] and got[3]["n_hit"] == 0


def test_decontamination_of_nothing(spark):
    x = spark.createDataFrame([(None, None), (1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"]) for r in decontam.decontaminate(x, b).collect()) == [(-1, 0, 0), (1, 2, 0)]


def test_decontamination_stage_judges_each_row(spark, prose, tmp_path):
    t = prose(20)
    spark.createDataFrame([(1, t)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    x = spark.createDataFrame([(1, t, 1), (1, prose(20), 2), (None, t, 3), (None, "clean", 4), (2, None, 5), (3, prose(500) + " " + t, 6), (4, t, 7), (4, t, 8)], "doc_id long, text string, __id long")
    out = decontam.drop_contaminated(spark, x, str(tmp_path))
    assert out.columns == x.columns and sorted(r["__id"] for r in out.collect()) == [2, 4, 5, 6]


def test_repeats_of_one_id_in_several_shards(spark, prose):
    t = prose(40)
    x = spark.createDataFrame([(1, t + " a"), (1, t + " b"), (1, t + " c"), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in substrings.find_repeats(x, layout=substrings.Layout(2, 50, 3, 40)).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 40)]


def test_a_term_missing_from_a_segment_is_no_wildcard(spark):
    item = [f"w{i}" for i in range(13)]
    near = " ".join([*item[:6], "other", *item[7:]])
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, near), (2, "before alpha"), (3, "alpha else")], schema).coalesce(1)
    second = spark.createDataFrame([(4, "w6 w6 w6"), (5, "beta beta"), (6, " ".join(item))], schema).coalesce(1)
    bench = spark.createDataFrame([("long", " ".join(item)), ("short", "alpha beta")], "item_id string, text string")
    segments = decontam.build_index(first).union(decontam.build_index(second))
    assert segments.count() == 2
    out = decontam.search(segments, decontam.item_phrases(bench)).collect()
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in out if r["n_hit"] or r["items"]} == {6: (13, ["long"])}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


def test_alignment_equals_the_whole_table(rng):
    left, right = [], []
    for _ in range(30):
        a = [rng.randrange(2**32) for _ in range(rng.randint(1, 90))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(2**32) for _ in range(rng.randint(0, 3))] or [1]
        left.append(np.array(a, np.uint32)), right.append(np.array(b, np.uint32))
    got = neardup.similarities(left, right)
    for a, b, s in zip(left, right, got, strict=True):
        ka, kb = ([tuple(x[i : i + 5]) for i in range(len(x) - 4)] for x in (a.tolist(), b.tolist()))
        m = lcs(ka, kb)
        true = m / (len(ka) + len(kb) - m) if ka and kb else 0.0
        assert (s >= 0.8) == (true >= 0.8) and (true < 0.8 or s == pytest.approx(true))


def test_classes_equal_brute_force(spark, prose, rng):
    docs, base = [], [prose(rng.randint(60, 200)).split() for _ in range(12)]
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            w[rng.randrange(len(w))] = prose(1) + "x"
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "one two"), (203, "One, TWO."), (204, prose(5000)), (205, "!!!")]
    x = spark.createDataFrame([*docs, (205, "!!!"), (None, docs[0][1])], "doc_id long, text string").withColumn("label", F.lit(1))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(x).collect()}
    words = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for d, t in docs}
    group = {d: d for d in words}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            ka, kb = ([tuple(words[d][j : j + 5]) for j in range(len(words[d]) - 4)] for d in (a, b))
            same = bool(words[a]) and words[a] == words[b]
            if not same and ka and kb and min(len(ka), len(kb)) >= 0.8 * max(len(ka), len(kb)) and len(set(ka) & set(kb)) >= 0.6 * len(set(ka)):
                m = lcs(ka, kb)
                same = m / (len(ka) + len(kb) - m) >= 0.8
            if same:
                p, q = sorted((root(a), root(b)))
                group[q] = p
    assert got.pop(None, 0) is None
    assert got == {d: root(d) for d in words}


@pytest.mark.parametrize("block_words", [1 << 20, 60_000])
def test_hub_of_a_middle_id_joins_its_copies(spark, prose, rng, monkeypatch, block_words):
    # Each copy is linked to the hub alone (or to a copy edited at nearly the same place).
    monkeypatch.setattr(neardup, "BLOCK_WORDS", block_words)
    hub = [f"{w}{i}" for i, w in enumerate(prose(300).split())]
    docs = [(500, " ".join(hub))]
    for i in range(400):
        w, at = list(hub), rng.randrange(len(hub) - 25)
        w[at : at + 25] = [f"{x}y{i}" for x in prose(25).split()]
        docs.append((300 + i + (i >= 200), " ".join(w)))
    x = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["class_id"] for r in neardup.near_duplicates(x).collect()} == {300}


def test_one_row_of_each_class_stays(spark, prose):
    t = prose(50)
    x = spark.createDataFrame([(3, t, 1), (1, t, 2), (1, t, 2), (2, prose(40), 3), (None, t, 4)], "doc_id long, text string, n long")
    got = sorted((r["doc_id"] or -1, r["n"]) for r in neardup.one_of_each(spark, x, "").collect())
    assert got == [(-1, 4), (1, 2), (2, 3)]


def test_repeats_stage_keeps_rows_and_columns(spark, corpus):
    rows = [(d, t, len(t or ""), "s", 5, [1], "x") for d, t in corpus] + [(None, corpus[0][1], 7, "s", 5, [1], "x"), (3, corpus[3][1], 8, "s", 5, [1], "x")]
    x = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, source string, n_words int, spans array<int>, kept_text string")
    out = substrings.remove_repeats(spark, x, "")
    assert out.columns == x.columns and out.schema["n_chars"].dataType == x.schema["n_chars"].dataType
    want = brute_repeats(corpus)
    got = out.collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 3 for r in got) == 2
    before = dict(corpus)
    for r in got:
        assert r["n_words"] == 5 and r["kept_text"] == "x"
        if r["doc_id"] is None or not want[r["doc_id"]][1]:
            assert r["text"] == (corpus[0][1] if r["doc_id"] is None else before[r["doc_id"]])
        else:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    assert substrings.remove_repeats(spark, x.where("false"), "").count() == 0
    with pytest.raises(ValueError, match="spans"):
        substrings.find_repeats(x, ["spans"])
