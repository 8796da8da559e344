"""The composed grammar against its machines one after another, and the operator against a plain reading."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brineloom.llm import toxicity as T
from brineloom.llm import words as W

SF = "/root/testdata/sf0.1"


def one_after_another(symbols, weights):
    """Each clause through the five machines in turn, for every choice of starts."""
    out = []
    machines = T.grammar()

    def walk(rest, stream, gathered):
        if not rest:
            out.append(gathered)
            return
        m = rest[0]
        for start in m.starts:
            s, says, own = start, [], gathered.copy()
            for x, w in zip(stream, weights, strict=True):
                if m.to[s, x] == T._DEAD:
                    s = T._DEAD
                    break
                own += m.fixed[s, x] + m.scaled[s, x] * w
                says.append(int(m.says[s, x]))
                s = m.to[s, x]
            if s != T._DEAD and s in m.accepts:
                walk(rest[1:], says, own)

    walk(machines, symbols, np.zeros(len(T.CHANNELS)))
    assert len(out) == 1  # exactly one path is accepted
    return out[0]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 2, 4, 8, 16, 3, 5, 9, 17, 20]), st.floats(0.1, 1)), min_size=1, max_size=14), min_size=1, max_size=6))
def test_the_composed_machine_equals_its_parts(clauses):
    symbols = np.array([x for c in clauses for x, _ in c], np.int16)
    weights = np.array([w for c in clauses for _, w in c])
    got = T.run(T.machine(), symbols, weights, np.array([len(c) for c in clauses]))
    for own, c in zip(got, clauses, strict=True):
        assert own == pytest.approx(one_after_another([x for x, _ in c], [w for _, w in c]))


def plain_channels(text, insults):
    """What the docstring says, word by word."""
    lists = {T._THREAT: T.THREATS, T._TARGET: T.TARGETS, T._NEGATION: T.NEGATIONS, T._REPORT: T.REPORTS}
    total = dict.fromkeys(T.CHANNELS, 0.0)
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\x00-\x60\x7B-\x7F]+", clause)
        kinds = [{k for k, w in lists.items() if x in w} for x in words]
        targeted = any(T._TARGET in k for k in kinds)
        got = dict.fromkeys(T.CHANNELS, 0.0)
        for i, (x, k) in enumerate(zip(words, kinds, strict=True)):
            negated = any(T._NEGATION in kinds[j] for j in range(max(0, i - T.NEGATION_REACH), i))
            said = any(T._REPORT in kinds[j] for j in range(i))
            if T._THREAT in k and targeted and not negated and not said:
                got["threat"] += 1
            if x in insults:
                got["negated" if negated else "reported" if said else "targeted" if targeted else "plain"] += insults[x]
        for c, v in got.items():
            total[c] += math.log1p(v)
    return [total[c] for c in T.CHANNELS]


def lexicon(words):
    hashes = [W.words(c, W.LETTERS, False).hashes for c in W.chunks(pa.array(list(words), pa.large_string()))][0]
    return T._Lookup(hashes, np.array(list(words.values())))


def test_channels_equal_a_plain_reading(rng):
    insults = {"fool": 0.5, "idiot": 1.0, "trottel": 0.7}
    words = [*insults, "kill", "hurt", "you", "they", "not", "never", "said", "the", "a", "house", "tree", "runs", "über"]
    known = T._known()
    known = T._Lookup(np.array(list(known), np.uint64), np.array(list(known.values()), np.int16))
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", "idiot", "a " * 20_000 + "you idiot " + "a " * 9 + "not a fool", "not the a the idiot", "not the a idiot"]
    got = T._channels(pa.array(texts, pa.large_string()), lexicon(insults), known)
    for own, text in zip(got, texts, strict=True):
        assert own == pytest.approx(plain_channels(text, insults))


def test_stage_keeps_rows_as_they_are(spark, tmp_path):
    toxic = ["you are an idiotic fool " + w for w in "one two three four five six seven eight nine ten eleven twelve".split()]
    clean = ["the house and the garden " + w for w in "one two three four five six seven eight nine ten eleven twelve".split()] * 3
    rows = [(i, t) for i, t in enumerate(toxic + clean)]
    spark.createDataFrame([(i, int(i < len(toxic))) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(100, None), (101, ""), (None, "a garden"), (None, toxic[0]), (5, "the house"), (5, "the house"), (102, "the garden " * 50_000), (103, "the garden. " * 50_000 + toxic[1])]
    x = spark.createDataFrame([(i, t, 0.9, [1], "c") for i, t in rows + more], "doc_id long, text string, score double, channels array<int>, __text string")
    out = T.reject_toxic(spark, x, str(tmp_path))
    assert out.columns == x.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert not any("idiotic" in (t or "") and len(t) < 100 for _, t in kept)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted((r for r in kept if r[0] != 103), key=key) == sorted([r for r in rows[len(toxic) :] + more if r[0] != 103 and "idiotic" not in (r[1] or "")], key=key)
    assert T.reject_toxic(spark, x.where("false"), str(tmp_path)).count() == 0


def test_scores_of_the_query_follow_its_channels(spark):
    """The query against the plain reading, with the lexicon and weights that it learned."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in T.op8(spark, SF).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    model = T.learn(docs, labels)
    sizes, known = (4, 5, 6), {h: 1 for h in model.insults.keys.tolist()}
    assert known and len(sizes) == len(T.STEMS)
    for r in docs.collect():
        x = np.array(got[r["doc_id"]]["channels"])
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-(x @ model.logistic[:-1] + model.logistic[-1]))), abs=1e-9)
    held = labels.join(spark.createDataFrame([(i, r["predicted"], r["held_out"]) for i, r in got.items()], "doc_id long, predicted int, held_out boolean"), "doc_id").where("held_out")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in held.groupBy("toxic", "predicted").agg(F.count("*").alias("count")).collect()}
    print(c)
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.85 and c[1, 1] / (c[1, 1] + c.get((0, 1), 0)) > 0.9
