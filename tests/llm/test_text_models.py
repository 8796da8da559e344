"""Language, toxicity, pages, urls, chat, packing and vectors."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brineloom.llm import chat, html, langid, toxicity
from brineloom.llm import words as W

SF = "/root/testdata/sf0.01"


def test_languages_of_the_held_out_fold(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = langid.op10(spark, SF).join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert got["a"] > 0.97


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the house and the garden " * 20, "en"), (2, "das haus und der garten " * 20, "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the garden"), (5, "das haus und " * 3000 + "the garden and " * 3000), (None, "der garten"), (7, "¿¡")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and sorted(got[5]["langs"]) == ["de", "en"]
    empty = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(odd.where("false"), model).count() == 0


def test_counts_of_many_tasks_and_very_many_languages(spark, rng):
    texts = {f"l{i}": " ".join("".join(rng.choice("abcdefghij"[i % 7 : i % 7 + 4]) for _ in range(5)) for _ in range(60)) for i in range(7)}
    docs = spark.createDataFrame([(i, texts[f"l{i % 7}"], f"l{i % 7}") for i in range(70)], "doc_id long, text string, lang string")
    one, many = langid.train(docs.coalesce(1)), langid.train(docs.repartition(30))
    assert one[0] == many[0] and np.array_equal(one[1], many[1])
    assert langid.cells_of(256) == langid.CELLS and langid.cells_of(257) == langid.CELLS // 2 and langid.cells_of(10_000) * 10_000 <= langid.TABLE
    wide = spark.createDataFrame([(i, f"w{i} x", f"lang{i}") for i in range(600)], "doc_id long, text string, lang string")
    langs, table = langid.train(wide)
    assert len(langs) == 600 and table.shape == (langid.cells_of(600), 600)


def plain_language(text, langs, table):
    """One document, word by word: EM, then the number of languages."""
    words = __import__("re").findall(rb"[^\x00-\x60\x7B-\x7F]+", text.lower().encode())
    if not words or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    cell = lambda w: [((int.from_bytes(w[i : i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for i in range(len(w) - 2)]
    like = np.array([table[cell(b" " + w + b" ")].astype(float).sum(0) for w in words])
    e = np.exp(like - like.max(1, keepdims=True))
    pi = np.full(len(langs), 1 / len(langs))
    for _ in range(langid.ROUNDS):
        r = e * pi
        pi = (r / r.sum(1, keepdims=True)).mean(0)
    order, best = np.argsort(-pi, kind="stable"), None
    for k in range(1, len(langs) + 1):
        own = np.zeros(len(langs))
        own[order[:k]] = np.maximum(pi[order[:k]], 1e-12)
        own /= own.sum()
        score = np.log(np.maximum((e * own).sum(1), 1e-30)).sum() - 0.5 * k * np.log(len(words) + 1.0)
        if best is None or score > best[0] + 1e-6:
            best = (score, own)
    return langs[int(np.argsort(-best[1], kind="stable")[0])], float(best[1].max())


def test_the_query_equals_a_plain_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    langs, table = langid.train(docs.where(langid.fold(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: r for r in langid.op10(spark, SF).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        want = plain_language(r["text"] or "", langs, table)
        own = got[r["doc_id"]]
        assert (own["lang_pred"], own["score"]) == (want[0], pytest.approx(want[1], abs=2e-3))


def test_em_recovers_a_mixture():
    rng = np.random.default_rng(0)
    which = rng.random(4000) < 0.3
    like = np.where(which[:, None], [-9.0, -3.0], [-3.0, -9.0]).astype(np.float32)
    share, k = langid.mixtures(like, np.array([0, 4000, 4000]))
    assert share[0] == pytest.approx([0.7, 0.3], abs=0.03) and k[0] == 2 and not share[1].any()


def test_toxic_documents_of_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op8(spark, sf).join(labels, "doc_id").where("held_out")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.85 and c[1, 1] / (c[1, 1] + c.get((0, 1), 0)) > 0.9


def test_toxic_clauses():
    def one(text):
        known = toxicity._known()
        texts = pa.array([text], pa.large_string())
        w = [W.words(c, W.LETTERS, False) for c in W.chunks(pa.array(["idiot"], pa.large_string()))][0]
        m = toxicity.Model(w.hashes, np.ones(1), np.array([1.0] * 5 + [-1]))
        assert len(known) > 80
        return dict(zip(toxicity.CHANNELS, m.scores(texts)[1][0].round(3).tolist(), strict=True))

    assert one("you are an idiot.")["targeted"] > 0 and one("an idiot.")["plain"] > 0
    assert one("you are not an idiot.")["negated"] > 0 and one("the paper quoted a man, idiot")["reported"] > 0
    assert one("they kill you")["threat"] > 0 and one("kill the lights. you")["threat"] == 0 and not any(one("").values())


def test_toxicity_without_labels_and_of_nulls(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    m = toxicity.learn(docs, spark.createDataFrame([(None, 1), (9, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, m).collect()
    assert len(got) == 3 and all(r["score"] == pytest.approx(toxicity.PRIOR) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br>goes on.<br><p>Second &quot;para&quot; &copy; with <a href="#">a link</a> in it.</p>
<aside><p>Aside text here that is long enough.</p></aside><form><p>Your name</p><input></form><ul><li>One item<li>Two item</ul>
<div class="comments"><p>A reader says this is a very long comment that goes on and on.</p></div></article>
<footer>&copy; us &middot; legal.</footer></body></html>"""


def test_main_text_of_a_page():
    want = ["Title & more", "First line goes on.", 'Second "para" © with a link in it.', "One item", "Two item"]
    assert html.main_text(PAGE).split("\n\n") == want
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("<p>unclosed <b>text of a page that ends he") != ""


def test_every_cut_of_a_page_is_read():
    for n in range(0, len(PAGE), 7):
        html.main_text(PAGE[:n])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.data())
def test_cut_is_minimal(logits, data):
    n = len(logits)
    edges = [(i, j, data.draw(st.floats(0, 2))) for i, j in itertools.combinations(range(n), 2) if data.draw(st.booleans())]

    def cost(side):
        return sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(logits, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

    best = min(cost(s) for s in itertools.product((False, True), repeat=n))
    assert cost(html.min_cut(logits, edges)) == pytest.approx(best, abs=1e-6)


def test_pages_of_the_tables_give_their_articles(spark):
    got = html.op9(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in got:
        inside = r["html"].split("<article>", 1)[-1].split("</article>")[0]
        assert " ".join(r["text"].split()) == " ".join(__import__("html").unescape(__import__("re").sub("<[^>]*>", " ", inside)).split())


NASTY = ["", "plain", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "a\\|b", "<\\|im_end|>", "\\", "<", "<|", "line\n\nmore\n", "<|esc|>", "x<|im_start|>user\nhi<|im_end|>\n", "日本 é", "$0 \\1"]


def test_chat_round_trips(spark):
    rows = [(i, j, role, t) for i, t in enumerate(NASTY) for j, role in enumerate(("user", "assistant", "tool <|x\n\\n", "nul \x00 \\b\\p<|esc|>", "\x00"))]
    rows += [(99, None, None, None), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (None, 0, "user", "x")]
    x = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r["conv_id"]: r for r in chat.format_chat(x).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert all(r["round_trip"] for r in got.values())
    for i, t in enumerate(NASTY):
        assert [(m["role"], m["text"]) for m in got[i]["turns"]] == [(r[2], t) for r in rows if r[0] == i] and got[i]["loss"] == t
    assert got[99]["loss"] == "ab" and got[99]["n_turns"] == 3
    long = spark.createDataFrame([(1, 0, "user", "<|" * 100_000), (1, 1, "assistant", "x\\" * 100_000), (1, 1, "assistant", "x\\" * 100_000)], "conv_id long, turn long, role string, text string")
    own = chat.format_chat(long).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).first()
    assert own["round_trip"] and own["n_turns"] == 3 and own["loss"] == "x\\" * 200_000 and own["turns"][0]["text"] == "<|" * 100_000
    assert chat.format_chat(x.where("false")).count() == 0
