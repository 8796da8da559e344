"""Language identification as mixture inference over word likelihoods.

Training: byte trigrams inside lower-cased words (a space on either side) are counted by
language over every training text; hashed to CELLS cells (fewer with very many languages), so the
tables have one size whatever the corpus.  Inference: each word of a document has a likelihood under each language,
the product of its trigrams'; expectation-maximisation finds the proportions with which the
languages make the document's words, and the number of languages is chosen by the likelihood
less a penalty of half the logarithm of the number of words for each language.

Defined results: null text or a text without a letter: ``und`` with score 0; very long texts
are read whole; repeated rows give repeated results; rows of a null lang or doc_id take no part
in training (a null doc_id has no fold, and is not held out) but are predicted; ties go to the first language in
order; an empty training set: every text ``und``; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineloom.llm import words as W

#: Cells of a language's table, and of all tables together: with over TABLE / CELLS languages each has less.
CELLS, TABLE = 1 << 16, 1 << 24
#: Each language's table is summed in so many parts, by as many tasks.
PARTS = 16
SMOOTHING = 0.5
ROUNDS = 8
UNDETERMINED = "und"
_SPACE = 0x20


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _lowered(texts: pa.Array) -> pa.Array:
    return W.text_array(pc.utf8_lower(texts))


def cells_of(n_languages: int) -> int:
    cells = CELLS
    while cells > PARTS and cells * n_languages > TABLE:
        cells >>= 1
    return cells


def _trigrams(c: W.Chunk, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all letters' trigrams, where each word begins in them, and each text's first word."""
    w = W.split(c, c.data, W.LETTERS)
    # U+00A0..U+00BF (signs, no letters but two) are C2 xx in UTF-8: spaces here.
    size = w.ends - w.starts
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.ptr
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1])
    step = np.ones(total, np.int64)
    step[0] = w.starts[0]
    step[at[1:]] = w.starts[1:] - w.ends[:-1] + 1
    b = c.data[np.cumsum(step)].astype(np.uint32)
    before = np.empty_like(b)
    before[1:] = b[:-1]
    before[at] = _SPACE
    after = np.empty_like(b)
    after[:-1] = b[1:]
    after[at + size - 1] = _SPACE
    code = (before << 16) | (b << 8) | after
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(33 - cells.bit_length())).astype(np.int64), at, w.ptr


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, float32 log probabilities [cells, languages]) from text and lang.

    What tasks have counted is added in two steps, first by groups of about as many tasks as there
    are groups, so that no group gathers a table from every task.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    cells = cells_of(len(langs))
    step = cells // PARTS
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def count(batches):
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names = codes.dictionary.to_pylist()
            code = codes.indices.to_numpy(zero_copy_only=False)
            for c in W.chunks(_lowered(batch.column(1))):
                found, at, ptr = _trigrams(c, cells)
                first = np.append(at, len(found))[ptr]
                of = np.repeat(code[c.lo : c.hi], np.diff(first))
                for k in np.unique(of):
                    n = np.bincount(found[of == k], minlength=cells)
                    sums[names[k]] = sums[names[k]] + n if names[k] in sums else n
        group = TaskContext.get().partitionId() % groups
        for name, n in sums.items():
            packed = [W.pack_ints(n[part * step : (part + 1) * step]) for part in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * PARTS), pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array(packed, pa.binary())], ["lang", "part", "group", "n"])

    def add(key, table):
        total = sum(W.unpack_ints(x.as_py()) for x in table.column("n"))
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "n": [W.pack_ints(total)]})

    counted = rows.mapInArrow(count, "lang string, part int, group int, n binary")
    for keys in (("lang", "part", "group"), ("lang", "part"))[groups == 1 :]:
        counted = counted.groupBy(*keys).applyInArrow(add, "lang string, part int, n binary")
    table = np.zeros((cells, len(langs)))
    number = {lang: i for i, lang in enumerate(langs)}
    for r in counted.collect():  # TABLE counts at most
        table[r["part"] * step : (r["part"] + 1) * step, number[r["lang"]]] = W.unpack_ints(r["n"])
    seen = max(1, int((table.sum(1) > 0).sum()))
    table = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * seen))
    return langs, table.astype(np.float32)


def mixtures(like: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: (proportions [texts, languages], chosen number of languages).

    like: log likelihoods [words, languages].  A text without words has proportions 0.
    """
    n_langs, count = like.shape[1], np.diff(ptr)
    full = np.flatnonzero(count)
    share, chosen = np.zeros((len(count), n_langs), np.float32), np.zeros(len(count), np.int64)
    if not len(full) or not n_langs:
        return share, chosen
    n, starts = count[full], ptr[:-1][full]
    top = like.max(1, keepdims=True)
    e = np.exp(like - top)

    def fit(pi, rounds):
        for _ in range(rounds):
            r = e * np.repeat(pi, n, axis=0)
            r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
            pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
        return pi

    pi = fit(np.full((len(full), n_langs), 1 / n_langs, np.float32), ROUNDS)
    order = np.argsort(-pi, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, best_k, best_pi = np.full(len(full), -np.inf), np.ones(len(full), np.int64), pi
    for k in range(1, n_langs + 1):
        own = np.where(rank < k, np.maximum(pi, 1e-12), 0).astype(np.float32)
        own /= own.sum(1, keepdims=True)
        fits = np.log(np.maximum((e * np.repeat(own, n, axis=0)).sum(1), 1e-30))
        score = np.add.reduceat(fits.astype(np.float64), starts) - 0.5 * k * np.log(n + 1.0)
        better = score > best
        best, best_k = np.where(better, score, best), np.where(better, k, best_k)
        best_pi = np.where(better[:, None], own, best_pi)
        if k >= 8 and not better.any():
            break
    share[full], chosen[full] = best_pi, best_k
    return share, chosen


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs' doc_id with (lang_pred, score, langs, shares): the chosen set, largest share first."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most TABLE values, or PARTS for each of more languages
    schema = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"

    def predict(batches):
        table = shared.value
        for batch in batches:
            texts = W.text_array(batch.column(1))
            low = _lowered(batch.column(1))
            pred, score, sets, shares = [], [], [], []
            for c in W.chunks(low):
                cells, at, ptr = _trigrams(c, len(table))
                n_words = np.diff(ptr)
                if len(at) and langs:
                    like = np.add.reduceat(table[cells], at, axis=0)
                    pi, k = mixtures(like, ptr)
                else:
                    pi, k = np.zeros((c.hi - c.lo, max(1, len(langs)))), np.zeros(c.hi - c.lo, np.int64)
                order = np.argsort(-pi, axis=1, kind="stable")
                ascii_letter = np.add.reduceat(np.append((c.data >= 0x61) & (c.data <= 0x7A), False).astype(np.int32), np.minimum(c.offs[:-1], len(c.data))) > 0
                for i in range(c.hi - c.lo):
                    if not n_words[i] or not langs or not (ascii_letter[i] and c.offs[i] < c.offs[i + 1] or has_letter(texts[c.lo + i].as_py())):
                        pred.append(UNDETERMINED), score.append(0.0), sets.append([]), shares.append([])
                        continue
                    own = order[i, : k[i]]
                    p = pi[i, own].astype(float)
                    pred.append(langs[own[0]]), score.append(min(1.0, float(p[0]))), sets.append([langs[j] for j in own]), shares.append(p.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "langs", "shares"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, schema)


def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "shares")


QUERIES = {"op10_language_mixture": op10}
ORACLE: dict[str, str] = {}
