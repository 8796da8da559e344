"""Exact repeats of WINDOW words across documents, by fixed-block anchors.

Any window of WINDOW words holds one whole block of BLOCK words that starts at a multiple of BLOCK
of its document, as 2 * BLOCK - 1 <= WINDOW.  So the non-overlapping blocks of all documents are
indexed, and every rolling window of BLOCK words probes the index; a block that is indexed and
that at least two documents hold is an anchor.  Hits are then extended: around anchors only, the
windows of WINDOW words are compared across documents, and consecutive repeated windows join to
maximal repeats.  A word goes if it lies in a window whose words also start in a document with a
smaller doc_id.

How it runs.  Texts are dealt once into shards of about a MB (by doc_id
and text, so that rows of a null or repeated doc_id spread).  A shard sends the
DISTINCT hashes of its windows, sorted and packed as differences, to buckets of the hash range; a
bucket answers each shard with one bit a hash.  So a passage that a third of all documents hold
costs its bucket one entry a shard, whatever the number of copies, no pair of documents is ever
made, and nothing goes to the driver.  Shards and buckets follow the size of the input.

Anchors' hashes are cut to log2(words) + 9 bits: a false anchor only adds windows to compare.
Windows are compared by 64-bit hashes.

Defined results: null, empty or shorter texts: nothing removed (null: no words); null doc_id:
neither earlier nor later than any other, nothing removed; repeated rows (same doc_id): do not
repeat each other; windows are judged on the input; very long texts are read whole; an empty
table: no rows; other columns are ignored or carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.llm import words as W
from brineloom.llm.shared import partitions

WINDOW, BLOCK = 13, 7
_U = np.uint64


@dataclass(frozen=True)
class Layout:
    parts: int
    shards: int
    buckets: int
    bits: int  # of an anchor's hash

    @staticmethod
    def of(docs: DataFrame) -> Layout:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_words = max(1, size // 6)
        shard = min(max(size // 1000, 1 << 20), 1 << 26)
        bucket = min(max(n_words // 128, 50_000), 1 << 25)
        return Layout(partitions(docs.sparkSession), max(1, math.ceil(size / shard)), math.ceil(n_words / bucket), min(62, max(32, n_words.bit_length() + 9)))


class Shard:
    """Word hashes of all texts of a shard, in one run."""

    def __init__(self, table: pa.Table):
        texts, ids = W.text_array(table.column("text")), table.column("doc_id")
        self.valid = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        hashes, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for c in W.chunks(texts):
            w = W.words(c, W.NON_SPACE, lower=False)
            hashes.append(w.hashes), counts.append(w.counts)
        self.hashes = np.concatenate(hashes)
        self.counts = np.concatenate(counts)
        self.ptr = np.append(0, np.cumsum(self.counts))
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.w = W.Words(self.row, self.row, self.ptr)

    def places(self, k: int) -> np.ndarray:
        """Where windows of k words start that end in the same text."""
        ok = W.whole(self.w, k)
        return np.flatnonzero(ok & self.valid[self.row[: len(ok)]])

    def blocks(self, bits: int) -> Distinct:
        at = self.places(BLOCK)
        key = W.windows(self.hashes, BLOCK, 21)[at] >> _U(64 - bits)
        return Distinct(at, key, self.ids[self.row[at]])

    def candidates(self, blocks: Distinct, anchors: np.ndarray) -> Distinct:
        """Windows of WINDOW words that hold an anchor."""
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[blocks.at[anchors[blocks.which]]] = 1
        upto = np.append(0, np.cumsum(hit))
        at = self.places(WINDOW)
        at = at[upto[at + WINDOW - BLOCK + 1] > upto[at]]
        key = W.windows(self.hashes, WINDOW, 22)
        return Distinct(at, key[at], self.ids[self.row[at]])


class Distinct:
    """Places by key: the distinct keys in order, and which of them each place has."""

    def __init__(self, at: np.ndarray, key: np.ndarray, doc: np.ndarray):
        self.at, self.doc = at, doc
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.starts = np.flatnonzero(new)
        self.keys = s[self.starts]
        self.order = order
        self.which = np.empty(len(s), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def least(self) -> np.ndarray:
        return np.minimum.reduceat(self.doc[self.order], self.starts) if len(self.starts) else self.doc[:0]

    def most(self) -> np.ndarray:
        return np.maximum.reduceat(self.doc[self.order], self.starts) if len(self.starts) else self.doc[:0]


def _bucket_cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys of so many bits."""
    edges = [(b << bits) // buckets for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(edges, _U)), len(keys))


_SENT = "bucket int, shard int, keys binary, more binary"
_TOLD = "shard int, step int, bucket int, bits binary"


def _send(shard: int, d: Distinct, bits: int, buckets: int, more) -> pa.Table:
    cuts = _bucket_cuts(d.keys, bits, buckets)
    rows = [(b, W.pack_sorted(d.keys[lo:hi]), more(lo, hi)) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "shard", "keys", "more"])


def _meet(table: pa.Table, read):
    """All keys of a bucket: (rows' lengths, order by key, starts of each key, the rows' own data)."""
    keys = [W.unpack_sorted(x.as_py()) for x in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    more = [read(x.as_py(), n) for x, n in zip(table.column("more"), sizes, strict=True)]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return sizes, order, new, more


def _tell(table: pa.Table, step: int, bucket: int, sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    cuts = np.append(0, np.cumsum(sizes))
    bits = [W.pack_bits(flags[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(sizes)
    return pa.table([table.column("shard").cast(pa.int32()), pa.array([step] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(bits, pa.binary())], names=["shard", "step", "bucket", "bits"])


def _told(answers: pa.Table, step: int, d: Distinct, bits: int, buckets: int) -> np.ndarray:
    """The buckets' bits for the distinct keys of a shard."""
    cuts = _bucket_cuts(d.keys, bits, buckets)
    out = np.zeros(len(d.keys), bool)
    for s, b, blob in zip(answers.column("step").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits"), strict=True):
        if s == step:
            out[cuts[b] : cuts[b + 1]] = W.unpack_bits(blob.as_py(), int(cuts[b + 1] - cuts[b]))[0]
    return out


def find_repeats(docs: DataFrame, carry=(), layout: Layout | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, carry..., n_words, n_removed, spans, kept_text) of each row.

    spans: [from, to) in words of each maximal run to remove; kept_text: the words that stay,
    joined by one space; with ``whole`` a text of which nothing goes stays as it is.
    """
    if clash := [c for c in carry if c in ("n_words", "n_removed", "spans", "kept_text", "__shard")]:
        raise ValueError(f"rename before looking for repeats: {clash}")
    L = layout or Layout.of(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kept = [f for f in base.schema.fields[2:]]
    base = base.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(L.shards)).cast("int")).repartition(L.parts, "__shard")

    def probe(key, table):
        s = Shard(table)
        d = s.blocks(L.bits)
        aligned = (d.at - s.ptr[s.row[d.at]]) % BLOCK == 0
        indexed = np.logical_or.reduceat(aligned[d.order], d.starts) if len(d.starts) else np.zeros(0, bool)
        several = d.least() != d.most()
        return _send(key[0].as_py(), d, L.bits, L.buckets, lambda lo, hi: W.pack_bits(indexed[lo:hi], several[lo:hi]))

    def anchor(key, table):
        sizes, order, new, more = _meet(table, lambda x, n: W.unpack_bits(x, n, 2))
        indexed, several = (np.concatenate([m[i] for m in more])[order] for i in (0, 1))
        starts = np.flatnonzero(new)
        alone = np.diff(np.append(starts, len(order))) == 1
        shared = np.logical_or.reduceat(indexed, starts) & (~alone | np.logical_or.reduceat(several, starts))
        flags = np.empty(len(order), bool)
        flags[order] = shared[np.cumsum(new) - 1]
        return _tell(table, 1, key[0].as_py(), sizes, flags)

    def extend(key, left, right):
        if not left.num_rows:
            return _NO_SENT
        s = Shard(left)
        blocks = s.blocks(L.bits)
        d = s.candidates(blocks, _told(right, 1, blocks, L.bits, L.buckets))
        least = d.least()
        return _send(left.column("__shard")[0].as_py(), d, 64, L.buckets, lambda lo, hi: W.pack_ints(least[lo:hi]))

    def earlier(key, table):
        sizes, order, new, more = _meet(table, lambda x, n: W.unpack_ints(x))
        least = np.concatenate(more)
        first = np.minimum.reduceat(least[order], np.flatnonzero(new))
        flags = np.empty(len(order), bool)
        flags[order] = first[np.cumsum(new) - 1] < least[order]
        return _tell(table, 2, key[0].as_py(), sizes, flags)

    fields = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.field("kept_text", pa.string())]

    def remove(key, left, right):
        s = Shard(left)
        gone = np.zeros(len(s.hashes), bool)
        if left.num_rows and right.num_rows:
            blocks = s.blocks(L.bits)
            d = s.candidates(blocks, _told(right, 1, blocks, L.bits, L.buckets))
            if len(d.at):
                later = _told(right, 2, d, 64, L.buckets)[d.which] | (d.doc > d.least()[d.which])
                gone = W.spread(np.sort(d.at[later]), WINDOW, len(s.hashes))
        spans, texts, removed = [], [], []
        for i, text in enumerate(W.text_array(left.column("text"))):
            words, own = text.as_buffer().to_pybytes().split() if text.as_py() else [], gone[s.ptr[i] : s.ptr[i + 1]]
            n = int(own.sum())
            removed.append(n)
            if whole and not n:
                spans.append([]), texts.append(left.column("text")[i].as_py())
                continue
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                spans.append([{"from": int(a), "to": int(b)} for a, b in edge.reshape(-1, 2)])
                words = [x for x, g in zip(words, own.tolist(), strict=True) if not g]
            else:
                spans.append([])
            texts.append(b" ".join(words).decode())
        return pa.table(
            [left.column("doc_id"), *(left.column(f.name) for f in kept), pa.array(s.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, fields[2].type), pa.array(texts, pa.string())],
            names=["doc_id", *(f.name for f in kept), *(f.name for f in fields)],
        )

    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long, n_removed long, spans array<struct<from: int, to: int>>, kept_text string"])
    one = base.groupBy("__shard").applyInArrow(probe, _SENT).groupBy("bucket").applyInArrow(anchor, _TOLD)
    two = base.groupBy("__shard").cogroup(one.repartition(L.parts, "shard").groupBy("shard")).applyInArrow(extend, _SENT).groupBy("bucket").applyInArrow(earlier, _TOLD)
    both = one.unionByName(two).repartition(L.parts, "shard")
    return base.groupBy("__shard").cogroup(both.groupBy("shard")).applyInArrow(remove, schema)


_NO_SENT = pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["bucket", "shard", "keys", "more"])


def op5(spark, sf_dir):
    out = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def remove_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: repeated words go from the texts; texts of which nothing goes stay as they are.

    Every row stays, with its other columns, whatever their names; ``n_chars``, if there is one,
    follows the text.  Nulls, empty and very long texts, repeated rows and an empty table are as in
    ``find_repeats``.
    """
    others = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    held = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(name) for c, name in others.items()))
    out = find_repeats(held, list(others.values()), whole=True)
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(name) for c, name in others.items()}
    if "n_chars" in others:
        back["n_chars"] = F.when(F.col("n_removed") == 0, back["n_chars"]).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(back[c].alias(c) for c in docs.columns))


QUERIES = {"op5_substring_anchors": op5}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = {
    "op5_substring_anchors": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
h as (select doc_id, i, hash(list_slice(w, i, i + 12)) as a, hash(list_slice(w, i, i + 12), 7) as b from g),
f as (select a, b, min(doc_id) as first from h group by a, b),
r as (select h.doc_id, list(h.i) as gone from h join f on h.a = f.a and h.b = f.b where f.first < h.doc_id group by h.doc_id),
m as (select doc_id, list_distinct(flatten(list_transform(gone, lambda i: range(i, i + 13)))) as gone from r),
k as (select d.doc_id, d.w, coalesce(m.gone, []) as gone from d left join m on d.doc_id = m.doc_id)
select doc_id, len(w) as n_words, len(gone) as n_removed,
       sha256(array_to_string(case when len(gone) = 0 then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from k""",
}
