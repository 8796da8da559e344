"""Benchmark decontamination with a distributed positional inverted index.

Build: each block of training texts becomes one index segment: for every term its postings, that
is the ascending positions at which it occurs in the segment, and for every document its place in
the segment.  Documents stand GAP positions apart, so that no phrase crosses a border.  Segments
are rows of a table: they can be stored and searched again, and they are dealt as Spark likes, so
the postings of a common term are spread over all segments.  A ``vocabulary`` restricts the
postings to the terms that the benchmark can ask for.

Search: phrases are the benchmark items' windows of WINDOW words.  Each phrase's terms are ordered
by how often the whole corpus holds them, rarest first.  A segment takes the postings of a
phrase's rarest term, adjusted by the term's offset in the phrase, as candidate starts, and
intersects them with the adjusted lists of the next terms, by search in the sorted postings, until
none or only exact matches are left.

Proximity: a phrase is near where it stands with all but NEAR_MISSES in WINDOW of its words (rounded
down, for shorter phrases in proportion) each within SLOP words of its place, in one document, as
counted from one of its rarest words.  As many candidate words are taken as misses are allowed and
one more; words that the corpus lacks are misses from the start.

Blocks: phrases are dealt to blocks of about PHRASE_BLOCK by hash and kept as a table; the driver gathers
and broadcasts one block at a time, searches all segments for it and writes the hits, so neither
driver nor workers hold more than a block whatever the benchmark's size.  A benchmark of more than
VOCABULARY terms is searched in an index of all terms.

Defined results: null or wordless text: no words, never contaminated; an item of fewer words than
WINDOW, but not none, is one phrase; null or repeated items: null item_ids are left out, repeated
ones count once; repeated document rows: a row each; very long texts are read whole; an empty
benchmark: no hits; an empty table: no rows; other columns are ignored or carried.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.llm import words as W
from brineloom.llm.shared import materialize

WINDOW = 13
GAP = 64
#: Words of a segment, at most (but a text is never cut).
SEGMENT_WORDS = 1 << 20
PHRASE_BLOCK, VOCABULARY = 200_000, 4_000_000
NEAR_MISSES, SLOP = 2, 2
#: Ids of contaminated documents up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A document is contaminated from this share of hit words on: one in so many.
SHARE = 20
_U = np.uint64

_SEGMENT = "segment string, docs binary, counts binary, at binary, terms binary, sizes binary, postings binary"


def item_phrases(items: DataFrame) -> DataFrame:
    """(item_id, phrase: array of term ids): every window of each item."""

    def cut(batches):
        for batch in batches:
            ids, out = [], []
            names = batch.column(0).to_pylist()
            for c in W.chunks(W.text_array(batch.column(1))):
                w = W.words(c, W.ALNUM, lower=True)
                terms = w.hashes.view(np.int64)
                for i in range(c.hi - c.lo):
                    own = terms[w.ptr[i] : w.ptr[i + 1]]
                    for j in range(max(min(1, len(own)), len(own) - WINDOW + 1)):
                        ids.append(names[c.lo + i]), out.append(own[j : j + WINDOW].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["item_id", "phrase"])

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item_id string, phrase array<long>").distinct()


class _Known:
    """Membership of term ids, by a bitmap of their top bits and a search."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms.view(_U))
        self.top = np.zeros(1 << 20, bool)
        self.top[(self.terms >> _U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, which): places in h of known terms, and their ranks."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.top[(h >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[near]), len(self.terms) - 1)
        hit = self.terms[at] == h[near]
        return near[hit], at[hit]


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, carry=()) -> DataFrame:
    """Segments of the positional index; with a vocabulary only of the terms in it.

    Tables of segments may be united.  A segment row: its name; documents' ids, word counts and first positions; the term ids in order, how
    many postings each has, and all postings, term by term; and the carried columns, if any.
    """
    build_id = uuid.uuid4().hex[:12]
    known = docs.sparkSession.sparkContext.broadcast(_Known(vocabulary)) if vocabulary is not None else None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kept = [f for f in source.schema.fields[2:]]
    extra = "".join(f", `__{f.name}` array<{f.dataType.simpleString()}>" for f in kept)

    def segment(number, ids, valid, counts, term, at, base, carried):
        order = np.argsort(term, kind="stable")
        s = term[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(s)))
        row = [pa.array([number], pa.string()), pa.array([W.pack_ints(np.append(ids, valid.astype(np.int64)))], pa.binary()), pa.array([W.pack_ints(counts)], pa.binary()), pa.array([W.pack_ints(np.diff(base, prepend=0))], pa.binary()),
               pa.array([W.pack_sorted(s[starts])], pa.binary()), pa.array([W.pack_ints(sizes)], pa.binary()), pa.array([W.pack_ints(np.diff(at[order], prepend=0))], pa.binary())]
        return pa.RecordBatch.from_arrays([*row, *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in carried)],
                                          ["segment", "docs", "counts", "at", "terms", "sizes", "postings", *(f"__{f.name}" for f in kept)])

    def build(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column(0)
            valid, ids = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
            held, n_words, lo = [], 0, 0
            for c in W.chunks(W.text_array(batch.column(1))):
                w = W.words(c, W.ALNUM, lower=True)
                if known is None:
                    where, term = np.arange(len(w.hashes)), w.hashes
                else:
                    where, which = known.value.find(w.hashes)
                    term = known.value.terms[which]
                held.append((w.counts, w.row[where], where - w.ptr[w.row[where]], term, c.lo))
                n_words += len(w.hashes)
                if n_words >= SEGMENT_WORDS or c.hi == batch.num_rows:
                    counts = np.concatenate([h[0] for h in held])
                    base = np.cumsum(counts + GAP) - counts
                    at = np.concatenate([base[h[1] + h[4] - lo] + h[2] for h in held])
                    yield segment(f"{build_id}-{part}-{number}", ids[lo : c.hi], valid[lo : c.hi], counts, np.concatenate([h[3] for h in held]), at, base, [x.slice(lo, c.hi - lo) for x in batch.columns[2:]])
                    held, n_words, lo, number = [], 0, c.hi, number + 1

    return source.mapInArrow(build, _SEGMENT + extra)


def term_counts(segments: DataFrame) -> DataFrame:
    """(term, n): how often the corpus holds each indexed term."""

    def count(batches):
        for batch in batches:
            for terms, sizes in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(W.unpack_sorted(terms.as_py()).view(np.int64)), pa.array(W.unpack_ints(sizes.as_py()))], ["term", "n"])

    return segments.select("terms", "sizes").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Phrases:
    """A block of phrases, each with its terms ordered from the rarest on."""

    def __init__(self, items: list[str], phrases: list[list[int]], counts: dict[int, int]):
        self.items = sorted(set(items))
        rank = {x: i for i, x in enumerate(self.items)}
        self.item = np.array([rank[x] for x in items], np.int64)
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.term = np.zeros((len(phrases), WINDOW), _U)
        self.offset = np.zeros((len(phrases), WINDOW), np.int64)
        self.absent = np.zeros(len(phrases), np.int64)  # terms that the corpus lacks: the first in order
        for i, p in enumerate(phrases):
            order = sorted(range(len(p)), key=lambda j: (counts.get(p[j], 0), j))
            self.term[i, : len(p)] = np.array([p[j] for j in order], np.int64).view(_U)
            self.offset[i, : len(p)] = order
            self.absent[i] = sum(not counts.get(t, 0) for t in p)
        self.misses = self.size * NEAR_MISSES // WINDOW


class _Segment:
    def __init__(self, docs, counts, at, terms, sizes, postings):
        both = W.unpack_ints(docs)
        n = len(both) // 2
        self.ids, self.valid = both[:n], both[n:].astype(bool)
        self.counts, self.base = W.unpack_ints(counts), np.cumsum(W.unpack_ints(at))
        self.terms, self.sizes, postings = W.unpack_sorted(terms), W.unpack_ints(sizes), np.cumsum(W.unpack_ints(postings))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.total = (int(self.base[-1] + self.counts[-1]) if n else 0) + 2 * GAP
        # All postings in one ascending list: by the term's rank, then by position.
        self.listed = np.repeat(np.arange(len(self.terms)), self.sizes) * self.total + postings

    def _rank(self, term: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(term.shape, -1)
        r = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[r] == term, r, -1)

    def _within(self, rank: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
        """Does the list of the term hold a position at most slop from the given one?"""
        if not len(self.listed):
            return np.zeros(len(at), bool)
        base = rank * self.total
        k = np.searchsorted(self.listed, base + np.maximum(at - slop, 0))
        return (rank >= 0) & (self.listed[np.minimum(k, len(self.listed) - 1)] <= base + at + slop) & (k < len(self.listed))

    def search(self, p: Phrases, near: bool):
        """((phrase, start) of exact matches, (phrase, document) of matches in proximity)."""
        rank = self._rank(p.term)
        exact, close = ([], []), ([], [])
        tasks = [(np.flatnonzero((p.absent == 0) & (rank[:, 0] >= 0)), 0, self._exact, exact)]
        if near:
            for k in range(NEAR_MISSES + 1):  # the k-th rarest word may be the first that is in its place
                tasks.append((np.flatnonzero((k <= p.misses) & (p.absent <= k) & (k < p.size) & (rank[:, k] >= 0)), k, self._near, close))
        for anchored, k, intersect, found in tasks:
            n = self.sizes[rank[anchored, k]]
            upto = np.cumsum(n)
            lo = 0
            while lo < len(anchored):  # about 2 ** 20 candidates at a time
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), "right")))
                own, m = anchored[lo:hi], n[lo:hi]
                which = np.repeat(own, m)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                at = self.listed[np.repeat(self.first[rank[own, k]], m) + inside] - rank[which, k] * self.total
                for column, got in zip(found, intersect(p, rank, k, which, at), strict=True):
                    column.append(got)
                lo = hi
        join = lambda x: tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in x)
        return join(exact), join(close)

    def _exact(self, p, rank, _, which, at):
        start = at - p.offset[which, 0]
        which, start = which[start >= 0], start[start >= 0]
        for k in range(1, WINDOW):
            if not len(which):
                break
            ok = (k >= p.size[which]) | self._within(rank[which, k], start + p.offset[which, k], 0)
            which, start = which[ok], start[ok]
        return which, start

    def _near(self, p, rank, anchor, which, at):
        doc = np.searchsorted(self.base, at, "right") - 1
        start, missed = at - p.offset[which, anchor], np.zeros(len(which), np.int64)
        for k in range(WINDOW):
            if not len(which):
                break
            if k == anchor:
                continue
            place = start + p.offset[which, k]
            # GAP is wider than a phrase and its slop, so what is found is in the same document.
            missed = missed + ((k < p.size[which]) & ~((place > -SLOP - 1) & self._within(rank[which, k], place, SLOP)))
            ok = missed <= p.misses[which]
            which, start, missed, doc = which[ok], start[ok], missed[ok], doc[ok]
        return which, doc


_HITS = "segment string, place int, starts binary, items array<string>, near_items array<string>"


def _find(segments: DataFrame, block, proximity: bool) -> DataFrame:
    """Hits of a broadcast block: of each document its exact matches (starts, with their sizes) and the items."""

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                s, p = _Segment(*(cols[x][r].as_py() for x in ("docs", "counts", "at", "terms", "sizes", "postings"))), block.value
                (which, start), (close, near_doc) = s.search(p, proximity)
                doc = np.searchsorted(s.base, start, "right") - 1
                out = {d: ([], set(), set()) for d in np.unique(np.append(doc, near_doc)).tolist()}
                for d, at, size, i in zip(doc.tolist(), (start - s.base[doc]).tolist(), p.size[which].tolist(), p.item[which].tolist(), strict=True):
                    out[d][0].append((at, size)), out[d][1].add(p.items[i])
                for d, i in set(zip(near_doc.tolist(), p.item[close].tolist(), strict=True)):
                    out[d][2].add(p.items[i])
                number = cols["segment"][r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(out), pa.string()), pa.array(list(out), pa.int32()), pa.array([W.pack_ints(np.array(sorted(set(v[0])), np.int64).ravel()) for v in out.values()], pa.binary()),
                     pa.array([sorted(v[1]) for v in out.values()], pa.list_(pa.string())), pa.array([sorted(v[2]) for v in out.values()], pa.list_(pa.string()))],
                    ["segment", "place", "starts", "items", "near_items"],
                )

    return segments.select("segment", "docs", "counts", "at", "terms", "sizes", "postings").mapInArrow(run, _HITS)


def _documents(segments: DataFrame) -> DataFrame:
    """(segment, place, doc_id, n_words, carried...) of each document row."""
    kept = [f for f in segments.schema.fields if f.name.startswith("__")]
    fields = "".join(f", `{f.name}` {f.dataType.elementType.simpleString()}" for f in kept)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                both, counts = W.unpack_ints(batch.column(1)[r].as_py()), W.unpack_ints(batch.column(2)[r].as_py())
                n = len(counts)
                ids = pa.array(both[:n], pa.int64(), mask=both[n:] == 0)
                own = [pa.array([batch.column(0)[r].as_py()] * n, pa.string()), pa.array(np.arange(n), pa.int32()), ids, pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *(batch.column(3 + i)[r].values for i in range(len(kept)))], ["segment", "place", "doc_id", "n_words", *(f.name for f in kept)])

    return segments.select("segment", "docs", "counts", *(f.name for f in kept)).mapInArrow(run, "segment string, place int, doc_id long, n_words long" + fields)


def _spans(hits: DataFrame) -> DataFrame:
    """(segment, place, n_hit, items, near_items, spans) of each document with hits, over all blocks."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    grouped = hits.groupBy("segment", "place").agg(F.collect_list("starts").alias("starts"), union("items"), union("near_items"))
    schema = "segment string, place int, n_hit long, items array<string>, near_items array<string>, spans array<struct<from: int, to: int>>"

    def run(batches):
        for batch in batches:
            n_hit, spans = [], []
            for blobs in batch.column(2):
                found = np.concatenate([W.unpack_ints(x.as_py()) for x in blobs.values]).reshape(-1, 2)
                found = found[np.argsort(found[:, 0], kind="stable")]
                out: list[list[int]] = []
                for at, size in found.tolist():
                    if out and at <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], at + size)
                    else:
                        out.append([at, at + size])
                n_hit.append(sum(b - a for a, b in out))
                spans.append([{"from": a, "to": b} for a, b in out])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), batch.column(3), batch.column(4), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                ["segment", "place", "n_hit", "items", "near_items", "spans"],
            )

    return grouped.select("segment", "place", "starts", "items", "near_items").mapInArrow(run, schema)


def find_hits(segments: DataFrame, phrases: DataFrame, proximity: bool = True) -> DataFrame:
    """(segment, place, n_hit, items, near_items, spans) of each document with a hit, block by block."""
    spark = segments.sparkSession
    counts = materialize(term_counts(segments), "counts", light=True)
    n = max(1, -(-phrases.count() // PHRASE_BLOCK))
    out = None
    for i in range(n):
        own = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == i)
        rows = own.orderBy("item_id", "phrase").toArrow()  # a block of the stated query set
        terms = own.select(F.explode("phrase").alias("term")).distinct()
        known = {r["term"]: r["n"] for r in counts.join(F.broadcast(terms), "term").collect()}
        block = spark.sparkContext.broadcast(Phrases(rows.column(0).to_pylist(), rows.column(1).to_pylist(), known))
        found = materialize(_find(segments, block, proximity), "hits", light=True)
        out = found if out is None else out.unionByName(found)
        block.unpersist()
    return _spans(out)


def search(segments: DataFrame, phrases: DataFrame, proximity: bool = True) -> DataFrame:
    """(doc_id, carry..., n_words, n_hit, items, near_items, spans) of each document row.

    items: item_ids with an exactly matched phrase, sorted; near_items: those with a phrase in
    proximity, exact ones among them; spans: [from, to) in words of each run of hit words.
    """
    found = materialize(find_hits(segments, phrases, proximity), "spans", light=True)
    every = _documents(segments)
    kept = [c for c in every.columns if c.startswith("__")]
    few = found.count() <= BROADCAST_IDS // 8
    every = every.join(F.broadcast(found) if few else found, ["segment", "place"], "left")
    none = F.array().cast("array<string>")
    return every.select(
        "doc_id", *(F.col(c).alias(c[2:]) for c in kept), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"), F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry=(), proximity: bool = True) -> DataFrame:
    """Index ``docs`` for the benchmark's terms and search it for the benchmark's phrases."""
    phrases = materialize(item_phrases(benchmark), "phrases", light=True)
    terms = materialize(phrases.select(F.explode("phrase").alias("term")).distinct(), "terms", light=True)
    vocabulary = terms.toArrow().column(0).to_numpy().astype(np.int64) if terms.count() <= VOCABULARY else None
    segments = materialize(build_index(docs, vocabulary, carry), "postings")
    return search(segments, phrases, proximity)


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["from"], s["to"])), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"), F.array_join("near_items", ",").alias("near_items"), spans.alias("spans"),
    )


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: contaminated documents go.

    The index carries a hash of each text and not the text, so that segments stay small; rows of
    one doc_id are judged one by one, those with the same text alike.
    """
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("__key"))
    found = decontaminate(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["__key"], proximity=False)
    gone = materialize(found.where(contaminated()).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of")).distinct(), "contaminated", light=True)
    small = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__of"])
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


QUERIES = {"op2_positional_index": op2}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op2_positional_index": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select distinct cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark where item_id is not null),
q as (select distinct item_id, least(len(w), {WINDOW}) as k, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) as phrase
      from (select item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as i from b where len(w) > 0)),
ks as (select distinct k from q),
g as (select doc_id, ks.k, w, unnest(range(1, len(w) - ks.k + 2)) as i from d, ks where len(w) >= ks.k),
h as (select g.doc_id, g.i, g.k, q.item_id from g join q on len(q.phrase) = g.k and q.phrase = list_slice(g.w, g.i, g.i + g.k - 1)),
a as (select doc_id, list_sort(list_distinct(list(item_id))) as items from h group by doc_id),
p as (select distinct doc_id, unnest(range(i - 1, i + k - 1)) as pos from h),
l as (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as island from p),
s as (select doc_id, island, min(pos) as lo, max(pos) + 1 as hi from l group by doc_id, island),
t as (select doc_id, sum(hi - lo) as n_hit, string_agg(lo || '-' || hi, ',' order by lo) as spans from s group by doc_id),
n as (select word, count(*) as n from (select unnest(w) as word from d) group by word),
o as (select item_id, phrase, k, unnest(range(1, k + 1)) as x from q),
r as (select item_id, phrase, k, x, phrase[x] as word, n, k * {NEAR_MISSES} // {WINDOW} as misses,
             row_number() over (partition by item_id, phrase order by coalesce(n, 0), x) as rarity
      from o left join n on n.word = o.phrase[o.x]),
c as (select * from r where rarity <= misses + 1 and n > 0),
e as (select doc_id, w, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
f as (select doc_id, w, item_id, phrase, k, c.x, misses, pos - c.x as start from e join c using (word)),
m as (select doc_id, list_sort(list_distinct(list(item_id))) as near from f
      where len(list_filter(range(1, k + 1), lambda j: j <> x and not list_contains(
              list_slice(w, greatest(1, start + j - {SLOP}), greatest(0, start + j + {SLOP})), phrase[j]))) <= misses
      group by doc_id)
select d.doc_id, len(d.w) as n_words, cast(coalesce(t.n_hit, 0) as bigint) as n_hit, coalesce(len(a.items), 0) as n_items,
       sha256(coalesce(array_to_string(a.items, ','), '')) as items_sha256,
       coalesce(t.n_hit, 0) > 0 and 20 * coalesce(t.n_hit, 0) >= len(d.w) as contaminated,
       coalesce(len(m.near), 0) as n_near, coalesce(array_to_string(m.near, ','), '') as near_items, coalesce(t.spans, '') as spans
from d left join a on d.doc_id = a.doc_id left join t on d.doc_id = t.doc_id left join m on d.doc_id = m.doc_id""",
}
