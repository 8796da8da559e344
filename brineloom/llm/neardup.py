"""Near duplicates by Order MinHash, verified by banded alignment.

Sketch: a text's k-mers of SHINGLE words are labelled with their occurrence (first, second, ...);
each of SKETCHES hash functions takes the TUPLE smallest labelled k-mers and keeps them in the
order of the text.  Two texts agree in a sketch only if they share those k-mers in that order, so
the sketch answers to edit similarity and not to a bag of words.  At a similarity of 0.8 all
SKETCHES miss with probability (1 - 0.8 ** TUPLE) ** SKETCHES = 3e-6.

Candidates: texts that agree in a sketch share a bucket.  Exact copies are one text from the
start.  A bucket offers each of its texts a few pivots (its first, its last, and two by hash), all
by aggregates that combine before the shuffle, so neither a bucket's size nor a group of copies
makes quadratic work.  Each text meets the one pivot that it shares most sketches with; then pivots of a
bucket that are still of different classes meet each other, and in buckets of up to SMALL texts
all texts meet their pivots of other classes.  Then, in each bucket that still has several classes, every pair
of its texts of different classes is compared in blocks: each block of the texts outside of the
bucket's largest class meets every block of texts of a similar length (a bucket that fits into one
block is one task, to which each of its texts goes once).  The pairs stay inside a
task, where a bound from hashed k-mers drops most of them exactly and the rest are aligned; only
links leave it.  So no pair of texts that share a sketch stays open.

Verification: similarity is the number of k-mers that an order-preserving alignment matches over
the number of k-mers in either text.  The multiset overlap bounds it from above; a narrow band
bounds it from below; if neither decides, the alignment runs in the band outside of which no
alignment can reach the threshold, which is exact.

Classes are the connected components of the verified links, named by their least doc_id.  It is
texts that are compared and not doc_ids: rows that repeat a doc_id with other texts are found each
by its own text, and may be of different classes.

Defined results: words are lower-cased runs of ASCII letters, digits and non-ASCII characters;
null or wordless texts are alone in their class; texts of fewer than SHINGLE words match exact
copies only; a null doc_id has a null class; repeated rows: the same class; very long texts are
read whole; ties do not arise (classes are named by minimum); an empty table: no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.llm import words as W
from brineloom.llm.shared import materialize

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TUPLE = 24, 4
#: Sets of ids up to this number are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Texts of a bucket that all meet its pivots as rows; in larger ones the blocks compare what is open.
SMALL = 64
#: Words of a block of texts (a long text is a block of its own), and what a text counts besides its words.
BLOCK_WORDS, TEXT_WORDS = 1 << 20, 64
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)


def _occurrences(kmers: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how often it came before in its row)."""
    order = np.lexsort((kmers, row))
    k, r = kmers[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    if new.all():
        return kmers
    starts = np.flatnonzero(new)
    nth = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
    out = kmers.copy()
    again = order[nth > 0]
    with np.errstate(over="ignore"):
        out[again] = W.mix(kmers[again] + nth[nth > 0].astype(_U) * _U(0x9E3779B97F4A7C15))
    return out


def _smallest(v: np.ndarray, row: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Places of the TUPLE smallest values of each row, in the order of the text.

    Only values under the row's limit are sorted; a row with too few of them is done in full.
    """
    near = np.flatnonzero(v <= limit[row])
    short = np.bincount(row[near], minlength=len(n)) < np.minimum(n, TUPLE)
    if short.any():
        near = np.flatnonzero((v <= limit[row]) | short[row])
    order = near[np.lexsort((v[near], row[near]))]
    r = row[order]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return np.sort(order[nth < TUPLE])


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, x1, x2, bands): a hash of the text, a 128-bit key of its words, and the ordered sketches."""

    def run(batches):
        odd, q = W.stream(31, SKETCHES) | _U(1), W.stream(32, TUPLE) | _U(1)
        for batch in batches:
            n_words, x1, x2, bands = [], [], [], []
            for c in W.chunks(W.text_array(batch.column(1))):
                w = W.words(c, W.ALNUM, lower=True)
                counts, row = w.counts, w.row
                n_words.append(counts)
                place = np.arange(len(row)) - np.repeat(w.ptr[:-1], counts)
                top = int(counts.max()) if len(counts) else 0
                full = np.flatnonzero(counts)
                for out, seed in ((x1, 33), (x2, 34)):
                    key = np.zeros(len(counts), _U)
                    if len(full):
                        with np.errstate(over="ignore"):
                            key[full] = W.mix(np.add.reduceat(w.hashes * (W.stream(seed, top) | _U(1))[place], w.ptr[:-1][full]) + counts[full].astype(_U))
                    out.append(key)
                ok = W.whole(w, SHINGLE)
                at = np.flatnonzero(ok)
                own = np.zeros((len(counts), SKETCHES), _U)
                if len(at):
                    r = row[at]
                    x = _occurrences(W.windows(w.hashes, SHINGLE, 35)[at], r)
                    n = np.bincount(r, minlength=len(counts))
                    with np.errstate(over="ignore", divide="ignore"):
                        limit = np.where(n <= 32, float(_MAX), 20.0 / np.maximum(n, 1) * float(_MAX))
                        limit = np.where(limit >= float(_MAX), _MAX, np.minimum(limit, 1.8e19).astype(_U))
                        for j in range(SKETCHES):
                            v = x * odd[j]
                            best = _smallest(v, r, n, limit)
                            rb = r[best]
                            starts = np.flatnonzero(np.append(True, rb[1:] != rb[:-1]))
                            nth = np.arange(len(rb)) - np.repeat(starts, np.diff(np.append(starts, len(rb))))
                            own[rb[starts], j] = W.mix(np.add.reduceat(x[best] * q[nth], starts) ^ odd[j])
                bands.append(own)
            every = np.concatenate(bands).view(np.int64)
            has = np.concatenate(n_words) >= SHINGLE
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * SKETCHES)), pa.int32()), pa.array(every[has].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(x1).view(np.int64)), pa.array(np.concatenate(x2).view(np.int64)), lists],
                ["doc_id", "h", "n_words", "x1", "x2", "bands"],
            )

    return _rows(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, h long, n_words long, x1 long, x2 long, bands array<long>")


def _aligned(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Longest common subsequences within a band of so many diagonals either side, pair by pair."""
    m, n = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), m), _U), np.ones((len(b), max(m, n) + 2 * width + 1), _U)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, : len(p)] = p
        y[i, width : width + len(q)] = q
    best = np.zeros((len(a), 2 * width + 2), np.int32)
    for i in range(m):
        step = best[:, :-1] + (y[:, i : i + 2 * width + 1] == x[:, i, None])
        np.maximum(step, best[:, 1:], out=step)
        np.maximum.accumulate(step, axis=1, out=best[:, :-1])
        best[:, -1] = 0
    return best.max(1)


def _bands(pairs: list[int], ka, kb, width_of) -> dict[int, int]:
    """Aligned k-mers of each pair, in groups of similar size that bound the memory."""
    out: dict[int, int] = {}
    pairs = sorted(pairs, key=lambda i: (width_of(i), len(ka[i])))
    lo = 0
    while lo < len(pairs):
        width, hi = width_of(pairs[lo]), lo + 1
        while hi < len(pairs) and hi - lo < 512 and width_of(pairs[hi]) <= 2 * width + 16 and (hi + 1 - lo) * max(len(ka[i]) for i in (pairs[lo], pairs[hi])) <= 1 << 19:
            hi += 1
        group = pairs[lo:hi]
        got = _aligned([ka[i] for i in group], [kb[i] for i in group], max(map(width_of, group)))
        out.update(zip(group, got.tolist(), strict=True))
        lo = hi
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


def similarities(left: list[np.ndarray], right: list[np.ndarray], threshold: float = SIMILARITY) -> np.ndarray:
    """Aligned k-mers over k-mers in either text, of pairs of word sequences; 0 if surely under the threshold."""
    ka = [W.windows(x.astype(_U), SHINGLE, 36) for x in left]
    kb = [W.windows(x.astype(_U), SHINGLE, 36) for x in right]
    total = [len(a) + len(b) for a, b in zip(ka, kb, strict=True)]
    ratio = lambda i, m: m / (total[i] - m) if total[i] > m else 1.0
    out = np.zeros(len(ka))
    open_ = [i for i in range(len(ka)) if len(ka[i]) and len(kb[i]) and min(len(ka[i]), len(kb[i])) >= threshold * max(len(ka[i]), len(kb[i])) and ratio(i, _common(ka[i], kb[i])) >= threshold]
    narrow = lambda i: 16 + abs(len(ka[i]) - len(kb[i]))
    unmatched = (1 - threshold) / (1 + threshold)
    exact = lambda i: int(np.ceil(unmatched * total[i])) + 1
    first = _bands(open_, ka, kb, narrow)
    again = [i for i in open_ if ratio(i, first[i]) < threshold and narrow(i) < exact(i)]
    first.update(_bands(again, ka, kb, exact))
    for i in open_:
        out[i] = ratio(i, first[i])
    return out


def _sequences(docs: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, seq): 32-bit word hashes of the given texts, each read from the row that texts names."""

    def run(batches):
        for batch in batches:
            out = []
            for c in W.chunks(W.text_array(batch.column(1))):
                w = W.words(c, W.ALNUM, lower=True)
                short = (w.hashes >> _U(32)).astype(np.uint32)
                out += [short[a:b].tobytes() for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "seq"])

    small = ids.count() <= BROADCAST_IDS
    own = texts.select("id", "doc_id", "h").join(F.broadcast(ids) if small else ids, "id", "left_semi")
    rows = _rows(docs).join(F.broadcast(own) if small else own, ["doc_id", "h"]).select("id", "text")
    return rows.mapInArrow(run, "id long, seq binary").dropDuplicates(["id"])


def _verify(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep, sims = [], []
            step = 2000
            for lo in range(0, batch.num_rows, step):
                x = [np.frombuffer(s.as_py(), np.uint32) for s in batch.column(2).slice(lo, step)]
                y = [np.frombuffer(s.as_py(), np.uint32) for s in batch.column(3).slice(lo, step)]
                s = similarities(x, y, threshold)
                hit = np.flatnonzero(s >= threshold)
                keep += (hit + lo).tolist()
                sims += s[hit].tolist()
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    x = pairs.join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("seq_a")), "a")
    x = x.join(seqs.select(F.col("id").alias("b"), F.col("seq").alias("seq_b")), "b")
    return x.select("a", "b", "seq_a", "seq_b").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame, name: str = "classes") -> DataFrame:
    """(id, label) with the least id of each connected component, for all ids in edges (a, b).

    Each round every id takes the least label among its neighbours, then the label of its label;
    the work is joins on materialized tables, so that hot ids can be split and lost tasks redone.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges", light=True)
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), name, light=True)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nxt = materialize(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), name, light=True)
        jump = nxt.select(F.col("id").alias("label"), F.col("label").alias("further"))
        nxt = materialize(nxt.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"), "was"), name, light=True)
        if not nxt.where("label <> was").limit(1).count():
            return nxt.select("id", "label")
        labels = nxt.select("id", "label")


def _labelled(rows: DataFrame, column: str, labels: DataFrame, out: str) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias(column), F.col("label").alias("__l")), column, "left").withColumn(out, F.coalesce("__l", column)).drop("__l")


def _block_links(ids, label, bands, seqs, right, own: bool, key: int, threshold: float) -> tuple[list[int], list[int]]:
    """Links that join the classes of the left texts and the right ones (own: and of the left ones themselves), as (a, b)."""
    kmers = [W.windows(x.astype(_U), SHINGLE, 36) for x in seqs]
    n = np.array([len(k) for k in kmers], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    labelled = _occurrences(np.concatenate(kmers), row)
    ptr = np.append(0, np.cumsum(n))
    first = np.argmax(bands == key, 1)
    names, code = np.unique(label, return_inverse=True)
    root = np.arange(len(names))

    def present(rows, bits):
        out = np.zeros((len(rows), 1 << bits), np.float32)
        for i, r in enumerate(rows):
            out[i, (labelled[ptr[r] : ptr[r + 1]] >> _U(64 - bits)).astype(np.int64)] = 1
        return out, n[rows] - out.sum(1).astype(np.int64)

    def by_length(rows):
        return rows[np.argsort(n[rows], kind="stable")]

    out = ([], [])
    xs, others = by_length(np.flatnonzero(~right)), by_length(np.flatnonzero(right))
    lo = 0
    while lo < len(xs):
        # Texts of similar length, against those that are long and short enough for a link.
        longest = n[xs[lo]] / threshold
        top = longest / threshold + 1
        bits = max(1, int(4 * min(top, n.max()) - 1).bit_length())
        step = max(1, min(2048, (1 << 24) >> bits))
        x = xs[lo : min(lo + step, int(np.searchsorted(n[xs], longest, "right")))]
        px, twice_x = present(x, bits)
        for ys, same in [(xs, True), (others, False)][not own :]:
            begin = lo if same else int(np.searchsorted(n[ys], threshold * n[x[0]] - 1))
            end = int(np.searchsorted(n[ys], n[x[-1]] / threshold + 1, "right"))
            for at in range(begin, end, step):
                y = ys[at : min(at + step, end)]
                py, twice_y = present(y, bits)
                # K-mers outside of the common slots are surely not in the other text.
                both = px @ py.T
                most = both + np.minimum(twice_x[:, None], twice_y[None, :])
                ok = (1 + threshold) * most >= threshold * (n[x][:, None] + n[y][None, :]) - 1e-6
                ok &= root[code[x]][:, None] != root[code[y]][None, :]
                if same:
                    ok &= lo + np.arange(len(x))[:, None] < at + np.arange(len(y))[None, :]
                i, j = np.nonzero(ok)
                i, j = x[i], y[j]
                some, size = 0, 16  # few pairs at first: one link may settle many
                while some < len(i):
                    p, q = i[some : some + size], j[some : some + size]
                    some, size = some + size, min(2 * size, 1024)
                    # A pair that shares an earlier sketch was or is compared there.
                    new = ~((bands[p] == bands[q]) & (np.arange(SKETCHES)[None, :] < first[p][:, None])).any(1)
                    new &= root[code[p]] != root[code[q]]
                    p, q = p[new], q[new]
                    if not len(p):
                        continue
                    hit = similarities([seqs[k] for k in p], [seqs[k] for k in q], threshold) >= threshold
                    for a, b in zip(p[hit].tolist(), q[hit].tolist(), strict=True):
                        ra, rb = root[code[a]], root[code[b]]
                        if ra != rb:
                            root[root == ra] = rb
                            out[0].append(int(max(ids[a], ids[b]))), out[1].append(int(min(ids[a], ids[b])))
        lo += len(x)
    return out


def _and_missing(docs, texts, seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """seqs with those of the ids that it lacks."""
    missing = ids.distinct().join(seqs.select("id"), "id", "left_anti")
    if not missing.limit(1).count():
        return seqs
    return seqs.unionByName(materialize(_sequences(docs, texts, missing), "sequences"))


def _in_buckets(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n_words, label, key): each text's row of each sketch; labels are joined to texts, not to those."""
    own = texts.where(F.size("bands") > 0).select("id", "n_words", "bands")
    return _labelled(own, "id", labels, "label").select("id", "n_words", "label", F.explode("bands").alias("key"))


def _still_open(texts, pivots, labels, best, near) -> DataFrame:
    """Pairs (a, b) of different classes: the pivots of a bucket, and in small ones each text and its pivots."""
    for i in range(4):
        pivots = _labelled(pivots, f"p{i}", labels, f"l{i}")
    pivots = pivots.select("key", "n", F.array_distinct(F.array(*(F.struct(F.col(f"p{i}").alias("id"), F.col(f"s{i}").alias("n_words"), F.col(f"l{i}").alias("label")) for i in range(4)))).alias("ps"))
    large = pivots.where(F.col("n") > SMALL).select("ps", F.explode("ps").alias("x")).select("x.*", "ps")
    small = _in_buckets(texts, labels).join(pivots.where(F.col("n") <= SMALL).select("key", "ps"), "key").select("id", "n_words", "label", "ps")
    x = large.unionByName(small).select("id", "n_words", "label", F.explode("ps").alias("p")).where("label <> p.label").where(near(F.col("n_words"), F.col("p.n_words")))
    x = x.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct()
    return x.join(best, ["a", "b"], "left_anti")


def _in_blocks(members: DataFrame) -> DataFrame:
    """(task, key, own, right, id, label): blocks of the texts outside of a bucket's largest class meet all of similar length."""
    grid = members.groupBy("key", "c", "minor").agg(F.ceil(F.sum(F.col("n_words") + TEXT_WORDS) / BLOCK_WORDS).alias("n"))
    grid = materialize(grid, "grid", light=True)
    x, y = grid.where("minor").select("key", F.col("c").alias("cx"), F.col("n").alias("nx")), grid.select("key", F.col("c").alias("cy"), "minor", F.col("n").alias("ny"))
    tasks = x.join(y, "key").where("cy - cx in (0, 1) or cy - cx = -1 and not minor").withColumn("gx", F.explode(F.expr("sequence(0, nx - 1)"))).withColumn("gy", F.explode(F.expr("sequence(0, ny - 1)")))
    tasks = tasks.where("not minor or cx <> cy or gx <= gy").withColumn("own", F.expr("minor and cx = cy and gx = gy")).drop("nx", "ny")
    tasks = materialize(tasks.withColumn("task", F.monotonically_increasing_id()), "blocks", light=True)
    members = members.join(grid, ["key", "c", "minor"]).withColumn("g", F.pmod(F.xxhash64("id"), F.col("n"))).select("key", "c", "minor", "g", "id", "label")
    sides = [
        members.where("minor").drop("minor").join(tasks.select("key", F.col("cx").alias("c"), F.col("gx").alias("g"), "task", "own"), ["key", "c", "g"]).withColumn("right", F.lit(False)),
        members.join(tasks.where("not own").select("key", F.col("cy").alias("c"), "minor", F.col("gy").alias("g"), "task", "own"), ["key", "c", "minor", "g"]).withColumn("right", F.lit(True)),
    ]
    columns = ["task", "key", "own", "right", "id", "label"]
    return sides[0].select(*columns).unionByName(sides[1].select(*columns))


def _between_classes(docs, texts, pivots, labels, seqs, threshold: float) -> DataFrame | None:
    """Links (a, b) between all texts of a bucket that are of different classes; None: no such texts.

    In buckets of up to SMALL texts the pivots were compared with every text before.
    """
    width = 1e-3 - float(np.log(threshold))  # texts that can be linked are at most one length class apart
    members = _in_buckets(texts, labels).join(pivots, "key").where(f"n > {SMALL} or id not in (p0, p1, p2, p3)")
    members = materialize(members.select("id", "n_words", "key", "label"), "open")
    words = F.sum(F.col("n_words") + TEXT_WORDS)
    mixed = members.groupBy("key", "label").agg(F.count("*").alias("n"), words.alias("words")).groupBy("key")
    mixed = mixed.agg(F.count("*").alias("n"), F.max_by("label", F.struct("n", "label")).alias("major"), (F.sum("words") <= BLOCK_WORDS).alias("one"))
    mixed = materialize(mixed.where("n > 1").drop("n"), "mixed", light=True)
    if not mixed.limit(1).count():
        return None
    members = members.join(mixed, "key").withColumn("minor", F.col("label") != F.col("major")).withColumn("c", F.floor(F.log(F.col("n_words") - (SHINGLE - 1)) / width))
    members = materialize(members.select("key", "one", "c", "minor", "id", "label", "n_words"), "open")
    seqs = _and_missing(docs, texts, seqs, members.select("id"))
    # A bucket that fits into a block is one task, to which each of its texts goes once.
    rows = members.where("one").select(F.lit(-1).cast("long").alias("task"), "key", F.lit(True).alias("own"), (~F.col("minor")).alias("right"), "id", "label")
    members = members.where("not one").drop("one")
    if members.limit(1).count():
        rows = rows.unionByName(_in_blocks(members))
    # Words and sketches are joined to texts; a text then goes to its tasks.
    rows = rows.groupBy("id", "label").agg(F.collect_list(F.struct("task", "key", "own", "right")).alias("at"))
    rows = rows.join(texts.select("id", "bands"), "id").join(seqs, "id").select("id", "label", "bands", "seq", F.inline("at"))

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        bands = np.array(t["bands"].to_pylist(), np.int64)
        seq = [np.frombuffer(s.as_py(), np.uint32) for s in t["seq"]]
        a, b = _block_links(t["id"].to_numpy(), t["label"].to_numpy(), bands, seq, t["right"].to_numpy(), t["own"][0].as_py(), t["key"][0].as_py(), threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(rows.groupBy("key", "task").applyInArrow(run, "a long, b long").distinct(), "links")


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, label, class_id) of each row that has a doc_id.

    h: the hash of its text; label: tells classes apart (null without words); class_id: the least
    doc_id of the class, which classes share if texts of one doc_id are in several.
    """
    sk = materialize(sketch(docs), "sketches")
    first = sk.where("n_words > 0").groupBy("x1", "x2").agg(F.min("doc_id").alias("rep"))
    # A text's id is a number of its own, as doc_ids may repeat.
    copies = materialize(first.withColumn("id", F.monotonically_increasing_id()), "copies", light=True)
    # One row of each distinct text.
    texts = sk.join(copies.withColumnRenamed("rep", "doc_id"), ["doc_id", "x1", "x2"]).select("id", "doc_id", "h", "n_words", "bands").dropDuplicates(["id"])
    texts = materialize(texts, "texts")
    banded = texts.where(F.size("bands") > 0).select("id", "n_words", F.explode("bands").alias("key"))
    h = F.xxhash64("id")
    first, last, least, most = F.min("id"), F.max("id"), F.min_by("id", h), F.max_by("id", h)
    sizes = F.min_by("n_words", "id"), F.max_by("n_words", "id"), F.min_by("n_words", h), F.max_by("n_words", h)
    pivots = banded.groupBy("key").agg(F.count("*").alias("n"), *(p.alias(f"p{i}") for i, p in enumerate((first, last, least, most))), *(x.alias(f"s{i}") for i, x in enumerate(sizes)))
    pivots = materialize(pivots.where("n > 1"), "pivots", light=True)
    grams = lambda c: F.greatest(c - (SHINGLE - 1), F.lit(1))
    near = lambda m, n: F.least(grams(m), grams(n)) >= threshold * F.greatest(grams(m), grams(n))
    offered = F.array_distinct(F.array(*(F.struct(F.col(f"p{i}").alias("id"), F.col(f"s{i}").alias("n_words")) for i in range(4))))
    found = banded.join(pivots, "key").select("id", "n_words", F.explode(offered).alias("p")).where("id <> p.id").where(near(F.col("n_words"), F.col("p.n_words")))
    found = found.groupBy("id", F.col("p.id").alias("pivot")).agg(F.count("*").alias("weight"))
    # First each text with the pivot that it shares most sketches with, then what is still open.
    best = found.groupBy("id").agg(F.max_by("pivot", F.struct("weight", -F.col("pivot"))).alias("pivot"))
    best = materialize(best.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct(), "best", light=True)
    seqs = materialize(_sequences(docs, texts, best.select(F.col("a").alias("id")).union(best.select("b")).distinct()), "sequences")
    links = materialize(_verify(best, seqs, threshold).select("a", "b"), "links")
    labels = components(links)
    rest = materialize(_still_open(texts, pivots, labels, best, near), "rest", light=True)
    seqs = _and_missing(docs, texts, seqs, rest.select(F.col("a").alias("id")).union(rest.select("b")))
    links = materialize(links.unionByName(_verify(rest, seqs, threshold).select("a", "b")), "links")
    labels = components(links)
    got = _between_classes(docs, texts, pivots, labels, seqs, threshold)
    if got is not None:
        labels = components(links.unionByName(got))
    named = labels.join(copies.select("id", "rep"), "id").groupBy("label").agg(F.min("rep").alias("least"))
    named = labels.join(materialize(named, "named", light=True), "label")
    named = copies.join(named, "id", "left").select("x1", "x2", F.coalesce("label", "id").alias("label"), F.coalesce("least", "rep").alias("class_id"))
    named = materialize(named, "named", light=True)
    known = sk.where("n_words > 0").select("doc_id", "h", "x1", "x2").join(named, ["x1", "x2"]).select("doc_id", "h", "label", "class_id")
    return known.unionByName(sk.where("n_words = 0").select("doc_id", "h", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id")))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of each row: the least doc_id of its class; a null doc_id: null."""
    null = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return classes(docs, threshold).select("doc_id", "class_id").unionByName(null)


def op1(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each class the document of the least doc_id stays.

    Of several texts of a class under that doc_id the one of the least hash stays, and of rows
    equal in doc_id and text one.  Null and wordless texts are in no class and stay; rows of a
    null doc_id stay.  An empty table stays empty; other columns, of any name but __d and __h, are
    kept.
    """
    found = materialize(classes(docs), "classes", light=True)
    best = found.where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("best")).where("n > 1")
    gone = found.join(best, "label").where("doc_id <> best.doc_id or h <> best.h").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct()
    gone = materialize(gone, "gone", light=True)
    again = found.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).count().where("count > 1").select("__d", "__h")
    again = materialize(again, "again", light=True)
    columns, key = docs.columns, ["__d", "__h"]
    keyed = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__h": F.xxhash64(F.col("text").cast("string"))})
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")
    if n := again.count():
        again = F.broadcast(again) if n <= BROADCAST_IDS else again
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(*columns)


QUERIES = {"op1_order_minhash": op1}
ORACLE: dict[str, str] = {}
