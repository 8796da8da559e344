"""Toxicity by a weighted finite-state pattern grammar.

Five transducers work on the words of a clause (what stands between . ! ? ; : and line feeds).  A
word is a symbol: a set of flags that the lexicon gives (insult, threat, target, negation, report)
and that the transducers add (negated, reported, targeted):

* negation: after a negation the next NEGATION_REACH words are marked negated;
* reported speech: from a verb of saying to the clause's end words are marked reported;
* target: pronouns of a second or third party.  It has two starts, one that promises a target
  in the clause and marks all words targeted, one that promises none; each clause has exactly one
  path that keeps its promise;
* threat: a verb of harm that is targeted, neither negated nor reported, has weight 1 in its channel;
* insult: a word with a stem or whole word of the lexicon has the heaviest one's weight in the
  channel negated, reported, targeted or plain, by its marks.

Each is a table (state, symbol) to (state, symbol, arc weight); ``compose`` makes one machine of
them, once, and ``run`` reads all clauses that hold an insult or a threat through it side by side.
A clause adds the logarithm of one plus what its path gathered in each channel; the document's
score is a logistic function of the channels' sums, so it is matched clauses that count and not
words alone.  The lexicon's weights and the logistic weights are learned.

Learning: stems over ALL labelled texts of the training folds, in two passes (first counts in
toxic texts; then, for stems that at least max(MIN_SUPPORT, SUPPORT_SHARE of toxic texts) have,
counts in the others).  That leaves at most stems-of-a-text / SUPPORT_SHARE candidates, whatever
the corpus, so they are safe to gather and to broadcast.  The logistic weights are fitted on at
most FIT_ROWS labelled rows, those of the smallest hashes.

Defined results: null or empty text: the score of a text without matches; very long texts are
read whole; repeated rows: repeated results; conflicting or repeated labels: each label row
counts; a null label or doc_id: not used to learn; a null doc_id is not held out; no labels or an
empty table: every score is PRIOR; other columns are ignored, or carried by the pipeline's stage
whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineloom.llm import words as W
from brineloom.llm.langid import _lowered, fold
from brineloom.llm.shared import materialize

#: Bytes of the stems that the insult trie holds, besides whole words.
STEMS = (4, 5, 6)
MIN_SUPPORT, SUPPORT_SHARE = 5, 0.001
#: Lower bound (Wilson) of the share of toxic among the texts that hold a stem.
PRECISION, Z = 0.4, 2.6
#: A stem of this log lift or more has weight 1.
FULL_LIFT = 6.0
FIT_ROWS = 100_000
#: Labels up to this number are broadcast; more are joined by a shuffle, once.
BROADCAST_ROWS = 2_000_000
PRIOR = 0.02
NEGATION_REACH = 3
CHANNELS = ("targeted", "plain", "negated", "reported", "threat")

# Word lists of the threat, target, negation and reported-speech transducers.
THREATS = "kill hurt destroy shoot stab beat burn töten umbringen schlagen verletzen tuer frapper blesser détruire matar golpear destruir herir".split()
TARGETS = "you your he she they them him her du dich dir euch ihr sie er tu te toi vous il elle ils ellos ella usted ustedes tú él".split()
NEGATIONS = "not no never nobody nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says say told reported quoted called wrote sagte sagt schrieb zitierte dit disait écrit rapporte dijo dice escribió citó".split()

# Flags of a symbol: what the lexicon says of a word, then what the transducers mark.
_INSULT, _THREAT, _TARGET, _NEGATION, _REPORT, _NEGATED, _REPORTED, _TARGETED = (1 << i for i in range(8))
SYMBOLS, WORD_SYMBOLS = 256, 32
_DEAD = -1
_END = np.zeros(256, bool)
_END[[ord(x) for x in ".!?;:\n"]] = True


def _known() -> dict[int, int]:
    out = {}
    for kind, words in ((_THREAT, THREATS), (_TARGET, TARGETS), (_NEGATION, NEGATIONS), (_REPORT, REPORTS)):
        texts = pa.array(words, pa.large_string())
        for c in W.chunks(texts):
            w = W.split(c, c.data, W.LETTERS)
            for h in W.hash_words(w, c.data):
                out[int(h)] = out.get(int(h), 0) | kind
    return out


def _features(c: W.Chunk) -> tuple[W.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for each kind of stem (whole words first): its hashes and whose they are."""
    w = W.split(c, c.data, W.LETTERS)
    w.hashes = W.hash_words(w, c.data)
    size, every = w.ends - w.starts, np.arange(len(w.starts))
    kinds = [(w.hashes, every)]
    for k in STEMS:
        own = every[size > k]
        at = w.starts[own]
        with np.errstate(over="ignore"):
            h = np.zeros(len(own), np.uint64)
            for j in range(k):
                h += W._BYTE[c.data[at + j]] * W._AT[j]
            kinds.append((W.mix(h ^ np.uint64(0x51A3 + k)), own))
    return w, kinds


class _Lookup:
    """Values of known hashes; a bitmap of their top bits spares most of the search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.top = np.zeros(1 << 20, bool)
        self.top[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, value) of those that are known."""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.values[:0]
        near = np.flatnonzero(self.top[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[near]
        return near[hit], self.values[at[hit]]


def _count_stems(texts: DataFrame, only) -> DataFrame:
    """(stem, n): in how many of the texts each stem occurs; only: a broadcast _Lookup, or None."""

    def count(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for c in W.chunks(_lowered(batch.column(0))):
                w, kinds = _features(c)
                row = w.row
                found_h, found_r = [], []
                for h, own in kinds:
                    r = row[own]
                    if only is not None:
                        at, _ = only.value(h)
                        h, r = h[at], r[at]
                    found_h.append(h), found_r.append(r)
                h, r = np.concatenate(found_h), np.concatenate(found_r)
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                keys, n = np.concatenate([keys, h[new]]), np.concatenate([n, np.ones(int(new.sum()), np.int64)])
                if len(keys) > 2_000_000:
                    keys, n = _sum_by(keys, n)
                    if len(keys) > 1_000_000:
                        yield _pairs(keys, n)
                        keys, n = keys[:0], n[:0]
        yield _pairs(*_sum_by(keys, n))

    out = texts.mapInArrow(count, "stem long, n long")
    return out.groupBy("stem").agg(F.sum("n").alias("n"))


def _sum_by(keys, n):
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _pairs(keys, n):
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["stem", "n"])


def _gather(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    return t.column(0).to_numpy().astype(np.int64).view(np.uint64), t.column(1).to_numpy().astype(np.int64)


def learn_lexicon(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the insult trie's stems from (text, label) rows."""
    n1, n0 = texts.agg(F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("label") == 0).cast("long")), F.lit(0))).first()
    if not n1:
        return np.zeros(0, np.uint64), np.zeros(0)
    support = max(MIN_SUPPORT, int(SUPPORT_SHARE * n1))
    stems, c1 = _gather(_count_stems(texts.where("label = 1").select("text"), None).where(F.col("n") >= support))
    only = texts.sparkSession.sparkContext.broadcast(_Lookup(stems, c1))
    k0, v0 = _gather(_count_stems(texts.where("label = 0").select("text"), only))
    order = np.argsort(k0)
    k0, v0 = k0[order], v0[order]
    c0 = np.zeros(len(stems), np.int64)
    if len(k0):
        at = np.minimum(np.searchsorted(k0, stems), len(k0) - 1)
        c0 = np.where(k0[at] == stems, v0[at], 0)
    n, p = c1 + c0, c1 / np.maximum(1, c1 + c0)
    low = (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    lift = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    keep = (low >= PRECISION) & (lift > 1)
    return stems[keep], np.minimum(lift[keep] / FULL_LIFT, 1.0)


@dataclass(frozen=True)
class Transducer:
    """Tables [state, symbol]: the next state (or _DEAD), the symbol written, and arc weights.

    fixed: [state, symbol, channel]; scaled: the same, to be multiplied by the word's own weight.
    """

    starts: tuple[int, ...]
    accepts: frozenset[int]
    to: np.ndarray
    says: np.ndarray
    fixed: np.ndarray
    scaled: np.ndarray

    @staticmethod
    def of(n: int, arc, starts=(0,), accepts=None) -> Transducer:
        """From arc(state, symbol) -> (state, symbol, {channel: weight}, {channel: scaled weight})."""
        to, says = np.zeros((n, SYMBOLS), np.int16), np.zeros((n, SYMBOLS), np.int16)
        fixed, scaled = np.zeros((n, SYMBOLS, len(CHANNELS))), np.zeros((n, SYMBOLS, len(CHANNELS)))
        for s in range(n):
            for x in range(SYMBOLS):
                to[s, x], says[s, x], one, many = arc(s, x)
                for table, weights in ((fixed, one), (scaled, many)):
                    for channel, weight in weights.items():
                        table[s, x, CHANNELS.index(channel)] = weight
        return Transducer(tuple(starts), frozenset(range(n) if accepts is None else accepts), to, says, fixed, scaled)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that gives b what a writes; its states are the pairs that a start can reach."""
    pairs = {}
    order = []

    def number(p):
        if p not in pairs:
            pairs[p] = len(order)
            order.append(p)
        return pairs[p]

    starts = tuple(number((x, y)) for x in a.starts for y in b.starts)
    to, says, fixed, scaled = [], [], [], []
    for s, t in order:  # grows while it is read
        middle = a.says[s]
        own = np.full(SYMBOLS, _DEAD, np.int16)
        for x in np.flatnonzero((a.to[s] != _DEAD) & (b.to[t, middle] != _DEAD)).tolist():
            own[x] = number((int(a.to[s, x]), int(b.to[t, middle[x]])))
        to.append(own), says.append(b.says[t, middle])
        fixed.append(a.fixed[s] + b.fixed[t, middle]), scaled.append(a.scaled[s] + b.scaled[t, middle])
    accepts = frozenset(i for i, (s, t) in enumerate(order) if s in a.accepts and t in b.accepts)
    return Transducer(starts, accepts, *map(np.stack, (to, says, fixed, scaled)))


def negation() -> Transducer:
    return Transducer.of(NEGATION_REACH + 1, lambda s, x: (NEGATION_REACH if x & _NEGATION else max(0, s - 1), x | _NEGATED * (s > 0), {}, {}))


def reported() -> Transducer:
    return Transducer.of(2, lambda s, x: (1 if x & _REPORT else s, x | _REPORTED * s, {}, {}))


def target() -> Transducer:
    """States: none promised; promised; promised and seen."""

    def arc(s, x):
        if not s:
            return (_DEAD if x & _TARGET else 0), x, {}, {}
        return (2 if x & _TARGET else s), x | _TARGETED, {}, {}

    return Transducer.of(3, arc, starts=(0, 1), accepts=(0, 2))


def threat() -> Transducer:
    return Transducer.of(1, lambda s, x: (0, x, {"threat": 1.0} if x & _THREAT and x & _TARGETED and not x & (_NEGATED | _REPORTED) else {}, {}))


def insult() -> Transducer:
    def channel(x):
        return "negated" if x & _NEGATED else "reported" if x & _REPORTED else "targeted" if x & _TARGETED else "plain"

    return Transducer.of(1, lambda s, x: (0, x, {}, {channel(x): 1.0} if x & _INSULT else {}))


def grammar() -> list[Transducer]:
    return [negation(), reported(), target(), threat(), insult()]


_MACHINE: list[Transducer] = []


def machine() -> Transducer:
    """All five composed, once a process."""
    if not _MACHINE:
        _MACHINE.append(functools.reduce(compose, grammar()))
    return _MACHINE[0]


def run(m: Transducer, symbols: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[clauses, CHANNELS]: what the accepted path of each clause gathers; clauses one after another.

    All clauses advance together, longest first, so that a step touches those that have a word left.
    """
    n = len(sizes)
    out = np.zeros((n, len(CHANNELS)))
    if not n:
        return out
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")  # clauses with a word at each place
    accepts = np.zeros(len(m.to), bool)
    accepts[list(m.accepts)] = True
    for start in m.starts:
        state, gathered = np.full(n, start, np.int16), np.zeros((n, len(CHANNELS)))
        for place, k in enumerate(active.tolist()):
            at = first[:k] + place
            s, x = state[:k], symbols[at]
            alive = s != _DEAD
            gathered[:k] += (m.fixed[s, x] + m.scaled[s, x] * weights[at][:, None]) * alive[:, None]
            state[:k] = np.where(alive, m.to[s, x], _DEAD)
        kept = (state != _DEAD) & accepts[state]
        out[order[kept]] += gathered[kept]
    return out


def _channels(batch_texts: pa.Array, insults: _Lookup, known: _Lookup) -> np.ndarray:
    """[texts, CHANNELS] sums over clauses of log(1 + weight)."""
    out = np.zeros((len(batch_texts), len(CHANNELS)))
    for c in W.chunks(batch_texts):
        w, kinds = _features(c)
        if not len(w.starts):
            continue
        weight = np.zeros(len(w.starts))
        for h, own in kinds:
            at, v = insults(h)
            np.maximum.at(weight, own[at], v)
        symbol = _INSULT * (weight > 0).astype(np.int16)
        at, v = known(w.hashes)
        symbol[at] |= v
        row = w.row
        clause = np.cumsum(_END[c.data])[w.starts]
        new = np.append(True, (row[1:] != row[:-1]) | (clause[1:] != clause[:-1]))
        number = np.cumsum(new) - 1
        hot = np.unique(number[(symbol & (_INSULT | _THREAT)) > 0])
        if not len(hot):
            continue
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(row)))
        take = np.zeros(len(begin), bool)
        take[hot] = True
        # Of plain words in a row, more than NEGATION_REACH change nothing.
        words = np.flatnonzero(take[number])
        plain = symbol[words] == 0
        since = np.arange(len(words)) - np.maximum.accumulate(np.where(plain & ~new[words], -1, np.arange(len(words))))
        words = words[~(plain & (since > NEGATION_REACH))]
        size = np.bincount(number[words], minlength=len(begin))[hot]
        got = run(machine(), symbol[words], weight[words], size)
        np.add.at(out, c.lo + row[begin[hot]], np.log1p(got))
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, bias last, by Newton steps with a small ridge; none below 0 but the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    free, b = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    for _ in range(4):
        b[:] = 0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ b[free], -30, 30)))
            h = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + 0.05 * np.eye(int(free.sum()))
            step = np.linalg.solve(h, x[:, free].T @ (y - p) - 0.05 * b[free])
            b[free] += step
            if np.abs(step).max() < 1e-8:
                break
        low = (b < 0) & free
        low[-1] = False
        if not low.any():
            break
        free &= ~low
        b[low] = 0
    return b


class Model:
    def __init__(self, hashes, weights, logistic):
        known = _known()
        self.insults = _Lookup(hashes, weights)
        self.known = _Lookup(np.array(list(known), np.uint64), np.array(list(known.values()), np.int16))
        self.logistic = logistic

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = _channels(texts, self.insults, self.known)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:-1] + self.logistic[-1], -30, 30))), x


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of ``docs`` outside the held-out fold."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("toxic").alias("label"))
    small = lab.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(lab) if small else lab, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label", "doc_id")
    if not small:
        texts = materialize(texts, "labelled")  # one shuffle of the texts instead of one a pass
    hashes, weights = learn_lexicon(texts)
    prior = np.append(np.zeros(len(CHANNELS)), np.log(PRIOR / (1 - PRIOR)))
    model = docs.sparkSession.sparkContext.broadcast(Model(hashes, weights, prior))

    def features(batches):
        for batch in batches:
            x = model.value.scores(_lowered(batch.column(0)))[1]
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int64())], ["x", "label", "doc_id"])

    # At most FIT_ROWS rows are gathered: those of the smallest hashes of their doc_id.
    rows = texts.mapInArrow(features, "x array<double>, label int, doc_id long").orderBy(F.xxhash64("doc_id"), "label").limit(FIT_ROWS).toArrow()
    if not rows.num_rows:
        return Model(hashes, weights, prior)
    x, y = np.array(rows.column(0).to_pylist()), rows.column(1).to_numpy().astype(float)
    return Model(hashes, weights, _fit(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with score and the five channels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most stems-of-a-text / SUPPORT_SHARE stems

    def run(batches):
        for batch in batches:
            s, x = shared.value.scores(_lowered(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "score", "channels"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, channels array<double>")


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score(docs, model)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "channels")


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows of score 0.5 or more go, each judged by its own text.

    The rows pass through as they are, so nulls, repeated rows, empty and very long texts and
    columns of any name stay what they were; a null or empty text stays, unless PRIOR is 0.5.
    """
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            clean = shared.value.scores(_lowered(batch.column(place)))[0] < 0.5
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


QUERIES = {"op8_toxic_clauses": op8}
ORACLE: dict[str, str] = {}
