"""URL filters: a fixed rule list, and association rules mined from the urls it labels.

Token combinations are mined by Spark's FP-growth over every url that the rule list judges (the
labels): items are the url's tokens and its label.  Rules {tokens} -> label above a support and a
confidence are kept; a rule goes if a part of its tokens already gives the same label with at
least its confidence.  Urls that the list does not judge are matched through an inverted index:
each rule is filed under its rarest token, so a url looks only at rules under its own tokens.
The surest rule decides (then the longer, then the first in order); without one, DEFAULT.

Three reductions before FP-growth lose no rule:

* tokens that always occur together, in the same urls, are one item (a url of many tokens that
  repeats would otherwise have a frequent set for each subset of them); a rule on that item is
  a rule on any of the tokens;
* a token whose urls all have one label is a rule of confidence 1 by itself, of which every larger
  set is pruned: it is not mined further;
* tokens under the support go.

The number of frequent sets depends on the support and on the items of one url: with at most MAX_ITEMS
there are at most 2 ** (MAX_ITEMS + 1) / support sets, whatever the number of urls, to be gathered.  Where
a url has more, judge has the same rules grown without listing all sets: each item's task gets the urls that
hold it, cut to the more frequent items, and extends sets there.  A set is left when no label has the
support, when all of its urls have one label, and when an item is in all of its urls (the smaller set has the
same confidence); all of that only drops rules that are pruned anyway.  Only rules leave a task.

Defined results: null url or one without ``://``: empty host and path, no rule, DEFAULT; urls are
read whole; repeated rows: repeated results, and each counts in mining; no labelled url: DEFAULT
for all; ties between rules: as above; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineloom.llm.shared import materialize

#: (rule, verdict): host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: Items of one url up to which all frequent sets are listed; with more, sets are grown item by item.
MAX_ITEMS = 10
DEFAULT = "allow"
_LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith(slash + rest), rule).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (digits as #), names of parameters."""
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.split(path, "[/.]"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.split(F.substring_index(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "#", 1), "&")
    names = F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    every = F.array_distinct(F.concat(scheme, labels, parts, names))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(every, lambda x: ~x.rlike("^[a-z]+:$")))


def prepare(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, tokens)."""
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    x = x.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return x.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def _token_table(rows: DataFrame, total: int, support: float) -> list:
    """(token, n, labels, item) of the tokens of the support: item names all that occur in the same rows."""
    # The same rows: as many, with the same sums of two hashes of a row.
    counts = rows.select(F.explode("tokens").alias("token"), "label", "copies", F.xxhash64("tokens", "label").alias("h1"), F.xxhash64(F.lit(5), "tokens", "label").alias("h2"))
    counts = counts.groupBy("token").agg(F.sum("copies").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("s1"), F.sum(F.col("h2").cast("decimal(38,0)")).alias("s2"))
    return counts.where(F.col("n") >= math.ceil(support * total)).orderBy("token").collect()  # at most tokens-of-a-url / support


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, exact: bool = False) -> tuple[list[tuple[tuple[str, ...], str, float, float]], dict[str, str]]:
    """Pruned rules (items, label, confidence, support) from rows (tokens, label), and each token's item.

    exact: rows of more than MAX_ITEMS items give their rules too, as judge and so the query ask for;
    without it the support is doubled until no row has more (the support that held is logged).
    """
    rows = labelled.groupBy(F.array_sort("tokens").alias("tokens"), "label").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "labelled", light=True)
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    if not total:
        return [], {}
    spark, support, of, found, open_ = rows.sparkSession, min_support, {}, [], {}  # open_: items of several labels
    names: dict[tuple, str] = {}
    table = _token_table(rows, total, support)
    for r in table:
        name = names.setdefault((r["n"], r["s1"], r["s2"]), r["token"])
        of[r["token"]] = name
        if r["least"] == r["most"] and name == r["token"]:
            found.append(((name,), r["least"], 1.0, r["n"] / total))
        elif r["least"] != r["most"]:
            open_[name] = r["n"]
    while True:
        least = math.ceil(support * total)
        kept = spark.createDataFrame([(t, n) for t, n in of.items() if open_.get(n, 0) >= least], "token string, item string")
        items = rows.select("tokens", "label", "copies", F.explode_outer("tokens").alias("token"))
        items = items.join(F.broadcast(kept), "token", "left").groupBy("tokens", "label", "copies").agg(F.array_sort(F.collect_set("item")).alias("items"))
        items = items.groupBy("items", "label").agg(F.sum("copies").alias("copies"))
        items = materialize(items, "transactions", light=True)
        if (items.agg(F.max(F.size("items"))).first()[0] or 0) <= MAX_ITEMS:
            break
        if exact:
            order = sorted((x for x, n in open_.items() if n >= least), key=lambda x: (open_[x], x))
            for r in grown(items, order, least, min_confidence).collect():
                found.append((tuple(sorted(order[i] for i in r["items"])), r["label"], r["n"] / r["of"], r["n"] / total))
            return prune(found), of
        support *= 2
    if support > min_support:
        logging.getLogger(__name__).warning("urls of over %d items: support raised to %g", MAX_ITEMS, support)
    # FP-growth has no weights: a row of n copies is n rows.
    every = items.select(F.array_append("items", F.concat(F.lit(_LABEL), "label")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("items")
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(every).freqItemsets
    counts = {frozenset(r["items"]): r["freq"] for r in sets.collect()}  # bounded by support and MAX_ITEMS
    for own, n in counts.items():
        label = [x for x in own if x.startswith(_LABEL)]
        rest = own.difference(label)
        if len(label) == 1 and rest and (sure := n / counts[rest]) >= min_confidence:
            found.append((tuple(sorted(rest)), label[0][len(_LABEL) :], sure, n / total))
    return prune(found), of


def _extend(has: np.ndarray, weight: np.ndarray, least: int, confidence: float):
    """(columns, label, n, of) of the rules on the rows of has (row, item) with weights (row, label).

    A rule is left out if a set on the way to it gives the label as surely.
    """
    stack = [((), np.arange(len(has)), np.arange(has.shape[1]), np.zeros(weight.shape[1]))]
    while stack:
        own, rows, items, best = stack.pop()
        n = weight[rows].sum(0)
        of = n.sum()
        sure = n / of
        for label in np.flatnonzero((n >= least) & (sure >= confidence) & (sure > best)).tolist():
            yield own, label, int(n[label]), int(of)
        if n.max() == of or not len(items):
            continue
        part = has[np.ix_(rows, items)]
        counts = weight[rows].T @ part
        go = (counts.max(0) >= least) & (counts.sum(0) < of)
        items, part = items[go], part[:, go]
        best = np.maximum(best, np.where(n >= least, sure, 0))
        for j in range(len(items)):
            stack.append(((*own, int(items[j])), rows[part[:, j]], items[j + 1 :], best))


def grown(rows: DataFrame, order: list[str], least: int, confidence: float) -> DataFrame:
    """(items, label, n, of) of rules from rows (items, label, copies), items as places in order (rarest first).

    A set is counted in the task of its rarest item.
    """
    place = rows.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(order)})

    def deal(batches):
        for batch in batches:
            out = ([], [], [], [])
            for items, label, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sorted(place.value[x] for x in items if x is not None)
                for i, x in enumerate(own):
                    for column, v in zip(out, (x, own[i + 1 :], label, copies), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int64()), strict=True)], ["item", "rest", "label", "copies"])

    def run(key, table):
        lists, labels = table.column("rest").combine_chunks(), table.column("label").combine_chunks().dictionary_encode()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        names, column = np.unique(flat, return_inverse=True)
        length = lists.value_lengths().to_numpy(zero_copy_only=False)
        has = np.zeros((len(lists), len(names)), bool)
        has[np.repeat(np.arange(len(lists)), length), column] = True
        weight = np.zeros((len(lists), len(labels.dictionary)))
        weight[np.arange(len(lists)), labels.indices.to_numpy(zero_copy_only=False)] = table.column("copies").to_numpy()
        rules = prune([(own, labels.dictionary[label].as_py(), n / of, 0.0, n, of) for own, label, n, of in _extend(has, weight, least, confidence)])
        first = key[0].as_py()
        return pa.table(
            [
                pa.array([[first, *(int(names[i]) for i in own)] for own, *_ in rules], pa.list_(pa.int32())),
                pa.array([r[1] for r in rules], pa.string()),
                pa.array([r[4] for r in rules], pa.int64()),
                pa.array([r[5] for r in rules], pa.int64()),
            ],
            names=["items", "label", "n", "of"],
        )

    dealt = rows.select("items", "label", "copies").mapInArrow(deal, "item int, rest array<int>, label string, copies long")
    dealt = dealt.groupBy("item", "rest", "label").agg(F.sum("copies").alias("copies"))
    return dealt.groupBy("item").applyInArrow(run, "items array<int>, label string, n long, of long")


def prune(found):
    """Without the rules of which a part gives the same label at least as surely."""
    best: dict[tuple[frozenset, str], float] = {}
    kept = []
    for items, label, sure, *more in sorted(found, key=lambda r: (len(r[0]), r[0], r[1])):
        own = frozenset(items)
        if not any(s >= sure and lab == label and part < own for (part, lab), s in best.items()):
            best[own, label] = sure
            kept.append((items, label, sure, *more))
    return kept


class Index:
    """Rules by their rarest item; of: the item of each token."""

    def __init__(self, rules, of):
        self.of = of
        seen: dict[str, int] = {}
        for items, *_ in rules:
            for x in items:
                seen[x] = seen.get(x, 0) + 1
        self.by: dict[str, list] = {}
        for items, label, sure, _ in sorted(rules, key=lambda r: (-r[2], -len(r[0]), r[0], r[1])):
            self.by.setdefault(min(items, key=lambda x: (seen[x], x)), []).append((-sure, -len(items), items, label))

    def verdict(self, tokens) -> tuple[str | None, str | None, float | None]:
        own, best = {self.of[x] for x in tokens if x in self.of}, None
        for x in own:
            for rule in self.by.get(x, ()):
                if best is not None and rule >= best:
                    break
                if own.issuperset(rule[2]):
                    best = rule
                    break
        return (best[3], " ".join(best[2]), -best[0]) if best else (None, None, None)


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence)."""
    verdicts = dict(rules)
    x = prepare(pages, rules)
    label = F.lit(None).cast("string")
    for rule, verdict in rules:
        label = F.when(F.col("rule") == rule, verdict).otherwise(label)
    labelled = x.where(F.col("rule").isNotNull()).select("tokens", label.alias("label"))
    index = x.sparkSession.sparkContext.broadcast(Index(*mine(labelled, min_support, min_confidence, exact=True)))  # rules, pruned

    def run(batches):
        for batch in batches:
            rule, out = batch.column(3).to_pylist(), ([], [], [])
            for own, toks in zip(rule, batch.column(4).to_pylist(), strict=True):
                said = (verdicts[own], None, None) if own is not None else index.value.verdict(toks)
                for column, v in zip(out, (said[0] or DEFAULT, *said[1:]), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"],
            )

    return x.select("page_id", "host", "path", "rule", "tokens").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined_rule string, confidence double")


def op4(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


QUERIES = {"op4_url_rules": op4}
ORACLE: dict[str, str] = {}
