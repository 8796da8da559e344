"""Rules and verdicts against a mining of all subsets, and urls that repeat or are very long."""

import itertools
import re

from pyspark.sql import functions as F

from brineloom.llm import urls

SF = "/root/testdata/sf0.01"


def test_hosts_paths_and_rules(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q"), (2, "https://x.net"), (3, "https://net/"), (4, "http://b.example.com/de/1#t"), (5, "ftp://c.org/fr/"), (6, None), (7, "no scheme"), (8, "http://notnet/"), (9, "http://x.net/?a"), (10, "a://b.net/p://q")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()} == {
        1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("x.net", "", None), 3: ("net", "/", "net/"), 4: ("b.example.com", "/de/1", "example.com/de/"), 5: ("c.org", "/fr/", "org/fr/"),
        6: ("", "", None), 7: ("", "", None), 8: ("notnet", "/", None), 9: ("x.net", "/", "net/"), 10: ("b.net", "/p://q", "net/"),
    }
    assert got[1]["verdict"] == "allow" and got[3]["verdict"] == "block" and got[6]["verdict"] == urls.DEFAULT


def all_rules(rows, support, confidence):
    """Every rule of rows (tokens, label), by counting every subset of every row; pruned."""
    counts, labelled = {}, {}
    for toks, label in rows:
        for k in range(1, len(toks) + 1):
            for items in itertools.combinations(sorted(toks), k):
                counts[items] = counts.get(items, 0) + 1
                labelled[items, label] = labelled.get((items, label), 0) + 1
    least = -(-support * len(rows) // 1)
    return urls.prune([(i, lab, n / counts[i], n / len(rows)) for (i, lab), n in labelled.items() if n >= least and n / counts[i] >= confidence])


def verdict(rules, toks):
    fits = [(-sure, -len(items), items, label) for items, label, sure, _ in rules if set(items) <= set(toks)]
    return min(fits)[3] if fits else None


def test_mined_rules_equal_brute_force(spark, rng):
    rows = []
    for _ in range(200):
        toks = sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 3)))
        rows.append((toks, "block" if "a" in toks and rng.random() < 0.95 or rng.random() < 0.1 else "allow"))
    got, of = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.8)
    want = all_rules(rows, 0.05, 0.8)
    assert got == want and of == {x: x for x in "abcde"}
    index = urls.Index(got, of)
    for toks, _ in rows:
        assert index.verdict(toks)[0] == verdict(want, toks)


def test_reductions_lose_no_rule(spark, rng):
    """Tokens that occur together, tokens of one label, and urls that hold only some of a pair."""
    rows = []
    for _ in range(150):
        toks = set(rng.sample(["a", "b", "c", "d"], rng.randint(1, 3)))
        toks |= {"a2", "a3"} if "a" in toks else set()
        label = "block" if ("a" in toks and "b" in toks) or rng.random() < 0.1 else "allow"
        toks |= {"only", "too"} if label == "block" and rng.random() < 0.5 else set()
        rows.append((sorted(toks), label))
    got, of = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.75)
    want = all_rules(rows, 0.05, 0.75)
    assert of["a3"] == of["a2"] == of["a"] == "a" and of["too"] == "only"
    index = urls.Index(got, of)
    for k in range(1, 5):
        for toks in itertools.combinations(["a", "a2", "a3", "b", "c", "d", "only", "too"], k):
            assert index.verdict(toks)[0] == verdict(want, toks), toks


def test_the_query_equals_a_plain_reading_of_its_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    toks = {r["page_id"]: r["tokens"] for r in urls.prepare(pages).collect()}
    plain, rows = {}, []
    for r in pages.collect():
        rest = (r["url"] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [rule for rule, _ in urls.RULES if ("." + host).endswith("." + rule.split("/", 1)[0]) and path.startswith("/" + rule.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        plain[r["page_id"]] = (host, path, rule)
        if rule:
            rows.append((toks[r["page_id"]], dict(urls.RULES)[rule]))
    rules = all_rules(rows, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE)
    got = urls.op4(spark, SF).collect()
    assert len(got) == len(plain) and {r["rule"] for r in got} > {None}
    for r in got:
        host, path, rule = plain[r["page_id"]]
        want = dict(urls.RULES)[rule] if rule else verdict(rules, toks[r["page_id"]]) or urls.DEFAULT
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, want)


def test_long_urls_that_repeat(spark):
    path = "/".join(f"part{c}x" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN")
    rows = [f"http://a.net/{path}"] * 50 + [f"http://b.example.net/en/{path}"] * 50 + [f"http://other.info/{path}", "http://a.info/"]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {r["verdict"] for r in got if r["page_id"] < 50} == {"block"} and {r["verdict"] for r in got if 50 <= r["page_id"] < 100} == {"allow"}


def test_more_items_than_are_mined_raise_the_support(spark, rng, monkeypatch):
    monkeypatch.setattr(urls, "MAX_ITEMS", 4)
    rows = [([x for x in "abcdefgh" if rng.random() < 0.3 + 0.05 * i], rng.choice(["allow", "block"])) for i in range(8) for _ in range(12)]
    rows = [(t or ["a"], lab) for t, lab in rows]
    got, of = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.6)
    assert set(of) == set("abcdefgh") and all(len(items) <= 4 for items, *_ in got)


def test_urls_of_many_items_give_the_rules_of_all_subsets(spark, rng, monkeypatch):
    """The support that is asked for holds, however many items a url has."""
    rows = [([x for x in "abcdefgh" if rng.random() < 0.3 + 0.05 * i], rng.choice(["allow", "block"])) for i in range(8) for _ in range(12)]
    rows = [(t or ["a"], "block" if {"b", "c"} <= set(t) else lab) for t, lab in rows] * 2
    want = all_rules(rows, 0.02, 0.6)
    monkeypatch.setattr(urls, "MAX_ITEMS", 4)
    got, _ = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.6, exact=True)
    assert sorted(got) == sorted(want)
    # Sixteen items a url at the default settings, half of them common.
    rows = []
    for _ in range(400):
        own = {f"t{rng.randrange(60)}" for _ in range(9)} | {f"c{rng.randrange(12)}" for _ in range(9)}
        rows.append((sorted(own), "block" if {"c1", "c2"} <= own or rng.random() < 0.1 else "allow"))
    monkeypatch.undo()
    assert max(len(t) for t, _ in rows) > urls.MAX_ITEMS
    got, _ = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.04, 0.8, exact=True)
    sets = [(set(t), lab) for t, lab in rows]
    some = {x for t, _ in rows for x in t}
    for k in (1, 2, 3):
        for items in itertools.combinations(sorted(some), k):
            held = [lab for t, lab in sets if t.issuperset(items)]
            for lab in ("allow", "block"):
                if held.count(lab) >= 16 and held.count(lab) / len(held) >= 0.8:
                    assert any(set(i) <= set(items) and r == lab and s >= held.count(lab) / len(held) for i, r, s, _ in got), items


def test_a_url_of_many_items_keeps_the_support_of_the_query(spark, rng):
    """A rule of 2 % of the labelled urls decides, though some url has more items than are listed."""
    words = [f"w{c}" for c in "abcdefghijklm"]
    paths = ["/".join(w for w in words if rng.random() < 0.8) for _ in range(294)]
    rows = [f"http://{'a.net/' if rng.random() < 0.5 else 'b.example.net/en/'}{p}" for p in paths]
    rows += ["http://a.net/rare/thing"] * 9 + ["http://b.example.net/en/rare/thing"] + ["http://q.info/rare/thing"]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert (got[len(rows) - 1]["rule"], got[len(rows) - 1]["verdict"], got[len(rows) - 1]["confidence"]) == (None, "block", 0.9)


def test_no_rows_and_repeated_rows(spark):
    x = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/"), (2, "http://q.info/a"), (3, None)], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("tokens", F.lit(1))
    assert sorted((r["page_id"], r["rule"]) for r in urls.judge(x).collect() if r["rule"]) == [(1, "net/")] * 2
    assert urls.judge(x.where("false")).count() == 0 and {r["verdict"] for r in urls.judge(x.where("page_id > 1")).collect()} == {urls.DEFAULT}
    assert urls.mine(x.where("false").selectExpr("array('') as tokens", "rule as label")) == ([], {})
