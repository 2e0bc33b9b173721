"""URL rules beyond the thousandth."""

from __future__ import annotations

import random
import time
from itertools import product

from pyspark.sql import functions as F

from glintframe.llm import url_rules


def test_no_rule_is_capped(spark):
    names = ["".join(x) for x in product("abcdef", "uvwxyz")][:30]
    urls = [(f"http://{x}.com/a{x}/b{x}/c{x}/d{x}/e{x}", "allow") for x in names for _ in range(10)]
    urls += [("http://late.net/z", "block")] * 35 + [("http://late.net/z", "allow")] * 15
    labelled = spark.createDataFrame(urls, "url string, label string")
    mined = url_rules.mine(labelled.select(url_rules.tokens_of(F.col("url")).alias("tokens"), "label"))
    # each name's tokens are one group; that of late.net has both labels, of which one is frequent enough
    assert {t for t in mined.groups if t.startswith("p:c")} == {f"p:c{x}" for x in names}
    assert all(url_rules.judge([f"p:{y}{x}"], mined) == "allow" for x in names for y in "abcde")
    pages = spark.createDataFrame([(0, "http://late.net/q"), (1, "http://au.com/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.filtered(pages, [], labelled).collect()} == {0: "block", 1: "allow"}
    assert url_rules.filtered(pages.limit(0), [], labelled).collect() == []


def test_decisive_rules_give_the_same_verdicts():
    rng = random.Random(3)
    rules = list({(tuple(sorted(rng.sample(range(7), rng.randint(1, 3)))), rng.choice(["allow", "block"])) for _ in range(60)})
    few = url_rules.decisive(rules)
    assert 0 < len(few) < len(rules)
    groups = {f"t{g}": [g] for g in range(7)}
    by = lambda rules: url_rules.Mined(groups, rules, list(range(len(rules))), url_rules.inverted(rules))
    for _ in range(300):
        have = [f"t{g}" for g in rng.sample(range(7), rng.randint(0, 6))]
        assert url_rules.judge(have, by(rules)) == url_rules.judge(have, by(few))


def deep(parts, seed):
    return "http://long.org/" + "/".join(f"{seed}{k // 26 // 26}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}x".translate({48 + d: chr(103 + d) for d in range(10)}) for k in range(parts))


def test_long_urls_that_repeat(spark):
    """Equal URLs of 300 parts, of one label and of two, and 40 that are each a part longer than the one before: seconds and few rules."""
    plain = [(f"http://site.org/{'good' if k % 2 else 'bad'}/p", "allow" if k % 2 else "block") for k in range(40)]
    chain = [(deep(k, "c"), "block" if k % 3 else "allow") for k in range(1, 41) for _ in range(2)]
    for more in ([(deep(300, "a"), "block")] * 2, [(deep(300, "a"), "block")] * 2 + [(deep(300, "a"), "allow")] * 2, chain):
        labelled = spark.createDataFrame([*plain, *more], "url string, label string")
        began = time.monotonic()
        mined = url_rules.mine(labelled.select(url_rules.tokens_of(F.col("url")).alias("tokens"), "label"))
        assert time.monotonic() - began < 40 and len(mined.rules) < 1000
        assert url_rules.judge(["p:bad"], mined) == "block" and url_rules.judge(["p:good"], mined) == "allow"
    assert url_rules.judge(url_tokens(spark, deep(299, "a")), url_rules.mine(spark.createDataFrame([*plain, (deep(300, "a"), "block"), (deep(300, "a"), "block")], "url string, label string").select(url_rules.tokens_of(F.col("url")).alias("tokens"), "label"))) == "block"


def url_tokens(spark, url):
    return spark.range(1).select(url_rules.tokens_of(F.lit(url)).alias("t")).first()["t"]
