import random

import numpy as np
import pytest

from logweave.llm import digest_array, url_filter
from logweave.llm.digest_array import Shard

PAGES = "page_id long, url string, host string, rule int, verdict string"
RULES = "host string, path string, verdict string, url int"
ODD = [None, "", "no scheme", "http://", "://", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/x?/net/",
       "http://example.com/en/1#top", "http://notexample.com/en/1", "https://www.example.com/en/", "http://a.www.example.com/en/z",
       "http://x.net/es/", "http://x.net/es", "http://net/fr/y", "http://É.net/fr/é", "http://x.com:80/", "http://u@x.com/",
       "http://x.com./", "http://.com/", "http://x.net?/es/", "a://b://c.net/es/", "http://x.net/fr/\n://y", "http://" + "a." * 3000 + "com/" + "p/" * 3000]


def plain(url, rules, default="allow"):
    """The contract read word by word."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def judged(spark, urls, rules, **limits):
    pages = spark.createDataFrame([(i, u, "h", 1, "v") for i, u in enumerate(urls)], PAGES).repartition(3)
    table = spark.createDataFrame([(*r, 1) for r in rules], RULES)
    return [tuple(r)[1:] for r in sorted(url_filter.judge(pages, table, **limits).collect(), key=lambda r: r.page_id)]


def test_contract_rules_on_odd_urls(spark):
    rules = url_filter.CONTRACT_RULES
    assert judged(spark, ODD, rules) == [plain(u, rules) for u in ODD]


@pytest.mark.parametrize("shard", [3, 1 << 20])
def test_random_rules_against_every_rule(spark, shard):
    rng = random.Random(5)
    labels, steps = ["a", "b", "com", "é", ""], ["/", "/x", "/xy/", "é", "/x/y", "?"]
    rules = list({(".".join(rng.choices(labels, k=rng.randrange(1, 4))), "".join(rng.choices(["/", "/x", "/xy/", "é"], k=rng.randrange(3))))
                  for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block", "ask"])) for h, p in rules] + [("a", "", "allow"), ("a", "", "block")]
    sound = [r for r in rules if r[1] == "" or r[1].startswith("/")]
    urls = ["s://" + ".".join(rng.choices(labels, k=rng.randrange(1, 5))) + "".join(rng.choices(steps, k=rng.randrange(4))) for _ in range(400)]
    once = {}
    for h, p, v in sound:
        held = once.get((h, p), "")
        once[h, p] = "block" if "block" in (held, v) else max(held, v)
    want = [plain(u, [(*k, v) for k, v in once.items()], "ask") for u in urls]
    assert judged(spark, urls, rules, default="ask", shard_entries=shard) == want
    assert len({w[2] for w in want}) > 10


def test_equal_digests_are_told_apart_by_their_strings():
    raw = np.frombuffer(digest_array.pack([-4, 7, 7, 7, 9], [b"x", b"a", b"bb", b"", b"z"], [b"0", b"1", b"2", b"", b"4"]), np.uint8)
    found = Shard(raw).find(np.array([7, 7, 7, 7, -4, 8, 9]), [b"bb", b"a", b"", b"c", b"x", b"z", b"zz"])
    assert found == [b"2", b"1", b"", None, b"0", None, None]


def test_digests_are_those_of_spark(spark):
    words = ["", "a", "日本", "x" * 500]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) AS d").collect()
    assert digest_array.digests_of([w.encode() for w in words]).tolist() == [r.d for r in got]


def test_bad_rules_no_rules_empty_table_and_limit(spark):
    urls = ["http://a.com/x", None]
    bad = [(None, "/", "block"), ("a.com", "x", "block"), ("a.com", "/", None)]
    assert judged(spark, urls, bad) == judged(spark, urls, []) == [("a.com", "/x", None, "allow"), ("", "", None, "allow")]
    assert judged(spark, urls, [("A.com", None, "block")])[0] == ("a.com", "/x", "a.com", "block")
    assert judged(spark, [], url_filter.CONTRACT_RULES) == []
    with pytest.raises(ValueError, match="max_bytes"):
        judged(spark, urls, url_filter.CONTRACT_RULES, max_bytes=10)


def test_repeated_rows_and_null_ids_stay(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/", "", 0, ""), (1, "http://x.net/es/", "", 0, ""), (None, "http://x.net/", "", 0, "")], PAGES)
    rows = sorted(map(tuple, url_filter.judge(pages, url_filter.contract_rules(pages)).collect()), key=str)
    assert rows == [(1, "x.net", "/es/", "net/es/", "block")] * 2 + [(None, "x.net", "/", None, "allow")]
