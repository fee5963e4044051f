import random
import re

import numpy as np
import pytest

from crosstally.llm import url_filter
from crosstally.llm.url_filter import Rule

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


URLS = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/12",
        "http://notexample.org/es/", "x://com/fr/", "x://a.com/de/?/fr/", "x://.com/de/", "x://a..org/", "x://org:80/", "x://org?u://b",
        "x://É.org/É", "x://a.com/d", "x://a.com/de/\nb", "x://" + "a." * 3000 + "com/de/" + "z" * 9000, "a://b://com/de/"]


def test_against_brute_force(spark):
    rows = [(i, u, "h", True) for i, u in enumerate(URLS)] + [(None, URLS[6], "h", None), (4, URLS[4], None, False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, k0 boolean")
    for rules in (RULES, RULES + [Rule("block", "org", "/"), Rule("block", "com", "")], []):
        got = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=repr)
        assert got == sorted([(i, *brute(u, rules)) for i, u, *_ in rows], key=repr)


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


@pytest.mark.parametrize("most_bytes", [64 << 20, 64])
def test_cascade_is_exact_over_its_universe(spark, most_bytes):
    rng = random.Random(5)
    keys = [f"k{i}" for i in range(3000)]
    listed = set(rng.sample(keys, 120)) | {"outside"}
    rows = [(k, rng.choice(keys + [None])) for k in keys]
    df = spark.createDataFrame(rows, "a string, b string")
    names = spark.createDataFrame([(k,) for k in listed] + [(None,)], "key string")
    got = url_filter.with_membership(df, ["a", "b"], {"x": names}, most_bytes).collect()
    assert all(r.a_x == (r.a in listed) and r.b_x == (r.b in listed) for r in got)
    assert len(got) == 3000


def test_levels_shrink_and_alternate(spark):
    h = np.random.default_rng(0).integers(-2**62, 2**62, (2, 5000))
    both = spark.createDataFrame([(int(a), int(b), n < 300) for n, (a, b) in enumerate(h.T)], "h1 long, h2 long, l boolean")
    levels = url_filter.cascade(both.filter("l"), both.filter("not l"))
    assert len(levels) > 2 and sum(x.bits for x in levels) < 300 * 14
    assert url_filter.member(h[0], h[1], levels).tolist() == [n < 300 for n in range(5000)]
