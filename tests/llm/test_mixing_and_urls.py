import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tracewright.llm import mixing, url_filter
from tracewright.operators import ordering


DEFAULTS = (mixing.WEIGHTS, mixing.SHARE, mixing.MOST_REPEATS)


def slow_targets(sizes):
    """Share by weight; whoever is above twice its size stops there, and its excess is shared anew."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(ordered)}
    left, open_, done = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > 2 * open_[s]]
        if not above:
            return done | {s: level * weight[s] for s in open_}
        for s in above:
            done[s] = 2.0 * open_[s]
            left -= 2 * open_.pop(s)
    return done


def test_targets_match_sharing_in_rounds(spark):
    draw = random.Random(3)
    cases = [[draw.choice([0, 1, draw.randint(0, 1000)]) for _ in range(draw.randint(1, 12))] for _ in range(12)] + [[0, 0], [5]]
    for sizes in cases:
        named = [(f"s{i:02d}", n) for i, n in enumerate(sizes)]
        named[-1] = (None, named[-1][1])
        want = slow_targets(named)
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(named, "source string, size long"), *DEFAULTS).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_more_sources_than_may_be_broadcast(spark, monkeypatch):
    rows = spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 110_000).alias("source"), F.lit("one two three").alias("text"))
    found = mixing.mix(rows)
    kept = found.agg(F.count("*"), F.sum("size"), F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size"))).first()
    assert kept[0] == 120_000 and kept[3] <= 0
    assert abs(kept[2] - 1.5 * kept[1]) < 0.25 * kept[1]  # a source is one or two rows, taken whole or not
    few = rows.where("doc_id % 1000 = 0")
    want = sorted(mixing.mix(few).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(ordering, "FEW", 3)
    assert sorted(mixing.mix(few).collect()) == want


@pytest.fixture(scope="module")
def mixed(odd_rows):
    draw = random.Random(1)
    return [(*r[:2], "en", None if r[0] == 4 else "odd") for r in odd_rows] + [(1000 + i, prose(i, draw.randint(1, 60)), "en", draw.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]


def test_each_source_comes_near_its_target(make_docs, mixed):
    rows = [r for r in mixed if r[3] != "odd"]
    found = mixing.mix(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    source = {r[0]: r[3] for r in rows}
    for s in ("a", "b", "c", None):
        of = [r for r in found if source[r.doc_id] == s]
        assert sum(r.size for r in of) == of[0].source_size
        assert abs(sum(r.taken for r in of) - of[0].target) <= 60
    again = mixing.mix(make_docs(rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_thresholds_are_those_of_a_sorted_prefix(make_docs, mixed):
    """The refined histogram takes what a sort by hash and a running sum would."""
    import hashlib

    docs = make_docs(mixed)
    found = mixing.mix(docs).collect()
    source = {r[0]: r[3] for r in mixed}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    keys = defaultdict(set)
    for doc_id, text, *_ in mixed:
        keys[doc_id].add(int(md5(f"{'' if doc_id is None else doc_id}:{md5(text or '')}")[:15], 16))
    found = [r for r in found if len(keys[r.doc_id]) == 1]
    h = lambda i: next(iter(keys[i]))
    for s in {*source.values()} - {"odd"}:
        of = [r for r in found if source[r.doc_id] == s]
        total, target = of[0].source_size, of[0].target
        copies = int(min(2, target // total)) if total else 0
        budget, upto = target - copies * total, 0
        for key in sorted({h(r.doc_id) for r in of}):
            own = sum(r.size for r in of if h(r.doc_id) == key)
            extra = upto + own <= budget or (upto <= budget and upto + own - budget < budget - upto)
            upto = upto + own if extra or upto + own > budget else upto
            assert all(r.taken == r.size * (copies + extra) for r in of if h(r.doc_id) == key)


def test_rows_are_repeated_as_the_mix_says(make_docs, mixed):
    docs = make_docs([r for r in mixed if r[3] != "odd"])
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken // r.size
    left = mixing.take_mix(docs)
    assert left.columns == docs.columns
    clashing = docs.withColumns({c: F.lit(c) for c in ("_h", "_source", "_cut", "_copy", "h", "row", "size", "s", "t", "cut", "copies")})
    again = mixing.take_mix(clashing)
    assert again.columns == clashing.columns
    assert Counter(map(tuple, again.select(*docs.columns).collect())) == Counter(map(tuple, left.collect()))
    assert {r["_h"] for r in again.collect()} == {"_h"}
    counted = {r.doc_id: r["count"] for r in left.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in taken.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0


RULES = [*url_filter.QUERY_RULES, ("a.b.org/", "block"), ("a.b.org/x/y", "allow"), ("twice.com/", "allow"), ("twice.com/", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1", "https://www.example.org/es", "https://example.org/en/148.html?q#f", "https://example.org/en/2", "http://x.a.b.org/x/yz", "http://a.b.org/x/z", "http://b.org",
    "http://b.org/", "http://shop.com/fr/1", "http://shop.com/de/1", "http://shop.com/it/", "http://twice.com/x", "ftp://h:80/p://q", "x://org/#://", "http://notexample.org/es/a", "http://a..org/es/", "http://org/?x", "http://b.org/\nline",
]


def slow_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(((h.count("."), len(p), verdict == "block"), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return (host, path, best[1], best[2])


def test_trie_and_join_match_a_scan_of_the_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    want = sorted((i, *slow_verdict(u, RULES)) for i, u in enumerate(URLS))
    key = lambda rows: sorted(map(tuple, rows), key=lambda r: r[0])
    assert key(url_filter.filter_urls(pages, RULES).collect()) == want
    table = spark.createDataFrame(RULES, "rule string, verdict string")
    assert key(url_filter.filter_by_join(pages, table).collect()) == want
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_more_rules_than_a_trie_may_hold_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    want = sorted(url_filter.filter_urls(pages, RULES).collect())
    monkeypatch.setattr(url_filter, "MAX_RULES", 1)
    assert sorted(url_filter.filter_urls(pages, RULES).collect()) == want


def test_many_rules_of_one_directory_cost_one_look_each():
    import time

    root = url_filter.build_trie([(f"a.com/x/{i:06d}", "block") for i in range(100_000)])
    began = time.perf_counter()
    assert all(url_filter.match(root, "w.a.com", f"/x/{i:06d}q/y") == (f"a.com/x/{i:06d}", "block") for i in range(0, 100_000, 20))
    assert time.perf_counter() - began < 2
