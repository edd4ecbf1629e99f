import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tracewright.llm import exact_dedup, simhash
from tracewright.llm.common import materialize
from tracewright.llm.exact_dedup import content, drop_duplicates, find_duplicates, located, sha256


def want_exact(rows):
    return Counter(want_exact_list(rows))


def want_exact_list(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_exact_groups_match_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, prose(i % 7, 20)) for i in range(60)]
    found = find_duplicates(make_docs(rows)).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    assert Counter(map(tuple, found)) == want_exact(rows)
    assert find_duplicates(make_docs(rows).limit(0)).count() == 0


def test_equal_digests_are_told_apart_by_their_bytes(make_docs):
    rows = [(i, prose(i % 7, 20 + i % 3)) for i in range(60)] + [(90, None), (91, "")]
    weak = find_duplicates(make_docs(rows), digest=lambda text: (F.octet_length(text) % 5).cast("string"))
    want = Counter(x[:4] for x in want_exact(rows).elements())
    assert Counter(map(tuple, weak.select("doc_id", "keep_id", "group_size", "kept").collect())) == want


def test_a_failed_batch_that_is_run_again_counts_once(make_docs, tmp_path, monkeypatch):
    rows = [(i, prose(i % 7, 20)) for i in range(30)]
    first, second = make_docs(rows[:15]), make_docs(rows[15:])
    state = f"file://{tmp_path}/state"
    find_duplicates(first, state=state, batch="1").collect()
    stream = exact_dedup.run_stream

    def fails_before(*_):
        raise OSError("lost")

    def fails_after(*arguments):
        stream(*arguments)
        raise OSError("lost")

    for failing in (fails_before, fails_after):
        monkeypatch.setattr(exact_dedup, "run_stream", failing)
        with pytest.raises(OSError, match="lost"):
            find_duplicates(second, state=state, batch="2")
    monkeypatch.setattr(exact_dedup, "run_stream", stream)
    found = find_duplicates(second, state=state, batch="2").select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, found)) == Counter(x[:4] for x in want_exact_list(rows)[15:])


def test_later_batches_meet_the_digests_of_earlier_ones(spark, make_docs, tmp_path):
    """Two calls with one state folder tell what one call over both batches tells of the second."""
    draw = np.random.default_rng(9)
    rows = [(i, prose(int(draw.integers(12)), 20)) for i in draw.permutation(60).tolist()] + [(None, prose(3, 20)), (99, None), (98, "")]
    sides = rows[:30], rows[30:]
    places = [f"file://{tmp_path}/with space+%41/{i}" for i in range(2)]
    for side, place in zip(sides, places, strict=True):
        make_docs(side).repartition(2).write.parquet(place)
    weak = lambda text: (F.octet_length(text) % 3).cast("string")
    for digest, name in ((sha256, "strong"), (weak, "weak")):
        for in_place in (True, False):
            state = f"file://{tmp_path}/state-{name}-{in_place}"
            columns = ["doc_id", "keep_id", "group_size", "kept"]
            first, second = (find_duplicates(spark.read.parquet(p), digest=digest, in_place=in_place, state=state).select(columns).collect() for p in places)
            assert Counter(map(tuple, first)) == Counter(x[:4] for x in want_exact(sides[0]).elements())
            want = Counter((i, *x[1:4]) for (i, _), x in zip(rows, want_exact_list(rows), strict=True) if (i, _) in sides[1])
            assert Counter(map(tuple, second)) == want


def test_locators_point_at_the_text(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).repartition(3).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    texts, stored_as = located(docs, "doc_id", "text", True, "unused")
    folder = f"file://{tmp_path}/state"
    texts.select(F.xxhash64("path").alias("file"), "path", F.lit(stored_as).alias("text_column")).distinct().write.parquet(f"{folder}/files")
    rows = materialize(texts.select(F.xxhash64("path").alias("file"), "row", "text"), "rows")
    found = content(rows, folder).collect()
    assert len(found) == len(odd_rows) and all(r.text == r.stored for r in found)


def test_one_row_of_each_text_stays(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, prose(i % 7, 20)) for i in range(60)]
    docs = make_docs(rows)
    left = drop_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter({(t or ""): 1 for _, t in rows})


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints, radius):
    """Smallest id by fingerprint, all pairs compared."""
    keys = sorted({p for _, p in prints})
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return {p: least.get(find(p)) for p in keys}


def test_fingerprints_match_the_plain_form(odd_rows):
    for _, text in odd_rows + [(0, "A B c"), (0, "a b C d"), (0, "É É É É É")]:
        if text is None or len(text) < 20_000:
            assert simhash.fingerprint(text or "") == slow_print(text)
    assert simhash.fingerprint(prose(1, 100_000)) == slow_print(prose(1, 100_000))


def test_components_match_all_pairs(make_docs, odd_rows):
    base = prose(42, 400).split()
    near = [(200 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(120)]
    rows = odd_rows + near + [(500 + i, prose(i, 60)) for i in range(60)]
    found = simhash.near_duplicates(make_docs(rows)).select("doc_id", simhash.hex_of(F.col("fp")).alias("f"), "component_id").collect()
    prints = [(i, simhash.fingerprint(t or "")) for i, t in rows]
    least = components(prints, 4)
    assert Counter(map(tuple, found)) == Counter((i, f"{p:016x}", least[p] if least[p] is not None or i is None else i) for i, p in prints)
    assert simhash.near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_tiles_and_chains_match_all_pairs(spark, monkeypatch):
    """Buckets larger than a tile, and a chain of links far longer than the radius."""
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = np.random.default_rng(3)
    chain = [(1 << (3 * i)) - 1 for i in range(20)]
    cloud = [int(x) for x in (np.uint64(0xF0F0F0F0F0F0F0F0) ^ (np.uint64(1) << draw.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 150).astype(np.uint64)))]
    far = [int(x) for x in draw.integers(0, 2**63, 100)]
    prints = [(i, p) for i, p in enumerate([*chain, *cloud, *far])]
    classes = spark.createDataFrame([(simhash.signed(p), 1) for p in {p for _, p in prints}], "fp long, n long")
    for count in (len(prints), 10**10):
        tree = {r.u: r.v for r in simhash.roots(simhash.links(simhash.tile_jobs(classes, 4, count), 4)).collect()}
        want = components(prints, 4)
        groups = defaultdict(set)
        for _, p in prints:
            groups[want[p]].add(tree.get(simhash.signed(p), simhash.signed(p)))
        assert all(len(g) == 1 for g in groups.values()) and len({*map(tuple, groups.values())}) == len(groups)


def test_one_document_of_each_component_stays(make_docs):
    base = prose(42, 400).split()
    docs = make_docs([(10 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(5)] + [(1, prose(9, 80))])
    left = simhash.drop_near_duplicates(docs)
    found = simhash.near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.component_id for r in found.collect()}


def test_null_and_repeated_ids_lose_only_their_near_rows(make_docs):
    base = prose(42, 400).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(8)]
    assert all((simhash.fingerprint(near[0]) ^ simhash.fingerprint(t)).bit_count() <= 4 for t in near)
    own = [prose(900 + i, 80) for i in range(12)]
    other = prose(77, 400).split()
    far = [" ".join(other[:i] + ["changed"] + other[i + 1 :]) for i in range(3)]
    assert len(set(components([(i, simhash.fingerprint(t)) for i, t in enumerate([near[0], far[0], *own])], 4).values())) == 14
    # One component with ids: 3 is smallest and stands twice; null and 7 have unique texts too.
    rows = [(3, near[0]), (3, near[0]), (3, near[1]), (None, near[2]), (7, near[3]), (8, near[4])]
    rows += [(None, own[0]), (None, own[1]), (7, own[2]), (9, own[3]), (3, own[4])]
    rows += [(None, t) for t in far]  # a component without any id
    left = simhash.drop_near_duplicates(make_docs(rows)).select("doc_id", "text").collect()
    alone = Counter(rows[6:11])
    rest = Counter(map(tuple, left)) - alone
    assert Counter(map(tuple, left)) & alone == alone
    assert rest.total() == 2
    assert {(i, t in near[:2], t in far) for i, t in rest} == {(3, True, False), (None, False, True)}
    again = simhash.drop_near_duplicates(make_docs(rows[::-1]).repartition(3)).select("doc_id", "text").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, left))


def test_columns_named_like_helpers_are_left_as_they_are(make_docs):
    base = prose(42, 400).split()
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(3)]
    rows = [(i, t) for i, t in enumerate([*texts, prose(5, 80)])]
    for docs in (make_docs(rows), make_docs(rows + rows[:1])):
        docs = docs.withColumns({"_id": F.lit("mine"), "_fp": F.lit("mine"), "_digest": F.lit("mine"), "__id": F.lit(1)})
        for drop, n in ((simhash.drop_near_duplicates, 2), (drop_duplicates, 4)):
            left = drop(docs)
            assert left.columns == docs.columns
            found = left.select("doc_id", "_id", "_fp", "_digest", "__id").collect()
            assert len(found) == n and {tuple(r)[1:] for r in found} == {("mine", "mine", "mine", 1)}
