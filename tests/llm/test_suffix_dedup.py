import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tracewright.llm import suffix_dedup
from tracewright.llm.suffix_dedup import Anchors, factors, find_repeats, gram_of, merged, sliding


def slow_repeats(rows, least, keep):
    """Every run of ``least`` bytes of every text by its bytes."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = [(rows[i][0], (rows[i][1] or "").encode()) for i in order]
    places = defaultdict(list)
    for d, (_, t) in enumerate(texts):
        for i in range(len(t) - least + 1):
            places[t[i : i + least]].append((d, i))
    gone = [bytearray(len(t)) for _, t in texts]
    for own in places.values():
        for d, i in own[1:] if keep == "first" else own if len(own) > 1 else []:
            gone[d][i : i + least] = b"\1" * least
    out = []
    for (doc, t), g in zip(texts, gone, strict=True):
        edges = np.flatnonzero(np.diff(np.frombuffer(bytes(g), np.uint8).astype(int), prepend=0, append=0)).tolist()
        out.append((doc, len(t), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, x in zip(t, g, strict=True) if not x)))
    return Counter(out)


def rows_of(found):
    return Counter((r.doc_id, r.n_bytes, tuple((x.begin, x.end) for x in r.removed), bytes(r.kept)) for r in found.collect())


def mixed_rows(seed, n, least):
    draw = random.Random(seed)
    passages = [prose(seed + i, least // 3) for i in range(3)]
    rows = []
    for i in range(n):
        text = prose(1000 * seed + i, draw.randint(1, least // 3))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            a = draw.randint(0, len(p) // 2)
            text += p[a : draw.randint(a, len(p))] + prose(draw.randint(0, 10**6), draw.randint(0, 9))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("least, group, lot", [(400, 1 << 14, 1 << 19), (40, 1 << 14, 1), (40, 3, 1 << 19), (9, 2, 100), (2, 1 << 14, 1 << 19)])
def test_runs_match_every_run_by_its_bytes(make_docs, odd_rows, monkeypatch, least, group, lot, keep):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    rows = [r if len(r[1] or "") < 2000 else (r[0], r[1][:2000]) for r in odd_rows] + [(i + 20, t) for i, t in mixed_rows(least, 25 if least > 1 else 4, max(least, 12))]
    rows += [(900 + i, "é" * 300 + str(i)) for i in range(3)] + [(910, "ab" * 500), (911, "abc" * 400), (None, rows[-1][1]), (912, "x" * least), (913, "x" * (least + 1))]
    found = find_repeats(make_docs(rows).repartition(3), least=least, keep=keep)
    assert rows_of(found) == slow_repeats(rows, least, keep)


def test_a_passage_that_most_texts_share_is_parted(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 20)
    passage = prose(5, 150)
    rows = [(i, prose(i + 10, i % 60) + passage + prose(-i, i % 50)) for i in range(90)] + [(100 + i, prose(i, 200)) for i in range(20)]
    for keep in ("first", "none"):
        found = find_repeats(make_docs(rows).repartition(4), keep=keep)
        assert rows_of(found) == slow_repeats(rows, 400, keep)


def test_no_rows_and_wrong_choice(make_docs):
    assert find_repeats(make_docs([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError, match="keep"):
        find_repeats(make_docs([(1, "x")]), keep="last")


@pytest.mark.parametrize("size, least", [(2, 5), (2, 40), (3, 11), (60, 8), (4, 3)])
def test_factors_match_every_pair_of_suffixes(size, least):
    draw = np.random.default_rng(size * least)
    text = draw.integers(0, size, 160)
    at = np.sort(draw.choice(len(text) - least, 90, replace=False))
    place = draw.integers(0, 70, 90)  # some share a place

    def match(i, j):
        n = 0
        while n < least and text[at[i] + n] == text[at[j] + n]:
            n += 1
        return n if n >= least else 0

    for later in (False, True):
        want = [max((match(i, j) for j in range(90) if place[j] < place[i] or later and place[j] > place[i]), default=0) for i in range(90)]
        assert factors(text, at, place, least, later).tolist() == want


def test_common_prefixes():
    _, common = suffix_dedup.suffix_order(np.frombuffer(b"abracadabra", np.uint8).astype(np.int64), 6)
    assert common(np.array([0, 1, 3, 0, 4]), np.array([7, 8, 5, 0, 9])).tolist() == [4, 3, 1, 6, 0]


def test_equal_runs_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    draw = random.Random(2)
    least = 50
    shared = bytes(draw.choice(b"ab c") for _ in range(200))
    texts = [bytes(draw.choice(b"ab c") for _ in range(n)) + shared + bytes(draw.choice(b"ab c") for _ in range(n)) for n in (0, 20, 777)]
    anchors = Anchors(least)
    found = []
    for n, text in zip((0, 20, 777), texts, strict=True):
        at, gram = anchors.of(text)
        assert all((at[(at >= i) & (at <= i + least - gram_of(least))]).size for i in range(len(text) - least + 1))
        found.append({(int(a) - n, int(g)) for a, g in zip(at, gram, strict=True) if n <= a <= n + 200 - gram_of(least)})
    inside = [{x for x in f if least <= x[0] <= 200 - least} for f in found]
    assert inside[0] == inside[1] == inside[2] and 0 < len(inside[0]) < 40
    assert Anchors(least).of(b"x" * 49)[0].tolist() == []


def test_windows_and_runs():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 99, 57).astype(np.uint64)
    for width in (1, 5, 57):
        assert sliding(values, width, np.minimum).tolist() == [min(values[i : i + width]) for i in range(58 - width)]
    a, b = merged(np.array([9, 0, 3, 20]), np.array([12, 4, 9, 30]))
    assert (a.tolist(), b.tolist()) == ([0, 20], [12, 30])


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_texts_that_keep_all_bytes_are_not_moved(spark, monkeypatch, words):
    monkeypatch.setattr(suffix_dedup, "WORDS", words)
    texts = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(-7).cast("long").alias("file"), F.col("id").alias("row"), F.lit("x").alias("text"))
    rows = texts.where("row % 50 = 3").select("file", "row")
    found = suffix_dedup.marked(texts, rows)
    assert found.columns == [*texts.columns, "may"] and found.count() == 5000
    assert found.where("row % 50 = 3 and not may").count() == 0
    assert words == 1 or found.where("may").count() < 1200
