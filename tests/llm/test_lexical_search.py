import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tracewright.llm import lexical_search
from tracewright.llm.common import materialize
from tracewright.llm.lexical_search import PATTERN, add, build_index, search, slices_of, top

UPPER = {c: c + 32 for c in range(65, 91)}


def slow_search(docs, items, k):
    """Every item against every document."""
    read = lambda text: Counter(re.findall(PATTERN, (text or "").translate(UPPER)))
    every = [(i, read(t)) for i, t in docs]
    n, size = sum(bool(c) for _, c in every), sum(c.total() for _, c in every)
    having = Counter(t for _, c in every for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts in every:
            m = 75 + 25 * counts.total() * n // size if size else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * having[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t, times in read(text).items() if t in counts)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def as_items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, "The river, the RIVER stone"), (2, None), (3, ""), (4, "unheard"), (5, "日本語 àé ÀÉ x"), (6, "one"), (7, "stone market " * 40), (None, "one river"), (7, "green")]


def test_ranks_match_every_item_against_every_document(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, prose(i % 23, 3 + i % 17)) for i in range(160)]
    rows += [(1000 + i, "common") for i in range(60)]  # a hot term, and ties
    items = [*ITEMS, (8, "common"), (9, "Common common river")]
    for k in (1, 5, 20):
        found = search(make_docs(rows).repartition(3), as_items(spark, items), k).collect()
        assert Counter(map(tuple, found)) == slow_search(rows, items, k)
    assert search(make_docs(rows).limit(0), as_items(spark, items)).count() == 0
    assert search(make_docs(rows), as_items(spark, items).limit(0)).count() == 0


def test_many_items_and_blocks_go_in_batches(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "BATCH_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "BROADCAST_BYTES", 0)
    rows = odd_rows + [(100 + i, prose(i % 23, 3 + i % 17)) for i in range(60)]
    found = search(make_docs(rows).repartition(3), as_items(spark, ITEMS), 4)
    assert Counter(map(tuple, found.collect())) == slow_search(rows, ITEMS, 4)


def test_index_holds_every_row_and_term(spark, make_docs, odd_rows):
    index = materialize(build_index(make_docs(odd_rows)), "index")
    assert sum(len(r.ids) for r in index.where("term = X''").collect()) == len(odd_rows)
    want = Counter(t for _, text in odd_rows for t in set(re.findall(PATTERN, (text or "").translate(UPPER))))
    held = Counter()
    for r in index.where("term != X''").collect():
        held[bytes(r.term).decode()] += r.n
    assert held == want


@pytest.mark.parametrize("words, k", [(1, 1), (3, 5), (3, 500), (2, 7)])
def test_bitmaps_add_and_select_like_numbers(words, k):
    draw = np.random.default_rng(k)
    want = np.zeros((4, words * 64), np.int64)
    total = np.zeros((40, 4 * words), np.uint64)
    for width in (1, 35, 20, 3):
        values = draw.integers(0, 1 << width, want.shape) * draw.integers(0, 2, want.shape)
        n, bits = slices_of(values.ravel())
        add(total, np.arange(4 * words), np.frombuffer(bits, np.uint64).reshape(n, -1))
        want += values
    want[1] = want[1] & 3  # many ties
    n, bits = slices_of(want.ravel())
    again = np.frombuffer(bits, np.uint64).reshape(n, 4, words)
    assert (total.reshape(40, 4, words)[:, [0, 2, 3]] == np.concatenate([again, np.zeros((40 - n, 4, words), np.uint64)])[:, [0, 2, 3]]).all()
    chosen = np.unpackbits(top(again, k).view(np.uint8), axis=1, bitorder="little")
    for q in range(4):
        best = sorted(range(words * 64), key=lambda i: (-want[q, i], i))[:k]
        assert np.flatnonzero(chosen[q]).tolist() == sorted(i for i in best if want[q, i] > 0)


def test_terms_are_those_of_the_pattern():
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice("aZ09 _-\n\t\x00\x7f\x85\xa0é日 .") for _ in range(40))
        assert lexical_search.count_terms(text.encode()) == Counter(x.encode() for x in re.findall(PATTERN, text.translate(UPPER)))
