"""The pipeline's stages, fed by one another, against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_dedup import components, slow_print
from tests.llm.test_mixing_and_urls import slow_targets
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import brute
from tracewright.llm import quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "_id _digest _fp _h _source _cut _copy _metrics _text score digest text_ path row file h size".split()


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ") if w]


def slow_good(text):
    n, chars, symbols, _, repeated = brute(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False
    stop = {w for each in quality_rules.STOP_WORDS.values() for w in each}
    lines = [x for x in text.split("\n") if words(x)]
    again = sum(map(len, lines)) - sum(map(len, set(lines)))
    dots = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    share = sum(w.lower() in stop for w in words(text)) / n
    return 2 <= chars / n <= 15 and symbols / n <= 0.15 and share >= 0.01 and again <= 0.3 * sum(map(len, lines)) and dots <= 0.5 * len(lines)


def rows_of_all_kinds():
    base = prose(42, 400).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(6)]
    rows = [(i, prose(i, 60 + i)) for i in range(40)] + [(100 + i, prose(i, 60 + i)) for i in range(10)]
    rows += [(200 + i, t) for i, t in enumerate(near)] + [(300, None), (301, ""), (302, "short"), (303, "### $$$ " * 80), (None, prose(700, 90)), (None, prose(701, 90)), (304, prose(702, 9000))]
    return [(i, t, "en", ("a", "a", "b", None)[n % 4], None) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows_of_all_kinds(), COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def stage_rows(spark, docs, folder):
    """Each stage's rows, each written and read again for the next."""
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return out


def test_each_stage_and_the_run_match_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good, single, apart, mixed, packed = stage_rows(spark, docs, tables)
    assert all(d.columns == docs.columns for d in (good, single, apart, mixed))
    rows = rows_of_all_kinds()
    want = [r for r in rows if slow_good(r[1])]
    assert Counter(map(tuple, good.collect())) == Counter(want)

    last = {}
    for r in want:
        if r[1] not in last or (last[r[1]][0] is None or (r[0] is not None and r[0] > last[r[1]][0])):
            last[r[1]] = r
    assert Counter(map(tuple, single.collect())) == Counter(last.values())

    prints = {r[1]: slow_print(r[1]) for r in last.values()}
    group = components([(i, prints[t]) for i, (t, _) in enumerate(last.items())], 4)
    of = defaultdict(list)
    for r in last.values():
        of[group[prints[r[1]]]].append(r)
    assert any(len(g) > 1 for g in of.values())
    stays = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in of.values()]
    assert Counter(map(tuple, apart.collect())) == Counter(stays)

    sizes = Counter()
    for r in stays:
        sizes[r[3]] += len(words(r[1]))
    targets = slow_targets([*sizes.items()])
    taken, most = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
        most[r.doc_id, r.text] += 1
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {r[:2] for r in stays} and max(most.values()) <= 2
    longest = {s: max(len(words(r[1])) for r in stays if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)

    check(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()], 2048)
    run = corpus_pipeline.run(spark, tables)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, run.select(pieces).collect())) == Counter(map(tuple, packed.select(pieces).collect()))


def test_empty_tables_and_clashing_columns_pass_through(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows_of_all_kinds(), COLUMNS)
    empty = stage_rows(spark, docs.limit(0), f"file://{tmp_path}/empty")
    assert [d.count() for d in empty] == [0] * 5
    clashing = docs.withColumns({c: F.lit(f"my {c}") for c in CLASHES}).repartition(3)
    plain = stage_rows(spark, docs.repartition(3), f"file://{tmp_path}/plain")
    found = stage_rows(spark, clashing, f"file://{tmp_path}/clashing")
    for a, b in zip(plain[:-1], found[:-1], strict=True):
        assert b.columns == clashing.columns
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.select(docs.columns).collect()))
        assert b.select(CLASHES).distinct().collect() == [tuple(f"my {c}" for c in CLASHES)]
    assert plain[-1].count() == found[-1].count()
