import re
from collections import Counter

import duckdb

from tests.llm.conftest import prose
from tracewright.llm import quality_rules
from tracewright.llm.quality_rules import RULES, Rule, judge_quality, keep_good

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_counts_match_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(20, "a b c a b c"), (21, "a a a a"), (22, "a b\n\na b\na b "), (23, "x\x85y\xa0z a\x0bb"), (24, " ".join(["w1 w2 w3 w4"] * 40)), (25, prose(7, 60) + "\n" + prose(7, 60))]
    found = judge_quality(make_docs(rows)).collect()
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)


def test_clean_stays_and_junk_goes(make_docs):
    clean = prose(3, 200)
    junk = " ".join(w + "$$$" for w in clean.split())
    shouted = "\n".join([prose(4, 12)] * 5 + [prose(i, 12) for i in range(5, 10)])
    docs = make_docs([(1, clean), (2, junk), (3, shouted), (4, None)])
    assert {r.doc_id for r in keep_good(docs).collect()} == {1}
    assert keep_good(docs).columns == docs.columns
    assert judge_quality(docs.limit(0)).count() == 0


def test_the_threshold_table_compiles(make_docs):
    docs = make_docs([(1, prose(3, 200))])
    assert judge_quality(docs, rules=(*RULES, Rule("n_words", least=1000))).first().kept is False


def test_sql_agrees(make_docs, odd_rows):
    rows = odd_rows + [(i, prose(i, 40 + i)) for i in range(30, 60)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t in rows if t is None or "\x00" not in t])
    want = con.sql(f"select doc_id, {', '.join(COUNTS)}, kept from ({quality_rules.oracle_sql()})").fetchall()
    found = judge_quality(make_docs([r for r in rows if r[1] is None or "\x00" not in r[1]])).select("doc_id", *COUNTS, "kept").collect()
    assert Counter(map(tuple, found)) == Counter(want)


OTHER_SCRIPTS = {
    "ru": "река камень рынок зелёный открытый письмо зима дом малый ответ дорога и не на что он был",
    "el": "ποτάμι πέτρα αγορά πράσινο ανοιχτό γράμμα χειμώνας σπίτι μικρό απάντηση δρόμος και το της με",
    "ar": "نهر حجر سوق أخضر مفتوح رسالة شتاء بيت صغير جواب طريق في من على إلى",
    "hi": "नदी पत्थर बाज़ार हरा खुला पत्र सर्दी घर छोटा उत्तर सड़क और है में की",
}


def test_languages_without_stop_words_are_not_judged_by_them(make_docs):
    said = {lang: prose(i, 200, words.split()) for i, (lang, words) in enumerate(OTHER_SCRIPTS.items())}
    indonesian = prose(9, 200, "sungai batu pasar hijau terbuka surat rumah kecil jawaban jalan dan yang untuk dengan".split())
    no_words = prose(8, 200, "xkq zzt vbn qwrt plmk tgbv yhnj rfcd wsxz olkm".split())
    rows = [(i, text, lang) for i, (lang, text) in enumerate(said.items())]
    rows += [(10 + i, text, None) for i, text in enumerate(said.values())]
    rows += [(20, indonesian, "id"), (21, indonesian, "id-ID")]
    bad = [(30, no_words, "en"), (31, no_words, None), (32, no_words, "und"), (33, no_words, "de-AT"), (34, " ".join(w + "$$$" for w in said["ru"].split()), "ru"), (35, " ".join(f"4{i % 9}71{i}-=" for i in range(100)) + " я", "en")]
    docs = make_docs(rows + bad)
    assert {r.doc_id for r in keep_good(docs).collect()} == {r[0] for r in rows}
    assert {r.doc_id for r in judge_quality(docs).where("kept").collect()} == {r[0] for r in rows}
    bare = docs.drop("lang")
    assert {r.doc_id for r in keep_good(bare).collect()} == {r[0] for r in rows if r[0] < 20}


def test_stop_words_are_a_parameter(make_docs):
    """With Russian words in the table, Russian without any of them is judged, and goes."""
    few = "река камень рынок зелёный открытый письмо зима дом малый ответ дорога".split()
    docs = make_docs([(1, prose(1, 200, few), "ru"), (2, prose(2, 200, [*few, "и", "не"]), "ru"), (3, prose(3, 200, OTHER_SCRIPTS["el"].split()), "el"), (4, prose(4, 200, few), None), (5, prose(5, 200), "en")])
    assert {r.doc_id for r in keep_good(docs).collect()} == {1, 2, 3, 4, 5}
    own = {**quality_rules.STOP_WORDS, "ru": ["и", "не"]}
    assert {r.doc_id for r in keep_good(docs, stop_words=own).collect()} == {2, 3, 5}
    clashing = docs.selectExpr("*", "'mine' as _metrics", "'mine' as __metrics")
    left = keep_good(clashing)
    assert left.columns == clashing.columns and left.count() == 5
