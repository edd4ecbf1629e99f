"""Operator 3: quality rules as one native projection.

A threshold table over length, symbol, stop-word and line ratios is compiled into Spark
columns; no user function runs, and no row leaves its partition.

The stop words given are those of English, French, German and Spanish; a table for other
languages is a parameter.  Their rule judges only what may be in one of the table's
languages: not texts mainly in a script that none of its words is in, nor rows whose
``lang`` names another language.  All other rules hold for every language; the counts go
by words between white space, so scripts without spaces rarely reach 50.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import SEPARATORS, free_name, let, text_of, words_of

StopWords = Mapping[str, Sequence[str]]

SYMBOLS = "#*$%&|<>"
#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were".split(),
    "fr": "le la les de des du et en un une est que qui dans pour par sur pas au avec ce il elle son ne se plus".split(),
    "de": "der die das und den von zu mit sich ist im nicht ein eine als auch es auf dem für".split(),
    "es": "el los las del y una por con para su al lo como más o pero sus le".split(),
}
#: Other codes of these languages, codes that name no language, and scripts.
OTHER_CODES = {"en": "eng", "fr": "fra fre", "de": "deu ger", "es": "spa"}
SCRIPTS = "Latin Cyrillic Greek Arabic Hebrew Devanagari Bengali Tamil Thai Hangul Hiragana Katakana Han Armenian Georgian".split()
NO_LANGUAGE = "und unk zxx mul mis".split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose ``metric`` lies between ``least`` and ``most``, both included."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table.  Metrics are those of :func:`text_metrics`.
RULES = (
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_ratio", most=0.15),
    Rule("stop_word_ratio", least=0.01),
    Rule("dup_line_char_ratio", most=0.3),
    Rule("ellipsis_line_ratio", most=0.5),
)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more, each word counted once.

    Windows are compared by 64-bit hash.  A text without a repeated window is done after
    one pass; others sort their windows, so the cost is n log n at worst.
    """

    def covered(hashes: Column) -> Column:
        def repeats(ordered: Column) -> Column:
            same = lambda x, other: x["h"] == other["h"]
            found = F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)))
            return F.sort_array(F.transform(found, lambda x: x["p"]))

        def widths(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, repeats), widths))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows, covered))


def all_words(stop_words: StopWords) -> list[str]:
    return sorted({w for words in stop_words.values() for w in words})


def text_metrics(text: Column, stop_words: StopWords = STOP_WORDS) -> Column:
    """Struct of counts and ratios of a non-null text; ratios over no words or lines are 0."""
    stripped = F.translate(text, SEPARATORS, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SEPARATORS, "")) > 0)
    ratio = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    count = lambda c: c.cast("long")

    by_words = let(
        words_of(text),
        lambda w: F.struct(
            count(F.size(w)).alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            count(F.size(F.filter(w, lambda x: F.lower(x).isin(*all_words(stop_words))))).alias("n_stop_words"),
        ),
    )
    chars_in = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda total, line: total + F.length(line))

    def line_counts(x: Column, once: Column) -> Column:
        return F.struct(
            count(F.size(x)).alias("n_lines"),
            count(F.size(x) - F.size(once)).alias("n_dup_lines"),
            chars_in(x).alias("line_chars"),
            (chars_in(x) - chars_in(once)).alias("dup_line_chars"),
            count(F.size(F.filter(x, lambda line: F.endswith(F.rtrim(line), F.lit("...")) | F.endswith(F.rtrim(line), F.lit("…"))))).alias("n_ellipsis_lines"),
        )

    by_lines = let(lines, lambda x: let(F.array_distinct(x), lambda once: line_counts(x, once)))
    sums = F.struct(count(F.length(stripped)).alias("word_chars"), count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))

    def joined(all_: Column) -> Column:
        w, x, s = all_["w"], all_["x"], all_["s"]
        return F.struct(
            w["n_words"].alias("n_words"),
            s["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            ratio(s["word_chars"], w["n_words"]).alias("mean_word_chars"),
            ratio(s["n_symbols"], w["n_words"]).alias("symbol_ratio"),
            ratio(w["n_stop_words"], w["n_words"]).alias("stop_word_ratio"),
            ratio(x["dup_line_chars"], x["line_chars"]).alias("dup_line_char_ratio"),
            ratio(x["n_ellipsis_lines"], x["n_lines"]).alias("ellipsis_line_ratio"),
        )

    return let(F.struct(by_words.alias("w"), by_lines.alias("x"), sums.alias("s")), joined)


def base_failed(metrics: Column) -> Column:
    return (metrics["n_words"] < 50) | (100 * metrics["n_repeat_words"] > 50 * metrics["n_words"])


def without_stop_words(docs: DataFrame, text_column: str, lang_column: str, stop_words: StopWords = STOP_WORDS) -> Column:
    """Whether a row's language has no stop words in the table, as far as lang or script say.

    ``lang`` counts where it is a code of two or three letters, with or without a region;
    a text is in another script where its letters outside the words' scripts, with their
    marks, are half or more of all that isn't white space.
    """
    text = text_of(text_column)
    scripts = [s for s in SCRIPTS if any(regex.search(rf"\p{{{s}}}", w) for w in all_words(stop_words))]
    other_letters = F.length(F.regexp_replace(text, "|".join([r"[^\p{L}\p{M}]+", *(rf"\p{{Is{s}}}+" for s in scripts)]), ""))
    word_chars = F.length(F.translate(text, SEPARATORS, ""))
    by_script = (other_letters > 0) & (2 * other_letters >= word_chars)
    if lang_column not in docs.columns:
        return by_script
    other_codes = [c for lang in stop_words for c in OTHER_CODES.get(lang, "").split()]
    code = F.regexp_extract(F.lower(F.trim(F.col(lang_column).cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.coalesce((code != "") & ~code.isin(*stop_words, *other_codes, *NO_LANGUAGE), F.lit(False)) | by_script


def passes(metrics: Column, rules: tuple[Rule, ...] = RULES, without_stop_words: Column | None = None) -> Column:
    """One condition compiled from the threshold table.  The stop-word rule passes where
    ``without_stop_words`` holds, which is looked at only where the rule fails."""
    condition = F.lit(True)
    for rule in rules:
        held = F.lit(True)
        if rule.least is not None:
            held = held & (metrics[rule.metric] >= rule.least)
        if rule.most is not None:
            held = held & (metrics[rule.metric] <= rule.most)
        if rule.metric == "stop_word_ratio" and without_stop_words is not None:
            held = held | without_stop_words
        condition = condition & held
    return condition


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, lang_column: str = "lang", stop_words: StopWords = STOP_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed`` and ``kept``.

    A null text counts as empty: no words, so ``base_failed``.  Repeated rows are judged
    alike; an empty table gives an empty one; ``lang`` is read where the table has it, for
    the stop-word rule alone, and no other column is.
    """
    name = free_name("_metrics", docs.columns)
    judged, metrics = docs.withColumn(name, text_metrics(text_of(text_column), stop_words)), F.col(name)
    return judged.select(
        F.col(id_column),
        *[metrics[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(metrics).alias("base_failed"),
        (~base_failed(metrics) & passes(metrics, rules, without_stop_words(docs, text_column, lang_column, stop_words))).alias("kept"),
    )


def keep_good(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES, lang_column: str = "lang", stop_words: StopWords = STOP_WORDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    name = free_name("_metrics", docs.columns)
    judged, metrics = docs.withColumn(name, text_metrics(text_of(text_column), stop_words)), F.col(name)
    return judged.where(~base_failed(metrics) & passes(metrics, rules, without_stop_words(docs, text_column, lang_column, stop_words))).drop(name)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same judgement in DuckDB's SQL, from words and windows of words as rows.

    It puts the stop-word rule to every text, so it agrees where all texts are in
    languages that have stop words, as those of the given tables are."""
    tests = " and ".join([f"{r.metric} >= {r.least}" for r in rules if r.least is not None] + [f"{r.metric} <= {r.most}" for r in rules if r.most is not None])
    stop = ", ".join(f"'{w}'" for w in all_words(STOP_WORDS))
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as pos from
      (select rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from d)),
tri as (select rid, pos, word, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as tri from w window o as (partition by rid order by pos)),
twice as (select rid, pos, word, case when tri is not null and count(*) over (partition by rid, tri) > 1 then 1 else 0 end as again from tri),
cover as (select rid, word, max(again) over (partition by rid order by pos rows between 2 preceding and current row) as inside from twice),
by_word as (select rid, count(*) as n_words, sum(length(word)) as word_chars, sum(inside) as n_repeat_words,
            count(*) filter (lower(word) in ({stop})) as n_stop from cover group by rid),
lines as (select rid, unnest(string_split(t, chr(10))) as line from d),
each_line as (select rid, line, count(*) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid, line),
by_line as (select rid, sum(n) as n_lines, sum(n) - count(*) as n_dup_lines, sum((n - 1) * length(line)) as dup_line_chars, sum(n * length(line)) as line_chars,
            coalesce(sum(n) filter (rtrim(line, ' ') like '%...' or rtrim(line, ' ') like '%…'), 0) as n_ellipsis
            from each_line group by rid),
m as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_stop / n_words, 0.0) as stop_word_ratio,
      coalesce(word_chars / n_words, 0.0) as mean_word_chars, coalesce(dup_line_chars / line_chars, 0.0) as dup_line_char_ratio,
      coalesce(n_ellipsis / n_lines, 0.0) as ellipsis_line_ratio
      from d left join by_word using (rid) left join by_line using (rid)),
r as (select *, coalesce(n_symbols / nullif(n_words, 0), 0.0) as symbol_ratio,
      n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {tests} as kept from r
"""
