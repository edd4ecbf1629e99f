"""Operator 2: hierarchical language identification.

A text's language family is decided first; one-versus-one linear support vector machines
then separate the languages within it.  Both levels read the same hashed letter n-grams.
Languages that no table lists are put into families by likeness, and each machine is
trained in a task of its own, so the number of languages is not bounded.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracewright.llm.common import joined, materialize, scratch

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi mr ne bn pa gu",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

UNDETERMINED = "und"
DIMENSIONS = 4096
NGRAMS = (1, 2, 3, 4)
#: Bound of the training sample: about this many texts of each language.
SAMPLE_PER_LANGUAGE = 800
#: Languages of a family at most; larger ones are halved by likeness.  So machines grow
#: with the languages and not with their square: about 90 KB of weights each at most.
FAMILY_LANGUAGES = 12
#: Rows on each side of a family's machine, about.
SAMPLE_PER_SIDE = 2400
#: Weights that are broadcast at once; a larger model is applied in several passes.
MODEL_BYTES = 256 << 20
#: Length of the mean vectors that tell how like two languages are.
FOLDED = 64
SLICE = 1 << 20

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed letter n-grams of the whole text, None where it has no letter.

    Runs of other characters count as one space, so n-grams see word ends.  A text is
    read in slices, so memory doesn't grow with its length.
    """
    counts, any_letter, longest = np.zeros(DIMENSIONS), False, max(NGRAMS)
    tail = np.full(1, 32, dtype=np.uint32)
    for start in range(0, len(text), SLICE):
        codes = np.frombuffer(text[start : start + SLICE].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = letter_table()[codes]
        any_letter |= bool(letters.any())
        last = start + SLICE >= len(text)
        codes = np.concatenate([tail, np.where(letters, codes, 32), np.full(1 if last else 0, 32, np.uint32)]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        hashed = codes * np.uint32(2654435761)
        fresh = 0 if not start else len(tail)  # n-grams that end within the tail were counted
        for n in range(1, longest + 1):
            if n > 1:
                hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(2246822519) + codes[n - 1 :] * np.uint32(3266489917)
            if n in NGRAMS:
                counts += np.bincount((hashed[max(0, fresh - n + 1) :] * np.uint32(2654435769)) >> np.uint32(32 - 12), minlength=DIMENSIONS)
        tail = codes[1 - longest :]
    if not any_letter:
        return None
    weights = np.sqrt(counts)
    return (weights / np.linalg.norm(weights)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 40) -> np.ndarray:
    """Weights, the bias last, of a hinge-loss machine by dual coordinate descent (y is -1 or 1)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, dual, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(dual[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), cost)
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return w


def family_name(lang: str) -> str:
    """The listed family of a code, with or without a region; empty where none is."""
    return FAMILY_OF.get(re.split("[-_]", lang.lower())[0], "")


def halved(langs: list[str], means: dict[str, np.ndarray]) -> list[list[str]]:
    """``langs`` in groups of :data:`FAMILY_LANGUAGES` at most, cut across the direction in
    which their mean vectors differ most."""
    if len(langs) <= FAMILY_LANGUAGES:
        return [langs]
    x = np.stack([means[lang] for lang in langs])
    x = x - x.mean(axis=0)
    along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    order = [langs[i] for i in sorted(range(len(langs)), key=lambda i: (along[i], langs[i]))]
    return [g for half in (order[: len(order) // 2], order[len(order) // 2 :]) for g in halved(half, means)]


def families_of(means: dict[str, np.ndarray]) -> list[list[str]]:
    """The languages of each family, both in a fixed order."""
    named = defaultdict(list)
    for lang in sorted(means):
        named[family_name(lang)].append(lang)
    return sorted(sorted(group) for name in sorted(named) for group in halved(named[name], means))


@dataclass
class Model:
    """Families, each a list of languages, and machines as columns of weights, the bias last.

    ``top`` has a machine for each family against the others, but one where there are two
    and none where there is one.  ``within`` has the machines of each family's pairs.
    """

    families: list[list[str]]
    top: np.ndarray
    within: dict[int, np.ndarray]

    def family(self, vector: np.ndarray) -> tuple[int, float]:
        if len(self.families) == 1:
            return 0, 1.0
        chance = sure(vector @ self.top[:-1] + self.top[-1])
        if len(self.families) == 2:
            chance = np.array([chance[0], 1 - chance[0]])
        best = int(np.argmax(chance))
        return best, float(chance[best] / chance.sum())

    def language(self, vector: np.ndarray, family: int) -> tuple[str, float]:
        """The language with most pairwise wins (ties: the larger sum of margins), and its
        mean pairwise probability."""
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], 1.0
        weights = self.within[family]
        margins = (vector @ weights[:-1] + weights[-1]).astype(float)
        chances = sure(margins)
        wins, total, chance = (np.zeros(len(langs)) for _ in range(3))
        for (a, b), m, p in zip(combinations(range(len(langs)), 2), margins, chances, strict=True):
            wins[a if m >= 0 else b] += 1
            total[[a, b]] += m, -m
            chance[[a, b]] += p, 1 - p
        best = max(range(len(langs)), key=lambda i: (wins[i], total[i]))
        return langs[best], float(chance[best] / (len(langs) - 1))


def sure(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(np.asarray(margins, dtype=float), -20, 20)))


def unpacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float16) for v in vectors]).astype(np.float32)


def sample_vectors(labelled: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(lang, x, h): about :data:`SAMPLE_PER_LANGUAGE` different texts of each language as
    vectors of fixed size, drawn by a hash of language and text."""
    known = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    hashed = joined(known, sizes, "lang", "inner").withColumn("h", F.xxhash64("lang", "text"))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < SAMPLE_PER_LANGUAGE / F.col("n"))
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies are one text

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "x": [None if v is None else v.astype(np.float16).tobytes() for v in found], "h": batch["h"]}).dropna(subset=["x"])

    return materialize(drawn.mapInPandas(vectors, "lang string, x binary, h long"), "vectors")


def machine_rows(vectors: DataFrame, families: list[list[str]], sizes: dict[str, int]) -> DataFrame:
    """(family, a, b, y, x, h): each machine's rows.  A pair's machine takes all rows of both
    languages, a family's (a is -1) a sample of its own and of the others'."""
    rows = []
    in_family = [sum(sizes[lang] for lang in langs) for langs in families]
    for f, langs in enumerate(families):
        rows += [(lang, f, i, len(langs), min(1.0, SAMPLE_PER_SIDE / in_family[f])) for i, lang in enumerate(langs)]
    spark, total = vectors.sparkSession, sum(in_family)
    placed = materialize(spark.createDataFrame(rows, "lang string, f int, i int, k int, share double"), "families")
    own = joined(vectors, placed, "lang", "inner")
    machine = lambda family, a, b, y: F.struct(family.cast("int").alias("family"), a.cast("int").alias("a"), b.cast("int").alias("b"), y.cast("double").alias("y"))
    mates = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("i"))
    of_pairs = F.transform(mates, lambda j: machine(F.col("f"), F.least(F.col("i"), j), F.greatest(F.col("i"), j), F.when(F.col("i") < j, 1).otherwise(-1)))
    drawn = lambda j: F.pmod(F.xxhash64("h", j), F.lit(1 << 30)) / float(1 << 30)
    if len(families) == 1:
        wanted = of_pairs
    else:
        against = F.array(F.lit(0)) if len(families) == 2 else F.sequence(F.lit(0), F.lit(len(families) - 1))
        other = min(1.0, SAMPLE_PER_SIDE / total)
        chosen = F.filter(against, lambda j: drawn(j) < F.when((j == F.col("f")) | F.lit(len(families) == 2), F.col("share")).otherwise(other))
        wanted = F.concat(of_pairs, F.transform(chosen, lambda j: machine(j, F.lit(-1), F.lit(-1), F.when(j == F.col("f"), 1).otherwise(-1))))
    return own.select(F.explode(wanted).alias("m"), "x", "h").select("m.*", "x", "h")


def machine(rows: pd.DataFrame) -> pd.DataFrame:
    """One machine's weights."""
    rows = rows.sort_values(["y", "h", "x"], ignore_index=True)
    w = linear_svm(unpacked(rows["x"]), rows["y"].to_numpy())
    return pd.DataFrame({"family": rows["family"].iloc[:1], "a": rows["a"].iloc[:1], "b": rows["b"].iloc[:1], "w": [w.astype(np.float16).tobytes()]})


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> list[tuple[Model, set[int]]]:
    """The model in parts of :data:`MODEL_BYTES` at most, each with the families it can
    tell apart further; none where no row teaches.

    What reaches the driver before a part's weights is a row for each language.
    """
    mean = "lang string, n int, mean binary"

    def mean_of(rows: pd.DataFrame) -> pd.DataFrame:
        folded = unpacked(rows["x"]).mean(axis=0).reshape(-1, FOLDED).sum(axis=0)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "n": [len(rows)], "mean": [folded.astype(np.float32).tobytes()]})

    with scratch(labelled.sparkSession):
        vectors = sample_vectors(labelled, text_column, lang_column)
        found = vectors.groupBy("lang").applyInPandas(mean_of, mean).collect()
        if not found:
            return []
        families = families_of({r.lang: np.frombuffer(r.mean, np.float32) for r in found})
        rows = machine_rows(vectors, families, {r.lang: r.n for r in found})
        machines = materialize(rows.groupBy("family", "a", "b").applyInPandas(machine, "family int, a int, b int, w binary"), "machines")
        packed = lambda rows: np.stack([np.frombuffer(r.w, np.float16) for r in sorted(rows, key=lambda r: (r.family, r.a, r.b))]).T.astype(np.float32)
        tops = machines.where("a = -1").collect()
        top = packed(tops) if tops else np.zeros((DIMENSIONS + 1, 0), np.float32)
        parts, size = [set()], 0
        for f, langs in enumerate(families):
            own = 4 * (DIMENSIONS + 1) * len(langs) * (len(langs) - 1) // 2
            if size + own > MODEL_BYTES and parts[-1]:
                parts, size = [*parts, set()], 0
            parts[-1].add(f)
            size += own
        models = []
        for part in parts:
            pairs = defaultdict(list)
            for r in machines.where((F.col("a") >= 0) & F.col("family").between(min(part), max(part))).toLocalIterator():
                pairs[r.family].append(r)
            models.append((Model(families, top, {f: packed(rows) for f, rows in pairs.items()}), part))
        return models


def identify_language(docs: DataFrame, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``lang_pred``, ``score``.

    ``learn_from`` tells which rows may teach.  Prediction reads nothing but the text, row
    by row without a shuffle.  A text that is null, empty or has no letter gets ``und``
    with score 0; so does every row where no row teaches.  Repeated rows get equal
    results; an empty table gives an empty one; other columns are not read.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    out = StructType([base.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    models = train(docs.where(learn_from), text_column, lang_column)
    if not models:
        return base.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def told_by(model: Model, part: set[int], first: bool) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES, and 16 KB a family

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = sent.value
            for batch in batches:
                found = []
                for text in batch["text"]:
                    vector = features(text or "")
                    if vector is None:
                        found.append((UNDETERMINED, 0.0) if first else None)
                        continue
                    family, chance = model.family(vector)
                    if family not in part:
                        found.append(None)
                        continue
                    lang, within = model.language(vector, family)
                    found.append((lang, min(1.0, max(0.0, chance * within))))
                here = np.array([f is not None for f in found], dtype=bool)
                found = [f for f in found if f is not None]
                yield batch.loc[here, ["doc_id"]].assign(lang_pred=[f[0] for f in found], score=np.array([f[1] for f in found], dtype=float))

        return base.mapInPandas(score, out)

    whole = told_by(*models[0], True)
    for model, part in models[1:]:  # each pass tells the texts of its own families
        whole = whole.unionByName(told_by(model, part, False))
    return whole
