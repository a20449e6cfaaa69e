"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding makes spellings that look alike equal: compatibility forms and case,
letters of other scripts that resemble Latin ones, i and l, struck-out and
invisible characters (letters with accents stay letters of their own), and digits or signs inside words ("st0p1d", "$cum").  A term is a
whole word or a stem, that is what longer words begin with.  Terms and their
weights (log odds of toxic against clean documents that have them) come from
labelled documents: those whose log-likelihood ratio is beyond what chance brings
about among so many terms.  Toxic documents count at most as often as the term
stands beside different words, so that copies of a document prove nothing.  A
stem stands for its extensions unless one is stronger.

An exception is a phrase of a matched word and a neighbour that makes up a good
share of what clean documents have of the term and that they have at least as
often as toxic ones; matches within exceptions don't count.
A text's weight is the sum over its words of the strongest term that matches,
divided by its length in words (and EXTRA_WORDS), and isotonic regression turns
it into a probability.  Each labelled document is weighed for that by the terms
of the other half of the labelled ones, so that chance terms don't count as proof.

Null and empty texts have weight 0 and are scored too.  Null labels are ignored,
repeated ones averaged.  Without labelled documents every score is 0.5; where all
labels are alike it is that label.  Equal texts have equal scores; repeated rows
are scored one by one.  Words whose letters are set apart are not joined.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityloom.llm.quality import averaged, pool
from cityloom.session import fresh, stored

#: About so many labelled documents fit a model, chosen by a hash of their key where there are more.
MAX_LABELLED = 100_000
#: Letters of a stem.
SHORTEST, LONGEST = 4, 10
#: Least log odds of a candidate and of a term.
CANDIDATE_WEIGHT, TERM_WEIGHT = 1.0, 2.0
#: Clean documents that an exception takes, and its share of the clean documents with its term.
EXCEPTION_DOCS, EXCEPTION_SHARE = 3, 0.2
#: Words added to a text's length, so that one word is no whole text.
EXTRA_WORDS, BINS = 20, 400

# fixed values: letters of other scripts that look like Latin ones, and what digits and signs stand for inside words
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ꞵ": "b",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "€": "e", "!": "i", "|": "i"}

LETTERS = str.maketrans(HOMOGLYPHS | {"l": "i"})
LETTERS_OF_ASCII = str.maketrans({"l": "i"})
IN_WORDS = str.maketrans(DIGITS)
WORD = re.compile(r"[^\W_]+")
DIGIT = re.compile(r"\d")
SIGN = re.compile(r"(?<![\W_])[@$€!|]+(?=[^\W_])|[@$€](?=[^\W\d_])")
HIDDEN = re.compile("[̀-ͯ­​-‏⁠﻿]")


def folded(text: str | None) -> list[str]:
    """The words of a text with look-alikes made equal."""
    t = (text or "").lower()
    if t.isascii():
        t = t.translate(LETTERS_OF_ASCII)
    else:
        t = HIDDEN.sub("", unicodedata.normalize("NFKC", t)).lower().translate(LETTERS)
    t = SIGN.sub(lambda m: "".join(SIGNS[c] for c in m.group()), t)
    words = WORD.findall(t)
    if DIGIT.search(t):
        words = [w if w.isalpha() or w.isdigit() else w.translate(IN_WORDS) for w in words]
    return words


def features(words: Iterable[str]) -> set[str]:
    """Whole words (these end in a space) and the stems that words go beyond, of a set of words."""
    out = set()
    for w in set(words):
        out.add(w + " ")
        out.update(w[:k] for k in range(SHORTEST, min(len(w) - 1, LONGEST) + 1))
    return out


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return float(np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1)))


def likelihood_ratio(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """G squared of a term's presence against the label."""
    table = np.array([[toxic, clean], [all_toxic - toxic, all_clean - clean]]).clip(0)
    expected = np.outer(table.sum(1), table.sum(0)) / max(table.sum(), 1e-9)
    some = table > 0
    return float(2 * (table[some] * np.log(table[some] / expected[some])).sum())


class Matcher:
    """Terms and exceptions in one automaton over words joined by spaces."""

    def __init__(self, terms: Iterable[str], exceptions: Iterable[str] = ()):
        self.machine = ahocorasick.Automaton()
        for t in terms:
            self.machine.add_word(" " + t, (t, False))
        for e in exceptions:
            self.machine.add_word(f" {e} ", (e, True))
        self.some = len(self.machine) > 0
        self.machine.make_automaton()

    def __call__(self, words: list[str]) -> tuple[list[tuple[int, str]], str]:
        """(place of the word, term) of every match outside exceptions, and the text that places refer to."""
        line = f" {' '.join(words)} "
        found, spans = [], []
        if self.some:
            for end, (term, is_exception) in self.machine.iter(line):
                if is_exception:
                    spans.append((end - len(term), end))
                elif term.endswith(" ") or line[end + 1] != " ":
                    found.append((end - len(term) + 1, term))
        if spans and found:
            found = [(s, t) for s, t in found if not any(a <= s < b for a, b in spans)]
        return found, line


@dataclass
class Model:
    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bins: list[int] = field(default_factory=lambda: [0])
    values: list[float] = field(default_factory=lambda: [0.5])

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.exceptions)

    def weight(self, found: list[tuple[int, str]], words: int) -> float:
        """The sum over matched places of their strongest term, for each word of a text of so many."""
        best: dict[int, float] = {}
        for place, term in found:
            best[place] = max(best.get(place, 0.0), self.terms[term])
        return sum(best.values()) / (words + EXTRA_WORDS)

    def score(self, weight: float) -> float:
        return self.values[max(bisect_right(self.bins, bin_of(weight)) - 1, 0)]


def bin_of(weight: float) -> int:
    """0 for weight 0, then from 1 in equal steps of the logarithm."""
    return 0 if weight <= 0 else int(np.clip(40 * (np.log(weight) + 7), 1, BINS))


def calibrated(n: np.ndarray, total: np.ndarray, base: float) -> list[float]:
    """Isotonic means of bins, each level with one row of mean `base` besides, so that few rows make no certainty."""
    level = pool(n, total)
    out = level.copy()
    for v in np.unique(level):
        same = level == v
        out[same] = (total[same].sum() + base) / (n[same].sum() + 1)
    return np.maximum.accumulate(out).tolist()


def _weighed(batches: Iterator[pa.RecordBatch], *, terms: list[dict[str, float]]) -> Iterator[pa.RecordBatch]:
    models = [Model(t) for t in terms]
    for batch in batches:
        bins = []
        for half, words, hits in zip(*(batch.column(c).to_pylist() for c in ("half", "words", "hits"))):
            known = [(h["place"], h["term"]) for h in hits if h["term"] in terms[half]]
            bins.append(bin_of(models[half].weight(known, words)))
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), batch.column("y")], names=["bin", "y"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic: dict[int, Counter] = {0: Counter(), 1: Counter()}
        clean: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for half, y, text in zip(*(c.to_pylist() for c in batch.columns)):
            got = features(folded(text))
            if y > 0:
                toxic[half].update(got if y == 1 else dict.fromkeys(got, y))
            if y < 1:
                clean[half].update(got if y == 0 else dict.fromkeys(got, 1 - y))
        terms = sorted(set().union(*toxic.values(), *clean.values()))
        columns = [[c[t] for t in terms] for c in (toxic[0], toxic[1], clean[0], clean[1])]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array(c, pa.float64()) for c in columns]], names=["term", *COUNTS])


COUNTS = ["t0", "t1", "c0", "c1"]
HITS = "half int, y double, words long, hits array<struct<place: long, term: string, before: string, after: string>>"


def _hits(batches: Iterator[pa.RecordBatch], *, terms: list[str]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(terms)
    for batch in batches:
        rows = []
        for half, y, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = folded(text)
            found, line = matcher(words)
            hits = []
            for s, term in found:
                stop = line.index(" ", s)
                word, before, after = line[s:stop], line[: s - 1].rsplit(" ", 1)[-1], line[stop + 1 :].split(" ", 1)[0]
                hits.append({"place": s, "term": term, "before": f"{before} {word}" if before else None, "after": f"{word} {after}" if after else None})
            rows.append((half, y, len(words), hits))
        kind = pa.list_(pa.struct([("place", pa.int64()), ("term", pa.string()), ("before", pa.string()), ("after", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.float64(), pa.int64(), kind))], names=["half", "y", "words", "hits"])


def beyond_chance(counts: dict[str, tuple[float, float]], all_toxic: float, all_clean: float, among: int, least: float) -> dict[str, float]:
    """Weights of the terms that weigh `least` and whose ratio is beyond what chance brings about `among` so many; of terms of one family with equal counts the longest."""
    beyond = 2 * np.log(max(among, 2))
    weights = {t: log_odds(a, b, all_toxic, all_clean) for t, (a, b) in counts.items()}
    kept = {t: w for t, w in weights.items() if w >= least and likelihood_ratio(*counts[t], all_toxic, all_clean) >= beyond}
    longer = {(t[:-2] if t.endswith(" ") else t[:-1], counts[t]) for t in kept}
    return {t: w for t, w in kept.items() if (t, counts[t]) not in longer}


def selected(counts: dict[str, tuple[float, float]], all_toxic: float, all_clean: float, among: int, least: float) -> dict[str, float]:
    """Terms beyond chance and their weights; a term gives way to a shorter one that begins it and weighs as much."""
    kept = beyond_chance(counts, all_toxic, all_clean, among, least)
    out: dict[str, float] = {}
    for t in sorted(kept, key=len):
        if all(out.get(t[:k], -np.inf) < kept[t] for k in range(1, len(t))):
            out[t] = kept[t]
    return out


def labelled_texts(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """half (0 or 1, by a hash of the key), y and text of about `most` labelled documents at most; no text is shuffled."""
    y = averaged(labels, key, label)
    rows = y.count()
    if rows > most:
        y = y.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / rows))
    k, v = fresh(df, "_key", "_y")
    few = F.broadcast(y.select(F.col(key).alias(k), F.col("y").alias(v)))  # bounded by `most`
    half = F.pmod(F.hash(F.col(k), F.lit("half")), F.lit(2)).cast("int")
    return df.select(key, text).join(few, F.col(key) == F.col(k)).select(half.alias("half"), F.col(v).cast("double").alias("y"), F.col(text).alias("text"))


def fit(rows: DataFrame, lexicon: dict[str, float] | None = None, exceptions: Iterable[str] = ()) -> Model:
    """Model of `rows` (half, y, text), all of them; `lexicon` (words, or stems where they end in *) and `exceptions` are added to what is learned.

    The driver gets terms beyond chance, exceptions and the bins of the calibration, whose number the labelled rows bound.
    """
    given = {"".join(folded(t)) + " ": w for t, w in (lexicon or {}).items()}
    given |= {"".join(folded(t)): w for t, w in (lexicon or {}).items() if t.endswith("*")}
    phrases = [" ".join(folded(e)) for e in exceptions]
    sums = {r["half"]: r for r in rows.groupBy("half").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).collect()}
    total = {h: (sums[h]["t"], sums[h]["c"]) if h in sums else (0.0, 0.0) for h in (0, 1)}
    all_toxic, all_clean = (total[0][i] + total[1][i] for i in (0, 1))
    if not all_toxic + all_clean:
        return Model(given, phrases)
    counted = rows.mapInArrow(_counted, "term string, " + ", ".join(f"{c} double" for c in COUNTS)).groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    toxic, clean = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    counted = stored(counted.withColumn("weight", F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))), "toxicity-terms")
    among = counted.count()
    # with fewer toxic documents a term can't be beyond chance
    base = all_toxic / (all_toxic + all_clean)
    few = np.log(max(among, 2)) / max(-np.log(base), 1e-9) / 2 if 0 < base < 1 else np.inf
    first = {r["term"]: (r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in counted.filter((F.col("weight") >= CANDIDATE_WEIGHT) & (toxic >= few)).collect()}
    candidates = beyond_chance(first, all_toxic, all_clean, among, CANDIDATE_WEIGHT)
    hits = stored(rows.mapInArrow(partial(_hits, terms=sorted({*candidates, *given})), HITS), "toxicity-hits")

    pairs = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.array(*[F.struct(h["term"].alias("term"), p.alias("phrase")) for p in (h["before"], h["after"], F.lit(""))]))))
    contexts = hits.select("y", F.explode(pairs).alias("p")).filter("p.phrase is not null").groupBy("p.term", "p.phrase").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    whole = contexts.filter("phrase = ''").select("term", F.col("c").alias("of"))
    many = (F.col("c") >= EXCEPTION_DOCS) & (F.col("c") >= EXCEPTION_SHARE * F.col("of")) & (F.col("c") * max(all_toxic, 1e-9) >= F.col("t") * all_clean)
    clean_ones = contexts.filter("phrase <> ''").join(whole, "term").filter(many)
    excepted = [(r["term"], r["phrase"]) for r in clean_ones.select("term", "phrase").collect()]
    every = sorted({*phrases, *(p for _, p in excepted)})

    out = F.array(*[F.lit(p) for p in every]) if every else F.array().cast("array<string>")
    left = hits.withColumn("hits", F.filter("hits", lambda h: ~F.coalesce(F.array_contains(out, h["before"]), F.lit(False)) & ~F.coalesce(F.array_contains(out, h["after"]), F.lit(False))))
    by_row = left.select("half", "y", F.explode("hits").alias("h")).select("half", "y", "h.*")
    support = by_row.filter("y > 0").groupBy("term", "half").agg(F.count_distinct("before").alias("b"), F.count_distinct("after").alias("a"))
    terms = F.array_distinct(F.transform("hits", lambda h: h["term"]))
    again = left.select("half", "y", F.explode(terms).alias("term")).groupBy("term", "half").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    counts: dict[int, dict[str, tuple[float, float]]] = {0: {}, 1: {}, 2: {}}
    for r in again.join(support, ["term", "half"], "left").collect():
        got = min(r["t"], r["b"] or 0, r["a"] or 0), r["c"]
        counts[r["half"]][r["term"]] = got
        t, c = counts[2].get(r["term"], (0.0, 0.0))
        counts[2][r["term"]] = (t + got[0], c + got[1])
    model = Model(selected(counts[2], all_toxic, all_clean, among, TERM_WEIGHT) | given)
    model.exceptions = sorted({*phrases, *(p for t, p in excepted if t in model.terms)})
    other = [selected(counts[1 - h], *total[1 - h], among, TERM_WEIGHT) | given for h in (0, 1)]

    bins = left.mapInArrow(partial(_weighed, terms=other), "bin long, y double")
    bins = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).orderBy("bin").collect()
    # one row of the mean label besides, so that a few rows don't make a certainty
    model.bins = [r["bin"] for r in bins]
    model.values = calibrated(np.array([r["n"] for r in bins], float), np.array([r["t"] for r in bins], float), base)
    return model


def _scored(batches: Iterator[pa.RecordBatch], *, model: Model, names: list[str], matches: bool) -> Iterator[pa.RecordBatch]:
    matcher = model.matcher()
    for batch in batches:
        scores, found = [], []
        for text in batch.column(batch.num_columns - 1):
            words = folded(text.as_py())
            hits = matcher(words)[0]
            scores.append(model.score(model.weight(hits, len(words))))
            found.append(sorted({t.strip() for _, t in hits}))
        columns = [*batch.columns[:-1], pa.array(scores, pa.float64())]
        if matches:
            columns.append(pa.array(found, pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def score_texts(df: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", out: str = "score", matches: str | None = None) -> DataFrame:
    """The columns `keep` (all, if none are named) and the score; with `matches` also a column of that name, the folded terms found.

    Existing columns named like these are replaced.
    """
    new = [out, *([matches] if matches else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {x.lower() for x in new}]
    (t,) = fresh(df.select(*[f"`{c}`" for c in kept]), "_text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(t))
    fields = [df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())]
    if matches:
        fields.append(T.StructField(matches, T.ArrayType(T.StringType())))
    schema = T.StructType(fields)
    return rows.mapInArrow(partial(_scored, model=model, names=schema.names, matches=bool(matches)), schema)
