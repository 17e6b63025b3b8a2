"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick after folding."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm._common import cut, written

#: Labelled rows that lexicon and curve are fitted on, at most; taken by the hash of their text.
SAMPLE = 24_000
#: Terms and exception phrases of the lexicon, at most.
TERMS = 2_000
THRESHOLD = 0.7
#: A term is in at least this many toxic sample texts; its log-odds, and these times the root of that number, are at least so high.
LEAST_TEXTS, LEAST_ODDS, LEAST_SIGNAL = 4, 1.5, 8.0
#: A longer term joins the stem it begins with only where its log-odds are higher by this much.
MORE_ODDS = 0.7
STEM, LONGEST_STEM = 4, 9

# Characters that look like a Latin letter, and digits and signs written for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}


class _Fold(dict):
    """A table for str.translate: letters of other looks to a to z, all else to a space; made up as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        out = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", HOMOGLYPHS.get(c, c)).lower() if not unicodedata.combining(x))
        if unicodedata.combining(c[0]) or unicodedata.category(c[0]) == "Cf":
            out = ""
        else:
            out = "".join(SUBSTITUTES.get(x, x) for x in out)
            out = out if out and all(x.isalpha() for x in out) else " "
        self[code] = out
        return out


_FOLD = _Fold()
#: Signs around a word; and those of them that are not written for a letter.
_OUTER = "!$@|.,;:?'\"()[]{}*#%&-_"
_OUTER_BUT_LETTERS = _OUTER.replace("$", "").replace("@", "")


def fold(text: str | None) -> str:
    """Words of a to z (and letters without a Latin look) parted by single spaces, one space at both ends.

    Upper case, accents, look-alike letters, full-width forms and invisible characters are folded away; digits
    and signs that stand for letters become them, except that signs at a word's end or without a letter beside
    them part words.  A word with ``$`` or ``@`` right before or after it stands twice: without it, and with it as
    the letter it may be meant for.
    """
    words = []
    for w in (text or "").split():
        core = w.strip(_OUTER) if not w.isalnum() else w
        if core and any(x.isalpha() for x in core):
            words.append(core.translate(_FOLD))
            if len(core) < len(w):
                wide = w.strip(_OUTER_BUT_LETTERS)
                if len(wide) > len(core) and core[0].isalpha() and core[-1].isalpha():
                    words.append(wide.translate(_FOLD))
    return " " + " ".join(" ".join(words).split()) + " "


@dataclass
class Lexicon:
    """Terms with weights (" word " is a whole word, " stem" the beginning of one), exceptions, and the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton | None:
        terms = ahocorasick.Automaton()
        for t, w in self.weights.items():
            terms.add_word(t, (t, w))
        for t in self.exceptions:
            terms.add_word(t, (t, None))
        if not len(terms):
            return None
        terms.make_automaton()
        return terms


def _matched(folded: str, terms: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Sum of the weights of terms outside exception phrases, and the number of words.  A word counts once, by its heaviest term."""
    if terms is None:
        return 0.0, folded.count(" ") - 1
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (t, w) in terms.iter(folded):
        begin = end - len(t) + 1
        if w is None:
            spared.append((begin, end))
        elif w > at.get(begin, 0.0):
            at[begin] = w
    if spared and at:
        spared.sort()
        begins, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        inside = lambda b: (i := bisect_right(begins, b)) > 0 and reach[i - 1] > b
        at = {b: w for b, w in at.items() if not inside(b)}
    return sum(at.values()), folded.count(" ") - 1


def _features(weight: float, words: int) -> tuple[float, float]:
    """What the curve sees: the weight found, and the weight for a thousand words."""
    return np.log1p(weight), np.log1p(1000.0 * weight / (words + 20))


def _score(weight: float, words: int, curve: tuple[float, float, float]) -> float:
    a, b = _features(weight, words)
    return float(1.0 / (1.0 + np.exp(-np.clip(curve[0] + curve[1] * a + curve[2] * b, -30, 30))))


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(STEM, min(len(w), LONGEST_STEM + 1)))
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many toxic and other texts of a batch each term occurs."""
    for pdf in batches:
        n = {0: Counter(), 1: Counter()}
        for t, y in zip(pdf["text"], pdf["toxic"], strict=True):
            n[y].update(_terms(fold(t)))
        terms = list(n[0] | n[1])
        yield pd.DataFrame({"term": terms, "n0": [n[0][t] for t in terms], "n1": [n[1][t] for t in terms]})


def _closed(found: pd.DataFrame) -> list[str]:
    """Of terms that begin alike, the longest that says as much: a stem shared by many words, else the word."""
    n1 = dict(zip(found["term"], found["n1"], strict=True))
    odds = dict(zip(found["term"], found["odds"], strict=True))
    longer: dict[str, int] = {}
    for t in n1:
        longer[t[:-1]] = max(longer.get(t[:-1], 0), n1[t])
    kept: dict[str, float] = {}
    for t in sorted(n1, key=lambda t: (len(t), t)):
        above = max((kept[b] for n in range(STEM + 1, len(t)) if (b := t[:n]) in kept), default=0.0)
        explained = not t.endswith(" ") and longer.get(t, 0) >= 0.9 * n1[t]
        if not explained and odds[t] >= above + MORE_ODDS * (above > 0):
            kept[t] = odds[t]
    return list(kept)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``text``, ``toxic`` of at most ``sample`` labels, by the hash of their ids, and the rows with those ids.

    The ids are chosen before texts are read, so only the sample's texts are kept; its ids are few enough to be
    broadcast.  Rows with a null text or label are left out; of several labels of an id all count.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    known = cut(known.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text")).where("text is not null")
    return written(rows.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "toxic"))


def fit(rows: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon learned from a bounded sample of rows with ``text`` and ``toxic``, as ``labelled_sample`` gives them.

    Term counts are grouped by Spark; terms that reach the driver are at most TERMS, and the curve is fitted on
    two numbers a sample row.  Exception phrases are ``exceptions`` and learned ones: a term with the word before
    or after it, where the sample has the phrase in at least three other texts and in more of those than in
    toxic ones.  Without toxic rows the lexicon is empty.
    """
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    fixed = tuple(fold(e) for e in exceptions if fold(e).strip())
    if not n1:
        return Lexicon({}, fixed, (-6.0, 0.0, 0.0))
    counts = rows.mapInPandas(_counted, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.25) / (n1 + 0.5)) - F.log((F.col("n0") + 0.25) / (n0 + 0.5))
    found = counts.withColumn("odds", odds).withColumn("signal", F.col("odds") * F.sqrt("n1"))
    found = found.where((F.col("n1") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS) & (F.col("signal") >= LEAST_SIGNAL))
    found = found.orderBy(F.col("signal").desc(), "term").limit(TERMS).toPandas()
    kept = set(_closed(found))
    weights = {t: float(w) for t, w in zip(found["term"], found["odds"], strict=True) if t in kept}
    lexicon = Lexicon(weights, fixed, (0.0, 0.0, 0.0))

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = lexicon.automaton()
        for pdf in batches:
            n = {0: Counter(), 1: Counter()}
            for t, y in zip(pdf["text"], pdf["toxic"], strict=True):
                f, seen = fold(t), set()
                for end, (term, _) in terms.iter(f) if terms else ():
                    begin = end - len(term) + 1
                    stop = f.find(" ", begin + 1)
                    left, right = f.rfind(" ", 0, begin), f.find(" ", stop + 1)
                    seen.update(f[a : b + 1] for a, b in ((left, stop), (begin, right)) if a >= 0 and b > 0)
                n[y].update(seen)
            some = [p for p, k in n[0].items() if k] + [p for p in n[1] if p not in n[0]]
            yield pd.DataFrame({"phrase": some, "n0": [n[0][p] for p in some], "n1": [n[1][p] for p in some]})

    spared = rows.mapInPandas(phrases, "phrase string, n0 long, n1 long").groupBy("phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 >= 3 and n0 > n1")
    lexicon.exceptions = fixed + tuple(r["phrase"] for r in spared.orderBy(F.col("n0").desc(), "phrase").limit(TERMS).collect())

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = lexicon.automaton()
        for pdf in batches:
            x = [_features(*_matched(fold(t), terms)) for t in pdf["text"]]
            yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "toxic": pdf["toxic"]})

    lexicon.curve = _logistic(rows.mapInPandas(measured, "a double, b double, toxic int").toPandas())
    return lexicon


def _logistic(rows: pd.DataFrame, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression on two features."""
    x = np.column_stack([np.ones(len(rows)), rows["a"], rows["b"]])
    y, w = rows["toxic"].to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` for each row of ``docs``.

    Whole texts are folded and matched; a text without words (empty, blank or null) scores as one in which
    nothing is found.  ``held_out`` is whether the CRC-32 of the id as text leaves 1 when divided by 3 (false
    for a null id); it is no input of the score.  Repeated rows stay, an empty table gives an empty one, other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most TERMS terms and twice as many phrases

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, curve = shared.value.automaton(), shared.value.curve
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [_score(*_matched(fold(t), terms), curve) for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of every row of ``docs`` by a lexicon fitted on labelled rows that are not held out.

    ``labels`` has ``doc_id`` and ``toxic``; several labels of one id count as so many rows.
    """
    known = labels.select("doc_id", "toxic").where(~held_out("doc_id"))
    return score(docs, fit(labelled_sample(docs, known)))
