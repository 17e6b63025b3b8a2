"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm._common import cut, written
from shoebox.llm.wordhash import blocks

#: Labelled rows that the text model is fitted on, at most, taken by the hash of their text; and tasks that count them.
SAMPLE, FIT_TASKS = 4000, 8
BUCKETS_BITS = 15
#: A text's evidence counts as that of this many trigrams at most, so that a long text cannot drown the rest.
EVIDENCE = 60
#: Pseudo-counts with which each level of the host hierarchy is drawn to the level above, and declared tags to a uniform one.
PRIOR, TAG_PRIOR = 8.0, 2.0
#: Share of the prior that is left to "no known language", and the probability below which a document is rejected.
NO_LANGUAGE, ACCEPT = 0.01, 0.5
UNKNOWN = "und"

_HIDDEN = re.compile(r"<(script|style)\b", re.IGNORECASE)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _trigrams(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters of a block of lower-cased texts (words parted by one space) and each one's text."""
    data = np.frombuffer(b" " + b" ".join(encoded) + b" ", np.uint8)
    at = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in encoded], out=at[1:])
    chars = np.where(_LETTER[data], data, 32)
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    place, c = np.flatnonzero(keep), chars[keep].astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = c[:-2] << 16 | c[1:-1] << 8 | c[2:]
    gram = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_BITS)
    doc = np.minimum(np.searchsorted(at, place - 1, side="right") - 1, len(encoded) - 1)
    inside = (c[1:-1] != 32) | (doc[:-2] == doc[2:])  # a trigram around the space between two texts is of neither
    return gram.astype(np.int64)[inside], doc[1:-1][inside]


def fit(labelled: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities of hashed trigrams, a column a language; the last column is no language.

    Fitted on at most ``sample`` labelled rows; rows with a null text or language are left out, equal texts of
    one language count once.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.lower(F.substring(F.trim(F.col(lang_col)), 1, 2)).alias("lang")).where("text is not null and lang rlike '^[a-z]{2}$'")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # hashes are chosen before texts are kept, so that no task gathers the first texts of all tasks
    last = rows.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    rows = rows.where(F.col("hash") <= F.lit(last).cast("long")).groupBy("hash", "lang").agg(F.min("text").alias("text"))
    rows = written(rows.orderBy("hash", "lang").limit(sample).select("text", "lang").repartition(FIT_TASKS))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                total = np.zeros(1 << BUCKETS_BITS, np.int64)
                for _, _, encoded in blocks([t.lower() for t in own["text"]]):
                    total += np.bincount(_trigrams(encoded)[0], minlength=1 << BUCKETS_BITS)
                some = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "gram": some, "n": total[some]})

    counts = rows.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((1 << BUCKETS_BITS, len(langs) + 1), 0.5)
    if langs:
        table[counts["gram"], np.searchsorted(langs, counts["lang"])] += counts["n"]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def likelihoods(rows: DataFrame, langs: list[str], table: np.ndarray, evidence: int = EVIDENCE) -> DataFrame:
    """Adds ``ll``: tempered log-likelihoods of the column ``text``, one a language and one for none; drops ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text") + ", ll array<double>, grams long"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ll, grams = np.zeros((len(pdf), len(langs) + 1)), np.zeros(len(pdf), np.int64)
            for a, b, encoded in blocks([t.lower() if t else t for t in pdf["text"]]):
                gram, doc = _trigrams(encoded)
                n = np.bincount(doc, minlength=b - a)
                for k in range(len(langs) + 1):
                    ll[a:b, k] = np.bincount(doc, weights=shared.value[gram, k], minlength=b - a)
                ll[a:b] *= (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]
                grams[a:b] = n
            out = pdf[kept].copy()
            out["ll"], out["grams"] = list(ll), grams
            yield out

    return rows.mapInPandas(score, schema)


def _normal(logs: Column) -> Column:
    """exp of ``logs``, divided by their sum."""
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, prior: float = PRIOR, evidence: int = EVIDENCE) -> DataFrame:
    """Adds ``language``, ``probability``, ``text_language`` to ``rows`` with columns ``row``, ``text``, ``declared``, ``host``.

    Evidence: the text's trigram likelihood; the declared language, by how often each tag goes with each
    language; and the host's prior, smoothed to that of its registered name, that to its address suffix and
    that to all rows.  A text's likelihood counts as that of ``evidence`` trigrams at most, however long it is.  Priors are grouped sums of what the texts say, each row's own part taken out.  A row
    without letters has text evidence for none; a null or empty host uses all rows; a null or malformed tag is
    a tag of its own.  ``language`` is "und" where no known language leads.  A model without languages says
    "und" for every row.
    """
    k = len(langs) + 1
    d = rows.select("row", "text", F.coalesce(F.nullif(F.regexp_extract(F.lower("declared"), r"^\s*([a-z]{2})(?:[-_].*)?\s*$", 1), F.lit("")), F.lit("?")).alias("tag"), F.lower(F.coalesce("host", F.lit(""))).alias("host"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    d = d.withColumn("domain", F.when(n >= 2, F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")).otherwise(F.col("host"))).withColumn("suffix", F.element_at(labels, -1))
    d = likelihoods(d, langs, table, evidence)
    start = F.array(*[F.lit(float(np.log((1 - NO_LANGUAGE) / max(1, k - 1))))] * (k - 1), F.lit(float(np.log(NO_LANGUAGE))))
    d = d.withColumn("own", _normal(F.zip_with("ll", start, lambda a, b: a + b)))
    # half a millionth steps: sums of whole numbers do not depend on the order in which rows arrive
    d = written(d.withColumn("own", F.transform("own", lambda x: F.round(x * 2_000_000).cast("long"))))
    parts = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)]
    sums = lambda *by: d.groupBy(*by).agg(F.array(*parts).alias("s"))
    less = lambda s: F.zip_with(s, F.col("own"), lambda a, b: (a - b) / F.lit(2_000_000.0))
    of = lambda s: F.aggregate(s, F.lit(0.0), lambda a, y: a + y)

    def drawn(s: Column, above: Column) -> Column:
        return F.zip_with(s, above, lambda a, b: (a + F.lit(prior) * b) / (of(s) + F.lit(prior)))

    whole = F.array(*[F.lit(v or 0).cast("long") for v in d.agg(*parts).first()])  # one number a language
    everywhere = F.array(*[F.lit(1.0 / k)] * k)
    x = d.withColumn("p", drawn(less(whole), everywhere))
    # a host fixes its registered name and that its suffix, so all levels' sums come to a row by one join
    hosts = cut(sums("suffix", "domain", "host"))
    above = lambda level: hosts.groupBy(level).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s")).select(F.col(level).alias("_key"), F.col("s").alias(f"s_{level}"))
    levels = hosts.withColumnRenamed("s", "s_host")
    for level in ("suffix", "domain"):
        levels = levels.join(above(level), F.col(level) == F.col("_key")).drop("_key")
    x = x.join(levels.select(F.col("host").alias("_host"), "s_suffix", "s_domain", "s_host"), F.col("host") == F.col("_host"))
    for level in ("suffix", "domain", "host"):
        x = x.withColumn("p", F.when(F.col("host") == "", F.col("p")).otherwise(drawn(less(F.col(f"s_{level}")), F.col("p")))).drop(f"s_{level}")
    tags = cut(sums("tag").select(F.col("tag").alias("_tag"), F.col("s").alias("t")))  # two letters or "?": 677 rows at most
    x = x.join(F.broadcast(tags), F.col("tag") == F.col("_tag"))
    says = F.zip_with(less(F.col("t")), less(whole), lambda a, b: (a + F.lit(TAG_PRIOR / 100)) / (b + F.lit(TAG_PRIOR)))
    logs = F.zip_with(F.zip_with("ll", "p", lambda a, b: a + F.log(b)), says, lambda a, b: a + F.log(b))
    x = x.withColumn("post", F.transform(_normal(logs), lambda v: F.round(v, 6)))
    names = F.array(*[F.lit(v) for v in [*langs, UNKNOWN]])
    lead = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    none = F.col("grams") == 0
    return x.select("row", F.when(none, F.lit(UNKNOWN)).otherwise(lead(F.col("post"))).alias("language"), F.when(none, F.lit(0.0)).otherwise(F.array_max("post")).alias("probability"), F.when(none, F.lit(UNKNOWN)).otherwise(lead(F.col("own"))).alias("text_language"))


def visible(html: str) -> str:
    """A page's text: scripts, styles, comments and tags taken out, entities as their signs.  What is never closed is text.

    One pass from sign to sign: whatever is missing once is not looked for again, so time grows with the page alone.
    """
    out, at, missing = [], 0, set()
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if "comment" not in missing and html.startswith("<!--", i):
            end = html.find("-->", i + 4) + 3
            if end < 3:
                missing.add("comment")
                end = -1
        elif (m := _HIDDEN.match(html, i)) and m[1].lower() not in missing:
            closed = _CLOSED[m[1].lower()].search(html, m.end())
            if closed:
                end = closed.end()
            else:
                missing.add(m[1].lower())
        if end < 0:
            end = html.find(">", i) + 1
            if not end:
                at = i
                break
        at = end
    return unescape(" ".join([*out, html[at:]])).replace("\xa0", " ")


def declared_language(html: str) -> str:
    """The language that the first html tag with one declares, or ""."""
    at = 0
    while m := _HTML.search(html, at):
        at = html.find(">", m.end())
        at = len(html) if at < 0 else at
        if named := _LANG.search(html, m.end(), at):
            return named[1]
    return ""


def page_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``row``, ``text`` (markup taken out), ``declared``, ``host`` of web pages; ``row`` is the page's id."""

    @F.pandas_udf("text string, declared string")
    def parts(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": pd.Series([None if h is None else visible(h) for h in html], dtype=object), "declared": pd.Series([None if h is None else declared_language(h) for h in html], dtype=object)})

    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(F.col(id_col).cast("long").alias("row"), parts(F.col(html_col)).alias("p"), host.alias("host")).select("row", "p.text", "p.declared", "host")


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """``page_id``, ``language``, ``probability``, ``text_language`` for each row of ``pages``.

    The text model is fitted on a bounded sample of ``labelled`` (columns ``text``, ``lang``).  Null or empty
    pages are "und" with probability 0; repeated rows stay; empty tables give empty results.
    """
    return identify(page_parts(pages), *fit(labelled)).withColumnRenamed("row", "page_id")


def accepted(docs: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", declared_col: str | None = None, host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with probability at least ``accept``.

    Rejected are rows without letters and rows for which no known language leads.  The text model is fitted on a
    bounded sample of rows with ``label_col``, which is no evidence of a row's language; ``declared_col`` is, where
    the rows have one that is not the label.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.md5(text_col).alias("md5")).alias("row"), F.col(text_col).alias("text"), (F.lit(None) if declared_col is None else F.col(declared_col)).cast("string").alias("declared"), F.col(host_col).cast("string").alias("host"))
    found = identify(rows, *fit(docs, sample, text_col, label_col))
    bad = found.where((F.col("language") == UNKNOWN) | (F.col("probability") < accept)).select("row.id", "row.md5").distinct().alias("bad")
    return docs.alias("docs").join(bad, F.col(f"docs.{id_col}").cast("long").eqNullSafe(F.col("bad.id")) & F.md5(F.col(f"docs.{text_col}")).eqNullSafe(F.col("bad.md5")), "left_anti")
