"""The fusion of language evidence against the same sums in NumPy, and markup of any length."""

import time
from collections import defaultdict

import numpy as np
import pytest

from shoebox.llm import language_id as li

ROWS = "row long, text string, declared string, host string, lang string"


def test_markup_is_read_in_one_pass():
    for sign in ("<", "<!--", "<script", "<style ", "<html ", "<script>", "</script ", "&", "<html lang"):
        began = time.perf_counter()
        page = sign * (1_000_000 // len(sign))
        li.visible(page)
        li.declared_language(page)
        assert time.perf_counter() - began < 3, sign
    assert li.visible("a < b").split() == ["a", "<", "b"] and li.visible("") == ""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>L&eacute;t&eacute;&nbsp;est</p>", "Lété est"),
        ("a<script>x = '<b>'</SCRIPT >b<!-- <i> -->c", "a b c"),
        ("a<STYLE>p{}</style>b<br/>c", "a b c"),
        ("open <script> stays", "open stays"),
        ("open <!-- stays > here", "open here"),
        ("<scripted>x</scripted>", "x"),
    ],
)
def test_text_of_a_page(html, text):
    assert " ".join(li.visible(html).split()) == text


def test_declared_language_is_that_of_the_first_tag_with_one():
    assert li.declared_language("<HTML class=x><html data-x=1 LANG = 'fr-CA'>") == "fr-CA"
    assert li.declared_language("<p lang=en>") == "" and li.declared_language("<html lang=de") == "de"


def naive(rows, langs, table, prior, evidence):
    k = len(langs) + 1
    start = np.log([(1 - li.NO_LANGUAGE) / max(1, k - 1)] * (k - 1) + [li.NO_LANGUAGE])
    normal = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    import re

    seen = []
    for row, text, declared, host in rows:
        gram, _ = li._trigrams([(text or "").lower().encode()])
        ll = np.array([table[gram, j].astype(float).sum() for j in range(k)]) * min(len(gram), evidence) / max(len(gram), 1)
        own = np.floor(normal(ll + start) * 2_000_000 + 0.5)
        m = re.match(r"\s*([a-z]{2})(?:[-_].*)?\s*$", (declared or "").lower())
        host = (host or "").lower()
        seen.append((row, ll, own, len(gram), m[1] if m else "?", [host.split(".")[-1], ".".join(host.split(".")[-2:]), host]))
    sums = defaultdict(lambda: np.zeros(k))
    for _, _, own, _, tag, levels in seen:
        for key in [("all",), ("tag", tag), *enumerate(levels)]:
            sums[key] += own
    out = {}
    for row, ll, own, n, tag, levels in seen:
        less = lambda key: (sums[key] - own) / 2_000_000  # noqa: E731, B023
        p = (less(("all",)) + prior / k) / (less(("all",)).sum() + prior)
        for key in enumerate(levels):
            p = (less(key) + prior * p) / (less(key).sum() + prior) if levels[2] else p
        says = (less(("tag", tag)) + li.TAG_PRIOR / 100) / (less(("all",)) + li.TAG_PRIOR)
        post = np.round(normal(ll + np.log(p) + np.log(says)), 6)
        out[row] = (li.UNKNOWN, 0.0) if not n else ([*langs, li.UNKNOWN][int(post.argmax())], post.max())
    return out


@pytest.mark.parametrize("evidence", [li.EVIDENCE, 5])
def test_fusion_equals_the_same_sums_in_numpy(spark, evidence):
    said = {"en": "the house and the garden were old and quiet", "de": "das haus und der garten waren alt und still", "fr": "la maison et le jardin étaient vieux et calmes"}
    train = spark.createDataFrame([(0, t, None, None, lang) for lang, t in said.items()], ROWS)
    langs, table = li.fit(train)
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        words = said[lang].split()
        text = None if i == 7 else "12 34" if i == 8 else " ".join(words[i % 5 : i % 5 + 1 + i % 4])
        host = None if i % 13 == 0 else f"{'www' if i % 2 else 'a'}.site{i % 4}.{'com' if i % 5 else lang}"
        rows.append((i, text, [None, lang, f"{lang.upper()}-XX", "nonsense"][i % 4], host))
    df = spark.createDataFrame([(*r, None) for r in rows], ROWS).repartition(3)
    got = {r["row"]: (r["language"], r["probability"]) for r in li.identify(df, langs, table, evidence=evidence).collect()}
    want = naive(rows, langs, table, li.PRIOR, evidence)
    assert got.keys() == want.keys()
    for row, (language, p) in want.items():
        assert got[row][1] == pytest.approx(p, abs=2e-5) and (got[row][0] == language or p < 0.51), row
