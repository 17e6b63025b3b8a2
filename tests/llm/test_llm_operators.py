"""Each operator against a brute-force version or an exact property, and its edge cases, on small tables."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from shoebox.llm import decontaminate, graph, hamming_topk, language_id, line_dedup, mixing, sharding, simhash_dedup, substring_dedup, token_counts, toxicity, wordhash

WORDS = [a + b + c for a in "ba ko mi ru se ta".split() for b in "la no vi".split() for c in "x zu de".split()]
DOCS = "doc_id long, text string, lang string, source string, size int, _id string, row int"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    full = [(i, t, "en", s, 7, "x", 1) for i, t, s in [r if len(r) == 3 else (*r, "s") for r in rows]]
    return spark.createDataFrame(full, DOCS).repartition(3)


ODD = [(None, "a null id"), (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "same text twice"), (5, "same text twice"), (6, "same text twice"), (7, "é" * 50), (8, "long " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# ---- 1


def test_passages_find_what_repeats_and_leave_the_rest(spark):
    rnd = random.Random(1)
    text = {i: prose(rnd, 150).split() for i in range(12)}
    shared = prose(rnd, 55).split()
    for i in (2, 5, 9):
        text[i][40:40] = shared
    fuzzy = list(shared)
    fuzzy[10], fuzzy[40] = "edited", "edited"
    text[7][90:90] = fuzzy
    rows = [(i, " ".join(w)) for i, w in text.items()] + [(20, " ".join(text[3])), (21, None), (22, ""), (None, " ".join(text[3]))]
    d = docs(spark, rows)
    found = substring_dedup.passages(d).collect()
    assert {r["doc_id"] for r in found} == {5, 7, 9, 20}
    by = dict(rows)
    for r in found:
        a, b = by[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode(), by[r["other_id"]].encode()[r["other_start"] : r["other_end"]].decode()
        assert r["similarity"] >= 0.8 and (a == b or r["doc_id"] == 7 or r["other_id"] == 7)
        assert a.split()[0] == (text[3] if r["doc_id"] == 20 else shared)[0] and abs(len(a.split()) - r["n_words"]) == 0
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_passages(d, substring_dedup.passages(d)).collect()}
    assert left[20].split() == [] and " ".join(shared) not in left[9] and left[2] == by[2]


def test_passages_of_hot_seeds_that_neither_first_nor_last_holders_have_whole(spark):
    rnd = random.Random(11)
    own = lambda n: " ".join(f"{rnd.randrange(10**6)}x" for _ in range(n))
    shared = own(60).split()
    head, tail = " ".join(shared[:44]), " ".join(shared[16:])
    around = lambda x: f"{own(50)} {x} {own(50)}"
    many = [(i, around(head)) for i in [1, *range(100, 120)]] + [(i, around(tail)) for i in [2, *range(200, 220)]]
    rows = [*many, (50, around(" ".join(shared))), (70, around(" ".join(shared)))]
    found = substring_dedup.passages(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["other_id"], r["n_words"]) for r in found if r["n_words"] >= 60} == {(70, 50, 60)}


@pytest.mark.parametrize("together", [1, 2])
def test_edited_copies_of_passages_made_of_hot_seeds_alone(spark, together):
    """Pieces of the passage are each in very many documents; only two hold it whole, and each has edits of its own."""
    rnd = random.Random(21)
    own = lambda n: " ".join(f"{rnd.randrange(10**6)}x" for _ in range(n))
    pieces = [own(15) for _ in range(4)]
    edited = lambda parts: "".join(f"{x} {own(2)} " for x in parts)
    many = [edited(pieces[k : k + together]) for k in range(5 - together) for _ in range(20)]
    ids = rnd.sample([*range(1, 50), *range(51, 70), *range(71, 90)], len(many))
    rows = [(i, f"{own(50)} {x} {own(50)}") for i, x in zip(ids, many, strict=True)] + [(i, f"{own(50)} {edited(pieces)} {own(50)}") for i in (50, 70)]
    assert {(r["doc_id"], r["other_id"]) for r in substring_dedup.passages(docs(spark, rows)).collect()} == {(70, 50)}


@pytest.mark.parametrize("similar", [0.8, 0.85, 0.9])
def test_passages_are_found_down_to_the_similarity_claimed(spark, similar):
    rnd = random.Random(12)
    own = lambda n: [f"{rnd.randrange(10**5)}x" for _ in range(n)]
    rows = []
    for i in range(60):
        a = own(50)
        b = list(a)
        for k in rnd.sample(range(1, 49), round(50 * (1 - similar))):
            b[k] = "edited"
        rows += [(2 * i, " ".join(own(50) + a + own(50))), (2 * i + 1, " ".join(own(50) + b + own(50)))]
    found = {r["doc_id"] for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert len(found) >= 57 and all(i % 2 for i in found)


def test_every_copy_inside_a_document_goes(spark):
    rnd = random.Random(13)
    own = lambda n: " ".join(f"{rnd.randrange(10**6)}x" for _ in range(n))
    shared, line = own(60), own(7)
    rest = [own(30) for _ in range(4)]
    rows = [(1, f"{own(30)} {shared} {own(30)}"), (2, f"{rest[0]} {shared} {rest[1]} {shared} {rest[2]} {shared} {rest[3]}")]
    rows += [(3, "word " * 500), (4, "word " * 1520), (5, f"{line}\n" * 40), (6, f"{line}\n" * 130)]
    d = docs(spark, rows)
    left = {r["doc_id"]: r["text"].split() for r in substring_dedup.without_passages(d, substring_dedup.passages(d)).collect()}
    assert left[2] == " ".join(rest).split() and left[1] == rows[0][1].split() and len(left[3]) == 500 and len(left[5]) == 280
    assert left[4] == [] and left[6] == []


def test_long_words_and_runs_without_spaces_lose_nothing(spark):
    rnd = random.Random(15)
    own = lambda n: " ".join(f"{rnd.randrange(10**6)}x" for _ in range(n))
    latin, runs = (" ".join(rnd.choice("abc汉字語"[k : k + 3]) * 40 + str(i) for i in range(60)) for k in (0, 3))
    rows = [(1, f"{own(40)} {latin} {own(40)}"), (2, f"{own(30)} {latin} {own(30)}"), (3, f"{own(40)} {runs} {own(40)}"), (4, f"{own(20)} {runs}")]
    found = substring_dedup.passages(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["other_id"], r["n_words"]) for r in found} == {(2, 1, 60), (4, 3, 60)}


def test_versions_of_one_id_are_both_compared(spark):
    rnd = random.Random(16)
    own = lambda n: " ".join(f"{rnd.randrange(10**6)}x" for _ in range(n))
    shared = own(60)
    rows = [(1, f"{own(30)} {shared}"), (2, f"{shared} {own(30)}"), (2, f"{own(50)} {shared}"), (3, own(90))]
    found = {(r["doc_id"], r["other_id"], r["start_byte"]) for r in substring_dedup.passages(docs(spark, rows)).collect()}
    assert found == {(2, 1, 0), (2, 1, len(rows[2][1]) - len(shared))}


def test_a_seed_of_very_many_documents_is_paired_with_little_held():
    import pandas as pd

    n = 5000
    rows = pd.DataFrame({"seed": [7] * n + [9, 9], "doc": [*range(n), 3, 8], "at": 1 << 32, "run": 1})
    whole = pd.concat(substring_dedup._links(iter([rows])))
    parts = pd.concat(substring_dedup._links(rows.iloc[i : i + 300] for i in range(0, len(rows), 300)))
    pairs = lambda x: Counter(zip(x["later"], x["earlier"], x["hot"], strict=True))
    want = Counter((i, 0, True) for i in range(n)) + Counter((i, 0, False) for i in range(1, n)) + Counter((i, i - 1, False) for i in range(2, n)) + Counter([(8, 3, False)])
    assert pairs(whole) == pairs(parts) == want


def test_only_the_first_document_of_a_hot_seed_is_marked_as_first():
    """Its places wait for no earlier document, so they ask for no keys."""
    import pandas as pd

    rows = pd.DataFrame({"seed": 7, "doc": [i // 2 for i in range(2000)], "run": [i % 2 << 40 | 1 for i in range(2000)]})
    found = pd.concat(substring_dedup._links(rows.iloc[i : i + 300] for i in range(0, len(rows), 300)))
    marks = found[found["hot"]]
    assert len(marks) == 2000 and sorted(marks["later"][marks["n"] >= substring_dedup._FIRST]) == [0, 0]


def test_a_key_of_very_many_documents_makes_two_pairs_a_document():
    import pandas as pd

    n = 5000
    rows = pd.DataFrame({"key": [7] * n + [9, 9, 9], "doc": [*range(n), 3, 8, 9], "asked": [*[True] * (n + 1), False, True], "at0": 5, "at1": 30})
    whole = pd.concat(substring_dedup._key_pairs(2)(iter([rows])))
    parts = pd.concat(substring_dedup._key_pairs(2)(rows.iloc[i : i + 300] for i in range(0, len(rows), 300)))
    pairs = lambda x: Counter(zip(x["later"], x["earlier"], x["l_at"], strict=True))
    once = Counter((i, 0) for i in range(1, n)) + Counter((i, i - 1) for i in range(2, n)) + Counter([(9, 3), (9, 8)])
    want = Counter({(l, e, at): k for (l, e), k in once.items() for at in (5, 30)})
    for got in (whole, parts):
        assert pairs(got[~got["hot"]]) == want and set(got["e_at"][got["hot"]]) == {7}


def test_passages_against_a_quadratic_aligner(spark):
    """Every equal run of LEAST_WORDS words of two documents lies in a passage of the later one."""
    rnd = random.Random(17)
    own = lambda n: [f"{rnd.randrange(300)}x" for _ in range(n)]
    pool = [own(rnd.choice([46, 60, 90])) for _ in range(12)]
    rows = [(i, " ".join(sum(([*own(rnd.randrange(20)), *rnd.choice(pool)] for _ in range(rnd.randrange(1, 4))), []))) for i in range(50)]
    spans = {}
    for r in substring_dedup.passages(docs(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        spans.setdefault(r["doc_id"], set()).update(range(len(text[: r["start_byte"]].split()), len(text[: r["end_byte"]].split())))
    seen = set()
    for i, text in rows:
        w = text.split()
        runs = [tuple(w[k : k + 45]) for k in range(len(w) - 44)]
        want = {k + j for k, r in enumerate(runs) if r in seen for j in range(45)}
        assert want <= spans.get(i, set()), i
        seen.update(runs)


def chain_score(own, l, e, n):
    gaps = sum(l[b] - l[a] - n[a] + e[b] - e[a] - n[a] for a, b in zip(own, own[1:], strict=False))
    return sum(n[i] for i in own) - substring_dedup.GAP_COST * gaps


def test_chain_is_the_best_of_all_chains():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(60):
        part = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(rnd.randrange(2, 8))})
        l, e, n = np.array([p[0] for p in part]), np.array([p[1] for p in part]), np.full(len(part), 5)
        got = substring_dedup.chain(l, e, n)
        assert sorted(i for c in got for i in c) == list(range(len(part)))
        goes = lambda c: all(l[b] >= l[a] + 5 and e[b] >= e[a] + 5 for a, b in zip(c, c[1:], strict=False))
        assert all(goes(c) for c in got)
        every = [c for m in range(1, 2 ** len(part)) if goes(c := [i for i in range(len(part)) if m >> i & 1])]
        wide = any(l[b] - l[a] - 5 > substring_dedup.MOST_GAP or e[b] - e[a] - 5 > substring_dedup.MOST_GAP for a in range(len(part)) for b in range(len(part)))
        if not wide:  # a chain is parted at wide gaps only
            assert max(chain_score(c, l, e, n) for c in got) == pytest.approx(max(chain_score(c, l, e, n) for c in every))


def test_passages_edges(odd, empty):
    assert {r["doc_id"] for r in substring_dedup.passages(odd).collect()} <= {5, 6, 8} and substring_dedup.passages(empty).count() == 0


# ---- 2


def test_token_counts_are_the_librarys(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tricky = ["a<|endoftext|>b c", "<|start oftext|> x<|startoftext|>", " ́a\té b", "İstanbul ΣΑΣ it's we'll\x0b1 23 ٣\r\nx", "a b c", "###$$$ %%% don't"]
    rows = ODD + [(100 + i, t) for i, t in enumerate(tricky)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs(spark, rows), path).collect())
    model = Tokenizer.from_file(path)
    n = [len(x.ids) for x in model.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True))
    assert token_counts.token_counts(empty, path).count() == 0
    piece = token_counts.token_counts(docs(spark, [(1, "Hello world"), (2, None)]), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert piece[0]["n_tokens"] > 0 and piece[1]["n_tokens"] == 0


# ---- 3


def words_of(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def test_contained_against_brute_force(spark, odd, empty):
    rnd = random.Random(3)
    items = [(i, prose(rnd, rnd.choice([3, 4, 6, 12, 30, 70]))) for i in range(40)] + [(90, ""), (91, None), (92, "same text twice"), (93, "what is entropy"), (94, "Antidisestablishmentarianism"), (95, "one two " * 30)]
    items.append((99, items[5][1]))
    rows = list(ODD)
    for i in range(60):
        w = prose(rnd, rnd.choice([20, 200, 900])).split()
        if i % 2:
            piece = items[i % 40][1].upper().split() if i % 4 == 1 else items[i % 40][1].split()
            if i % 3 == 0 and len(piece) > 20:
                piece[len(piece) // 2] = "edited"
            at = rnd.randrange(len(w))
            w[at:at] = [p + "," for p in piece]
        rows.append((100 + i, " ".join(w)))
    rows += [(300, "so here we ask: What is Entropy? and no more of it in these fourteen"), (301, "what was entropy"), (302, prose(rnd, 300) + " antidisestablishmentarianism " + prose(rnd, 30)), (303, "one two " * 31), (304, "one two one two one")]
    first = {}
    for i, t in items:
        if shingle_set(t):
            first.setdefault(frozenset(shingle_set(t)), i)
    held = lambda t, n: shingle_set(t) | {tuple(w[i : i + n]) for w in [words_of(t)] for i in range(len(w) - n + 1)}
    want = Counter((d, i) for d, t in rows for s, i in first.items() if len(s & held(t, len(next(iter(s))))) / len(s) >= 0.8)
    assert {(300, 93), (302, 94), (303, 95)} <= set(want)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = decontaminate.contained(docs(spark, rows), it)
    assert Counter((r["doc_id"], r["item_id"]) for r in found.collect()) == want and want
    kept = decontaminate.decontaminated(docs(spark, rows), it)
    bad = {d for d, _ in want}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad) and kept.columns == odd.columns
    assert decontaminate.contained(odd, it.limit(0)).count() == 0 and decontaminate.contained(empty, it).count() == 0


# ---- 4


def reference_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    return target


def test_mix(spark, odd, empty):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.choice([0, 5, 40, 400])) or None, rnd.choice(["a", "b", "b", "b", "b", "c", None, "ü", "d"])) for i in range(600)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = reference_targets(size)
    once, again = (sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()), key=repr) for _ in range(2))
    assert once == again and len(once) == len(rows)
    taken = Counter()
    for _, s, n, total, target, k in once:
        taken[s] += k
        assert total == size[s] and abs(target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= k <= 2 * n
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 2 for s in want)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    kept = mixing.mixed(docs(spark, rows))
    assert kept.columns == odd.columns and max(Counter(r["doc_id"] for r in kept.collect()).values()) == 2


def test_sainte_lague_against_the_loop(spark):
    rnd = random.Random(5)
    for seats in (0, 1, 7, 100):
        votes = {i: rnd.choice([0, 1, 10, 333, 1000]) + rnd.random() for i in range(8)}
        won = Counter()
        for _ in range(seats):
            won[max(votes, key=lambda s: votes[s] / (2 * won[s] + 1))] += 1
        df = spark.createDataFrame([(i, v, seats) for i, v in votes.items()], "k int, v double, seats long")
        got = {r["k"]: r["n"] for r in mixing.sainte_lague(df, [], ["k"], "v", "seats", "n").collect()}
        assert got == {i: won[i] for i in votes}


# ---- 5


def test_toxicity(spark, odd, empty):
    rnd = random.Random(6)
    bad = ["scumbag", "idiotic"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rnd, rnd.choice([30, 200])).split()
        y = i % 3 == 0
        for _ in range(3 * y):
            b = rnd.choice(bad)
            w[rnd.randrange(len(w))] = rnd.choice([b, b.upper(), b.replace("i", "1").replace("o", "0"), b.replace("c", "с"), "ｓ" + b[1:] if b[0] == "s" else b])
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows), lab).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert 200 < len(held) < 400 and all(got[i]["predicted"] == dict(labels)[i] for i in held)
    out = toxicity.toxicity(odd, lab).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(odd, lab.limit(0)).count() == len(ODD)


def test_folding_and_exceptions():
    assert toxicity.fold("W0RTHLE$S, ｉｄｉｏｔ! $$$ сlоwn é") == " worthless idiot clown e "
    lex = toxicity.Lexicon({" idiot ": 2.0, " scum": 1.0}, (" useful idiot ",), (0.0, 0.0, 0.0))
    terms = lex.automaton()
    assert toxicity._matched(" useful idiot scummy idiot ", terms) == (3.0, 4)


def test_matching_against_a_naive_search():
    rnd = random.Random(18)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    for _ in range(60):
        weights = {rnd.choice([f" {w} ", f" {w}"]): rnd.random() + 0.1 for w in rnd.sample(words, 8)}
        spared = tuple(f" {' '.join(rnd.sample(words, 2))} " for _ in range(6))
        text = " " + " ".join(rnd.choice(words) for _ in range(60)) + " "
        inside = {p for e in spared for b in range(len(text)) if text.startswith(e, b) for p in range(b, b + len(e) - 1)}
        want = sum(max((w for t, w in weights.items() if text.startswith(t, b)), default=0.0) for b in range(len(text)) if b not in inside)
        got, n = toxicity._matched(text, toxicity.Lexicon(weights, spared, (0.0, 0.0, 0.0)).automaton())
        assert got == pytest.approx(want) and n == 60


def test_signs_around_a_word_may_be_letters():
    assert toxicity.fold("($hit) @ss a$$ $100 idiot! you@") == " hit shit ss ass a ass idiot you youa "


# ---- 6


def test_shards(spark, odd, empty):
    rnd = random.Random(7)
    texts = [prose(rnd, 5) for _ in range(500)]
    rows = [(i, texts[rnd.randrange(500)] if i % 3 else "one hot text") for i in range(1500)]
    got = sharding.shard(docs(spark, rows)).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    text = dict(rows)
    where = {}
    for r in got:
        where.setdefault(text[r["doc_id"]], Counter())[r["shard"]] += 1
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["law"] == "rows" and r["grown_shard"] is None
    hot = where.pop("one hot text")
    assert sum(len(c) == 1 for c in where.values()) > 0.97 * len(where) and len(hot) <= 16
    out = sharding.shard(odd).collect()
    assert len(out) == len(ODD) and sorted(r["size"] for r in out)[0] == 8 and sharding.shard(empty).count() == 0


def test_groups_up_to_a_shard_stay_whole(spark, tmp_path):
    for copies, more in ((95, 2305), (100, 2300), (250, 2150)):
        rows = [(i, "copied text" if i < copies else f"text {i}") for i in range(copies + more)]
        got = Counter(r["shard"] for r in sharding.shard(docs(spark, rows)).where(f"doc_id < {copies}").collect())
        assert len(got) == -(-copies // 100), (copies, got)
    rows = [(i, f"group {i // 30}" if i < 1500 else f"text {i}") for i in range(2400)]
    where = {}
    for r in sharding.shard(docs(spark, rows)).where("doc_id < 1500").collect():
        where.setdefault(r["doc_id"] // 30, set()).add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 1


# ---- 7


def test_top_k_against_brute_force(spark):
    rnd = random.Random(8)
    codes = [rnd.getrandbits(64) for _ in range(300)] + [rnd.getrandbits(4) for _ in range(100)] + [5] * 300
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(i, signed(c), "x") for i, c in enumerate(codes)] + [(None, 1, "x"), (9999, None, "x")], "id long, code long, distance string")
    got = {}
    for r in hamming_topk.top_k(df, df.where("id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    for q in range(0, len(codes), 20):
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    assert hamming_topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert hamming_topk.top_k(df.where("id < 3"), df.where("id < 3")).count() == 6
    v = spark.createDataFrame([(1, [1.0, -1.0, None]), (2, None)], "vec_id long, embedding array<double>")
    assert [(r["id"], r["code"]) for r in hamming_topk.sign_codes(v, "vec_id", "embedding").collect()] == [(1, 1), (2, 0)]


# ---- 8


def line_sets(rows):
    out = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = re.findall(rb"[0-9a-z\x80-\xff]+", line.encode().lower())
            out.append((i, k, frozenset(w)))
    return out


def removed_lines(rows):
    """By document: each line's number and whether an earlier one is equal or similar."""
    want, seen = {}, []
    for i, k, s in sorted(line_sets(rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        kind = "exact" if s and s in seen else "near" if s and any(5 * len(s & b) >= 4 * len(s | b) for b in seen) else None
        seen.append(s)
        want.setdefault(i, []).append((k, kind))
    return want


def assert_lines(spark, rows):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for i, lines in removed_lines(rows).items():
        assert got[i]["removed"] == [k for k, kind in lines if kind], i
        assert (got[i]["n_lines"], got[i]["n_exact"], got[i]["n_near"]) == (len(lines), sum(x == "exact" for _, x in lines), sum(x == "near" for _, x in lines))


def test_line_dedup_against_brute_force(spark, empty, monkeypatch):
    rnd = random.Random(9)
    base = [prose(rnd, rnd.choice([1, 2, 4, 8, 20, 60])) for _ in range(40)]
    rows = [(-1, None), (-2, "")]
    for i in range(90):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            w = rnd.choice(base).split() if rnd.random() < 0.7 else base[3].split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            lines.append(rnd.choice(["", "!"]) + " ".join(w).upper())
        rows.append((i, "\n".join(lines)))
    rows += [(None, rows[5][1]), (500, "long " * 3000 + prose(rnd, 5000)), (501, "long " * 3000 + prose(rnd, 5000))]
    assert_lines(spark, rows)
    monkeypatch.setattr(line_dedup, "BEFORE", 2)
    monkeypatch.setattr(line_dedup, "WRITTEN", 1)
    monkeypatch.setattr(line_dedup, "FURTHER", 3)
    assert_lines(spark, rows)
    assert line_dedup.dedup_lines(empty).count() == 0
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(docs(spark, [(1, "a b c\nd e f"), (2, "a b c\nnew one"), (3, "A B c")])).collect()}
    assert kept == {1: "a b c\nd e f", 2: "new one", 3: ""}


@pytest.mark.parametrize("similar", [0.5, 0.7, 0.9])
def test_lines_at_other_similarities(spark, similar):
    rnd = random.Random(21)
    base = [prose(rnd, n).split() for n in (1, 2, 3, 3, 4, 5, 9, 12, 20) for _ in range(4)]
    rows = [(0, "aa bb cc\naa bb cc dd\nee ff\nee\nee ff gg hh")]
    for i in range(1, 60):
        lines = []
        for _ in range(3):
            w = list(rnd.choice(base))
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            lines.append(" ".join(w + rnd.sample(WORDS, rnd.randrange(2))))
        rows.append((i, "\n".join(lines)))
    want, seen = {}, []
    for i, k, s in line_sets(rows):
        if s and any(len(s & b) >= similar * len(s | b) - 1e-9 for b in seen):
            want.setdefault(i, []).append(k)
        seen.append(s)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(docs(spark, rows), similar).collect()}
    assert {i: k for i, k in got.items() if k} == want
    if similar == 0.7:
        assert got[0] == [1]


def test_repeated_ids_are_later_rows(spark):
    line = "one two three four five six seven eight nine ten"
    got = line_dedup.dedup_lines(docs(spark, [(1, line), (1, line + " eleven"), (1, "other words here"), (2, line)])).collect()
    assert sorted(r["n_near"] + r["n_exact"] for r in got) == [0, 0, 1, 1] and {r["removed"][0] for r in got if r["removed"]} == {0}


def test_lines_of_a_hot_token(spark, monkeypatch):
    """10,000 lines share their rarest words, and few of them are similar: longer keys tell the rest apart."""
    monkeypatch.setattr(line_dedup, "BEFORE", 40)
    monkeypatch.setattr(line_dedup, "FURTHER", 60)
    rnd = random.Random(14)
    lines = [f"alpha beta gamma delta {i}x {rnd.randrange(10**6)}y" for i in range(10_000)]
    same = [3, 77, 500]
    rows = [(i, "\n".join(lines[i * 100 : i * 100 + 100])) for i in range(100)]
    rows.append((200, "\n".join(f"{lines[k]} {lines[k].split()[4]}" for k in same) + "\nalpha beta gamma delta 77x other words"))
    rows.append((201, "\n".join(lines[k] + " more" for k in same)))
    got = {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[200] == (3, 0) and got[201] == (0, 3) and all(got[i] == (0, 0) for i in range(100))


# ---- 9


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_near_duplicates_against_brute_force(spark, odd, empty):
    rnd = random.Random(10)
    rows = list(ODD)
    for i in range(40):
        w = prose(rnd, 300).split()
        rows.append((100 + i, " ".join(w)))
        for j in range(rnd.randrange(3)):
            w[rnd.randrange(300)] = "edit"
            rows.append((1000 + 10 * i + j, " ".join(w)))
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    want = Counter((i, f"{fp[x]:016x}", least.get(find(x))) for x, (i, _) in enumerate(rows))
    assert Counter(map(tuple, simhash_dedup.near_duplicates(docs(spark, rows)).collect())) == want
    kept = simhash_dedup.deduplicated(docs(spark, rows))
    assert kept.count() == len({find(x) for x in range(len(rows))}) and kept.columns == odd.columns
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (None, 3), (200, 300), (300, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(51)} | {200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---- 10


def test_languages(spark, empty):
    d, p = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "pages"))
    model = language_id.fit(d, 100)
    rows = d.where(F.xxhash64("text") > 0).select(F.col("doc_id").alias("row"), "text", F.lit(None).cast("string").alias("declared"), F.lit("a.example.org").alias("host"))
    right = language_id.identify(rows, *model).join(d, F.col("row") == F.col("doc_id")).agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97
    got = language_id.page_languages(p, d)
    parts = language_id.page_parts(p)
    assert got.join(parts, F.col("page_id") == F.col("row")).agg(F.avg((F.col("language") == F.col("declared")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", "", 1), (3, "http://x.org/", "<html lang=fr><p>123 ...</p>", 1), (3, "http://x.org/", "<html lang=fr>", 1)], "page_id long, url string, html string, row int")
    assert [(r["page_id"], r["language"], r["probability"]) for r in language_id.page_languages(odd, d).orderBy("page_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (3, "und", 0.0)]
    assert language_id.page_languages(odd.limit(0), d).count() == 0
    assert {r["language"] for r in language_id.page_languages(p, d.limit(0)).collect()} == {"und"}


def test_declared_language_and_host_decide_where_the_text_does_not(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(d, 100)
    plain = d.where("lang in ('de', 'en')").select(F.col("doc_id").alias("row"), "text", F.col("lang").alias("declared"), F.concat("lang", F.lit(".example.org")).alias("host"))
    unclear = spark.createDataFrame([(-1, "in", "de", "de.example.org"), (-2, "in", "en", "en.example.org")], "row long, text string, declared string, host string")
    got = {r["row"]: r["language"] for r in language_id.identify(plain.unionByName(unclear), *model).where("row < 0").collect()}
    assert got == {-1: "de", -2: "en"}


def test_accepted_keeps_clean_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(90001, "### 123 $$$", "en", "src0", 1), (90002, None, "en", "src0", 0), (90003, "", None, None, 0)], d.schema)
    kept = language_id.accepted(d.unionByName(more))
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in d.select("doc_id").collect()}


# ---- shared


def test_word_hashes_tell_words_apart():
    a, _, _, at = wordhash.hashed([b"One two, THREE", b"", b"two"])
    assert at.tolist() == [0, 3, 3, 4] and a[1] == a[3] and len(set(a.tolist())) == 3
    s, off = wordhash.shingles(a, at, 2)
    assert off.tolist() == [0, 2, 2, 3] and math.prod(off) == 0
