"""Alignment, packing and collocations against brute force, and their edge cases, on small tables."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest

from shoebox.llm import alignment, collocations, packing, tokens

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, row int, rid int, block int, n long, _id string"
SIGNS = ["a", "the", "word", "Übung", "é", ".", ",", "12", " ", "  ", "\n", "\t", "\r\n", " ", " ", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "中文", "\U0001f600", "\x00", "\x1c", "'s", "don't", "é"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, 4, "x") for i, t, lang in rows], DOCS).repartition(3)


def mess(rnd, n):
    return "".join(rnd.choice(SIGNS) + rnd.choice(["", " "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    said = [" ".join(rnd.choice(["the", "cats", "Running", "unbelievably", "über", "x1", "end.", "so,"]) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    odd = [(None, "a null id", None), (1, None, "en"), (2, "", "en"), (3, "  \n\t ", "en"), (5, "same text twice", "en"), (5, "same text twice", "en"), (6, "same text twice", None), (7, "long words " * 40_000, "de"), (8, "y" * 30_000, "en")]
    return odd + [(100 + i, t, "en") for i, t in enumerate(said)] + [(200 + i, mess(rnd, 30), "fr") for i in range(150)]


def test_texts_are_parted_where_no_token_crosses():
    rnd = random.Random(1)
    a, a_safe, a_bytes = tokens.byte_level(BYTE, False)
    b, b_safe, _ = tokens.piece_level(PIECE)
    assert a_safe and b_safe and b"".join(a_bytes[i] for i in a(["zu Ähre\n"])[0]) == "zu Ähre\n".encode()
    for _ in range(1500):
        text = mess(rnd, rnd.randint(1, 12))
        split = tokens.parts(text)
        assert " ".join(split) == text
        whole = [x for i, ids in enumerate(a([" " * (i > 0) + p for i, p in enumerate(split)])) for x in ids]
        assert whole == a([text])[0], text
        assert [x for ids in b(split) for x in ids] == b([text])[0], text


def test_merging_by_rank_is_merging_by_the_merges():
    import json

    with open(BYTE, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    held = tokens.byte_level(BYTE, False)[2]
    rank = {h: i for i, h in enumerate(held)}
    for i in range(len(merges)):
        parts = [bytes([x]) for x in held[256 + i]]
        while len(parts) > 2:  # the merges before this one, the first of the least rank each time
            least, at = min((rank.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            assert least < 256 + i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair = merges[i].split(" ") if isinstance(merges[i], str) else merges[i]
        names = [bytes_of(p) for p in pair]
        assert parts == names


def bytes_of(name):
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    return bytes(sign[c] for c in name)


def test_both_encoders_give_the_library_ids():
    from tokenizers import Tokenizer

    rnd, model = random.Random(7), Tokenizer.from_file(BYTE)
    letters = "etaoinshrdlucmfwygpbvkETAOIN'.,-!éüßàçñÿŒœŞ019\n  "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(4000)] + [mess(rnd, 9) for _ in range(500)] + ["a<|endoftext|>b"]
    for plain in (False, True):
        model.encode_special_tokens = plain
        assert tokens.byte_level(BYTE, plain)[0](texts) == [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]


def naive_alignment(rows):
    a, _, a_bytes = tokens.byte_level(BYTE, True)
    b, _, b_bytes = tokens.piece_level(PIECE)
    found, count = [], Counter()
    for i, text, _ in rows:
        x, y = (a([" " + text])[0], b([text])[0]) if text else ([], [])
        data = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[t] for t in x) != data or b"".join(b_bytes[t] for t in y) != data:
            found.append((i, [], [], [], ""))
            continue
        at, to = (list(accumulate(len(names[t]) for t in ids)) for names, ids in ((a_bytes, x), (b_bytes, y)))
        groups, links, p, q = [], [], 0, 0
        for end in sorted({*at} & {*to}):
            i1, j1 = at.index(end) + 1, to.index(end) + 1
            groups.append(f"{','.join(map(str, x[p:i1]))}|{','.join(map(str, y[q:j1]))}")
            links.append((x[i1 - 1], y[j1 - 1]))
            p, q = i1, j1
        count.update(links)
        found.append((i, x, y, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, t), n in count.items():
        top[t] = max(top[t], n)
    return [(i, len(x), len(y), len(ln), len(ln), sum(count[p] == top[p[1]] for p in ln), sum(count[p] for p in ln), sha) for i, x, y, ln, sha in found]


def test_alignment_is_that_of_all_ends(spark, rows, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_LINKS", 1000)
    short = [r for r in rows if len(r[1] or "") < 100_000] + [(9, "some words " * 900, "en")]
    got = alignment.align(docs(spark, short), BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(naive_alignment(short), key=repr)
    assert alignment.align(docs(spark, []), BYTE, PIECE).count() == 0


def test_transducer_closes_groups_and_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"d", b"x"])
    assert t.groups([0, 1, 3], [0, 1, 2]) == [([0, 1], [0, 1]), ([3], [2])]
    assert t.groups([2, 3], [0, 1, 2]) == [([2], [0, 1]), ([3], [2])]
    assert t.groups([0], [0, 3]) is None and t.groups([0], [0]) is None and t.groups([], []) == []


def test_packing_keeps_every_token_and_cuts_long_texts_alone(spark, rows):
    encode = tokens.byte_level(BYTE, False)[0]
    want, total = Counter(), 0
    for i, text, _ in rows:
        ids = encode([text or ""])[0] + [2]
        at, total = 0, total + len(ids)
        for piece in range(-(-len(ids) // 64)):
            n = 64 if piece else (len(ids) - 1) % 64 + 1
            want[(i, piece, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])))] += 1
            at += n
    got = packing.pack_documents(docs(spark, rows), BYTE, capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert len(held) <= 1.01 * total / 64 + 1
    assert packing.pack_documents(docs(spark, []), BYTE).count() == 0


def test_exchanges_empty_sequences_that_best_fit_leaves():
    s = packing.Sequences(10)
    for own in ((6, 2), (5, 3), (7,), (4, 3)):  # 30 tokens in four sequences
        s.add([(n, i) for i, n in enumerate(own)])
    squares = sum(f * f for f in s.fill)
    assert s.exchange() and sum(f * f for f in s.fill) > squares
    assert sorted(s.fill) == [0, 10, 10, 10]
    assert sorted(n for h in s.held for n, x in h.items() for _ in x) == [2, 3, 3, 4, 5, 6, 7]


def least_sequences(lengths, capacity):
    best = len(lengths)

    def go(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for f in sorted(set(fills)):
            if f + lengths[i] <= capacity:
                rest = list(fills)
                rest[rest.index(f)] += lengths[i]
                go(i + 1, rest)
        go(i + 1, [*fills, lengths[i]])

    go(0, [])
    return best


def test_packing_is_close_to_the_least_number_and_never_above_best_fit():
    rnd = random.Random(5)
    over = 0
    for _ in range(60):
        lengths = sorted((rnd.randint(3, 14) for _ in range(9)), reverse=True)
        s = packing.Sequences(20)
        s.best_fit([(n, i) for i, n in enumerate(lengths)])
        first = len(s.fill)
        s.exchange()
        used = sum(f > 0 for f in s.fill)
        least = least_sequences(lengths, 20)
        assert least <= used <= first
        over += used - least
    assert over <= 3


def test_groups_of_pieces_are_packed_in_rounds(spark):
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 1024) for _ in range(4000)] + [300] * 2000
    rows = [(i % 7, i, 0, n, 1) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES).repartition(4), 1024, group_rows=256).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted((a, b, n) for a, b, _, n, _ in rows)
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    whole = packing.Sequences(1024)  # a third of the pieces is alike: small groups cost little against one
    whole.best_fit([(n, i) for i, n in enumerate(lengths)])
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * len(whole.fill)


def naive_collocations(rows, least, most, per_lang):
    import re

    count, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, most + 1):
                count[lang or "und"].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if a >= least and " " in p}
        found = []
        for p, a in often.items():
            if any(f" {p} " in f" {q} " and len(q) > len(p) and 100 * b >= 100 * a for q, b in often.items()):
                continue
            w = p.split(" ")
            score, _, left, right = min((1000 * a * n[lang] // (f[x] * f[y]), k, f[x], f[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
            found.append((-score, -a, p.encode(), lang, p, a, left, right, n[lang], score))
        out += [(x[3], i + 1, *x[4:]) for i, x in enumerate(sorted(found)[:per_lang])]
    return sorted(out)


@pytest.fixture(scope="module")
def said():
    rnd = random.Random(8)
    words = ["red", "Blue", "deep", "sea", "of", "the", "a,b", "x y", "été", "zz"]
    texts = [(i, rnd.choice([" ", "  ", "\t"]).join(rnd.choice(words) + rnd.choice(["", "", "", ".", "!\n"]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None, "und"])) for i in range(300)]
    return texts + [(900, None, "en"), (901, "", None), (902, "tick " * 500, "en"), (903, "New york city " * 60, "de"), (903, "New york city " * 60, "de"), (904, ".,; \t\n", "xx"), (None, "The the the", "en")]


@pytest.mark.parametrize("per_lang", [5, 2000])
def test_collocations_equal_counting_all_phrases(spark, said, per_lang, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 2000)
    got = collocations.collocations(docs(spark, said), least_count=6, per_lang=per_lang)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == naive_collocations(said, 6, 5, per_lang)


def test_collocations_with_more_frequent_pairs_than_are_shared(spark, said, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 2000)
    got = collocations.collocations(docs(spark, said), least_count=6, shared_pairs=0)
    assert sorted(map(tuple, got.collect())) == naive_collocations(said, 6, 5, 2000)


def test_collocations_of_empty_tables_and_pairs_alone(spark, said):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "", "en")])).count() == 0
    got = collocations.collocations(docs(spark, said), least_count=6, most_words=2)
    assert sorted(map(tuple, got.collect())) == naive_collocations(said, 6, 2, 2000)


def test_automaton_has_the_states_of_a_suffix_automaton():
    rnd = random.Random(4)
    for _ in range(60):
        pieces = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 5))]
        depth = rnd.randint(1, 5)
        ids = np.array([x for p in pieces for x in p])
        first = np.array([i == 0 for p in pieces for i in range(len(p))])
        places, at = defaultdict(set), 0  # of each phrase: where it ends
        for p in pieces:
            for i in range(len(p)):
                for k in range(1, min(depth, i + 1) + 1):
                    places[tuple(p[i - k + 1 : i + 1])].add(at + i)
            at += len(p)
        classes = defaultdict(list)
        for phrase, where in places.items():
            classes[frozenset(where)].append(phrase)
        want = sorted((max(x, key=len), min(map(len, x)), len(where)) for where, x in classes.items())
        last, most, least, n = collocations.automaton(ids, first, depth)
        assert sorted((tuple(ids[e - m + 1 : e + 1].tolist()), int(s), int(c)) for e, m, s, c in zip(last, most, least, n, strict=True)) == want
