"""Alignment of two tokenizers' tokens over the same bytes by a dangling-suffix transducer, and counts of the token pairs that end together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import tokens
from shoebox.llm._common import Scratch, written

#: Links that one row of the written table holds; a text with more has several rows.
ROW_LINKS = 1 << 16
#: Characters of texts whose parts are looked up together.
HELD_CHARS = 1 << 20

LINKED = "row long, doc_id long, block int, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"


class Transducer:
    """Reads two token sequences over the same bytes and closes a group wherever both end.

    A state is the side that leads and the bytes by which it leads; the next token read is always one of the other
    side.  It either leaves a shorter lead, an empty one (the group closes), or takes the lead.  Transitions are remembered
    by state and token; leads are ends of tokens, so there are never more states than tokens have bytes.
    """

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = (a, b)
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.names: list[tuple[int, bytes]] = [(0, b"")]
        self.known: list[dict[int, int]] = [{}]  # of each state: token of the side that lags, next state (-1: the bytes differ)
        self.from_a = [True]  # nobody leads: a reads first

    def _next(self, state: int, token: int) -> int:
        lead, rest = self.names[state]
        side = 0 if self.from_a[state] else 1
        held = self.bytes[side][token]
        if rest.startswith(held):
            name = (lead, rest[len(held) :])
        elif held.startswith(rest):
            name = (side, held[len(rest) :])
        else:
            return -1
        name = name if name[1] else (0, b"")
        if name not in self.states:
            self.states[name] = len(self.names)
            self.names.append(name)
            self.known.append({})
            self.from_a.append(name[0] == 1)
        return self.states[name]

    def closings(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of both sides have been read whenever both end; None where the bytes differ."""
        known, from_a, out, state, i, j = self.known, self.from_a, [], 0, 0, 0
        n, m = len(a), len(b)
        while True:
            if from_a[state]:
                if i == n:
                    break
                token = a[i]
                i += 1
            else:
                if j == m:
                    break
                token = b[j]
                j += 1
            at = known[state].get(token)
            if at is None:
                at = known[state][token] = self._next(state, token)
            if at < 0:
                return None
            state = at
            if not state:
                out.append((i, j))
        return out if not state and j == m else None

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The smallest groups of tokens of both sides that cover the same bytes; None where the bytes differ."""
        ends = self.closings(a, b)
        return None if ends is None else [(a[i:k], b[j:m]) for (i, j), (k, m) in zip([(0, 0), *ends], ends, strict=False)]


class Aligner:
    """What each text gives: its groups, written out, its links as pairs, and its numbers of tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, a_safe, a_bytes = tokens.byte_level(a_path, True)
        self.b, b_safe, b_bytes = tokens.piece_level(b_path)
        self.safe, self.n_b, self.bytes = a_safe and b_safe, len(b_bytes), (a_bytes, b_bytes)
        self.lengths = tokens.Lengths(a_bytes), tokens.Lengths(b_bytes)
        self.transducer = Transducer(a_bytes, b_bytes)
        self.memory: tokens.Memory = tokens.Memory(self.made)

    def made(self, parts: list[str]) -> list[tuple[bytes, bytes, int, int] | None]:
        """What each part gives; parts that may stand side by side are read as one text, which both sides' tokens part at their ends."""
        if len(parts) > 1:
            whole = parts if tokens.all_sound(parts) else [p for p in parts if tokens.sound(p)]
            found = self._read(*tokens.joined(whole)) if whole else []
            if found is not None:
                if len(whole) == len(parts):
                    return found
                own = dict(zip(whole, found, strict=True))
                return [own[p] if p in own else self.made([p])[0] for p in parts]
        return [(self._read(*tokens.joined([p])) or [None])[0] for p in parts]

    def _read(self, text: str, ends: np.ndarray) -> list[tuple[bytes, bytes, int, int]] | None:
        """What the stretches of a text that end at these bytes give; None where a side does not give the text's bytes."""
        a, b = self.a([text])[0], self.b([text[1:]])[0]
        data = text.encode("utf-8", "surrogatepass")
        if any(b"".join(map(held.__getitem__, ids)) != data for held, ids in zip(self.bytes, (a, b), strict=True)):
            return None
        closed = self.transducer.closings(a, b)
        cut_a, cut_b = (n.cuts(np.array(ids, np.int64), ends) for n, ids in zip(self.lengths, (a, b), strict=True))
        if closed is None or cut_a is None or cut_b is None:
            return None
        at = np.array(closed, np.int64)
        groups = np.searchsorted(at[:, 0], cut_a, side="right")
        links = (np.array(a, "<i8")[at[:, 0] - 1] * self.n_b + np.array(b, "<i8")[at[:, 1] - 1]).tobytes()
        name_a, name_b = ([*map(str, ids)] for ids in (a, b))
        texts, i, j = [], 0, 0
        for k, m in closed:
            texts.append((name_a[i] if k == i + 1 else ",".join(name_a[i:k])) + "|" + (name_b[j] if m == j + 1 else ",".join(name_b[j:m])))
            i, j = k, m
        out, g, i, j = [], 0, 0, 0
        for h, k, m in zip(groups.tolist(), cut_a.tolist(), cut_b.tolist(), strict=True):
            out.append((";".join(texts[g:h]).encode(), links[8 * g : 8 * h], k - i, m - j))
            g, i, j = h, k, m
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        split = [(tokens.parts(t) if self.safe else [t]) if t else [] for t in texts]
        self.memory.learn(split)
        for text, parts in zip(texts, split, strict=True):
            found = [self.memory[p] for p in parts]
            if None in found and len(parts) > 1:
                found = self.made([text])  # the rule is one on whole texts
            if not found or None in found:
                yield 0, 0, "", np.zeros(0, "<i8")
                continue
            groups, links, n_a, n_b = zip(*found, strict=True)
            yield sum(n_a), sum(n_b), hashlib.sha256(b";".join(groups)).hexdigest(), np.frombuffer(b"".join(links), "<i8")


def _linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        names = [c.split()[0] for c in LINKED.split(", ")]
        for batch in batches:
            keys, ids, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < HELD_CHARS and i + 1 < len(texts):
                    continue
                rows: list[tuple] = []
                links: list[np.ndarray] = []
                for key, doc, (n_a, n_b, sha, held) in zip(keys[first : i + 1], ids[first : i + 1], aligner.texts([t or "" for t in texts[first : i + 1]]), strict=True):
                    for block in range(max(1, -(-len(held) // ROW_LINKS))):
                        rows.append((key, doc, block, n_a, n_b, len(held), sha))
                        links.append(held[block * ROW_LINKS : (block + 1) * ROW_LINKS])
                offsets = np.zeros(len(links) + 1, np.int32)
                np.cumsum([len(x) for x in links], out=offsets[1:])
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(links)))], names)
                first, size = i + 1, 0

    return docs.mapInArrow(run, LINKED)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` for each row of ``docs``.

    Each text is encoded with a space before it by the byte-level file ``a_path`` and, without it, by the sentencepiece file
    ``b_path``, which adds it; special strings are plain text.  Places where tokens of both end cut them into groups; the two
    tokens that end there are linked.  A pair of ids counts as often as it is linked in all texts: ``count_sum`` adds
    these counts over a text's links, and ``n_best`` counts the links whose pair is linked most often of all with its
    B id, ties included.  ``groups_sha256`` hashes the groups written as ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens: zeros and ''.
    Long texts are parted where neither tokenizer can join, and a worker remembers the groups of parts it has met.  One of
    two linked tokens ends with the other, so no more pairs can occur than tokens have ends that are tokens (some
    10^5 with vocabularies of 10^5): the table of their counts has this size however many texts there are, and is broadcast.
    Links are written once, in rows of at most ROW_LINKS.  Repeated rows stay, an empty table gives an empty one, other
    columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_b = len(tokens.piece_level(b_path)[2])
    with Scratch(docs.sparkSession) as scratch:
        held = scratch.written(_linked(rows, a_path, b_path))
        pairs = held.select("row", F.explode("links").alias("pair"))
        counts = scratch.written(pairs.groupBy("pair").agg(F.count("*").alias("n")))
        top = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("top"))
        ranked = counts.join(top, F.col("pair") % n_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
        sums = pairs.join(F.broadcast(ranked), "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
        out = held.where("block = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left")
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return written(out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), none("n_best"), none("count_sum"), "groups_sha256"))
