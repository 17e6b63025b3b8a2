"""Token ids of whole texts: texts are parted where no token can cross, and parts met before are remembered."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TypeVar

import numpy as np

#: Parts that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Characters of new parts that one call of a tokenizer encodes.
BATCH_CHARS = 1 << 16

#: White space other than the space and the line feed, and the sign that stands for a space in pieces.
_RARE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
#: A space between two signs that are surely no white space.
_SAFE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_SURE = re.compile(r"[!-~\w]")
#: A space beside a sign that may be white space, or such a sign at the end.
_LOOSE = re.compile(r"[^!-~\w] | (?![!-~\w])|[^!-~\w]\Z")
#: Letters of Latin alphabets, ASCII and line feeds.
_LATIN = re.compile("[\n -~\u00c0-\u024f]*")

T = TypeVar("T")


def parts(text: str) -> list[str]:
    """Parts of a text that give it again when joined by a space, each of which has a sign that is no white space on both sides of the joint."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _RARE.search(text):
        return _SAFE.split(text)
    return text.split(" ")


def byte_level(path: str, plain_special: bool) -> tuple[Callable[[list[str]], list[list[int]]], bool, list[bytes]]:
    """Of a byte-level BPE file: an encoder of batches, whether texts may be parted before a space, and the bytes of each id.

    They may if the file has no normaliser, parts words by the usual pattern (a space begins a word) and no added token holds or
    strips white space.  ``plain_special``: the strings of special tokens are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = plain_special
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    safe = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    safe = safe and all(not re.search(r"\s", a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in added)
    # the signs that stand for bytes: printable Latin ones for themselves, the rest in order from U+0100 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    names = {i: t for t, i in model.get_vocab(with_added_tokens=True).items()}
    special = {a["id"] for a in added}
    held = [names[i].encode() if i in special else bytes(sign[c] for c in names[i]) for i in range(len(names))]
    slow = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    fast = _by_rank(spec, names, held, special) if safe else None
    if fast is None:
        return slow, bool(safe), held
    marks = [] if plain_special else [names[i] for i in special]

    def encode(texts: list[str]) -> list[list[int]]:
        plain = [_LATIN.fullmatch(t) is not None and not any(m in t for m in marks) for t in texts]
        rest = iter(slow([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [fast(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]

    return encode, True, held


def _by_rank(spec: dict, names: dict[int, str], held: list[bytes], special: set[int]) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same file, which merges by the rank of what a merge makes, where ids are these ranks.

    The two agree if each merge is the one that makes its token when all before it are done (a test runs through them all).
    Words are parted by the usual pattern; ``_LATIN`` keeps to signs whose kind is the same in any edition of Unicode.
    """
    import public_tokenizers
    import tiktoken

    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    model = spec["model"]
    if any(names.get(256 + i) != a + b for i, (a, b) in enumerate(merges)) or any(len(h) != 1 for h in held[:256]) or 256 + len(merges) + len(special) != len(names):
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    ranks = {h: i for i, h in enumerate(held) if i not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def piece_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], bool, list[bytes]]:
    """Of a sentencepiece file: an encoder of batches, whether texts may be parted before a space, and the bytes of each id.

    They may if no piece holds a space after another sign, so that no merge crosses the place.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    safe = not any(re.search("[^▁]▁", n) for n in names) and model.encode("a  b") == model.encode("a") + model.encode(" b")
    held = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return lambda texts: model.encode(texts, num_threads=1), safe, held


def batches(items: Sequence[str]) -> Iterator[list[str]]:
    """Items in calls of about BATCH_CHARS; a longer one is a call of its own."""
    held, size = [], 0
    for x in items:
        if held and size + len(x) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


class Lengths:
    """Where the tokens of joined parts are to be cut: the bytes of each id, summed along a text's ids."""

    def __init__(self, held: list[bytes]):
        self.lengths = np.array([len(x) for x in held], np.int64)

    def cuts(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many of the ids come before each of the byte offsets ``ends``; None where one of these is no token's end."""
        at = np.cumsum(self.lengths[ids])
        n = np.searchsorted(at, ends, side="right")
        return n if len(at) and (n > 0).all() and (at[n - 1] == ends).all() and at[-1] == ends[-1] else None


def sound(part: str) -> bool:
    """Whether a part begins and ends with signs that are no white space, so that it may stand between others."""
    return bool(part) and not _RARE.search(part) and _SURE.match(part[0]) is not None and _SURE.match(part[-1]) is not None


def all_sound(parts: Sequence[str]) -> bool:
    """Whether ``sound`` holds for all parts, found out on the joined text."""
    text = " " + " ".join(parts)
    return bool(parts) and not _LOOSE.search(text) and not _RARE.search(text)


def joined(parts: Sequence[str]) -> tuple[str, np.ndarray]:
    """Parts as one text, a space before each, and where each ends in bytes."""
    text = " " + " ".join(parts)
    return text, np.cumsum([1 + len(p) if p.isascii() else 1 + len(p.encode("utf-8", "surrogatepass")) for p in parts])


class Memory(dict[str, T]):
    """What ``made`` gives for parts, remembered; ``made`` gets the new ones of a batch of texts in few calls."""

    def __init__(self, made: Callable[[list[str]], Iterable[T]]):
        super().__init__()
        self.made = made

    def learn(self, texts: list[list[str]]) -> None:
        """Makes all parts of ``texts`` known."""
        if len(self) > REMEMBERED:
            self.clear()
        new: set[str] = set()
        for t in texts:
            new.update(t)
        for some in batches(list(new.difference(self.keys()))):
            self.update(zip(some, self.made(some), strict=True))
