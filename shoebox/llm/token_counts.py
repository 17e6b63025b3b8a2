"""Token counts of whole texts with a public tokenizer, encoded in batches inside Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of new pieces that one call of the tokenizer encodes.
BATCH_BYTES = 1 << 18
#: Piece lengths that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

#: ASCII white space: no token of a tokenizer that drops white space, no special string and no Unicode
#: composition crosses it, so a text may be split there and the counts added.
SAFE = re.compile("[ \t\n\r]+")


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _white_space_is_safe(path: str) -> bool:
    """Whether the tokenizer file drops white space before its model and has no special string that holds any."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    drops = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and r"[^\s" in (p.get("pattern") or {}).get("Regex", "") for p in parts)
    added = spec.get("added_tokens") or []
    return drops and all(not SAFE.search(a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in added)


class Counter:
    """Counts tokens as the tokenizer library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.remembered: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.split = False
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.split = _white_space_is_safe(path)

    def _encode(self, texts: list[str]) -> Iterator[int]:
        """Lengths of ``texts`` in order, in calls of about BATCH_BYTES."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += n_bytes(t)
            if size >= BATCH_BYTES:
                yield from self.encode(held)
                held, size = [], 0
        if held:
            yield from self.encode(held)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return list(self._encode(texts))
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        known = self.remembered
        pieces = [SAFE.split(t) if "\t" in t or "\r" in t else t.replace("\n", " ").split(" ") for t in texts]
        new = [p for p in set().union(*pieces) if p not in known] if pieces else []
        known.update(zip(new, self._encode(new), strict=True))
        return [sum(map(known.__getitem__, p)) for p in pieces]


def _balanced(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about four BATCH_BYTES each, so that one batch holds a few long texts or many short ones."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > 4 * BATCH_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def token_counts(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > ``max_tokens``) for each row of ``docs``.

    ``tokenizer`` is a file that every worker can read (.json for tokenizers, .model for sentencepiece).  Whole
    texts are counted: no truncation, padding or added special tokens; special strings inside a text are handled
    as the library does by default.  Null and empty texts have 0 bytes and 0 tokens.  Only lengths leave the
    Arrow function.  Long texts are split at white space where the tokenizer file shows that this cannot change
    a count, and a worker remembers the lengths of pieces it has met; otherwise texts are encoded whole.
    Repeated rows stay, an empty table gives an empty one, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts: list[int] = []
            for a, b in _balanced(batch.column("n_bytes").to_pylist()):
                counts += counter.counts(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > max_tokens)
