"""Token counts of every prefix of a text, by dynamic programming over byte-pair encodings.

The encoding of a prefix ends in exactly one token t such that the encoding of the rest ends in a token a with
``encode(a + t) == [a, t]``. So going through a piece byte by byte, the token that ends each prefix, and with it the
number of tokens of each prefix, follow from those of shorter prefixes. Pieces are what the tokenizer's split
pattern finds; frequent ones are remembered.

What is stored for a text is the change of its count with each character, one byte each: the number of tokens of
the first n characters is the sum of the first n bytes. Truncation and budget questions read these and never encode again.
"""

from __future__ import annotations

import json
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import held, text_slices
from caseloom.llm.tokens import byte_letters, tokenizer_path

BYTE_TOKENIZER = "byte_bpe_50k.json"
MEMO = 250_000
#: The split pattern of byte-level BPE, and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACES = frozenset(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


class PrefixCounter:
    def __init__(self, name: str):
        import regex

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(byte[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        special = set(self.specials)
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.tails = {t[i:] for t in self.tokens for i in range(len(t))}
        self.find = regex.compile(PATTERN).finditer
        self.at_special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.fits: dict = {}
        self.whole: dict = {}
        self.words: dict = {}
        self.chunks: dict = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """Plain merging, for the few bytes of two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fit(self, a: bytes, t: bytes) -> bool:
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        found = self.fits[a, t] = self.merged(a + t) == [a, t]
        return found

    def alone(self, t: bytes) -> bool:
        found = self.whole.get(t)
        if found is None:
            found = self.whole[t] = self.merged(t) == [t]
        return found

    def piece(self, text: str) -> list[int]:
        """The number of tokens of each prefix of one piece, by characters."""
        found = self.words.get(text)
        if found is not None:
            return found
        raw = text.encode("utf-8", "replace")
        last, counts, tails, tokens, known = [b""] * (len(raw) + 1), [0] * (len(raw) + 1), self.tails, self.tokens, self.fits.get
        for i in range(1, len(raw) + 1):
            for j in range(i - 1, -1, -1):
                t = raw[j:i]
                if t in tokens:
                    if j:
                        fits = known((last[j], t))
                        if fits is None:
                            fits = self.fit(last[j], t)
                    else:
                        fits = self.alone(t)
                    if fits:
                        last[i], counts[i] = t, counts[j] + 1
                        break
                elif t not in tails:
                    raise ValueError(f"no token ends {raw[:i]!r}")
        found = counts[1:] if len(raw) == len(text) else [counts[n] for n in accumulate(len(c.encode("utf-8", "replace")) for c in text)]
        if len(self.words) < MEMO and len(text) < 64:
            self.words[text] = found
        return found

    def plain(self, text: str) -> list[int]:
        """The number of tokens of each prefix of a text without special tokens."""
        out: list[int] = []
        run, base, settled = None, 0, 0  # where a run of white space began, what was counted before it, and with it
        for m in self.find(text):
            piece = m[0]
            counts = self.piece(piece)
            if piece[-1] in SPACES:
                if run is None:
                    run, base = m.start(), settled
                # A prefix that ends here has the whole run so far as its last piece.
                out += [base + n for n in self.piece(text[run : m.end()])[m.start() - run :]]
                settled += counts[-1]
                continue
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                counts = [sum(self.piece(p[0])[-1] for p in self.find(piece[:n])) for n in range(1, len(piece))] + [counts[-1]]
            if run is not None and piece[0] == " ":
                out.append(base + self.piece(text[run : m.start() + 1])[-1])
                out += [settled + n for n in counts[1:]]
            else:
                out += [settled + n for n in counts]
            settled, run = out[-1], None
        return out

    def counts(self, text: str) -> list[int]:
        """The same for any text; a special token counts as one from its last character on."""
        if not self.at_special or not self.at_special.search(text):
            return self.plain(text)
        out, start = [], 0
        for m in self.at_special.finditer(text):
            base = out[-1] if out else 0
            part = self.plain(text[start : m.end() - 1])
            whole = self.plain(text[start : m.start()])
            out += [base + n for n in part] + [base + (whole[-1] if whole else 0) + 1]
            start = m.end()
        base = out[-1]
        return out + [base + n for n in self.plain(text[start:])]

    def changes(self, text: str) -> bytes:
        """The change of the count with each character, as signed bytes."""
        if self.at_special and self.at_special.search(text):
            return _changes(self.counts(text))
        # Pieces never cross from other text to a space, so the text is counted between such places.
        parts = text.split(" ")
        chunks, open_ = [parts[0]], not parts[0] or parts[0][-1] in SPACES
        for p in parts[1:]:
            if open_:
                chunks[-1] += " " + p
            else:
                chunks.append(" " + p)
            open_ = not p or p[-1] in SPACES
        get, out = self.chunks.get, []
        for c in chunks:
            found = get(c)
            if found is None:
                found = _changes(self.piece(c) if c[1:].isalpha() else self.plain(c))
                if len(self.chunks) < MEMO and len(c) < 64:
                    self.chunks[c] = found
            out.append(found)
        return b"".join(out)


def _changes(counts: list[int]) -> bytes:
    return bytes([n - m & 255 for m, n in zip([0, *counts], counts, strict=False)])


def counter(name: str = BYTE_TOKENIZER) -> PrefixCounter:
    return held(("prefixes", name), lambda: PrefixCounter(name))


def _count(name: str):
    def count(batches):
        prefix = counter(name)
        for batch in text_slices(batches, "text"):
            texts = batch.column("text")
            changes = [prefix.changes(t) for t in texts.to_pylist()]
            totals = [int(np.frombuffer(c, np.int8).sum(dtype=np.int64)) for c in changes]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(changes, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_counts"])

    return count


def token_counts(docs: DataFrame, tokenizer: str = BYTE_TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_bytes, n_tokens and prefix_counts for each row.

    Null texts count as empty: no bytes, no tokens, no prefixes. Strings of special tokens inside a text count as that
    token, as in the library. Repeated rows are counted again; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(_count(tokenizer), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, prefix_counts binary")


def tokens_in(prefix_counts: str, n_chars: int) -> Column:
    """How many tokens the first n_chars characters of each text have: all, of a shorter one; none, of an empty one; null, where nothing is stored."""

    @F.pandas_udf("long")
    def read(stored: pd.Series) -> pd.Series:
        return stored.map(lambda x: None if x is None else int(np.frombuffer(x, np.int8)[:n_chars].sum(dtype=np.int64))).astype("Int64")

    return read(F.col(prefix_counts))


def chars_within(prefix_counts: str, budget: int) -> Column:
    """The length of the longest prefix of each text that has at most budget tokens: 0, of an empty one; null, where nothing is stored."""

    @F.pandas_udf("long")
    def read(stored: pd.Series) -> pd.Series:
        def longest(x: bytes | None) -> int | None:
            if x is None:
                return None
            fits = np.flatnonzero(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64) <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0

        return stored.map(longest).astype("Int64")

    return read(F.col(prefix_counts))


def op6_prefix_counts(spark, sf_dir):
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
