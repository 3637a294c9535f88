"""Byte-level BPE ids and character offsets of whole texts, with words remembered; token counts of sections.

Such a tokenizer parts a text before every single space that a visible character follows, whatever stands
around it, so the stretches between those places can be encoded one by one. Usual stretches are looked up.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, sliced, with_arrow

STRETCHES = re.compile(r"(?= \S)")


class StretchEncoder:
    """Encodes by a tokenizer file of byte-level BPE without a prefix space.

    ``offsets``: remember where tokens start (in characters of the stretch) instead of their ids. ``added``: the
    strings of the file's added tokens give their ids, as in the library; else they are plain text.
    """

    def __init__(self, path: str, offsets: bool = False, remember: int = 120_000, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added, self.parting = None, STRETCHES
        if added and (tokens := "|".join(map(re.escape, added_tokens(path)))):
            self.added, self.parting = re.compile(tokens), re.compile(rf"(?= (?!{tokens})\S)")
        self.offsets, self.remember = offsets, remember
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def raw(self, stretches: list[str], at_once: int = 2048) -> list[bytes]:
        if len(stretches) > at_once:  # the library's results are large while they last
            return [b for k in range(0, len(stretches), at_once) for b in self.raw(stretches[k : k + at_once])]
        if self.offsets:
            found = self.tokenizer.encode_batch(stretches, add_special_tokens=False)
            return [np.array([o[0] for o in e.offsets], "<u4").tobytes() for e in found]
        found = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def stretches(self, text: str) -> list[str]:
        """The stretches without their leading space; the first stands as it is, so that it is ' '-free or whole."""
        parts = text.split(" ")
        # white space before an added token is a text's end for the library, so it is not parted
        if any(not p or p[0].isspace() for p in parts[1:]) or (self.added and self.added.search(text)):
            parts = self.parting.split(text)
            parts[1:] = [p[1:] for p in parts[1:]]
            if text[:1] == " " and parts[0] == "":
                return parts
        return parts

    def __call__(self, texts: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """For each text its stretches and, as little-endian unsigned 32-bit numbers, what was asked for of each."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.stretches(text))
            size += len(text)
            if size > 500_000:  # characters held at once
                yield from self.several(held)
                held, size = [], 0
        yield from self.several(held)

    def several(self, held: list[list[str]]) -> Iterator[tuple[list[str], list[bytes]]]:
        new = set()
        rows = []
        for parts in held:
            row = list(map(self.spaced.get, parts))
            row[0] = b""
            if None in row:
                for k, x in enumerate(row):
                    if x is None:
                        old = self.older.get(parts[k])
                        if old is None:
                            new.add(parts[k])
                        else:
                            self.spaced[parts[k]] = row[k] = old
            rows.append(row)
        if len(self.spaced) > self.remember:
            self.older, self.spaced = self.spaced, {}
        words = list(new)
        made = dict(zip(words, self.raw([" " + w for w in words]), strict=True))
        self.spaced |= {w: b for w, b in made.items() if len(w) < 64}
        first = self.raw([parts[0] for parts in held])
        for parts, row, head in zip(held, rows, first, strict=True):
            row[0] = head
            if None in row:
                row = [made[p] if x is None else x for p, x in zip(parts, row, strict=True)]
            yield parts, row


def added_tokens(path: str) -> dict[str, int]:
    """The strings and ids of a tokenizer file's added tokens."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in tokens):
        raise ValueError("added tokens that depend on what stands around them")
    return {t["content"]: t["id"] for t in tokens}


#: Fixed value: how byte-level BPE parts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE tokenizer file as bytes and ids; ids must be in the order of merges."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    parted = said["pre_tokenizer"] or {}
    if parted.get("type") != "ByteLevel" or parted.get("add_prefix_space") or not parted.get("use_regex", True) or said.get("normalizer"):
        raise ValueError("not byte-level BPE as PATTERN parts it, without a prefix space or a normalizer")
    # visible bytes stand for themselves, the others for characters from 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary, special = said["model"]["vocab"], {t["content"] for t in said["added_tokens"]}
    ids = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError("ids are not in the order of merges")
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class WholeTextEncoder:
    """The ids that the tokenizer file gives, by a second engine that is faster on whole texts.

    Texts are given to the engine in parts of about ``longest`` characters, which end where the tokenizer parts a
    text in any case, so that results do not depend on it. ``added`` as in StretchEncoder.
    """

    def __init__(self, path: str, longest: int = 100_000, added: bool = False):
        import tiktoken

        self.special = added_tokens(path) if added else {}
        ranks = merge_ranks(path)
        self.engine = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        # not before an added token, where white space is a text's end for the library
        self.safe = re.compile(rf"(?= (?!{'|'.join(map(re.escape, self.special))})\S)" if self.special else r"(?= \S)")
        self.longest = longest
        #: Bytes of the text that each id stands for.
        self.sizes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        for token, i in self.special.items():
            self.sizes[i] = len(token.encode())

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= self.longest:
            return self.part(text)
        parts, at = [], 0
        while at < len(text):
            m = self.safe.search(text, at + max(1, self.longest))
            end = m.start() if m else len(text)
            parts.append(self.part(text[at:end]))
            at = end
        return np.concatenate(parts)

    def part(self, text: str) -> np.ndarray:
        if any(t in text for t in self.special):
            return np.array(self.engine.encode(text, allowed_special="all"), "<u4")
        return np.array(self.engine.encode_ordinary(text), "<u4")


def joined(row: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(row), "<u4")


def token_starts(parts: list[str], row: list[bytes]) -> np.ndarray:
    """First characters of a text's tokens, from those of its stretches."""
    inside = joined(row).astype(np.int64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    lengths[0] -= 1
    begins = np.cumsum(lengths) - lengths
    return inside + np.repeat(begins, np.fromiter(map(len, row), np.int64, len(row)) // 4)


def section_tokens(starts: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """How many tokens each section (given by its first characters, ascending from 0) gets.

    A token belongs to the section that holds its first character, so tokens over a boundary count once, before it.
    """
    return np.bincount(np.searchsorted(sections, starts, side="right") - 1, minlength=len(sections))


def line_starts(text: str) -> np.ndarray:
    """Sections are lines with their line ends; a last line without text counts only if it is the only one."""
    at = [0]
    i = text.find("\n")
    while 0 <= i < len(text) - 1:
        at.append(i + 1)
        i = text.find("\n", i + 1)
    return np.array(at, np.int64)


def byte_lines(raw: np.ndarray) -> np.ndarray:
    """As ``line_starts``, in bytes of the UTF-8 text."""
    at = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], at[at < len(raw)]])


def section_token_counts(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns but the text, one row for each line of it: ``section`` (from 0), ``start``, ``end``, ``n_tokens``, ``text_tokens``.

    Each whole text is encoded once. The tokens' lengths in bytes add up to their places in the text, which are
    joined to the sections' intervals; a token over a boundary belongs to the section of its first byte. Sections start
    and end at characters, so the character that holds this byte says the same. The
    sections' counts add up to ``text_tokens``. Null and empty texts give one empty section without tokens; equal rows
    give equal rows, an empty table gives an empty one; texts may have any length. A new column whose name is taken gets underscores behind it.
    """
    kept = [c for c in df.columns if c != text]
    new = fresh(df.select(*kept), "section", "start", "end", "n_tokens", "text_tokens")
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, T.LongType()) for n in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WholeTextEncoder(path, added=True)
        for batch in sliced(batches):  # many lines come of few texts
            begins, ends, counts = [], [], []
            for t in batch.column(len(kept)).to_pylist():
                raw = np.frombuffer((t or "").encode(), np.uint8)
                sizes = encoder.sizes[encoder(t or "")]
                lines = byte_lines(raw)
                counts.append(section_tokens(np.cumsum(sizes) - sizes, lines))
                if len(raw) != len(t or ""):  # bytes to characters
                    lines = np.cumsum((raw & 0xC0) != 0x80)[lines] - 1
                begins.append(lines)
                ends.append(np.append(lines[1:], len(t or "")))
            n = np.array([len(b) for b in begins])
            cells = [np.concatenate([np.arange(k) for k in n]), *(np.concatenate(x).astype(np.int64) for x in (begins, ends, counts)), np.repeat([c.sum() for c in counts], n)]
            others = batch.select(range(len(kept))).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([*others.columns, *map(pa.array, cells)], names=schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


def with_ids(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns with ``ids`` (array of long) of every whole text; a null text counts as empty.

    Equal rows give equal rows, an empty table an empty one; texts may have any length. If there is a column ``ids``, the new one gets underscores behind it.
    """

    def make():
        encoder = WholeTextEncoder(path, added=True)

        def work(texts):
            return [pa.array([encoder(t or "").astype(np.int64) for t in texts], pa.list_(pa.int64()))]

        return work

    return with_arrow(df, [text], [T.StructField("ids", T.ArrayType(T.LongType()))], make)


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return section_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
