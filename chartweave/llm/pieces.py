"""Exact encoding with a merge-type piece model by backtracking, and decoding.

A text's encoding is the one sequence of pieces in which every adjacent pair is stable, which means that
merging the characters of the two pieces anew gives the same two pieces. The encoder takes the longest
piece that an Aho-Corasick automaton of the vocabulary finds at a place, steps to shorter ones when a pair
is not stable, and marks places from which the rest could not be encoded in a bit field, so that each is
tried once.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

#: The mark that stands for a space, and the form of byte pieces.
MARK = "▁"
BYTE_PIECE = "<0x%02X>"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_pieces(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, type) in id order, and the settings of the model that matter here."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        kind = BYTE if model.is_byte(i) else CONTROL if model.is_control(i) else UNKNOWN if model.is_unknown(i) else UNUSED if model.is_unused(i) else NORMAL
        pieces.append((model.id_to_piece(i), model.get_score(i), kind))
    # what the model does to plain texts tells how it prepares them
    prefixed = model.encode_as_pieces("a")[:1] in ([MARK + "a"], [MARK])
    return pieces, {"prefix": prefixed, "keeps_spaces": model.decode(model.encode("  a  ")) == "  a  ", "unknown": model.unk_id()}


class PieceCodec:
    """Encodes and decodes as the model's own library does: no begin or end ids, no sampling.

    For models of merge type that keep white space, with or without a leading space mark, with byte
    pieces for characters outside the vocabulary (else the unknown id).
    """

    def __init__(self, pieces: list[tuple[str, float, int]], settings: dict, remember: int = 250_000):
        import ahocorasick

        if not settings["keeps_spaces"]:
            raise ValueError("this codec is for models that keep white space as it is")
        self.prefix, self.unknown, self.remember = settings["prefix"], settings["unknown"], remember
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.shown = [p for p, _, _ in pieces]
        self.kind = [kind for _, _, kind in pieces]
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.pairs = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: each piece's longest proper prefix that is a piece
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), "") for p in self.id_of}
        self.stretches: dict[str, list[int]] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.plain = set(self.id_of.values())
        self.inner = any(MARK in p.lstrip(MARK) for p in self.id_of)

    def merged(self, text: str) -> list[str]:
        """The pieces by merging: the best-scored neighbours first, the leftmost of equals."""
        at = list(text)
        score = self.score
        while len(at) > 1:
            best, where = None, -1
            for i in range(len(at) - 1):
                s = score.get(at[i] + at[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            at[where : where + 2] = [at[where] + at[where + 1]]
        return at

    def fits(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            known = left[-1] + right[0] not in self.pairs or self.merged(left + right) == [left, right]
            if len(self.stable) >= self.remember:
                self.stable.clear()
            self.stable[left, right] = known
        return known

    def backtrack(self, text: str) -> list[str]:
        """The stable sequence of pieces for a text whose characters are all in the vocabulary."""
        out = [piece for _, piece in self.automaton.iter_long(text)]
        stable, last = self.stable, ""
        for piece in out:  # the longest matches one after another are the answer if all pairs are stable
            if not (stable.get((last, piece)) or (self.fits(last, piece) if last else self.alone(piece))):
                break
            last = piece
        else:
            return out
        n = len(text)
        longest: list[str] = [""] * n
        for end, piece in self.automaton.iter(text):
            start = end - len(piece) + 1
            if len(piece) > len(longest[start]):
                longest[start] = piece
        failed = bytearray(n // 8 + 1)  # a bit for each place from which the rest cannot be encoded
        out, at, piece, last, shorter = [], 0, longest[0] if n else "", "", self.shorter
        while at < n:
            stop = at + len(piece)
            if not failed[stop >> 3] >> (stop & 7) & 1:
                fit = stable.get((last, piece))
                if fit is None:
                    fit = self.fits(last, piece) if last else self.alone(piece)
                if fit:
                    out.append(piece)
                    at, last = stop, piece
                    piece = longest[at] if at < n else ""
                    continue
            piece = shorter.get(piece)
            if piece:
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not out:
                return self.merged(text)  # not reached for a vocabulary that holds all its characters
            piece = out.pop()
            at, last = at - len(piece), out[-1] if out else ""
        return out

    def alone(self, piece: str) -> bool:
        known = self.stable.get(("", piece))
        if known is None:
            known = self.stable["", piece] = self.merged(piece) == [piece]
        return known

    def part(self, text: str) -> list[int]:
        """Ids of a stretch without a place that no piece can span."""
        ids = self.stretches.get(text)
        if ids is None:
            ids = [self.id_of[p] for p in self.backtrack(text)] if self.chars.issuperset(text) else self.outside(text)
            if len(text) < 24 and len(self.stretches) < self.remember // 2:
                self.stretches[text] = ids
        return ids

    def outside(self, text: str) -> list[int]:
        """Ids of a stretch with characters that the vocabulary lacks; these part it."""
        ids: list[int] = []
        for run in self.runs(text):
            if run[0] in self.chars:
                ids += [self.id_of[p] for p in self.backtrack(run)]
            else:
                for c in run:
                    raw = c.encode()
                    ids += [self.byte_id[b] for b in raw] if all(b in self.byte_id for b in raw) else [self.unknown]
        return ids

    def runs(self, text: str) -> list[str]:
        out, inside = [], None
        for c in text:
            if (c in self.chars) == inside:
                out[-1] += c
            else:
                out.append(c)
                inside = c in self.chars
        return out

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word with its leading marks, cut where no piece spans two characters."""
        ids: list[int] = []
        start, pairs = 0, self.pairs
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                ids += self.part(word[start:i])
                start = i
        return ids + self.part(word[start:])

    def split(self, text: str) -> list[str]:
        """Words with their leading space marks, which no piece spans the end of."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        if self.inner:
            return [text]
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.split(text) for i in self.word_ids(word)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks to spaces but for the leading one, byte pieces joined and read as UTF-8.

        A leading negative id stands for text before.
        """
        out: list[str] = []
        raw = bytearray()
        for k, i in enumerate(ids):
            if i < 0:
                continue
            if self.kind[i] == BYTE:
                raw.append(int(self.shown[i][3:5], 16))
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            if self.kind[i] == CONTROL:
                continue
            shown = " ⁇ " if self.kind[i] == UNKNOWN else self.shown[i]
            if k == 0 and self.prefix and shown.startswith(MARK):
                shown = shown[1:]
            out.append(shown.replace(MARK, " "))
        if raw:
            out.append(utf8(bytes(raw)))
        return "".join(out)

    def word_digest(self, word: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the decoded word (marks as spaces)."""
        ids = self.word_ids(word)
        decoded = word.replace(MARK, " ")  # pieces are stretches of the word; only other ids need reading
        if not self.plain.issuperset(ids):
            decoded = self.decode([-1, *ids])
        return ",".join(map(str, ids)), len(ids), decoded

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text."""
        words = self.split(text or "")
        if not words:
            return 0, EMPTY, EMPTY
        rows = list(map(self.words.get, words))
        if None in rows:
            for k, row in enumerate(rows):
                if row is None:
                    rows[k] = self.remembered(words[k])
        ids, numbers, decoded = zip(*rows, strict=True)
        shown = "".join(decoded)
        if self.prefix and shown.startswith(" "):
            shown = shown[1:]
        return sum(numbers), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()

    def remembered(self, word: str) -> tuple[str, int, str]:
        """A word's digest; digests are kept in two generations, so that memory is bounded and usual words stay."""
        row = self.words.get(word) or self.older.get(word) or self.word_digest(word)
        if len(word) < 40:
            if len(self.words) >= self.remember:
                self.older, self.words = self.words, {}
            self.words[word] = row
        return row


EMPTY = hashlib.sha256(b"").hexdigest()


def utf8(raw: bytes) -> str:
    """Bytes as text, one replacement character for each byte that is not part of a valid sequence."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(*model_pieces(path))


def encode_texts(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns with ``ids`` (array of int) of every whole text; a null text counts as empty and has no ids."""

    def make():
        c = codec(path)
        return lambda texts: [pa.array([c.encode(t or "") for t in texts], pa.list_(pa.int32()))]

    return with_arrow(df, [text], [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode_ids(df: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """All columns with ``decoded``; null ids give an empty text."""

    def make():
        c = codec(path)
        return lambda rows: [pa.array([c.decode(r or []) for r in rows], pa.string())]

    return with_arrow(df, [ids], [T.StructField("decoded", T.StringType())], make)


def piece_digests(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text (null: empty).

    Equal rows give equal rows, an empty table an empty one; texts may have any length. A new column whose name is taken gets
    underscores behind it.
    """

    def make():
        c = codec(path)

        def work(texts):
            rows = [c.digest(t) for t in texts]
            return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_arrow(df, [text], fields, make)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
