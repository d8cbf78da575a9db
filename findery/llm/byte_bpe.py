"""Byte-level BPE, exact and in linear time.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the
vocabulary finds, in one pass over a piece of text, the longest token that starts
at each byte. Encoding then walks left to right: it takes the longest token,
steps back to a shorter one where the token is not compatible with its left
neighbour, and marks positions that cannot be completed, so that each is tried
once. Two adjacent tokens are compatible if BPE applied to their joined bytes
would give back just these two; a sequence all of whose neighbours are compatible
is the BPE result. Answers are memoised, as are the results for pieces of text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, map_arrow, ref, text_slices

#: Where the public vocabulary files lie; every operator takes the path as a parameter.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A coarser cut at white space; no piece of PATTERN reaches across it.
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_PIECE = regex.compile(PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))
#: Entries after which a memo begins anew (``shorter`` has at most one for each token); that of
#: chunks keeps as many again from before.
_CACHE, _PAIRS = 150_000, 1_000_000
_LONG = 256


@dataclass
class Vocabulary:
    """Token bytes by id, and for each token the two whose merge makes it (itself
    twice for a single byte or a token no merge reaches)."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray


def load(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """Reads a rank file (base64 token, rank); the rank is the id and the order of
    the merges. The last merge of a token is what merging by rank leaves of it."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    left, right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    return Vocabulary(tokens, left, right)


class _Pieces(dict):
    """Memo of chunk -> ids; long chunks are not kept. What is asked for again after a
    turn is taken over from before it, so frequent chunks stay."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.encoder.chunk(chunk)
        if len(chunk) <= _LONG:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.tokens = vocabulary.tokens
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.sizes = [len(t) for t in self.tokens]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.pairs = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        reached = [len(t) == 1 or a != i for i, (t, a) in enumerate(zip(self.tokens, self.left))]
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            if token and reached[i]:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.usable = reached
        self.shorter: dict[int, int] = {}
        self.partners: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.pairs_known = 0
        self.pieces = _Pieces(self)

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1: none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.tokens[token]
            found = next((i for n in range(len(text) - 1, 0, -1) if (i := self.ids.get(text[:n])) is not None and self.usable[i]), -1)
            self.shorter[token] = found
        return found

    def fits(self, first: int, second: int) -> bool:
        """Whether merging by rank leaves the joined bytes as these two tokens.

        Undo the later of the two tokens' last merges, again and again; the pair is
        broken if the two that touch merge before what stood there was made.
        """
        a, b = first, second
        limit = len(self.tokens) + 1  # what touches now was merged away at this rank
        good = True
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                good = False
                break
            if a > b:  # the left token was made later
                if self.left[a] == a:
                    if self.left[b] == b:
                        break
                    limit, b = b + 1, self.left[b]
                else:
                    limit, a = a, self.right[a]
            else:
                if self.left[b] == b:
                    if self.left[a] == a:
                        break
                    limit, a = a, self.right[a]
                else:
                    limit, b = b + 1, self.left[b]
        return good

    def piece(self, raw: bytes) -> list[int]:
        """BPE of one piece of text."""
        n = len(raw)
        whole = self.ids.get(raw)
        if whole is not None and self.usable[whole]:
            return [whole]
        longest = [-1] * n
        for end, (token, back) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - back] = token  # a later match that starts here is longer
        dead = bytearray(n + 1)
        out: list[int] = []
        sizes, shorter, partners = self.sizes, self.shorter, self.partners
        at, token, last, known = 0, longest[0], -1, {}
        while True:
            while token >= 0:
                end = at + sizes[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = known.get(token)
                    if fits is None:
                        fits = known[token] = self.fits(last, token)
                        self.pairs_known += 1
                    if fits:
                        break
                found = shorter.get(token)
                token = self.next_shorter(token) if found is None else found
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at == n:
                    return out
                known, token = partners[last], longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this text")
                token = out.pop()
                at -= sizes[token]
                token = self.next_shorter(token)
                last = out[-1] if out else -1
                known = partners[last] if out else {}

    def chunk(self, text: str) -> bytes:
        """Ids (int32) of a chunk between white space."""
        if text.isascii() and text[text[0] == " " :].isalpha():  # one piece
            return array("i", self.piece(text.encode())).tobytes()
        out: list[int] = []
        for piece in _PIECE.findall(text):
            out += self.piece(piece.encode())
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if len(self.pieces) > _CACHE:
            self.pieces.turn()
        if self.pairs_known > _PAIRS:
            self.partners.clear()
            self.pairs_known = 0
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, _CHUNK.findall(text))), np.int32)

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker process and vocabulary, kept between tasks."""
    key = shared._path if getattr(shared, "_path", None) else id(shared)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", tokens_out: str = "tokens", count_out: str = "n_tokens", check_out: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text (no special tokens), their
    number and, if ``check_out`` is given, whether decoding gives the text back.

    Defined results: a null text has null ids, count and check; an empty text has no
    ids; texts of any length are encoded whole. Rows are independent, so repeated rows
    repeat their result; an empty table gives an empty table. Outputs get underscores in
    front where ``docs`` has a column of the name (in any case of letters).
    """
    names = fresh(docs, tokens_out, count_out, *([check_out] if check_out else []))
    tokens_out, count_out, check_out = [*names, None][:3]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in text_slices(batches, text_col, 2 << 20):
            texts = batch.column(text_col).to_pylist()
            ids = [None if t is None else encoder.encode(t) for t in texts]
            sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
            flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([x is None for x in ids] + [False]))
            made = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int32())]
            if check_out:
                made.append(pa.array([None if t is None else encoder.decode(x.tolist()) == t for t, x in zip(texts, ids)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    fields = [T.StructField(tokens_out, T.ArrayType(T.IntegerType())), T.StructField(count_out, T.IntegerType())]
    fields += [T.StructField(check_out, T.BooleanType())] if check_out else []
    return map_arrow(docs, work, T.StructType([*docs.schema.fields, *fields]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, tokens_col: str = "tokens", text_out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its token ids.

    A null list gives a null text, an empty one an empty text; a null or unknown id
    among others stands for U+FFFD, and so do bytes that are no UTF-8. The output gets
    underscores in front where ``encoded`` has a column of the name.
    """
    (text_out,) = fresh(encoded, text_out)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lost = shared.value.tokens, "\ufffd".encode()
        for batch in batches:
            texts = []
            for ids in batch.column(tokens_col).to_pylist():
                known = [] if ids is None else [lost if i is None or not 0 <= i < len(tokens) else tokens[i] for i in ids]
                texts.append(None if ids is None else b"".join(known).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_out])

    return map_arrow(encoded, work, T.StructType([*encoded.schema.fields, T.StructField(text_out, T.StringType())]))


def query(spark: SparkSession, sf_dir: str, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(ref("doc_id"), ref("text"))
    return encode(docs, load(vocabulary_path), check_out="round_trip").select("doc_id", "tokens", "n_tokens", "round_trip")
