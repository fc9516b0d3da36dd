"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be covered by
one token, so a cut between the two is certain. Texts are divided by the
tokenizer's own word pattern, the words are cut at every such pair, each
fragment is encoded by the merges alone and the ids are concatenated: no merge
crosses a cut, so the result equals that of the whole word. The fragments of
all words new to a task are encoded in one call; the results of the last words
are kept, in two generations of bounded size. Decoding goes from the ids alone:
the bytes of the tokens are laid end to end.

The vocabulary file is a parameter; every task opens it by itself.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._words import map_texts, slices

CACHE_WORDS = 100_000  # of each generation, besides the words of one slice

# The word pattern of the tokenizer's pre-tokeniser, and the
# contractions in it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters on which pattern engines of all Unicode versions agree; a text with
# any other is divided by the tokenizer's own pre-tokeniser.
PLAIN = r"[\t\n\r\x20-\x7e -ȳΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞]*"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    visible Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class TokenBytes:
    """The decoder: the bytes of all tokens in one buffer, and where each starts.
    Ids that are no token's stand for no bytes, as in the tokenizers library."""

    def __init__(self, bytes_of: dict[int, bytes]):
        count = max(bytes_of, default=-1) + 1
        self.length = np.zeros(count + 1, np.int64)  # the last one is no token
        for i, raw in bytes_of.items():
            self.length[i] = len(raw)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(bytes_of[i] for i in sorted(bytes_of)), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids < 0) | (ids >= len(self.length)), len(self.length) - 1, ids)
        n = self.length[ids]
        ends = np.cumsum(n)
        shift = np.repeat(self.start[ids] - (ends - n), n)
        return self.data[np.arange(len(shift)) + shift].tobytes()


class ForcedBoundaryBPE:
    """The encoder of one task, with its decoder."""

    def __init__(self, path: str):
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        self.pre = full.pre_tokenizer
        self.merges = Tokenizer(full.model)  # no pre-tokeniser, no special tokens
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.special = {t.content: i for i, t in full.get_added_tokens_decoder().items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        bytes_of: dict[int, bytes] = {}
        inside = np.zeros((256, 256), bool)
        for token, i in full.get_vocab(with_added_tokens=False).items():
            raw = np.array([self.byte_of[c] for c in token], np.uint8)
            bytes_of[i] = raw.tobytes()
            inside[raw[:-1], raw[1:]] = True
        for content, i in self.special.items():
            bytes_of[i] = content.encode()
        self.bytes_of = bytes_of
        self.decode = TokenBytes(bytes_of)
        self.forced = ~inside
        self.decimal = [str(i) for i in range(max(bytes_of) + 1)]
        self.spelled = dict(enumerate(self.alphabet))
        self.words: dict[str, str] = {}      # ids in decimals
        self.older: dict[str, str] = {}

    def cut(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The fragments of the words between forced boundaries, all words at
        once, and the number of the first fragment of each word (and the end)."""
        whole = b"".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        data = np.frombuffer(whole, np.uint8)
        here = self.forced[data[:-1], data[1:]]
        here[ends[:-1] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(here) + 1, [len(whole)]])
        bounds = at.tolist()
        return [whole[i:j] for i, j in zip(bounds, bounds[1:])], np.concatenate([[0], np.searchsorted(at, ends)])

    def learn(self, fresh: list[str]) -> None:
        """Encode words not seen lately: all their fragments in one call."""
        parts, first = self.cut([w.encode() for w in fresh])
        decimal, spelled = self.decimal, self.spelled
        new = list(set(parts))
        found = self.merges.encode_batch([f.decode("latin-1").translate(spelled) for f in new], add_special_tokens=False)
        known = {f: ",".join([decimal[i] for i in e.ids]) for f, e in zip(new, found)}
        results = [known[f] for f in parts]
        for w, i, j in zip(fresh, first[:-1].tolist(), first[1:].tolist()):
            self.words[w] = results[i] if j == i + 1 else ",".join(results[i:j])

    def recall(self, wanted: set[str]) -> None:
        """Have all wanted words in the younger generation."""
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        missing = wanted - self.words.keys()
        old = missing & self.older.keys()
        for w in old:
            self.words[w] = self.older[w]
        if fresh := list(missing - old):
            self.learn(fresh)

    def divide(self, text: str) -> list[str]:
        if self.plain(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def batch(self, texts: list[str]) -> Iterator[str]:
        """Ids in decimals joined by commas."""
        split = self.split_special
        pieces = [[t] if split is None or not split.search(t) else split.split(t) for t in texts]
        divided = [[[p] if p in self.special else self.divide(p) for p in ps if p] for ps in pieces]
        self.recall({w for ps in divided for ws in ps for w in ws} - self.special.keys())
        known = self.words
        for content, i in self.special.items():
            known[content] = str(i)
        for ps in divided:
            yield ",".join([known[w] for ws in ps for w in ws])


def numbers(joined: str) -> np.ndarray:
    """Ids written in decimals and joined by commas."""
    return np.fromstring(joined, np.int64, sep=",") if joined else np.zeros(0, np.int64)


def readable(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace")


def encode(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False, with_text: bool = False, passed: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text.

    Returns (id, n_tokens, ids_sha256, decoded_sha256), one row per input row,
    and on request ``ids`` (array of int), ``decoded`` (string) and the input columns
    named in ``passed``. Ids equal those
    of the tokenizers library without special tokens added; the strings of
    special tokens in a text become their ids, as there. ``decoded`` and its digest
    are made from the ids, as by ``decode``.

    Defined cases: null and empty texts have no tokens and decode to the empty
    text; null or repeated ids are passed through; an empty table gives no
    rows; other columns are ignored unless passed. Memory per task: a slice
    of texts, the bounded caches and the longest text.
    """
    fields = f"n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' * with_ids}{', decoded string' * with_text}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(tokenizer_path)
        for whole in batches:
            for b in slices(whole, "text"):
                n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
                for joined in bpe.batch([t or "" for t in b.column(1).to_pylist()]):
                    found = numbers(joined)
                    text = readable(bpe.decode(found))
                    n.append(len(found))
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids.append(found.astype(np.int32))
                    if with_text:
                        decoded.append(text)
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                columns += [pa.array(decoded, pa.string())] if with_text else []
                columns += [b.column(2)] if passed else []
                yield pa.RecordBatch.from_arrays(columns, names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       *([F.struct(*[F.col(c) for c in passed]).alias("passed")] if passed else []))
    fields = f"id {source.schema['id'].dataType.simpleString()}, {fields}"
    fields += f", passed {source.schema['passed'].dataType.simpleString()}" if passed else ""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text, *["passed"] * bool(passed)]
    out = map_texts(source, run, fields)
    return out.select(F.col("id").alias(id_col), *[c for c in names if c not in ("id", "passed")],
                      *[F.col(f"passed.`{c}`").alias(c) for c in passed])


def decode(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids",
           passed: tuple[str, ...] = ()) -> DataFrame:
    """The texts of arrays of ids: (id, decoded) and the input columns named in
    ``passed``, one row per input row.

    The tokens' bytes are joined, special tokens as their strings; bytes that are
    no UTF-8 become U+FFFD.

    Defined cases: a null or empty array decodes to the empty text; null ids and
    ids outside the vocabulary stand for nothing; null or repeated document ids
    are passed through; an empty table gives no rows; other columns are ignored
    unless passed. Memory per task: an Arrow batch, of which one array is decoded at a
    time, and its texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(tokenizer_path)
        for b in batches:
            texts = [readable(bpe.decode(v.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))) if v.is_valid else ""
                     for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *([b.column(2)] if passed else [])], names)

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<long>").alias("ids"),
                       *([F.struct(*[F.col(c) for c in passed]).alias("passed")] if passed else []))
    names = ["id", "decoded", *["passed"] * bool(passed)]
    fields = f"id {source.schema['id'].dataType.simpleString()}, decoded string"
    fields += f", passed {source.schema['passed'].dataType.simpleString()}" if passed else ""
    out = map_texts(source, run, fields)
    return out.select(F.col("id").alias(id_col), "decoded", *[F.col(f"passed.`{c}`").alias(c) for c in passed])
