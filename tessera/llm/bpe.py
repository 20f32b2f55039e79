"""Operator 8: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is built from a rank file: bytes map to the printable characters of the byte-level
alphabet, and each token's merge is the pair that lower ranks leave of it. Every match of the split
pattern is encoded separately, without special tokens. ``encode`` gives whole texts to the library, which
splits them and gives ids and character offsets. ``round_trip`` needs ids only: most matches are words that
come again and again, so each worker keeps the ids of those met so far in a bounded table, and the library
encodes the others of some texts in one batch (half the time of giving it whole texts). Decoding maps ids back
through the byte table, so a character split over tokens is whole again once the bytes are joined.

Defined results: null text is empty text: no tokens, digests of the empty string; repeated rows are
encoded one by one; texts of over ``PIECE`` characters are cut where the pattern always splits (after
a letter or digit, before a blank that a letter follows) and go on from there; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG = 64
TABLE_ENTRIES = 1_000_000
PIECE = 1 << 20

# The pattern that splits text for these vocabularies, and what it is on ASCII text.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, in order of rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        char = byte_alphabet()
        shown = lambda token: "".join(char[b] for b in token)
        model = models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges], cache_capacity=0, ignore_merges=True)
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        self.texts, self.matches = Tokenizer(model), Tokenizer(model)
        self.texts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), to_bytes])
        self.matches.pre_tokenizer = to_bytes
        self.known: dict[str, bytes] = {}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.bytes_of_decimal = {b"%d" % r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall if pattern == WORD_PATTERN else self.split
        self.cut = regex.compile(r"(?<=[\p{L}\p{N}]) (?=\p{L})")

    def _pieces(self, text: str) -> Iterator[str]:
        lo = 0
        while len(text) - lo > PIECE:
            m = self.cut.search(text, lo + PIECE)
            if m is None:
                break
            yield text[lo : m.start()]
            lo = m.start()
        yield text[lo:] if lo else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The decimal ids of each text, joined by one blank. The library encodes the matches that were not met
        before, in one batch for all texts."""
        split = [[self.split_ascii(p) if t.isascii() else self.split(p) for p in self._pieces(t)] for t in texts]
        known, met = self.known, set().union(*(m for pieces in split for m in pieces))
        if len(known) + len(met) > TABLE_ENTRIES:
            known.clear()
        new = list(met.difference(known))
        for word, found in zip(new, self.matches.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[word] = "".join([f" {i}" for i in found.ids]).encode()
        out = [b"".join(b"".join(map(known.__getitem__, m)) for m in pieces)[1:] for pieces in split]
        for word in new:
            if len(word) > LONG:
                del known[word]
        return out

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Ids, first characters and ends (exclusive) of each text's tokens; tokens that split a character
        share it."""
        pieces = [list(self._pieces(t)) for t in texts]
        found = iter(self.texts.encode_batch([p for x in pieces for p in x], add_special_tokens=False))
        for own in pieces:
            ids, starts, ends, at = [], [], [], 0
            for piece in own:
                e = next(found)
                ids += e.ids
                starts += [at + a for a, _ in e.offsets]
                ends += [at + z for _, z in e.offsets]
                at += len(piece)
            yield ids, starts, ends

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of_decimal.__getitem__, ids.split()))


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    if id(shared) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(shared)] = Codec(*shared.value)
    return _CODECS[id(shared)]


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """The texts (null: empty) of about PIECE characters at once."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size > PIECE:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def vocabulary(docs: DataFrame, path: str, pattern: str):
    """Ranks, merges and pattern as a broadcast: the size of the vocabulary file, whatever the corpus."""
    ranks = read_ranks(path)
    return docs.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks), pattern))


def encode(docs: DataFrame, shared, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, input_ids, starts, ends (character offsets of the tokens) of each row."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            rows = [row for texts in _groups(b.column(1)) for row in codec.encode_with_offsets(texts)]
            ids, starts, ends = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=[key, "input_ids", "starts", "ends"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, input_ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, shared, key: str = "doc_id") -> DataFrame:
    """key and text of each row of input_ids; bytes that are no UTF-8 become U+FFFD."""
    key_type = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codec(shared).bytes_of
        for b in batches:
            texts = [b"".join(map(table.__getitem__, x.as_py() or ())).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return tokens.select(key, "input_ids").mapInArrow(run, f"`{key}` {key_type}, text string")


def round_trip(docs: DataFrame, shared, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and input_ids): texts encoded, then decoded from ids."""
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            n, ids, back, lists = [], [], [], []
            for row in (row for texts in _groups(b.column(1)) for row in codec.encode(texts)):
                n.append(row.count(b" ") + 1 if row else 0)
                ids.append(hashlib.sha256(row).hexdigest())
                back.append(hashlib.sha256(codec.decode(row)).hexdigest())
                if with_ids:
                    lists.append(np.array(row.split(), dtype=np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["input_ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>" * with_ids)
