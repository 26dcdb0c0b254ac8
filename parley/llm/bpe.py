"""Byte-level BPE encoding and decoding with a given rank table.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is a vocabulary entry as a
whole; any other pre-token is merged bottom-up with a heap of candidate pairs over a linked list of its bytes,
O(n log n) for a pre-token of n bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from parley.llm.common import Memo, list_table, regrouped, slices
from parley.llm.mph import MinimalPerfectHash

#: Fixed value: a pattern under which a lone blank between two characters that aren't white space begins a pre-token, so
#: that texts can be cut there. Texts under any other pattern are encoded in one piece.
CUT_AT_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text, and ids, at a time.
_PIECE, _OUT_IDS = 4 << 20, 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 and id. Ids must be 0..n-1."""
    with open(path, "rb") as f:
        ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tokens with a minimal perfect hash from their bytes to their ids, each hit checked against the bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.mph = MinimalPerfectHash.of_bytes(tokens)
        self.at = [0] * len(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        for i, t in enumerate(tokens):
            self.at[self.mph.find(t)] = i
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.double = [[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.known = Memo(self.resolve, 3 << 16)
        self.whole_texts = pattern != CUT_AT_BLANKS

    def whole(self, data: bytes) -> int:
        slot = self.mph.find(data)
        if slot >= 0 and self.tokens[i := self.at[slot]] == data:
            return i
        return -1

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry: of the neighbouring parts that form an entry together, those
        of the lowest rank merge first, the leftmost of equal ones. pair holds the rank of each part and its right
        neighbour, so a heap entry that no longer agrees with it is out of date."""
        n, rank_of = len(data), self.ranks.get
        shift = n.bit_length()
        low = (1 << shift) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ids = list(map(self.single.__getitem__, data))
        pair = [row[b] for row, b in zip(map(self.double.__getitem__, data), data[1:], strict=False)]
        heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
        pair.append(-1)
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            i = best & low
            if pair[i] != best >> shift:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            before[end] = i
            ids[i], ids[gone], pair[gone] = best >> shift, -1, -1
            pair[i] = rank = rank_of(data[i : after[end]], -1) if end < n else -1
            if rank >= 0:
                heapq.heappush(heap, rank << shift | i)
            if i:
                left = before[i]
                pair[left] = rank = rank_of(data[left:end], -1)
                if rank >= 0:
                    heapq.heappush(heap, rank << shift | left)
        return [i for i in ids if i >= 0]

    def resolve(self, piece: str) -> bytes:
        """Id bytes of one pre-token."""
        data = piece.encode()
        ids = [i] if (i := self.whole(data)) >= 0 else self.merge(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """Id bytes of a text."""
        pieces = self.pattern.findall(text)
        return self.known[pieces[0]] if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def columns(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text. Texts are cut at blanks, and each distinct piece is encoded once."""
        if self.whole_texts:
            return list_table([self.packed(t or "") for t in texts.to_pylist()], 4)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        count = np.asarray(pc.list_value_length(split)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        n, start = len(words), np.cumsum(count) - count
        size = lambda x: np.asarray(pc.binary_length(x))
        own = size(words)
        lead, trail = ((size(cut(words)) < own) | (own == 0) for cut in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        glued = np.zeros(len(code), bool)  # to the piece before: a blank beside white space is no cut
        glued[1:] = lead[code[1:]] | trail[code[:-1]]
        glued[start] = False
        head = np.zeros(len(code), bool)
        head[start] = True
        first = np.flatnonzero(~glued)
        length = np.diff(np.append(first, len(code)))
        unit = code[first] + n * head[first]  # pieces after a blank, then pieces at the beginning of a text, then glued ones
        texts_of = words.to_pylist()
        glued_texts = []
        for j, i in enumerate(np.flatnonzero(length > 1).tolist()):
            piece = " ".join(map(texts_of.__getitem__, code[first[i] : first[i] + length[i]].tolist()))
            glued_texts.append(piece if head[first[i]] else " " + piece)
            unit[i] = 2 * n + j

        used = np.bincount(unit, minlength=2 * n + len(glued_texts)) > 0
        table = list_table([self.packed(" " + texts_of[c] if c < n else texts_of[c - n] if c < 2 * n else glued_texts[c - 2 * n]) for c in np.flatnonzero(used).tolist()], 4)
        return regrouped(table.take(pa.array((np.cumsum(used) - 1)[unit])), np.diff(np.append(np.searchsorted(first, start), len(first))))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and `ids` (array of int) of each row's whole text. Null text counts as empty and gives no ids; other
    columns are ignored, so clashing names can't matter; repeated rows give repeated rows; an empty table gives none. Pre-tokens are the matches
    of `pattern`, each encoded by itself without special tokens. The rank table is a file of fixed size, read on the driver and sent along."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokens.value, pattern)
        for batch in batches:
            for piece in slices(batch, _PIECE):
                lists = vocabulary.columns(piece.column("text"))
                ends = np.asarray(lists.offsets)
                start = 0
                while start < len(lists):  # about _OUT_IDS ids at a time, one row at least
                    stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _OUT_IDS, "right")) - 1)
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").slice(start, stop - start), lists.slice(start, stop - start).cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    start = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, `ids` and the `decoded` bytes (binary, empty for no ids) of rows of doc_id and ids. Null ids count as none. Ids outside the table fail."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(tokens.value, pa.large_binary())
        for whole in batches:
            count = np.asarray(pc.fill_null(pc.list_value_length(whole.column("ids")), 0)).astype(np.int64)
            ends, start = np.cumsum(count), 0
            while start < len(ends):  # about _OUT_IDS ids at a time, one row at least
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _OUT_IDS, "right")))
                batch = whole.slice(start, stop - start)
                flat = batch.column("ids").flatten()
                if len(flat) and not (0 <= pc.min(flat).as_py() and pc.max(flat).as_py() < len(table)):
                    raise ValueError("id outside the vocabulary")
                parts = table.take(flat)
                at = np.frombuffer(parts.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(count[start:stop])])] if len(flat) else np.zeros(stop - start + 1, np.int64)
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(at.tobytes()), parts.buffers()[2]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded.cast(pa.binary())], names=["doc_id", "ids", "decoded"])
                start = stop

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def coded(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests (lower-case hex) of each row's ids, as decimals joined by commas, and of the bytes that the ids decode to; with the ids themselves
    if wanted. `encode` and `decode` in one pass, so that ids don't travel between two of them. Null text counts as empty; other columns are ignored; repeated rows give repeated rows; an empty table gives none."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table, decimals = Vocabulary(tokens.value, pattern), pa.array(tokens.value, pa.large_binary()), pa.array([f",{i}" for i in range(len(tokens.value))], pa.large_binary())
        for batch in batches:
            for piece in slices(batch, _PIECE):
                lists = vocabulary.columns(piece.column("text"))
                ends = np.asarray(lists.offsets)
                digests = []
                for of, skip in ((decimals, 1), (table, 0)):  # what an id is written as: its decimals behind a comma, which the first one loses, or its bytes
                    parts = of.take(lists.values)
                    at = np.frombuffer(parts.buffers()[1], np.int64)[ends] if len(parts) else np.zeros(len(ends), np.int64)
                    data = memoryview(parts.buffers()[2]) if len(parts) else memoryview(b"")
                    digests.append(pa.array([hashlib.sha256(data[a + skip if b > a else a : b]).hexdigest() for a, b in itertools.pairwise(at.tolist())], pa.string()))
                    del parts, data
                columns = [piece.column("doc_id"), pa.array(np.diff(ends), pa.int64()), *digests, *([lists.cast(pa.list_(pa.int32()))] if ids else [])]
                made = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])
                start = 0
                while start < len(made):  # about _OUT_IDS ids at a time, one row at least
                    stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _OUT_IDS, "right")) - 1) if ids else len(made)
                    yield made.slice(start, stop - start)
                    start = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if ids else ''}")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return coded(docs, path, public_tokenizers.PATTERN)
