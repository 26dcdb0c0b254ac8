"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A dataset is a folder. Shard s holds the documents of one range of doc_id, ascending, in three files:

* `ids-s.bin`: the raw little-endian ids of all its documents, one after the other, as 16-bit integers if the
  vocabulary allows and 32-bit ones otherwise;
* `mph-s.npz`: the index. A minimal perfect hash over the shard's distinct keys gives a slot; the slot stores a
  32-bit fingerprint of its key, the ordinal of the key's first document and the number of its documents; `ends` turns ordinals into id offsets;
* `key-s.bin`: the keys in order, for scans of everything (a lookup doesn't read them).

`manifest` is a table of one row a shard: its key range, documents and ids. The number of shards is the number
of partitions, so the manifest is small beside the data. Files are written under the task's own name and then
renamed, so a repeated or speculative task leaves one whole copy.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import Memo, list_table, new_folder, partitions, regrouped, slices
from parley.llm.mph import MinimalPerfectHash, mix

_KEY_SEED, _PRINT_SEED = 0, 1
#: Bytes of text at a time; bytes of text a shard, where the caller names no number of shards; most shards a lookup takes; parts whose ids a task keeps.
_PIECE, SHARD_BYTES, MOST_SHARDS, _KNOWN = 16 << 20, 512 << 20, 1 << 20, 1 << 18
#: What `by_words` tries: words of letters, digits, marks, signs, combining characters and other scripts, and what may part them.
_WORDS = ("a", "Bc", "1", "23", "x9", "'", "'s", "it's", "don't", "-", "...", "a.b", "<|", "é", "e\u0301", "\u0301", "Σ", "ΑΣ", "日本", "ß", "İ", "_", "🎉", "\u200d", "ﬁ", "#x")
_GAPS = (" ", "\n", "\t", "\r", "\x0b", "\x0c", "  ", " \n ")


#: A run of ASCII signs but the apostrophe, between ASCII letters or digits or at a word's end.
_SIGNS = r"([A-Za-z0-9])([!-&(-/:-@\[-`{-~]+)(?:([A-Za-z0-9])|$)"


def by_words(encode: Callable[[str], list[int]]) -> bool:
    """Whether a text's ids are its words' ids, words being what ASCII white space parts: tried on all pairs of probes in both orders, with every kind of white space between and around."""
    ids = {w: encode(w) for w in _WORDS}
    return all(encode(f"{gap}{x}{gap}{y}{gap}") == ids[x] + ids[y] for gap in _GAPS for x in _WORDS for y in _WORDS)


def by_signs(encode: Callable[[str], list[int]]) -> bool:
    """Whether a word's ids are the ids of what runs of ASCII signs part and of the runs, in lower case: tried on all signs, doubled too."""
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
    parted = all(encode(a + s + b) == encode(a) + encode(s) + encode(b) for s in [*signs, *(x + y for x in signs[:8] for y in signs)] for a in ("a", "Z", "7") for b in ("b", "9", ""))
    return parted and all(encode(chr(c) + "Xy" + chr(c)) == encode((chr(c) + "Xy" + chr(c)).lower()) for c in range(33, 127))


def straight(encode: Callable[[str], list[int]], model) -> bool:
    """Whether words of a-z alone go to the tokenizer's model as they are: tried on all of up to three letters and some long ones."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    tried = ["".join(x) for n in (1, 2, 3) for x in product(letters, repeat=n)] + [letters, letters * 3, *(a * 40 for a in letters)]
    return all(encode(w) == [t.id for t in model.tokenize(w)] for w in tried)


class TextIds:
    """Ids of texts by the tokenizers library. words: the tokenizer passed `by_words`, so each distinct word of a piece of the
    table is encoded once, otherwise whole texts are; signs: it passed `by_signs`, so distinct words are parted further; letters: it passed
    `straight`, so parts of a-z skip the library's normaliser and pre-tokenizer. Strings of special tokens hold signs that must stay together, so words with `<|` or `|>` are not parted."""

    def __init__(self, tokenizer_json: str, width: int, words: bool, signs: bool, letters: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.words, self.signs = Tokenizer.from_str(tokenizer_json), width, words, signs
        self.model, self.code, self.letters = self.tokenizer.model, "H" if width == 2 else "I", letters
        self.known: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x.ids)}{self.code}", *x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def columns(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text."""
        texts = pc.fill_null(texts, "")
        if not self.words:
            return list_table(self.packed(texts.to_pylist()), self.width)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        table = self.of_words(coded.dictionary)
        return regrouped(table.take(coded.indices), np.asarray(pc.list_value_length(split)))

    def of_words(self, words: pa.Array) -> pa.LargeListArray:
        if not self.signs:
            return list_table(self.of_parts(words.to_pylist()), self.width)
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring_regex(words, r"<\||\|>")))
        parts = pc.split_pattern(pc.if_else(plain, pc.replace_substring_regex(pc.ascii_lower(words), _SIGNS, r"\1 \2 \3"), words), " ")
        coded = parts.flatten().dictionary_encode()
        table = list_table(self.of_parts(coded.dictionary.to_pylist()), self.width)
        return regrouped(table.take(coded.indices), np.asarray(pc.list_value_length(parts)))

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """Id bytes of each part; those of the first _KNOWN parts of up to Memo.CHARS characters are kept for later pieces."""
        out = list(map(self.known.get, parts))
        new = [i for i, ids in enumerate(out) if ids is None]
        rest = []
        for i in new:
            word = parts[i]
            if self.letters and word.isascii() and word.isalpha() and word.islower():
                ids = [t.id for t in self.model.tokenize(word)]
                out[i] = struct.pack(f"<{len(ids)}{self.code}", *ids)
            else:
                rest.append(i)
        for i, ids in zip(rest, self.packed([parts[i] for i in rest]), strict=True):
            out[i] = ids
        room = _KNOWN - len(self.known)
        self.known.update((parts[i], out[i]) for i in new[: max(0, room)] if len(parts[i]) <= Memo.CHARS)
        return out


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else pafs.FileSystem.from_uri("file://" + re.sub(r"^file:", "", folder))


def _put(files: pafs.FileSystem, path: str, data: bytes) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


def build_index(keys: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of an index over ascending keys, equal ones being one key's documents; ends: id offsets after each."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    hashed = mix(keys[first].view(np.uint64), _KEY_SEED)
    mph = MinimalPerfectHash.build(hashed)
    slot = mph.lookup(hashed)
    prints, ordinal, count = np.empty(len(first), np.uint32), np.empty(len(first), np.uint32), np.empty(len(first), np.uint32)
    prints[slot] = (mix(keys[first].view(np.uint64), _PRINT_SEED) >> np.uint64(32)).astype(np.uint32)
    ordinal[slot] = first
    count[slot] = np.diff(np.append(first, len(keys)))
    np.savez(out := io.BytesIO(), prints=prints, ordinal=ordinal, count=count, ends=ends.astype(np.uint64), **mph.arrays())
    return out.getvalue()


class Shard:
    """A shard open for keyed access. nulls: its documents without a key, which stand first and aren't indexed."""

    def __init__(self, folder: str, shard: int, width: int, nulls: int):
        self.files, self.path = _open(folder)
        self.shard, self.width, self.nulls = shard, width, nulls
        with self.files.open_input_file(f"{self.path}/mph-{shard:06d}.npz") as f:
            index = np.load(io.BytesIO(f.read()))
        self.mph = MinimalPerfectHash(index["sizes"], index["words"], index["ranks"])
        self.prints, self.ordinal, self.count = index["prints"], index["ordinal"], index["count"]
        self.begin = np.concatenate([[0], index["ends"].astype(np.int64)])
        self.ids = self.files.open_input_file(f"{self.path}/ids-{shard:06d}.bin")

    def keys(self) -> np.ndarray:
        with self.files.open_input_file(f"{self.path}/key-{self.shard:06d}.bin") as f:
            return np.frombuffer(f.read(), "<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the first document, number of documents) of each key; number 0 where the fingerprint differs or no slot is found."""
        slot = self.mph.lookup(mix(keys.view(np.uint64), _KEY_SEED))
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (mix(keys[known].view(np.uint64), _PRINT_SEED) >> np.uint64(32)).astype(np.uint32)
        at = np.where(known, slot, 0)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self.ordinal[at].astype(np.int64) + self.nulls, np.where(known, self.count[at], 0).astype(np.int64)

    def document(self, ordinal: int) -> np.ndarray:
        lo, hi = int(self.begin[ordinal]), int(self.begin[ordinal + 1])
        return np.frombuffer(self.ids.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shards: int | None = None) -> DataFrame:
    """Encode each row's whole text (null: empty), add end_id, and write a dataset to `folder`, of so many shards or of one for each SHARD_BYTES of text.

    doc_id must be integral. Rows without one stand first, unindexed; rows of equal doc_id stand together, by text; an
    empty table makes no shard. Other columns are ignored. Returns the manifest, read back: shard, first_key, last_key (null if all its keys are), n_nulls, n_docs, n_ids, width.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    passed = by_words(encode), by_signs(encode), straight(encode, tokenizer.model)
    if shards is None:
        shards = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    sent = spark.sparkContext.broadcast(source)
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts = TaskContext.get().partitionId(), None
        keys, ends, nulls, total, out = [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if texts is None:
                texts = TextIds(sent.value, width, *passed)
                files, path = _open(folder)
                own = f"{path}/ids-{shard:06d}.bin.{uuid.uuid4().hex}"
                out = files.open_output_stream(own)
            for piece in slices(batch, _PIECE):
                lists = texts.columns(piece.column("text"))
                at = np.asarray(lists.offsets)[1:]
                out.write(np.insert(lists.values.to_numpy().view(f"<u{width}"), at, end_id).tobytes())
                ends.append(total + at + np.arange(1, len(at) + 1))
                total += int(at[-1]) + len(at)
                known = piece.column("doc_id").drop_null()
                nulls += piece.num_rows - len(known)
                keys.append(known.to_numpy())
        if texts is None:
            return
        out.close()
        files.move(own, f"{path}/ids-{shard:06d}.bin")
        known, after = np.concatenate(keys).astype("<i8"), np.concatenate(ends)
        if len(known) >= 1 << 32:
            raise ValueError("more documents in a shard than its index can number: ask for more shards")
        _put(files, f"{path}/key-{shard:06d}.bin", known.tobytes())
        _put(files, f"{path}/mph-{shard:06d}.npz", build_index(known, after))
        row = (shard, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, nulls, len(after), total, width)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), *[pa.int64()] * 5, pa.int32()), strict=True)], names=names)

    names = ["shard", "first_key", "last_key", "n_nulls", "n_docs", "n_ids", "width"]
    schema = "shard int, first_key long, last_key long, n_nulls long, n_docs long, n_ids long, width int"
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a dataset, from its files through the index: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers). Fails if the index misses a stored key."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    work = manifest.withColumn("base", before).select("shard", "width", "n_nulls", "n_docs", "base").repartition(partitions(spark), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(folder, r["shard"], r["width"], r["n_nulls"])
                keys = shard.keys()
                ordinals = np.arange(r["n_docs"])
                if len(keys):
                    distinct = np.unique(keys)
                    first, count = shard.find(distinct)
                    ordinals = np.concatenate([np.arange(r["n_nulls"]), np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]).astype(np.int64)
                    if len(ordinals) != r["n_docs"]:
                        raise ValueError(f"shard {r['shard']} of {folder}: the index doesn't fit the keys")
                sums = [zlib.crc32(shard.document(o).astype("<u4").tobytes()) for o in ordinals.tolist()]
                own = pa.concat_arrays([pa.nulls(r["n_nulls"], pa.int64()), pa.array(keys, pa.int64())])
                yield pa.RecordBatch.from_arrays([own, pa.array(shard.begin[ordinals] + r["base"], pa.int64()), pa.array(np.diff(shard.begin)[ordinals], pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return work.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Keyed access: doc_id and `ids` (array of int) of the documents whose doc_id is in `keys`, repeats of a key counting
    once. Keys that aren't stored, and null ones, give no row. A key's shard is found by binary search over the shards' key ranges,
    which don't overlap; they come from the manifest, one row a shard, of MOST_SHARDS at most."""
    ranges = spark.read.parquet(f"{folder}/manifest").where("first_key is not null").select("shard", "width", "n_nulls", "first_key", "last_key").orderBy("first_key").limit(MOST_SHARDS + 1).collect()
    if len(ranges) > MOST_SHARDS:
        raise ValueError(f"{folder} has over {MOST_SHARDS} shards")
    sent = spark.sparkContext.broadcast(np.array([tuple(r) for r in ranges], np.int64).reshape(-1, 5))
    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, width, n_nulls, first, last = sent.value.T
        for batch in batches:
            key = batch.column("doc_id").to_numpy()
            at = np.searchsorted(first, key, "right") - 1
            inside = (at >= 0) & (key <= last[at]) if len(first) else np.zeros(len(key), bool)
            key, at = key[inside], at[inside]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, shard[at], width[at], n_nulls[at])], names=["doc_id", "shard", "width", "n_nulls"])

    routed = asked.mapInArrow(route, "doc_id long, shard long, width long, n_nulls long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, Shard] = {}
        for batch in batches:
            found, ids = [], []
            for r in batch.to_pylist():
                if r["shard"] not in shards:
                    shards = {r["shard"]: Shard(folder, r["shard"], r["width"], r["n_nulls"])}
                shard = shards[r["shard"]]
                (first,), (count,) = shard.find(np.array([r["doc_id"]], np.int64))
                for o in range(first, first + count):
                    found.append(r["doc_id"])
                    ids.append(shard.document(o).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return routed.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, ids array<int>")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, folder, partitions(spark))
    return read_all(spark, folder)
