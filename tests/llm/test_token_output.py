"""Binary token output against the tokenizers library, text by text."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import token_output
from parley.llm.common import new_folder

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

SCHEMA = "doc_id long, text string, ids string, shard int"
TEXTS = ["Hello World", "it's a.b,c... d!", None, "", " \n\t ", "naïve Ünïcode ΑΣ é", "日本語 テスト 🎉🎉", "<|startoftext|> a<|endoftext|>b x|>y", "x" * 3000, "12 3,456.78 a1b2", "same same SAME"]


def rows():
    return [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (None, None), (6, "again"), (-5, "first"), (6, None)]


def expected(table, path):
    tokenizer = tokenizers.Tokenizer.from_file(path)
    out, start = [], 0
    for key, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("table", [rows(), [(1, None)], []])
def test_written_ids_come_back(spark, file, table):
    path, folder = public.path(file), new_folder(spark, "test-ids")
    docs = spark.createDataFrame([(*r, "clash", 1) for r in table], SCHEMA)
    manifest = token_output.write(docs, path, 2, folder, 3)
    want = expected(table, path)
    assert manifest.agg(F.sum("n_ids")).first()[0] == (sum(r[2] for r in want) or None)
    got = [tuple(r) for r in token_output.read_all(spark, folder).orderBy("start").collect()]
    assert got == [r[:4] for r in want]
    keys = spark.createDataFrame([(k,) for k in (6, 0, 7, -5, 10**12, None, 6)], "doc_id long")
    found = sorted((r["doc_id"], list(r["ids"])) for r in token_output.lookup(spark, folder, keys).collect())
    assert found == sorted((r[0], r[4]) for r in want if r[0] in (6, 0, 7, -5))


def test_shards_follow_the_bytes(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(10)], "doc_id long, text string")
    assert token_output.write(docs, public.path("word_bpe_49k.json"), 2, new_folder(spark, "test-ids")).count() == 1


def test_other_tokenizers_are_not_cut(spark):
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert not token_output.by_words(lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
