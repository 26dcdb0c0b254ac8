"""The filter audit against a plain walk through every order, and the query against its SQL."""

import random
import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from parley.llm import filter_audit as A

FOLDER = "/root/testdata/sf0.01"


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    read = [(i, lang or "", text or "") for i, text, lang in docs]
    fails = []
    for i, _, text in read:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(j is not None and i is not None and j < i and other == text for j, _, other in read)
        one = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        fails.append({f for f, x in one.items() if x})
    rows, total = {}, {}
    for part in {p for _, p, _ in read}:
        own = [k for k, (_, p, _) in enumerate(read) if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                before = [k for k in own if f in fails[k] and k not in gone]
                rows[part, "".join(order), step] = [len(left), len(gone), len(before), sum(fails[k] == {f} for k in own), sum(read[k][0] in good for k in gone), sum(read[k][0] in toxic for k in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {key: (*row, total[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def got(df):
    rows = df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def run(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("x")).withColumn("n", F.lit(7)).withColumn("A", F.lit(None).cast("string")).repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    return A.audit(A.flagged_counts(docs, labels))


def test_random_documents(spark):
    rng = random.Random(5)
    some = ["", None, "  \t\n", "#", "ABC " * 120, "word\x0bword\x1cword é Ü " * 40, " ".join(map(str, range(130))), " ".join(map(str, range(130))) + " $", "one two three"]
    for _ in range(40):
        some.append(" ".join(rng.choice(["a", "B", "c%", "d", "EE", "f", "ünï", "x" * 30, str(rng.random())]) for _ in range(rng.randrange(160))))
    docs = [(i, rng.choice(some), rng.choice(["en", "de", "", None])) for i in range(260)] + [(None, some[6], "en"), (None, some[6], "en"), (3, some[6], "fr"), (3, some[6], "fr"), (7, None, None), (8, None, None)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 260, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1), (5, None, None)]
    assert got(run(spark, docs, labels)) == brute(docs, labels)


def test_one_text_in_most_rows(spark):
    docs = [(i % 90, "same text", "en" if i % 3 else "de") for i in range(100)] + [(200 + i, f"text {i}", "en") for i in range(20)]
    labels = [(i, 1, i % 2) for i in range(210)]
    assert got(run(spark, docs, labels)) == brute(docs, labels)


def test_very_long_text(spark):
    long = "w " * 1_000_000 + "Zz|" * 10
    docs = [(1, long, "en"), (2, long, "en"), (3, " ".join(map(str, range(200_000))), "en")]
    assert got(run(spark, docs, [])) == brute(docs, [])


def test_no_rows(spark):
    assert got(run(spark, [], [(1, 1, 1)])) == {}


def test_query_against_sql(spark):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    columns = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    want = {r[:3]: r[3:] for r in db.execute(f"SELECT {columns} FROM ({A.OP12_SQL})").fetchall()}
    assert got(A.op12_filter_audit(spark, FOLDER)) == want and len(want) == 2400
