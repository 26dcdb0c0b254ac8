"""Queries of the engine's own operators on the driver's tables, each with the SQL that must agree with it.

Bindings: an event is a turn (recording: its date, speaker: its type, t0: its second, t1: t0 + value), views are voice activity, a
conversation is a recording of utterances, a vector's label is its speaker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import intervals as I
from parley.operators import sequences as S
from parley.operators import vectors as V
from parley.plans import refinement, signals
from parley.streaming import turns as R

Query = Callable[[SparkSession, str], DataFrame]

_TURNS = "turns AS (SELECT CAST(ts AS DATE) AS recording, event_id AS idx, epoch_us(ts) / 1000000.0 AS t0, epoch_us(ts) / 1000000.0 + value AS t1, event_type AS speaker FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"
_SAID = "said AS (SELECT conv_id AS recording, turn AS idx, turn * 10.0::DOUBLE AS t0, turn * 10.0::DOUBLE + length(text) AS t1, role AS speaker, text FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    second = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = second * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    t0 = micros / F.lit(1000000.0)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null and value is not null")
    return rows.select(ts.cast("date").alias("recording"), F.col("event_id").alias("idx"), t0.alias("t0"), (t0 + F.col("value")).alias("t1"), F.col("event_type").alias("speaker"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    t0 = F.col("turn") * F.lit(10.0)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("recording"), F.col("turn").alias("idx"), t0.alias("t0"), (t0 + F.length("text")).alias("t1"), F.col("role").alias("speaker"), "text")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("speaker = 'view'").select("recording", "t0", "t1")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: near turns of a speaker joined, speakers named in the order in which they first speak."""
    named = S.chronological_names(I.merge_same_speaker(turns(spark, sf_dir), 60.0))
    return named.select("recording", "speaker", F.col("t0").alias("start"), F.col("t1").alias("end"))


_MERGED = """
, marked AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker THEN 1 ELSE 0 END AS changed FROM turns WINDOW w AS (PARTITION BY recording ORDER BY t0, t1, idx)),
runs AS (SELECT *, sum(changed) OVER (PARTITION BY recording ORDER BY t0, t1, idx ROWS UNBOUNDED PRECEDING) AS run FROM marked),
reached AS (SELECT *, max(t1) OVER (PARTITION BY recording, run ORDER BY t0, t1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 60.0 + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, run ORDER BY t0, t1, idx ROWS UNBOUNDED PRECEDING) AS island FROM reached),
merged AS (SELECT recording, arg_min(idx, (t0, t1, idx)) AS idx, min(t0) AS t0, max(t1) AS t1, min(speaker) AS speaker FROM islands GROUP BY recording, run, island)
"""

QUERIES: dict[str, Query] = {
    "conversation_turns": conversation_turns,
    "merge_same_speaker": lambda s, d: I.merge_same_speaker(turns(s, d), 60.0),
    "merge_intervals": lambda s, d: I.merge_intervals(turns(s, d), 30.0, 20.0),
    "pad_intervals": lambda s, d: I.pad(turns(s, d), 5.0).select("recording", "idx", "t0", "t1"),
    "split_long": lambda s, d: I.split_long(turns(s, d), 20.0).select("recording", "idx", "part", "t0", "t1"),
    "drop_overlap": lambda s, d: I.drop_overlap(turns(s, d)).select("recording", "t0", "t1"),
    "min_length": lambda s, d: I.at_least(I.positive(turns(s, d)), 20.0).select("recording", "idx", "t0", "t1", "speaker"),
    "resolve_overlaps": lambda s, d: I.resolve_overlaps(turns(s, d)).select("recording", "t0", "t1", "speaker"),
    "clip_to_vad": lambda s, d: I.clip(turns(s, d), I.merge_intervals(_views(s, d), 30.0)).select("recording", "idx", "t0", "t1", "speaker"),
    "flatten": lambda s, d: I.flatten(turns(s, d), 20.0),
    "postprocess_turns": lambda s, d: I.postprocess_turns(turns(s, d)),
    "speech_segments": lambda s, d: I.speech_segments(_views(s, d)),
    "build_turns": lambda s, d: I.build_turns(said(s, d), 5.0),
    "chronological_names": lambda s, d: S.chronological_names(turns(s, d), letters=True).select("recording", "idx", "speaker"),
    "speaker_runs": lambda s, d: S.runs(turns(s, d)).select("recording", "run", "speaker", "first_idx", "n"),
    "longest_run": lambda s, d: S.longest_run(turns(s, d)),
    "median_smooth": lambda s, d: S.median_smooth(S.renumber(turns(s, d)), "number", 5).select("recording", "idx", "number"),
    "micro_switches": lambda s, d: S.remove_micro_switches(turns(s, d), 20.0).select("recording", "idx", "speaker"),
    "centroid_similarity": lambda s, d: V.centroid_similarity(_vectors(s, d), "label").select("a", "b", F.round("sim", 5).alias("sim")),
    "normalised_transcript": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.normalised(F.replace("text", F.lit(". "), F.lit(".... "))).alias("text")),
    "indexed_rows": lambda s, d: T.indexed(said(s, d)).select("recording", "id", "speaker", "duration_sec"),
    "share_times": lambda s, d: T.share_times(said(s, d).withColumnRenamed("idx", "part"), ["recording"], F.lit(60.0)).select("recording", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end")),
    "deduplicated_turns": lambda s, d: R.deduplicated(_twice(s, d)).select("recording", "place", "seq", "speaker", "text"),
}


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance first without, then with its speaker."""
    rows = said(spark, sf_dir).select("recording", "idx", F.col("t0").alias("start"), F.col("t1").alias("end"), "speaker", "text")
    return rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again")).withColumn("seq", F.col("idx") * 2 + F.col("again")).withColumn("speaker", F.when(F.col("again") == 1, F.col("speaker")).otherwise(""))


ORACLE_SQL: dict[str, str] = {
    "conversation_turns": f"""WITH {_TURNS} {_MERGED}
, first AS (SELECT recording, speaker, min((t0, t1, idx)) AS f FROM merged GROUP BY recording, speaker),
named AS (SELECT recording, speaker, 'SPEAKER_' || row_number() OVER (PARTITION BY recording ORDER BY f) AS name FROM first)
SELECT m.recording, n.name AS speaker, m.t0 AS start, m.t1 AS "end" FROM merged m JOIN named n USING (recording, speaker)""",
    "merge_same_speaker": f"WITH {_TURNS} {_MERGED} SELECT * FROM merged",
    "merge_intervals": f"""WITH {_TURNS}, r AS (SELECT *, max(t1) OVER (PARTITION BY recording ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns WHERE t1 > t0),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT recording, min(t0) AS t0, max(t1) AS t1 FROM i GROUP BY recording, island HAVING max(t1) - min(t0) >= 20""",
    "pad_intervals": f"WITH {_TURNS} SELECT recording, idx, greatest(0.0::DOUBLE, t0 - 5) AS t0, t1 + 5 AS t1 FROM turns WHERE t1 + 5 > greatest(0.0::DOUBLE, t0 - 5)",
    "split_long": f"""WITH {_TURNS} SELECT recording, idx, part::INTEGER AS part, t0 + part * 20.0::DOUBLE AS t0, least(t1, t0 + part * 20.0::DOUBLE + 20.0::DOUBLE) AS t1
FROM (SELECT *, unnest(range(0, ceil((t1 - t0 - 1e-6) / 20)::BIGINT)) AS part FROM turns)""",
    "drop_overlap": f"""WITH {_TURNS}, r AS (SELECT recording, greatest(t0, coalesce(max(t1) OVER (PARTITION BY recording ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t0)) AS t0, t1 FROM turns)
SELECT * FROM r WHERE t1 > t0 + 1e-6""",
    "min_length": f"WITH {_TURNS} SELECT * FROM turns WHERE t1 > t0 AND t1 - t0 >= 20",
    "resolve_overlaps": f"""WITH {_TURNS}, p AS (SELECT DISTINCT recording, unnest([t0, t1]) AS a FROM turns WHERE t1 > t0),
pieces AS (SELECT * FROM (SELECT recording, a, lead(a) OVER (PARTITION BY recording ORDER BY a) AS b FROM p) WHERE b - a >= 1e-9),
chosen AS (SELECT p.recording, a, b, arg_max(speaker, (t0, -idx)) AS speaker FROM pieces p JOIN turns t ON p.recording = t.recording AND t0 <= a AND t1 >= b AND t1 > t0 GROUP BY p.recording, a, b),
m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND abs(lag(b) OVER w - a) < 1e-6 THEN 0 ELSE 1 END AS o FROM chosen WINDOW w AS (PARTITION BY recording ORDER BY a)),
g AS (SELECT *, sum(o) OVER (PARTITION BY recording ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT recording, min(a) AS t0, max(b) AS t1, min(speaker) AS speaker FROM g GROUP BY recording, run""",
    "clip_to_vad": f"""WITH {_TURNS}, v AS (SELECT recording, t0, t1, max(t1) OVER (PARTITION BY recording ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns WHERE speaker = 'view' AND t1 > t0),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM v),
vad AS (SELECT recording, min(t0) AS v0, max(t1) AS v1 FROM i GROUP BY recording, island)
SELECT * FROM (SELECT t.recording, idx, greatest(t0, v0) AS t0, least(t1, v1) AS t1, speaker FROM turns t JOIN vad ON t.recording = vad.recording AND t0 < v1 AND t1 > v0) WHERE t1 - t0 >= 0.12
UNION ALL SELECT recording, idx, t0, t1, speaker FROM turns WHERE recording NOT IN (SELECT recording FROM vad)""",
    "flatten": f"""WITH RECURSIVE {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t0, t1, speaker) AS i FROM turns),
f AS (SELECT recording, i, t0 AS s, t1 AS e, speaker, t1 - t0 >= 20 AS kept, CASE WHEN t1 - t0 >= 20 THEN t1 END AS cur FROM n WHERE i = 1
UNION ALL SELECT n.recording, n.i, greatest(n.t0, coalesce(f.cur, n.t0)), n.t1, n.speaker, n.t1 - greatest(n.t0, coalesce(f.cur, n.t0)) >= 20, CASE WHEN n.t1 - greatest(n.t0, coalesce(f.cur, n.t0)) >= 20 THEN n.t1 ELSE f.cur END
FROM f JOIN n ON n.recording = f.recording AND n.i = f.i + 1)
SELECT recording, s AS t0, e AS t1, speaker FROM f WHERE kept""",
    "build_turns": f"""WITH {_SAID}, t AS (SELECT recording, idx, t0, t1, speaker, trim(coalesce(text, '')) AS text FROM said),
m AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker THEN 1 ELSE 0 END AS c FROM t WINDOW w AS (PARTITION BY recording ORDER BY t0, t1, idx)),
r AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY t0, t1, idx ROWS UNBOUNDED PRECEDING) AS run FROM m),
x AS (SELECT *, max(t1) OVER (PARTITION BY recording, run ORDER BY t0, t1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 5 + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, run ORDER BY t0, t1, idx ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT recording, round(min(t0), 3) AS start, round(max(t1), 3) AS "end", min(speaker) AS speaker, coalesce(string_agg(text, ' ' ORDER BY t0, t1, idx) FILTER (text <> ''), '') AS text FROM i GROUP BY recording, run, island""",
    "chronological_names": f"""WITH {_TURNS}, f AS (SELECT recording, speaker, min((t0, t1, idx)) AS f FROM turns GROUP BY recording, speaker),
n AS (SELECT recording, speaker, row_number() OVER (PARTITION BY recording ORDER BY f) - 1 AS k FROM f)
SELECT t.recording, idx, CASE WHEN k < 26 THEN chr((k + 65)::INTEGER) ELSE 'S' || (k - 25) END AS speaker FROM turns t JOIN n USING (recording, speaker)""",
    "speaker_runs": f"""WITH {_TURNS}, m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS c FROM turns WINDOW w AS (PARTITION BY recording ORDER BY idx)),
r AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT recording, run::BIGINT AS run, min(speaker) AS speaker, min(idx) AS first_idx, count(*) AS n FROM r GROUP BY recording, run""",
    "longest_run": f"""WITH {_TURNS}, m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS c FROM turns WINDOW w AS (PARTITION BY recording ORDER BY idx)),
r AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT recording, min(speaker) AS speaker, min(idx) AS first_idx, count(*) AS n FROM r GROUP BY recording, run)
SELECT recording, speaker, first_idx, n FROM g QUALIFY row_number() OVER (PARTITION BY recording ORDER BY n DESC, first_idx) = 1""",
    "median_smooth": f"""WITH {_TURNS}, f AS (SELECT recording, speaker, min((t0, t1, idx)) AS f FROM turns GROUP BY recording, speaker),
k AS (SELECT recording, speaker, row_number() OVER (PARTITION BY recording ORDER BY f) - 1 AS k FROM f),
w AS (SELECT t.recording, idx, list_sort(list(k) OVER (PARTITION BY t.recording ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM turns t JOIN k USING (recording, speaker))
SELECT recording, idx, l[len(l) // 2 + 1]::INTEGER AS number FROM w""",
    "micro_switches": f"""WITH RECURSIVE {_TURNS}, n AS (SELECT *, row_number() OVER w AS i, lead(speaker) OVER w AS nxt FROM turns WINDOW w AS (PARTITION BY recording ORDER BY idx)),
f AS (SELECT recording, i, idx, speaker FROM n WHERE i = 1
UNION ALL SELECT n.recording, n.i, n.idx, CASE WHEN f.speaker = n.nxt AND f.speaker <> n.speaker AND n.t1 - n.t0 < 20 THEN f.speaker ELSE n.speaker END FROM f JOIN n ON n.recording = f.recording AND n.i = f.i + 1)
SELECT recording, idx, speaker FROM f""",
    "centroid_similarity": """WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) / CASE WHEN n > 0 THEN n ELSE 1 END AS x FROM u),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), l AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 5) AS sim FROM l a JOIN l b ON a.label < b.label""",
    "normalised_transcript": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
replace(nfc_normalize(replace(text, '. ', '.... ')), chr(160), ' '), '\.{3,}', '..', 'g'), ',{3,}', ',,', 'g'), '!{3,}', '!!', 'g'), '\?{3,}', '??', 'g'), ';{3,}', ';;', 'g'), ':{3,}', '::', 'g'), '…{3,}', '……', 'g'), '-{3,}', '--', 'g'), '—{3,}', '——', 'g'),
'[\s\x0b\x85\x{2028}\x{2029}\p{Zs}]+', ' ', 'g')) AS text FROM documents""",
    "indexed_rows": f"""WITH {_SAID}, n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY idx)::INTEGER AS id FROM said)
SELECT recording, id, speaker, round(t1 - t0, 3) AS duration_sec FROM n WHERE trim(coalesce(text, '')) <> '' AND t0 IS NOT NULL AND t1 IS NOT NULL""",
    "share_times": f"""WITH {_SAID}, c AS (SELECT recording, idx AS part, length(coalesce(text, '')) AS n FROM said),
s AS (SELECT recording, part, n, sum(n) OVER (PARTITION BY recording) AS a, sum(n) OVER (PARTITION BY recording ORDER BY part ROWS UNBOUNDED PRECEDING) AS r,
count(*) OVER (PARTITION BY recording) AS k, row_number() OVER (PARTITION BY recording ORDER BY part) AS i FROM c)
SELECT recording, part, round(CASE WHEN a > 0 THEN r / a - n / a ELSE i / k - 1.0 / k END * 60, 6) AS start, round(CASE WHEN a > 0 THEN r / a ELSE i / k END * 60, 6) AS "end" FROM s""",
    "deduplicated_turns": f"""WITH {_SAID}, d AS (SELECT recording, t0 AS start, t1 AS "end", CASE WHEN again = 1 THEN speaker ELSE '' END AS speaker, text, idx * 2 + again AS seq FROM said, range(2) r(again)),
g AS (SELECT *, min(seq) OVER w AS place, row_number() OVER (w ORDER BY (speaker <> '') DESC, seq DESC) AS k FROM d WINDOW w AS (PARTITION BY recording, start, "end", trim(text)))
SELECT recording, place, seq, speaker, text FROM g WHERE k = 1""",
}

QUERIES |= refinement.QUERIES | signals.QUERIES
ORACLE_SQL |= refinement.oracle_sql(_TURNS) | signals.ORACLE_SQL
