"""Queries of vector, mask, signal, word and patch operators on the driver's tables, each with the SQL that must agree with it.

Bindings: fifty vectors in the order of vec_id are a recording (a vector's place in it is its segment and chunk, its label its cluster); a vector's components are
samples of a signal, or sixteen frames of four speakers; utterances of a conversation are rows of a transcript, their words are its blanks' pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import signal as G
from parley.functions import text as T
from parley.functions import words as W
from parley.operators import density as D
from parley.operators import frames as M
from parley.operators import hidden as H
from parley.operators import linkage as L
from parley.operators import patches as P
from parley.operators import sequences as S
from parley.operators import vectors as V
from parley.sources import sinks
from parley.streaming import stateful as E
from parley.streaming import turns as R

Query = Callable[[SparkSession, str], DataFrame]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    idx = F.col("vec_id") % 50
    return rows.select(F.floor(F.col("vec_id") / 50).alias("recording"), idx.alias("idx"), (idx * 2.5).alias("t0"), (idx * 2.5 + 2.0).alias("t1"), F.col("label").alias("cluster"), F.concat(F.lit("s"), F.col("label")).alias("speaker"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


_SEGMENTS = "segments AS (SELECT vec_id // 50 AS recording, vec_id % 50 AS idx, (vec_id % 50) * 2.5::DOUBLE AS t0, (vec_id % 50) * 2.5::DOUBLE + 2 AS t1, label AS cluster, 's' || label AS speaker, embedding::DOUBLE[] AS embedding FROM embeddings WHERE embedding IS NOT NULL)"
_UNIT = "unit AS (SELECT *, list_transform(embedding, lambda x: x / CASE WHEN list_inner_product(embedding, embedding) > 0 THEN sqrt(list_inner_product(embedding, embedding)) ELSE 1 END) AS v FROM segments)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = segments(spark, sf_dir).select("recording", F.col("idx").alias("chunk"), F.posexplode("embedding").alias("pos", "x"))
    return each.select("recording", "chunk", F.floor(F.col("pos") / 4).cast("int").alias("frame"), (F.col("pos") % 4).alias("spk"), F.least(F.lit(1.0), F.abs("x") * 3).alias("p"))


_FRAMES = "frames AS (SELECT recording, idx AS chunk, ((pos - 1) // 4)::INTEGER AS frame, ((pos - 1) % 4)::INTEGER AS spk, least(1.0::DOUBLE, abs(embedding[pos]) * 3) AS p FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM segments))"
_CLUSTERS = "clusters AS (SELECT DISTINCT recording, chunk, spk, nullif((chunk + spk) % 4, 3) AS cluster FROM frames)"


def _clusters(rows: DataFrame) -> DataFrame:
    return rows.select("recording", "chunk", "spk").distinct().withColumn("cluster", F.nullif((F.col("chunk") + F.col("spk")) % 4, F.lit(3)))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every 0.4 seconds; each seventh lacks its start, each fifth its end."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")

    def word(x, i):
        start = F.when(i % 7 != 6, i * F.lit(0.4))
        end = F.when(i % 5 != 4, i * F.lit(0.4) + F.lit(0.25))
        return F.struct(x.alias("text"), start.alias("start"), end.alias("end"), ((i % 10) / F.lit(10.0)).alias("confidence"), F.lit("").alias("speaker"))

    return rows.select(F.col("conv_id").alias("recording"), F.col("turn").alias("idx"), (F.col("turn") * F.lit(10.0)).alias("t0"), (F.col("turn") * F.lit(10.0) + 8.0).alias("t1"), F.col("role").alias("speaker"), "text", F.transform(F.split("text", " "), word).alias("words"))


_UTTERANCES = """utterances AS (SELECT conv_id AS recording, turn AS idx, turn * 10.0::DOUBLE AS t0, turn * 10.0::DOUBLE + 8 AS t1, role AS speaker, text FROM conversations WHERE text IS NOT NULL),
words AS (SELECT recording, idx, t0, speaker, i, w[i] AS word, CASE WHEN (i - 1) % 7 <> 6 THEN (i - 1) * 0.4::DOUBLE END AS s, CASE WHEN (i - 1) % 5 <> 4 THEN (i - 1) * 0.4::DOUBLE + 0.25 END AS e, ((i - 1) % 10) / 10.0::DOUBLE AS c
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM utterances)))"""


def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("recording", (F.col("idx") + 1).cast("long").alias("id"), "t0", "t1", "speaker", "text")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for each conversation: row 1 in capitals, row 2 in two parts, 3 and 4 merged, 4 and 5 too, and one patch of a row that isn't there."""
    items = '[{"id": 1, "speaker": " ", "text": " FIRST ROW "}, {"id": "2", "speaker": "a", "text": "— one PART"}, 7, {"source_ids": [2], "text": "the Other part is longer"}, {"source_ids": [4, 3], "speaker": "", "text": ""}, {"source_ids": [4, 5], "speaker": "b", "text": "joined"}, {"id": 99, "text": "nowhere"}]'
    fence = F.when(F.col("recording") % 2 == 0, F.lit(f"Here it is:\n```\n{items}\n```\nDone [1].")).otherwise(F.lit(f"So: {items} \n"))
    return transcript_rows(spark, sf_dir).select("recording").distinct().withColumn("answer", fence)


_ROWS = "rows_ AS (SELECT recording, idx + 1 AS id, t0, t1, speaker, text, count(*) OVER (PARTITION BY recording) AS n FROM utterances)"


def _text_sql(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\x0b\x85\x{{a0}}\x{{2028}}\x{{2029}}\p{{Zs}}]+', ' ', 'g'))"


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.corrected(transcript_rows(spark, sf_dir), P.parsed(answers(spark, sf_dir)))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.resolved(P.parsed(answers(spark, sf_dir)), transcript_rows(spark, sf_dir))


def _flat_words(rows: DataFrame) -> DataFrame:
    return rows.select("recording", "idx", F.posexplode("words").alias("place", "w")).select("recording", "idx", "place", F.col("w.text").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.speaker").alias("speaker"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn events of a live transcript: each third one isn't final, each fourth has a blank text, each fifth no label."""
    rows = utterances(spark, sf_dir)
    return rows.select("recording", F.col("idx").alias("seq"), (F.col("idx") % 3 != 2).alias("end_of_turn"), F.when(F.col("idx") % 4 == 3, " \n ").otherwise(F.col("text")).alias("transcript"), F.when(F.col("idx") % 5 != 4, F.col("speaker")).otherwise("").alias("speaker_label"), "words")


QUERIES: dict[str, Query] = {
    "cosine_distances": lambda s, d: V.cosine_distances(segments(s, d)).withColumn("distance", F.round("distance", 5)),
    "imputed_vectors": lambda s, d: _components(V.impute(segments(s, d).withColumn("embedding", F.when(F.col("idx") % 7 != 0, F.col("embedding"))))),
    "centred_scale": lambda s, d: _components(V.centred_scale(segments(s, d), centred=True)),
    "nearest_centroid": lambda s, d: V.nearest_centroid(segments(s, d), V.centroids(segments(s, d))).select("recording", "idx", "nearest"),
    "merge_speakers": lambda s, d: V.merge_speakers(segments(s, d), 0.2).select("recording", "idx", "speaker"),
    "merge_clusters": lambda s, d: V.merge_clusters(segments(s, d), 0.2).select("recording", "idx", "cluster"),
    "temporal_proximity": lambda s, d: segments(s, d).select("recording", "idx", F.round(V.temporal_proximity(F.col("t0"), F.col("t1") * 1.5), 6).alias("near")),
    "joint_similarity": lambda s, d: V.joint_similarity(_spoken(s, d)).withColumn("sim", F.round("sim", 5)),
    "graph_partition": lambda s, d: V.graph_partition(V.joint_similarity(_spoken(s, d)), segments(s, d), 3),
    "agglomerate": lambda s, d: L.agglomerate(segments(s, d), threshold=0.9),
    "agglomerate_k": lambda s, d: L.agglomerate(segments(s, d), k=4),
    "hmm_smooth": lambda s, d: H.hmm_smooth(segments(s, d).select("recording", "idx", "speaker")),
    "hdbscan": lambda s, d: D.hdbscan(segments(s, d), 3),
    "exclusive_region": lambda s, d: M.exclusive_region(frames(s, d)).select("recording", "chunk", "frame", "spk", "keep"),
    "usable_runs": lambda s, d: M.usable_runs(frames(s, d)).select("recording", "chunk", "spk", F.col("first").alias("first_frame"), "n"),
    "clustered_frames": lambda s, d: M.clustered(frames(s, d), _clusters(frames(s, d))).withColumn("p", F.round("p", 6)),
    "reconstructed": lambda s, d: M.reconstructed(frames(s, d), _clusters(frames(s, d)), _counts(s, d), 8),
    "capped_counts": lambda s, d: M.capped(_counts(s, d), F.col("recording") % 2 == 0),
    "resegmented": lambda s, d: M.resegmented(frames(s, d), _clusters(frames(s, d)), segments(s, d).select("recording", F.col("idx").alias("chunk"), (F.col("idx") * 0.5).alias("start"), (F.col("idx") * 0.5 + 5).alias("end"), F.lit(100.0).alias("offset"), (F.col("idx") % 2 == 0).alias("overlap"))),
    "masked_signal": lambda s, d: segments(s, d).select("recording", "idx", M.masked(F.col("embedding"), F.slice(F.transform("embedding", F.abs), 1, 16)).alias("m"), M.maskable(F.col("embedding")).alias("maskable")).select("recording", "idx", "maskable", F.round(F.col("m")[3], 8).alias("m3"), F.round(F.col("m")[63], 8).alias("m63")),
    "frame_rms": lambda s, d: segments(s, d).select("recording", "idx", F.posexplode(G.frame_rms(F.col("embedding"), 8, 4)).alias("frame", "rms")).withColumn("rms", F.round("rms", 8)),
    "voiced_frames": lambda s, d: segments(s, d).select("recording", "idx", F.posexplode(G.voiced(F.col("embedding"), 4)).alias("frame", "voiced")),
    "cropped": lambda s, d: segments(s, d).select("recording", "idx", G.crop(F.col("embedding"), F.col("idx") / 10.0, F.col("idx") / 5.0, 10).alias("c")).select("recording", "idx", F.size("c").alias("n"), F.round(F.coalesce(F.get("c", F.lit(0)), F.lit(0.0)), 6).alias("x"), G.long_enough(F.col("c"), 0.5, 10).alias("long"), G.loud_enough(F.col("c"), 0.12).alias("loud")),
    "enough_samples": lambda s, d: segments(s, d).withColumn("c", G.crop(F.col("embedding"), F.col("idx") / 10.0, F.col("idx") / 5.0, 10)).where(G.long_enough(F.col("c"), 0.7, 10)).select("recording", "idx"),
    "loud_segments": lambda s, d: segments(s, d).where(G.loud_enough(F.slice("embedding", 1, 16), 0.12)).select("recording", "idx"),
    "end_of_turns": lambda s, d: E.end_of_turns_batch(_heard(s, d), E.Endpoint(frame=100)),
    "pitch": lambda s, d: segments(s, d).select("recording", "idx", F.round(G.pitch(F.col("embedding"), 800), 4).alias("hz")),
    "embedding_input": lambda s, d: segments(s, d).select("recording", "idx", G.best_stretch(F.col("embedding"), 400, 0.04, 0.01).alias("stretch"), F.size(G.embedding_input(F.col("embedding"), 400, 0.04, 0.01)).alias("n")).select("recording", "idx", "stretch.start", "stretch.end", "n"),
    "word_times": lambda s, d: _flat_words(utterances(s, d).withColumn("words", W.absolute(F.col("words"), F.col("t0"), F.col("speaker")))),
    "single_speaker": lambda s, d: W.single_speaker(utterances(s, d)).select("recording", "idx", "speaker", "text", "start", "end", F.size("words").alias("n")),
    "shifted_turns": lambda s, d: W.shifted(segments(s, d), segments(s, d).where("idx < 40").select("recording", "idx", (F.col("idx") * 3.0).alias("w0")), ["recording", "idx"]).select("recording", "idx", "t0", W.to_ms(F.col("t1")).alias("t1_ms"), W.to_seconds(W.to_ms(F.col("t1"))).alias("t1_s")),
    "transcripts": lambda s, d: T.transcript(utterances(s, d)),
    "joined_texts": lambda s, d: utterances(s, d).select("recording", "idx", T.joined(F.array("speaker", F.lit(" \n"), "text", F.lit(""))).alias("text")),
    "json_array": lambda s, d: answers(s, d).select("recording", P.json_array(F.col("answer")).alias("json")),
    "parsed_patches": lambda s, d: P.parsed(answers(s, d)).select("recording", "place", "id", "speaker", "text"),
    "resolved_patches": lambda s, d: _resolved(s, d).select("recording", "place", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")),
    "merge_groups": lambda s, d: P.merge_groups(_resolved(s, d)),
    "corrected_rows": _corrected,
    "json_documents": lambda s, d: sinks.json_documents(_corrected(s, d), pretty=False),
    "titled_documents": lambda s, d: sinks.titled(sinks.json_documents(_corrected(s, d), columns=("speaker", "text"), pretty=False), "TURNS"),
    "word_seconds": lambda s, d: _flat_words(utterances(s, d)).where("start is not null").select("recording", "idx", "place", W.to_seconds(W.to_ms(F.col("start") + 0.0004)).alias("start")),
    "similarity_thresholds": lambda s, d: V.neighbours_similarity(segments(s, d)).where("sim is not null").select("recording", "idx", ((1 - F.col("sim")) < V.distance_threshold(0.1)).alias("near")),
    "final_turns": lambda s, d: R.final(_events(s, d)).select("recording", "seq"),
    "turn_confidence": lambda s, d: R.confidence(_events(s, d)).select("recording", "seq", F.round("confidence", 8).alias("confidence"), F.get("words", F.lit(0))["speaker"].alias("speaker")),
    "name_numbers": lambda s, d: segments(s, d).select("recording", "idx", S.number_of_name(F.when(F.col("idx") % 3 != 0, S.numbered_name(F.col("cluster"))).otherwise("other")).alias("number")),
}


def _components(rows: DataFrame) -> DataFrame:
    return rows.select("recording", "idx", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round("x", 6))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a recording of 64 frames of 100 ms: components are voices, and the next ones confidences."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    each = rows.select(F.col("vec_id").cast("string").alias("recording"), "embedding", F.posexplode("embedding").alias("pos", "x"))
    after = F.get("embedding", (F.col("pos") + 1) % F.size("embedding"))
    return each.select("recording", (F.col("pos") * 100).cast("long").alias("t"), (F.abs(F.col("x").cast("double")) * 4).alias("voice"), (F.abs(after.cast("double")) * 2).alias("confidence"))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("text", F.concat_ws(" ", F.lit("said by"), "speaker", (F.col("idx") % 6).cast("string")))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(420)))
    return segments(spark, sf_dir).select("recording").distinct().withColumn("at", at).withColumn("count", F.col("at") % 3)


_COUNTS = "counts AS (SELECT recording, k::INTEGER AS \"at\", (k % 3)::INTEGER AS count FROM (SELECT DISTINCT recording FROM segments), range(0, 421) r(k))"
_OTHER = "o AS (SELECT f.*, coalesce((SELECT max(g.p) FROM frames g WHERE g.recording = f.recording AND g.chunk = f.chunk AND g.frame = f.frame AND g.spk <> f.spk), 0) AS other FROM frames f), k AS (SELECT *, CASE WHEN count(*) FILTER (p >= 0.35 AND p - other >= 0.1) OVER (PARTITION BY recording, chunk, spk) >= 5 THEN p >= 0.35 AND p - other >= 0.1 ELSE p >= 0.35 + 0.1::DOUBLE END AS keep FROM o)"
_CENTRES = "e AS (SELECT recording, cluster, speaker, unnest(range(1, 65)) AS i, unnest(v) AS x FROM unit), c AS (SELECT recording, cluster, any_value(speaker) AS speaker, list(x ORDER BY i) AS v FROM (SELECT recording, cluster, any_value(speaker) AS speaker, i, sum(x) AS x FROM e GROUP BY recording, cluster, i) GROUP BY recording, cluster)"
_PATCHED = """m AS (SELECT recording, count(*) AS n FROM rows_ GROUP BY recording)"""

ORACLE_SQL: dict[str, str] = {
    "cosine_distances": f"WITH {_SEGMENTS}, {_UNIT} SELECT a.recording, a.idx AS i, b.idx AS j, round(1 - greatest(-1, least(1, list_inner_product(a.v, b.v))), 5) AS distance FROM unit a JOIN unit b ON a.recording = b.recording AND a.idx < b.idx",
    "imputed_vectors": f"""WITH {_SEGMENTS}, e AS (SELECT recording, idx, unnest(range(0, 64)) AS place, unnest(embedding) AS x FROM segments),
m AS (SELECT recording, place, avg(x) FILTER (idx % 7 <> 0) AS mean FROM e GROUP BY recording, place)
SELECT recording, idx, place::INTEGER AS place, round(CASE WHEN idx % 7 <> 0 THEN x ELSE coalesce(mean, 0) END, 6) AS x FROM e JOIN m USING (recording, place)""",
    "centred_scale": f"""WITH {_SEGMENTS}, e AS (SELECT recording, idx, unnest(range(0, 64)) AS place, unnest(embedding) AS x FROM segments), m AS (SELECT *, x - avg(x) OVER (PARTITION BY recording, place) AS y FROM e),
n AS (SELECT recording, idx, sqrt(sum(y * y)) AS n FROM m GROUP BY recording, idx)
SELECT recording, idx, place::INTEGER AS place, round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS x FROM e JOIN n USING (recording, idx)""",
    "nearest_centroid": f"""WITH {_SEGMENTS}, {_UNIT}, {_CENTRES} SELECT recording, idx, cluster AS nearest FROM (SELECT u.recording, u.idx, c.cluster, row_number() OVER (PARTITION BY u.recording, u.idx ORDER BY list_cosine_similarity(u.v, c.v) DESC, c.cluster) AS k FROM unit u JOIN c ON u.recording = c.recording) WHERE k = 1""",
    "merge_speakers": f"""WITH RECURSIVE {_SEGMENTS}, {_UNIT}, {_CENTRES}, near AS (SELECT a.recording, a.speaker AS a, b.speaker AS b FROM c a JOIN c b ON a.recording = b.recording AND a.speaker <> b.speaker AND list_cosine_similarity(a.v, b.v) >= 0.2),
reach AS (SELECT recording, speaker AS a, speaker AS b FROM c UNION SELECT r.recording, r.a, n.b FROM reach r JOIN near n ON r.recording = n.recording AND r.b = n.a),
least_ AS (SELECT recording, a, min(b) AS b FROM reach GROUP BY recording, a) SELECT s.recording, idx, l.b AS speaker FROM segments s JOIN least_ l ON s.recording = l.recording AND s.speaker = l.a""",
    "temporal_proximity": f"WITH {_SEGMENTS} SELECT recording, idx, round(exp(-abs(t0 - t1 * 1.5) / 3), 6) AS near FROM segments",
    "exclusive_region": f"WITH {_SEGMENTS}, {_FRAMES}, {_OTHER} SELECT recording, chunk, frame, spk, keep FROM k",
    "usable_runs": f"""WITH {_SEGMENTS}, {_FRAMES}, {_OTHER}, r AS (SELECT *, frame - row_number() OVER (PARTITION BY recording, chunk, spk ORDER BY frame) AS run FROM k WHERE keep),
g AS (SELECT recording, chunk, spk, min(frame) AS first_frame, count(*) AS n, avg((other >= 0.35)::INTEGER) AS o FROM r GROUP BY recording, chunk, spk, run)
SELECT recording, chunk, spk, first_frame, n FROM (SELECT *, row_number() OVER (PARTITION BY recording, chunk, spk ORDER BY n DESC, first_frame) AS k FROM g) WHERE k = 1 AND n >= 3 AND o < 0.2""",
    "clustered_frames": f"WITH {_SEGMENTS}, {_FRAMES}, {_CLUSTERS} SELECT f.recording, f.chunk, frame, cluster, round(max(p), 6) AS p FROM frames f JOIN clusters c ON f.recording = c.recording AND f.chunk = c.chunk AND f.spk = c.spk WHERE cluster IS NOT NULL GROUP BY f.recording, f.chunk, frame, cluster",
    "reconstructed": f"""WITH {_SEGMENTS}, {_FRAMES}, {_CLUSTERS}, {_COUNTS}, m AS (SELECT f.recording, f.chunk, frame, cluster, max(p) AS p FROM frames f JOIN clusters c ON f.recording = c.recording AND f.chunk = c.chunk AND f.spk = c.spk WHERE cluster IS NOT NULL GROUP BY f.recording, f.chunk, frame, cluster),
a AS (SELECT recording, chunk * 8 + frame AS "at", cluster, sum(p) AS p FROM m GROUP BY recording, chunk * 8 + frame, cluster), r AS (SELECT *, row_number() OVER (PARTITION BY recording, "at" ORDER BY p DESC, cluster) AS place FROM a)
SELECT r.recording, r."at", cluster FROM r JOIN counts c ON r.recording = c.recording AND r."at" = c."at" WHERE place <= count AND p > 0""",
    "capped_counts": f"WITH {_SEGMENTS}, {_COUNTS} SELECT recording, \"at\", CASE WHEN recording % 2 = 0 THEN count ELSE least(count, 1) END AS count FROM counts",
    "masked_signal": f"""WITH {_SEGMENTS}, w AS (SELECT recording, idx, embedding, list_transform(embedding[1:16], lambda x: abs(x)) AS mask FROM segments),
m AS (SELECT recording, idx, len(list_filter(embedding, lambda x: x > 0.25)) >= 3 AS maskable, embedding[4] * least(1, greatest(0, mask[1] * 0.75 + mask[2] * 0.25)) AS m3, embedding[64] * least(1, mask[16]) AS m63 FROM (SELECT recording, idx, embedding, mask FROM w))
SELECT recording, idx, maskable, round(embedding[4] * least(1, mask[1] * (1 - (3 * 16 / 64.0 - 0.5)) + mask[2] * (3 * 16 / 64.0 - 0.5)), 8) AS m3, round(m63, 8) AS m63 FROM w JOIN m USING (recording, idx)""",
    "enough_samples": f"WITH {_SEGMENTS} SELECT recording, idx FROM segments WHERE len(embedding[least(64, trunc(idx / 10.0::DOUBLE * 10)::INTEGER) + 1:least(64, trunc(idx / 5.0::DOUBLE * 10)::INTEGER)]) >= 7",
    "loud_segments": f"WITH {_SEGMENTS} SELECT recording, idx FROM segments WHERE sqrt(list_sum(list_transform(embedding[1:16], lambda x: x * x)) / 16 + 1e-12) >= 0.12",
    "end_of_turns": """WITH RECURSIVE f AS (SELECT vec_id::VARCHAR AS recording, i, (i - 1) * 100 AS t, abs(embedding[i]::DOUBLE) * 4 AS voice, abs(embedding[i % 64 + 1]::DOUBLE) * 2 AS confidence FROM embeddings, range(1, 65) r(i) WHERE embedding IS NOT NULL),
s AS (SELECT recording, 0::BIGINT AS i, -1::BIGINT AS open_, -1::BIGINT AS heard, 0::BIGINT AS number, NULL::BIGINT AS start, NULL::BIGINT AS "end", NULL::VARCHAR AS reason FROM (SELECT DISTINCT recording FROM f)
UNION ALL SELECT recording, i, CASE WHEN voice >= 0.4 THEN CASE WHEN open_ >= 0 THEN open_ ELSE t END WHEN closes THEN -1 ELSE open_ END, CASE WHEN voice >= 0.4 THEN t + 100 ELSE heard END, number + closes::BIGINT,
CASE WHEN closes THEN open_ END, CASE WHEN closes THEN heard END, CASE WHEN closes THEN CASE WHEN t + 100 - heard >= 1280 THEN 'silence' ELSE 'confidence' END END
FROM (SELECT f.*, open_, heard, number, open_ >= 0 AND voice < 0.4 AND (t + 100 - heard >= 1280 OR t + 100 - heard >= 250 AND confidence >= 0.25) AS closes FROM s JOIN f ON f.recording = s.recording AND f.i = s.i + 1))
SELECT recording, number - 1 AS number, start, "end", reason FROM s WHERE reason IS NOT NULL UNION ALL SELECT recording, number, open_, heard, 'over' FROM s WHERE i = 64 AND open_ >= 0""",
    "frame_rms": f"WITH {_SEGMENTS} SELECT recording, idx, f::INTEGER AS frame, round(sqrt(list_sum(list_transform(embedding[4 * f + 1:4 * f + 8], lambda x: x * x)) / 8), 8) AS rms FROM segments, range(0, 15) r(f)",
    "voiced_frames": f"""WITH {_SEGMENTS}, l AS (SELECT recording, idx, list_transform(range(0, 16), lambda f: sqrt(list_sum(list_transform(embedding[4 * f + 1:4 * f + 4], lambda x: x * x)) / 4 + 1e-12)) AS levels FROM segments)
SELECT recording, idx, f::INTEGER AS frame, levels[f + 1] >= greatest(2e-4, 0.25 * list_sort(levels)[8], 0.08 * list_max(levels)) AS voiced FROM l, range(0, 16) r(f)""",
    "cropped": f"""WITH {_SEGMENTS}, c AS (SELECT recording, idx, embedding[least(64, trunc(idx / 10.0::DOUBLE * 10)::INTEGER) + 1:least(64, trunc(idx / 5.0::DOUBLE * 10)::INTEGER)] AS c FROM segments)
SELECT recording, idx, len(c)::INTEGER AS n, round(coalesce(c[1], 0), 6) AS x, len(c) >= 5 AS long, CASE WHEN len(c) = 0 THEN false ELSE sqrt(list_sum(list_transform(c, lambda x: x * x)) / len(c) + 1e-12) >= 0.12 END AS loud FROM c""",
    "word_times": f"""WITH {_UTTERANCES} SELECT recording, idx, (row_number() OVER (PARTITION BY recording, idx ORDER BY i) - 1)::INTEGER AS place, word, round((t0 + s) * 1000)::INTEGER AS start, round(coalesce(t0 + e, t0 + s) * 1000)::INTEGER AS "end", speaker FROM words WHERE s IS NOT NULL""",
    "single_speaker": f"""WITH {_UTTERANCES}, w AS (SELECT recording, idx, min(round(coalesce(s, 0) * 1000)::INTEGER) AS start, max(round(coalesce(e, 0) * 1000)::INTEGER) AS "end", count(*)::INTEGER AS n FROM words GROUP BY recording, idx)
SELECT recording, idx, '—' AS speaker, {_text_sql("nfc_normalize(text)")} AS text, start, "end", n FROM utterances JOIN w USING (recording, idx)""",
    "shifted_turns": f"WITH {_SEGMENTS} SELECT recording, idx, t0 + idx * 3.0 AS t0, round((t1 + idx * 3.0) * 1000)::INTEGER AS t1_ms, round((t1 + idx * 3.0) * 1000)::INTEGER / 1000.0::DOUBLE AS t1_s FROM segments WHERE idx < 40",
    "transcripts": f"WITH {_UTTERANCES} SELECT recording, string_agg(trim(text), chr(10) ORDER BY idx) FILTER (trim(text) <> '') AS text FROM utterances GROUP BY recording",
    "joined_texts": f"WITH {_UTTERANCES} SELECT recording, idx, speaker || CASE WHEN trim(text) <> '' THEN ' ' || trim(text) ELSE '' END AS text FROM utterances",
    "json_array": None,
    "parsed_patches": f"""WITH {_UTTERANCES}, p(place, id, speaker, text) AS (VALUES (0, '1', ' ', ' FIRST ROW '), (1, '2', 'a', '— one PART'), (3, NULL, NULL, 'the Other part is longer'), (4, NULL, '', ''), (5, NULL, 'b', 'joined'), (6, '99', NULL, 'nowhere'))
SELECT recording, place::INTEGER AS place, id, speaker, text FROM (SELECT DISTINCT recording FROM utterances), p""",
    "resolved_patches": f"""WITH {_UTTERANCES}, {_ROWS}, {_PATCHED}, p(place, least_, ids) AS (VALUES (0, 1, '1'), (1, 2, '2'), (3, 2, '2'), (4, 4, '3,4'), (5, 5, '4,5')) SELECT recording, place::INTEGER AS place, ids FROM m, p WHERE n >= least_""",
    "merge_groups": f"""WITH {_UTTERANCES}, {_ROWS} SELECT recording, id, 3::BIGINT AS root FROM rows_ WHERE id >= 3 AND id <= 5 AND n >= 4""",
    "corrected_rows": f"""WITH {_UTTERANCES}, {_ROWS}, done AS (
SELECT recording, 1 AS kind, id, 0 AS part, t0 AS start, t1 AS "end", speaker, CASE WHEN id = 1 THEN 'FIRST ROW' ELSE text END AS text FROM rows_ WHERE id <> 2 AND NOT (id BETWEEN 3 AND 5 AND n >= 4)
UNION ALL SELECT recording, 1, id, 0, t0, greatest(t0 + 0.1, t0 + 10 / 34.0::DOUBLE * (t1 - t0) - 0.05), 'a', 'One part' FROM rows_ WHERE id = 2
UNION ALL SELECT recording, 1, id, 1, greatest(t0 + 0.1, t0 + 10 / 34.0::DOUBLE * (t1 - t0) - 0.05) + 0.05, t1, speaker, 'The other part is longer' FROM rows_ WHERE id = 2
UNION ALL SELECT recording, 0, 3, 0, min(t0), max(t1), CASE WHEN max(n) >= 5 THEN 'b' ELSE max(speaker) FILTER (id = 3) END, CASE WHEN max(n) >= 5 THEN 'joined' ELSE trim(string_agg(text, ' ' ORDER BY id)) END FROM rows_ WHERE id BETWEEN 3 AND 5 AND n >= 4 GROUP BY recording)
SELECT recording, (row_number() OVER (PARTITION BY recording ORDER BY round(start, 3), round("end", 3), kind, id, part) - 1)::INTEGER AS idx, round(start, 3) AS start, round("end", 3) AS "end", speaker, text FROM done""",
    "word_seconds": f"""WITH {_UTTERANCES} SELECT recording, idx, (i - 1)::INTEGER AS place, round((s + 0.0004::DOUBLE) * 1000)::INTEGER / 1000.0::DOUBLE AS start FROM words WHERE s IS NOT NULL""",
    "similarity_thresholds": f"WITH {_SEGMENTS}, p AS (SELECT recording, idx, list_cosine_similarity(embedding, lag(embedding) OVER (PARTITION BY recording ORDER BY idx)) AS sim FROM segments) SELECT recording, idx, 1 - sim < 0.9 AS near FROM p WHERE sim IS NOT NULL",
    "final_turns": f"WITH {_UTTERANCES} SELECT recording, idx AS seq FROM utterances WHERE idx % 3 <> 2 AND idx % 4 <> 3 AND trim(text) <> ''",
    "turn_confidence": f"""WITH {_UTTERANCES}, c AS (SELECT recording, idx, avg(c) AS confidence FROM words GROUP BY recording, idx) SELECT recording, idx AS seq, round(confidence, 8) AS confidence, CASE WHEN idx % 5 <> 4 THEN speaker ELSE '' END AS speaker FROM utterances JOIN c USING (recording, idx)""",
    "name_numbers": f"WITH {_SEGMENTS} SELECT recording, idx, CASE WHEN idx % 3 <> 0 THEN cluster ELSE 0 END AS number FROM segments",
}
ORACLE_SQL["json_array"] = f"""WITH {_UTTERANCES} SELECT DISTINCT recording, '[{{"id": 1, "speaker": " ", "text": " FIRST ROW "}}, {{"id": "2", "speaker": "a", "text": "— one PART"}}, 7, {{"source_ids": [2], "text": "the Other part is longer"}}, {{"source_ids": [4, 3], "speaker": "", "text": ""}}, {{"source_ids": [4, 5], "speaker": "b", "text": "joined"}}, {{"id": 99, "text": "nowhere"}}]' AS json FROM utterances"""
ORACLE_SQL["json_documents"] = f"""SELECT recording, to_json(list({{'speaker': speaker, 'start': start, 'end': "end", 'text': text}} ORDER BY idx))::VARCHAR AS json FROM ({ORACLE_SQL["corrected_rows"]}) GROUP BY recording"""
ORACLE_SQL["titled_documents"] = f"""SELECT recording, chr(10) || '--- TURNS ---' || chr(10) || to_json(list({{'speaker': speaker, 'text': text}} ORDER BY idx))::VARCHAR AS text FROM ({ORACLE_SQL["corrected_rows"]}) GROUP BY recording"""
ORACLE_SQL["pitch"] = f"""WITH {_SEGMENTS}, y AS (SELECT recording, idx, list_transform(embedding, lambda x: x - list_avg(embedding)) AS y FROM segments),
a AS (SELECT recording, idx, k, list_sum(list_transform(range(1, 65), lambda i: y[i] * y[(i - 1 + k) % 64 + 1])) AS likeness FROM y, range(2, 11) r(k))
SELECT recording, idx, round(800.0::DOUBLE / arg_max(k, likeness), 4) AS hz FROM a GROUP BY recording, idx"""
