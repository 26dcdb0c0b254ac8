"""Queries of composed interval operators on the driver's events and conversations, with SQL built from one text for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import intervals as I
from parley.plans import signals
from parley.streaming import turns as R

Query = Callable[[SparkSession, str], DataFrame]


def _over(by: str, order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} {frame})"


_SO_FAR, _BEFORE = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def merged_sql(source: str, name: str, gap: float, order: str = "t0, t1, idx") -> str:
    return f"""{name}_a AS (SELECT *, CASE WHEN lag(speaker) {_over("recording", order)} = speaker THEN 0 ELSE 1 END AS changed FROM {source}),
{name}_b AS (SELECT *, sum(changed) {_over("recording", order, _SO_FAR)} AS run FROM {name}_a),
{name}_c AS (SELECT *, max(t1) {_over("recording, run", order, _BEFORE)} AS reach FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > {gap!r}::DOUBLE + 1e-9 THEN 1 ELSE 0 END) {_over("recording, run", order, _SO_FAR)} AS island FROM {name}_c),
{name} AS (SELECT recording, arg_min(idx, ({order})) AS idx, arg_min(t0, ({order})) AS t0, max(t1) AS t1, min(speaker) AS speaker FROM {name}_d GROUP BY recording, run, island)"""


def touching_sql(source: str, name: str) -> str:
    return f"""{name}_a AS (SELECT *, CASE WHEN lag(speaker) {_over("recording", "idx")} = speaker AND abs(lag(t1) {_over("recording", "idx")} - t0) < 1e-6 THEN 0 ELSE 1 END AS opened FROM {source}),
{name}_b AS (SELECT *, sum(opened) {_over("recording", "idx", _SO_FAR)} AS run FROM {name}_a),
{name} AS (SELECT recording, min(idx) AS idx, arg_min(t0, idx) AS t0, arg_max(t1, idx) AS t1, min(speaker) AS speaker FROM {name}_b GROUP BY recording, run)"""


def absorbed_sql(source: str, name: str, longest: float) -> str:
    """A walk along the turns by recursion: at each step the group that the turn belongs to."""
    return f"""{name}_n AS (SELECT *, row_number() {_over("recording", "t0, t1, idx")} AS i FROM {source}),
{name}_w AS (SELECT recording, i, 1::BIGINT AS g FROM {name}_n WHERE i = 1 UNION ALL SELECT n.recording, n.i, w.g + CASE WHEN n.t1 - n.t0 < {longest!r}::DOUBLE THEN 0 ELSE 1 END FROM {name}_w w JOIN {name}_n n ON n.recording = w.recording AND n.i = w.i + 1),
{name}_g AS (SELECT recording, g AS idx, arg_min(t0, i) AS t0, max(t1) AS t1, arg_min(speaker, i) AS speaker FROM {name}_n JOIN {name}_w USING (recording, i) GROUP BY recording, g),
{name}_f AS (SELECT recording, t0 FROM {name}_g f WHERE idx = 1 AND t1 - t0 < {longest!r}::DOUBLE AND EXISTS (SELECT 1 FROM {name}_g s WHERE s.recording = f.recording AND s.idx = 2)),
{name}_h AS (SELECT g.recording, g.idx, CASE WHEN g.idx = 2 THEN least(g.t0, coalesce(f.t0, g.t0)) ELSE g.t0 END AS t0, g.t1, g.speaker FROM {name}_g g LEFT JOIN {name}_f f ON f.recording = g.recording WHERE NOT (g.idx = 1 AND f.recording IS NOT NULL)),
{touching_sql(f"{name}_h", name)}"""


def resolved_sql(source: str, name: str) -> str:
    return f"""{name}_p AS (SELECT DISTINCT recording, unnest([t0, t1]) AS a FROM {source} WHERE t1 > t0),
{name}_q AS (SELECT * FROM (SELECT recording, a, lead(a) {_over("recording", "a")} AS b FROM {name}_p) WHERE b - a >= 1e-9),
{name}_r AS (SELECT p.recording, row_number() {_over("p.recording", "a")} AS idx, a AS t0, b AS t1, arg_max(speaker, (t0, -idx)) AS speaker FROM {name}_q p JOIN {source} t ON p.recording = t.recording AND t0 <= a AND t1 >= b AND t1 > t0 GROUP BY p.recording, a, b),
{touching_sql(f"{name}_r", name)}"""


def refined_sql(source: str, name: str, intrusion: float = 0.18, padding: float = 0.04, shortest: float = 0.12, gap: float = 0.25) -> str:
    return f"""{absorbed_sql(source, f"{name}1", intrusion)},
{name}2 AS (SELECT recording, idx, greatest(0, t0 - {padding!r}::DOUBLE) AS t0, t1 + {padding!r}::DOUBLE AS t1, speaker FROM {name}1 WHERE t1 + {padding!r}::DOUBLE > greatest(0, t0 - {padding!r}::DOUBLE)),
{merged_sql(f"{name}2", f"{name}3", 0.0)}, {absorbed_sql(f"{name}3", f"{name}4", shortest)},
{name}5 AS (SELECT * FROM {name}4 WHERE t1 - t0 >= 0.5 * {shortest!r}::DOUBLE),
{merged_sql(f"{name}5", name, gap)}"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.plans.queries import turns

    return turns(spark, sf_dir)


def _with_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / 7).cast("int")), lambda k: F.col("t0") + k * F.lit(7.25))
    return _turns(spark, sf_dir).where("t1 > t0").withColumn("cuts", cuts)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.segments(spark, sf_dir).select("recording", "idx", "t0", "t1", F.posexplode("embedding").alias("frame_idx", "x")).select("recording", "idx", "t0", "t1", "frame_idx", F.abs("x").alias("rms"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null").select(F.col("user_id").alias("recording"), F.col("ts").cast("timestamp").alias("ts"))


QUERIES: dict[str, Query] = {
    "merge_in_order": lambda s, d: I.merge_same_speaker(_turns(s, d), 60.0, by_time=False),
    "merge_touching": lambda s, d: I.merge_touching(I.split_long(_turns(s, d).where("t1 > t0"), 20.0).select("recording", (F.col("idx") * 1000 + F.col("part")).alias("idx"), "t0", "t1", "speaker")),
    "absorb_short": lambda s, d: I.absorb_short(_turns(s, d), 20.0),
    "refine_boundaries": lambda s, d: I.refine_boundaries(_turns(s, d), 20.0, 2.0, 15.0, 30.0),
    "fixed_chunks": lambda s, d: I.split_long(_turns(s, d).where("t1 > t0"), 7.5).select("recording", "idx", "part", "t0", "t1"),
    "speech_chunks": lambda s, d: I.speech_chunks(_with_cuts(s, d)).select("recording", "idx", "part", "t0", "t1"),
    "silence_points": lambda s, d: I.silence_points(_levels(s, d), 0.02, margin=0.05).select("recording", "idx", F.explode("cuts").alias("cut")).withColumn("cut", F.round("cut", 6)),
    "word_envelope": lambda s, d: I.word_envelope(signals.utterances(s, d)).select("recording", "idx", "t0", "t1"),
    "first_last_envelope": lambda s, d: I.word_envelope(signals.utterances(s, d), first_last=True).select("recording", "idx", "t0", "t1"),
    "sessions": lambda s, d: R.sessions(_visits(s, d), "6 hours", "1 day").select("recording", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"),
}


def oracle_sql(turns: str) -> dict[str, str]:
    """turns: SQL of the events as turns."""
    tiled = "tiled AS (SELECT recording, idx * 1000 + part AS idx, t0 + part * 20.0::DOUBLE AS t0, least(t1, t0 + part * 20.0::DOUBLE + 20.0::DOUBLE) AS t1, speaker FROM (SELECT *, unnest(range(0, ceil((t1 - t0 - 1e-6) / 20)::BIGINT)) AS part FROM turns WHERE t1 > t0))"
    next_cut = "CASE WHEN t1 - {0} <= 20 + 1e-6 THEN t1 ELSE coalesce(list_max(list_filter(cuts, lambda c: c > {0} + 1.5::DOUBLE AND c <= {0} + 20.0::DOUBLE - 1.5::DOUBLE)), {0} + 20.0::DOUBLE) END"
    return {
        "merge_in_order": f"WITH {turns}, {merged_sql('turns', 'm', 60.0, 'idx')} SELECT recording, idx, t0, t1, speaker FROM m",
        "merge_touching": f"WITH {turns}, {tiled}, {touching_sql('tiled', 'm')} SELECT * FROM m",
        "absorb_short": f"WITH RECURSIVE {turns}, {absorbed_sql('turns', 'm', 20.0)} SELECT recording, idx, t0, t1, speaker FROM m",
        "refine_boundaries": f"WITH RECURSIVE {turns}, {refined_sql('turns', 'm', 20.0, 2.0, 15.0, 30.0)} SELECT recording, idx, t0, t1, speaker FROM m",
        "postprocess_turns": f"WITH RECURSIVE {turns}, {resolved_sql('turns', 'r')}, {merged_sql('r', 'q', 0.4)}, {refined_sql('q', 'm')}, {merged_sql('m', 'z', 0.4)} SELECT recording, idx, t0, t1, speaker FROM z",
        "speech_segments": f"""WITH {turns}, v AS (SELECT recording, t0, t1, max(t1) {_over("recording", "t0, t1", _BEFORE)} AS reach FROM turns WHERE speaker = 'view' AND t1 > t0),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 0.25 THEN 1 ELSE 0 END) {_over("recording", "t0, t1", _SO_FAR)} AS island FROM v),
m AS (SELECT recording, greatest(0, min(t0) - 0.05::DOUBLE) AS t0, max(t1) + 0.05::DOUBLE AS t1 FROM i GROUP BY recording, island HAVING max(t1) - min(t0) >= 0.25),
s AS (SELECT recording, t0 + part * 45.0::DOUBLE AS t0, least(t1, t0 + part * 45.0::DOUBLE + 45.0::DOUBLE) AS t1 FROM (SELECT *, unnest(range(0, ceil((t1 - t0 - 1e-6) / 45)::BIGINT)) AS part FROM m)),
o AS (SELECT recording, greatest(t0, coalesce(max(t1) {_over("recording", "t0, t1", _BEFORE)}, t0)) AS t0, t1 FROM s) SELECT * FROM o WHERE t1 > t0 + 1e-6""",
        "fixed_chunks": f"WITH {turns} SELECT recording, idx, part::INTEGER AS part, t0 + part * 7.5::DOUBLE AS t0, least(t1, t0 + part * 7.5::DOUBLE + 7.5::DOUBLE) AS t1 FROM (SELECT *, unnest(range(0, ceil((t1 - t0 - 1e-6) / 7.5)::BIGINT)) AS part FROM turns WHERE t1 > t0)",
        "speech_chunks": f"""WITH RECURSIVE {turns}, c AS (SELECT *, list_transform(range(0, floor((t1 - t0) / 7)::BIGINT + 1), lambda k: t0 + k * 7.25::DOUBLE) AS cuts FROM turns WHERE t1 > t0),
w AS (SELECT recording, idx, t1, cuts, 0 AS part, t0 AS a, {next_cut.format("t0")} AS b FROM c UNION ALL SELECT recording, idx, t1, cuts, part + 1, b, {next_cut.format("b")} FROM w WHERE b < t1 - 1e-6)
SELECT recording, idx, part, a AS t0, b AS t1 FROM w""",
        "silence_points": f"""WITH {signals._SEGMENTS}, f AS (SELECT recording, idx, t0, t1, i - 1 AS k, abs(embedding[i]) AS rms FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM segments)),
l AS (SELECT *, greatest(quantile_cont(rms, 0.25) OVER (PARTITION BY recording, idx), 0.35 * avg(rms) OVER (PARTITION BY recording, idx)) AS level FROM f),
r AS (SELECT *, k - row_number() OVER (PARTITION BY recording, idx ORDER BY k) AS run FROM l WHERE rms < level),
g AS (SELECT recording, idx, t0, t1, t0 + (min(k) + count(*) // 2) * 0.01::DOUBLE + 0.01 AS cut FROM r GROUP BY recording, idx, t0, t1, run HAVING count(*) * 0.01::DOUBLE >= 0.02)
SELECT recording, idx, round(cut, 6) AS cut FROM g WHERE cut > t0 + 0.05 AND cut < t1 - 0.05""",
        "word_envelope": f"WITH {signals._UTTERANCES}, e AS (SELECT recording, idx, min(s) AS s, max(e) AS e FROM words GROUP BY recording, idx) SELECT recording, idx, coalesce(s, t0) AS t0, coalesce(e, t1) AS t1 FROM utterances JOIN e USING (recording, idx)",
        "first_last_envelope": f"WITH {signals._UTTERANCES}, e AS (SELECT recording, idx, max(s) FILTER (i = 1) AS s, arg_max(coalesce(e, -1), i) AS e FROM words GROUP BY recording, idx) SELECT recording, idx, coalesce(s, t0) AS t0, coalesce(nullif(e, -1), t1) AS t1 FROM utterances JOIN e USING (recording, idx)",
        "sessions": f"""WITH v AS (SELECT user_id AS recording, epoch_us(ts) AS u FROM events WHERE ts IS NOT NULL), l AS (SELECT *, CASE WHEN u - lag(u) OVER w < 21600000000 THEN 0 ELSE 1 END AS opened FROM v WINDOW w AS (PARTITION BY recording ORDER BY u)),
g AS (SELECT *, sum(opened) {_over("recording", "u", _SO_FAR)} AS k FROM l) SELECT recording, min(u) AS start_us, max(u) + 21600000000 AS end_us, count(*) AS n FROM g GROUP BY recording, k""",
    }
