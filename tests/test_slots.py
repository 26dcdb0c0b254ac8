"""One recording's failure is its own."""

import pandas as pd

from parley.operators import slots


def test_a_failing_recording_keeps_what_it_had(spark):
    rows = [(r, i) for r in ("fine", "late", "early", "quiet") for i in range(4)]
    df = spark.createDataFrame(rows, "recording string, idx int")

    def model(part):
        name = part["recording"].iloc[0]
        for i in sorted(part["idx"]) if name != "quiet" else ():
            if name == "early" or name == "late" and i == 2:
                raise ValueError(f"no speech in {name}")
            yield pd.DataFrame({"t0": [float(i)], "speaker": [f"s{i}"]})

    found = slots.guarded(df, model, "t0 double, speaker string")
    got = sorted(((r["recording"], r["t0"], r["speaker"], r["error"]) for r in found.collect()), key=str)
    want = [("fine", float(i), f"s{i}", None) for i in range(4)] + [("late", float(i), f"s{i}", None) for i in range(2)]
    want += [(r, None, None, f"ValueError: no speech in {r}") for r in ("late", "early")]
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, slots.statuses(found).collect())) == [("early", "error", 0, "ValueError: no speech in early"), ("fine", "ok", 4, None), ("late", "error", 2, "ValueError: no speech in late")]
    assert slots.guarded(df.where("false"), model, "t0 double, speaker string").count() == 0
