"""The jobs: growing input, late and repeated rows, runs that are repeated or were cut off."""

import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import log_intervals, text_responses

SF = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type")


def whole(spark, df, at):
    """What one run over everything gives."""
    df.write.parquet(f"{at}/all-events")
    log_intervals.run(spark, f"{at}/all-events", f"{at}/all-output", f"{at}/all-checkpoint")
    return rows_of(log_intervals.timeline(spark, f"{at}/all-output"))


def brute(rows, slices=4, off="click"):
    """Timeline of (worm, ts, event_id, state) by plain loops."""
    out, shift = [], {}
    days = {}
    for worm, ts, event_id, state in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        days.setdefault((worm, ts.date()), []).append(state)
    for (worm, day), states in sorted(days.items()):
        found = []
        for i, s in enumerate(states, 1):
            if found and found[-1][0] == s:
                found[-1][2] = i
            else:
                found.append([s, i, i])
        adjust = found[0][2] if found[0][0] == off else found[0][1]
        for seq, (s, a, b) in enumerate(found, 1):
            cut = s == off and seq in (1, len(found))
            v = [None if cut else (x - adjust + 1) // slices for x in (a, b)]
            out.append(dict(worm=worm, seq=seq, state=s, start=a, end=b, first_volume=v[0], last_volume=v[1], shift=shift.get(worm, 0), day=day))
        shift[worm] = shift.get(worm, 0) + len(states)
    return sorted((tuple(r[c] for c in sorted(r)) for r in out), key=repr)


def test_log_grows(spark, tmp_path):
    """New files, among them one of earlier days, are taken in alone, and the result is that of one run over all of them."""
    e, at = events(spark), str(tmp_path)
    parts = [e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1 AND ts < '2024-01-10'"), e.where("event_id % 3 = 2 OR event_id % 3 = 1 AND ts >= '2024-01-10'")]
    taken = []
    for p in parts:
        p.coalesce(2).write.mode("append").parquet(f"{at}/events")
        taken.append(log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint", files_per_batch=1))
        taken.append(log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint"))  # nothing new
    counts = [p.count() for p in parts]
    assert taken == [counts[0], 0, counts[1], 0, counts[2], 0]
    got = rows_of(log_intervals.timeline(spark, f"{at}/output"))
    assert got == whole(spark, e, at)
    assert got == brute([(r["user_id"], r["ts"], r["event_id"], r["event_type"]) for r in e.collect()])


def test_log_later_days_alone_leave_earlier_files(spark, tmp_path):
    """A new day writes its own folders and no others."""
    e, at = events(spark), str(tmp_path)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(f"{at}/output/timeline") for f in names if f.endswith(".parquet")}

    e.where("ts < '2024-01-20'").write.parquet(f"{at}/events")
    log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint")
    before = files()
    e.where("ts >= '2024-01-20'").write.mode("append").parquet(f"{at}/events")
    log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint")
    assert before < files()
    assert rows_of(log_intervals.timeline(spark, f"{at}/output")) == whole(spark, e, at)


def test_log_cut_off_batch_runs_again(spark, tmp_path, monkeypatch):
    """A failure after the intervals are written, before the timeline is: the next run takes the same batch."""
    e, at = events(spark), str(tmp_path)
    e.write.parquet(f"{at}/events")

    def broken(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(log_intervals, "timeline_from", broken)
        with pytest.raises(Exception, match="cut off"):
            log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint")
    assert log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint") == e.count()
    assert rows_of(log_intervals.timeline(spark, f"{at}/output")) == whole(spark, e, at)


def test_log_odd_rows(spark, tmp_path):
    """Repeated ids, missing states, rows without a worm, a time or an id, columns of other names, a file without rows."""
    at, day = str(tmp_path), dt.datetime(2024, 3, 1)
    rows = [(i, day + dt.timedelta(minutes=50 * i), 1 if i % 4 else 2, ("a", "a", None, "click")[i // 5 % 4], "x") for i in range(40)]
    odd = [(None, day, 1, "a", "x"), (90, None, 1, "a", "x"), (91, day, None, "a", "x")]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, day string"
    spark.createDataFrame(rows + odd, schema).coalesce(1).write.parquet(f"{at}/events")
    log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint")
    spark.createDataFrame([(*rows[7][:3], "later", "x")], schema).coalesce(1).write.mode("append").parquet(f"{at}/events")
    log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint")
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{at}/events")
    log_intervals.run(spark, f"{at}/events", f"{at}/output", f"{at}/checkpoint")
    rows[7] = (*rows[7][:3], "later", "x")
    assert rows_of(log_intervals.timeline(spark, f"{at}/output")) == brute([(r[2], r[1], r[0], r[3]) for r in rows])


def test_responses(spark, tmp_path):
    """Two runs give the same; a language that is gone leaves no rows; odd texts have a defined result."""
    at = str(tmp_path)
    texts = [("one two three four five six seven", "en", "s1"), ("aa bb " * 40, "en", "s1"), ("", "en", "s2"), (None, None, "s1"), (" \t\n", "fr", None), ("ää b c d e ff", "fr", None), ("x", "de", "s3"), ("x", "de", "s3")]
    df = spark.createDataFrame([(i, *t, 1, 2.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n long, mean double")
    df.write.parquet(f"{at}/documents")
    text_responses.run(spark, f"{at}/documents", f"{at}/out")
    first = rows_of(text_responses.traces_of(spark, f"{at}/out")), rows_of(text_responses.peaks_of(spark, f"{at}/out"))
    text_responses.run(spark, f"{at}/documents", f"{at}/out")
    assert (rows_of(text_responses.traces_of(spark, f"{at}/out")), rows_of(text_responses.peaks_of(spark, f"{at}/out"))) == first
    peaks = {(r["neuron"], r["stimulus"]): r for r in text_responses.peaks_of(spark, f"{at}/out").collect()}
    assert set(peaks) == {("en", "s1"), ("en", "s2"), (None, "s1"), ("fr", None), ("de", "s3")}
    assert peaks["en", "s2"]["peak"] == 0 and peaks["de", "s3"]["trials"] == 2
    # one two three four five six seven: lengths 3 3 5 4 4 3 5, less 3.8; aa bb: zeros
    assert peaks["en", "s1"]["peak"] == pytest.approx(0.5 * 1.2) and peaks["en", "s1"]["normalised"] == 1.0
    t0 = {r["t"]: r for r in text_responses.traces_of(spark, f"{at}/out").where("neuron = 'en' AND stimulus = 's1'").collect()}
    assert sorted(t0) == list(range(8)) and t0[0]["n"] == 2 and t0[0]["mean"] == pytest.approx(-0.4) and t0[7]["n"] == 1 and t0[7]["sem"] is None
    df.where("lang = 'fr'").write.parquet(f"{at}/fewer")
    text_responses.run(spark, f"{at}/fewer", f"{at}/out")
    assert {r["neuron"] for r in text_responses.peaks_of(spark, f"{at}/out").collect()} == {"fr"}
    df.limit(0).write.parquet(f"{at}/none")
    text_responses.run(spark, f"{at}/none", f"{at}/out")
    assert text_responses.traces_of(spark, f"{at}/out").count() == 0 == text_responses.peaks_of(spark, f"{at}/out").count()


def test_settings_stay(spark, tmp_path):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    events(spark).write.parquet(f"{tmp_path}/events")
    log_intervals.run(spark, f"{tmp_path}/events", f"{tmp_path}/output", f"{tmp_path}/checkpoint")
    text_responses.run(spark, f"{SF}/documents.parquet", f"{tmp_path}/out")
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


@pytest.mark.parametrize("name", ["log_intervals", "text_responses"])
def test_command_line(spark, tmp_path, name):
    """In a process of its own; what the command line names goes before the configuration."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(f"{root}/jobs/{name}.json") as f:
        config = json.load(f)
    config["output"] = "/nowhere/at/all"
    if "checkpoint" in config:
        config["checkpoint"] = f"{tmp_path}/checkpoint"
    source = next(k for k in ("events", "documents") if k in config)
    config[source] = f"{SF}/{source}.parquet"
    with open(f"{tmp_path}/config.json", "w") as f:
        json.dump(config, f)
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--config", f"{tmp_path}/config.json", "--output", f"{tmp_path}/out"], cwd=root, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr
    for folder in os.listdir(f"{tmp_path}/out"):
        assert spark.read.parquet(f"{tmp_path}/out/{folder}").where(F.lit(True)).count() > 0
