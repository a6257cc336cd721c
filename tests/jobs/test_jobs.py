"""The jobs on small copies: growing input, reruns, failures, settings, the command line."""

import hashlib
import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import archive_intake, common, league_reports

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, shelf string, sha256 string"
ROWS = [
    (1, "one\r\ntwo\rthree\n", "en", "a"), (2, None, "en", "a"), (3, "  ", "de", "a/b?*é"), (4, "NaN", None, None), (5, "same", "en", "a"), (6, "same", "en", "a"), (None, "x" * 200_000, "en", ""), (6, "same", "en", "a"),
]
MORE = [(7, "same", "en", "a"), (8, "new", "fr", "z"), (8, "new", "fr", "z")]


def add(spark, folder, rows):
    spark.createDataFrame([(*r, 0, "b", "s", "d") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def expected(rows):
    out = []
    for doc, text, lang, source in rows:
        clean = (text or "").strip(" ")
        problem = "missing" if text is None else "blank" if clean in ("", "NaN") else None
        lines = 0 if text is None else len(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        raw = (text or "").encode()
        out.append((doc, source, lang, len(raw), lines, None if text is None else hashlib.sha256(raw).hexdigest(), problem))
    return Counter(out)


def held(spark, output):
    manifest, coverage = archive_intake.read_back(spark, output)
    texts = Counter(tuple(r) for r in manifest.drop("batch", "shelf").collect())
    return texts, {(r.source, r.lang): (r.n_texts, r.n_distinct, r.n_problems, r.n_bytes) for r in coverage.collect()}, {r.batch for r in manifest.select("batch").distinct().collect()}


def counted(rows):
    out = {}
    for (_, source, lang, size, _, digest, problem), n in expected(rows).items():
        t, d, p, b = out.get((source, lang), (0, set(), 0, 0))
        out[source, lang] = (t + n, d | {digest} - {None}, p + n * (problem is not None), b + n * size)
    return {k: (t, len(d), p, b) for k, (t, d, p, b) in out.items()}


def test_intake_of_a_growing_archive(spark, tmp_path):
    archive, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    add(spark, archive, ROWS)
    assert archive_intake.run(spark, archive, output, checkpoint) == {"batches": 1, "texts": len(ROWS), "shelves": 4}
    assert held(spark, output) == (expected(ROWS), counted(ROWS), {0})
    assert archive_intake.run(spark, archive, output, checkpoint) == {"batches": 0, "texts": 0, "shelves": 0}
    add(spark, archive, MORE)
    untouched = {p: p.stat().st_mtime_ns for p in Path(output, "coverage").rglob("*.parquet") if "shelf=a-" not in str(p)}
    assert archive_intake.run(spark, archive, output, checkpoint) == {"batches": 1, "texts": len(MORE), "shelves": 2}
    assert held(spark, output) == (expected(ROWS + MORE), counted(ROWS + MORE), {0, 1})
    assert untouched and all(p.stat().st_mtime_ns == t for p, t in untouched.items())


def test_intake_after_failures(spark, tmp_path, monkeypatch):
    """A batch that failed after it had written its rows is taken again without doubling them, and coverage catches up."""
    archive, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    add(spark, archive, ROWS)
    add(spark, archive, MORE)
    true_replace, calls = archive_intake._replace, []

    def fails(df, path, *partitions):
        true_replace(df, path, *partitions)
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(archive_intake, "_replace", fails)
        with pytest.raises(Exception, match="lost"):
            archive_intake.run(spark, archive, output, checkpoint, {"files_per_batch": 1})
    assert archive_intake.run(spark, archive, output, checkpoint, {"files_per_batch": 1})["batches"] == 1
    assert held(spark, output) == (expected(ROWS + MORE), counted(ROWS + MORE), {0, 1})


def test_intake_of_files_that_were_written_long_ago(spark, tmp_path):
    archive, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    add(spark, archive, ROWS)
    archive_intake.run(spark, archive, output, checkpoint)
    there = set(Path(archive).glob("*.parquet"))
    add(spark, archive, MORE)
    for file in set(Path(archive).glob("*.parquet")) - there:
        os.utime(file, (86_400, 86_400))
    assert archive_intake.run(spark, archive, output, checkpoint)["texts"] == len(MORE)


def test_intake_of_nothing(spark, tmp_path):
    archive, output = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, archive, [])
    for _ in range(2):
        archive_intake.run(spark, archive, output, str(tmp_path / "checkpoint"))
    assert held(spark, output) == (Counter(), {}, set())


def test_settings(spark, tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"discovery_rate": 0.2}))
    assert common.settings("league_reports", str(own), spark) == {"leagues": None, "least_matches": 1, "discovery_rate": 0.2}
    own.write_text(json.dumps({"rate": 0.2}))
    with pytest.raises(ValueError, match="unknown settings: rate"):
        common.settings("league_reports", str(own), spark)


def test_reports_of_some_leagues_leave_the_others(spark, tmp_path):
    output = str(tmp_path / "reports")
    wrote = league_reports.run(spark, SF, output)
    before = {tuple(r) for r in league_reports.read_back(spark, output).drop("q_value", "discovery").collect()}
    assert wrote["rows"] == len(before) and wrote["leagues"] == 5
    league = league_reports.read_back(spark, output).agg(F.min("league")).first()[0]
    files = {p for p in Path(output).rglob("*.parquet")}
    again = league_reports.run(spark, SF, output, {"leagues": [league]})
    assert again["leagues"] == 1 and len(files & {p for p in Path(output).rglob("*.parquet")}) == len(files) - len({p for p in files if f"league={league}" in str(p)})
    assert {tuple(r) for r in league_reports.read_back(spark, output).drop("q_value", "discovery").collect()} == before


def test_command_line(spark, tmp_path):
    archive, output = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, archive, ROWS)
    command = [sys.executable, "-m", "jobs.archive_intake", "--archive", archive, "--output", output, "--checkpoint", str(tmp_path / "c")]
    done = subprocess.run(command, cwd=Path(common.__file__).parents[1], env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"read and wrote {len(ROWS)} texts" in done.stderr
    assert held(spark, output)[0] == expected(ROWS)
