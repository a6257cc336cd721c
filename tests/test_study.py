"""The chain from season files to cells, with its files and its checks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from oddsmith.__main__ import main
from oddsmith.operators import study
from oddsmith.sources import seasons


def write_seasons(root):
    rng = random.Random(3)
    teams = ["Aa", "Bb", "Cc", "Dd", "Ee", "Ff"]
    for season in range(8):
        for league in ("E0", "D1"):
            lines = ["Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,B365CH,B365CD,B365CA"]
            games = [(h, a) for h in teams for a in teams if h != a]
            for i, (h, a) in enumerate(games):
                lines.append(f'{league},{i % 28 + 1:02d}/{8 + i // 28:02d}/{2000 + season},15:00,"{h}",{a},{rng.choice([0, 1, 1, 2, 3])},{rng.choice([0, 0, 1, 2])},2.1,3.3,3.4')
            path = root / f"{season:02d}{season + 1:02d}"
            path.mkdir(parents=True, exist_ok=True)
            (path / f"{league}.csv").write_text("\n".join(lines))


def test_chain(spark, tmp_path):
    root, out = tmp_path / "archive", tmp_path / "results"
    write_seasons(root)
    main(["coverage", str(root), str(out), "--leagues", "E0", "D1"])
    full = spark.read.option("header", True).csv(f"{out}/coverage.csv")
    assert full.count() == 16 and spark.read.option("header", True).csv(f"{out}/coverage_eligible.csv").count() == 16

    matches, odds, bad = seasons.load_seasons(spark, str(root))
    assert bad.isEmpty() and matches.count() == 480 and matches.where("home = 'Aa'").count() == 80
    table = study.calibrate(matches, (100.0, 400.0), min_fit_matches=60)
    found = study.write_calibration(table, str(out))
    assert json.loads((out / "calibration.json").read_text()) == found
    assert 90 <= found["n_paired"] <= 120 and found["selected_at_grid_boundary"] and {c["half_life_days"] for c in found["candidates"]} == {100.0, 400.0}

    note = tmp_path / "registered.md"
    note.write_text("no rate")
    with pytest.raises(ValueError):
        study.frozen_rate(note.read_text(), found)
    with pytest.raises(ValueError):
        study.frozen_rate("xi = 0.5", found)
    note.write_text(f"We freeze xi = {found['xi']!r}.")
    with pytest.raises(SystemExit):
        main(["evaluate", str(root), str(out)])
    main(["evaluate", str(root), str(out), "--registration", str(note), "--min-fit-matches", "60", "--min-cell", "50"])
    cells = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/cells.csv").collect()
    assert {(r.league, r.method) for r in cells} == {(x, m) for x in ("E0", "D1") for m in ("proportional", "power", "shin", "odds_ratio")}
    assert all(75 <= r.n_matches <= 90 and r.roi_low <= r.roi <= r.roi_high for r in cells)

    # only the league that is missing is fitted again
    files = lambda: sorted(f.name for f in (out / "forecasts" / "league=E0").glob("*.parquet"))
    kept = files()
    for f in (out / "forecasts" / "league=D1").iterdir():
        f.unlink()
    (out / "forecasts" / "league=D1").rmdir()
    again = study.evaluate(matches, odds, found["xi"], str(out), 60, 50, n_resamples=50)
    assert again.count() == 8 and files() == kept
    # keys with outer blanks still join
    spaced = odds.withColumn("home", F.concat(F.lit(" "), "home"))
    assert study.evaluate(matches, spaced, found["xi"], str(out), 60, 50, n_resamples=50).count() == 8

    store = str(tmp_path / "margins")
    assert study.cached_margins(odds, store).count() == 2
    assert study.cached_margins(odds.limit(0), store).count() == 2
    assert study.cached_margins(odds.where("league = 'E0'"), store, refresh=True).count() == 1


def test_checks(spark):
    twice = spark.createDataFrame([("E0", "0001", "burn_in"), ("E0", "0001", "evaluation"), ("E0", "0102", "evaluation")], "league string, season string, period string")
    with pytest.raises(ValueError, match="E0 0001"):
        study.check_disjoint(twice)
    study.check_disjoint(twice.where("period = 'evaluation'"))
    with pytest.raises(Exception, match="a bad row"):
        study.strict(spark.range(3), F.col("id") < 2, "a bad row").collect()
    assert study.strict(spark.range(3), F.col("id") < 3, "a bad row").count() == 3


def test_quoted_fields(spark):
    line = spark.createDataFrame([('a,"b, c",,"d"',), ("x,y,",), ('"open, to the end',), ('p,"q",',)], "line string")
    got = [r.f for r in line.select(seasons._fields(F.col("line")).alias("f")).collect()]
    assert got[0] == ["a", "b, c", "", "d"] and got[1] == ["x", "y", ""] and got[3] == ["p", "q", ""]
