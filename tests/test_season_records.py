"""Records of season files whose quoted fields hold commas, quotes and line ends, in batches and in the stream."""

import os

from pyspark.sql import functions as F

from oddsmith.functions import pricing
from oddsmith.operators import study
from oddsmith.plans import surrogate
from oddsmith.sources import seasons
from oddsmith.sources.registry import registry
from oddsmith.streaming import ingest

HEADER = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,Referee,B365CH,B365CD,B365CA"
FILE = (
    HEADER + '\r\nE0,12/08/2023,15:00,"Ars, ""the"" A",Ful,2,1,"Smith,\r\nJ.\r\n\r\n(4th)",1.5,4,7,,\r\n'
    + 'E0,13/08/2023,,Che, Liv ,1,1,O"Neill,2.5,3.1,2.9\nE0,14/08/2023,12:30,Bur,Mci,0,3,"never closed,1.5,2.5,3.5\nE0,15/08/2023,12:30,Avl,New,0,0,x,1.9,3.3,"4.1"\n'
)


def test_records_and_fields(spark):
    texts = [FILE, 'a,b\n"x\ny",1\n', '"a', 'a\n\n"b"', "", "plain\r\rtext\n\n", 'a,"b""\nc",d\n,"\n",""\n', '"' * 5 + "\n" + "x", "q," * 50_000 + '"\n"']
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(seasons.records(F.col("text")).alias("r"))
    got = [r.r for r in df.collect()]
    got[0] = [x for x in got[0] if x]
    assert len(got[0]) == 5 and got[0][1].endswith(",1.5,4,7,,") and got[0][3].startswith("E0,14/08")
    assert [x for x in got[1] if x] == ["a,b", '"x\ny",1'] and [x for x in got[2] if x] == ['"a'] and [x for x in got[3] if x] == ["a", '"b"'] and not any(got[4])
    assert [x for x in got[5] if x] == ["plain", "text"] and [x for x in got[6] if x] == ['a,"b""\nc",d', ',"\n",""'] and [x for x in got[7] if x] == ['"' * 5, "x"] and len([x for x in got[8] if x]) == 1
    lines = spark.createDataFrame([(x,) for x in (got[0][1], got[6][0], got[6][1], got[0][3])], "line string")
    fields = [r.f for r in lines.select(seasons._fields(F.col("line")).alias("f")).collect()]
    assert fields[0][3] == 'Ars, "the" A' and fields[0][7] == "Smith,\nJ.\n\n(4th)" and fields[0][8:] == ["1.5", "4", "7", "", ""]
    assert fields[1] == ["a", 'b"\nc', "d"] and fields[2] == ["", "\n", ""] and fields[3][7:] == ['"never closed', "1.5", "2.5", "3.5"]


def test_batch_and_stream_agree(spark, tmp_path):
    folder = tmp_path / "2324"
    folder.mkdir()
    (folder / "E0.csv").write_bytes(("﻿" + FILE).encode())
    matches, odds, problems = seasons.load_seasons(spark, str(tmp_path))
    assert problems.isEmpty()
    got = {(r.home, r.away, str(r.kickoff), r.home_goals, r.away_goals) for r in matches.collect()}
    assert got == {('Ars, "the" A', "Ful", "2023-08-12 15:00:00", 2, 1), ("Che", "Liv", "2023-08-13 00:00:00", 1, 1), ("Bur", "Mci", "2023-08-14 12:30:00", 0, 3), ("Avl", "New", "2023-08-15 12:30:00", 0, 0)}
    q = ingest.stream_odds(spark, str(tmp_path)).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("records").collect()} == {tuple(r) for r in odds.select(spark.table("records").columns).collect()} and odds.count() == 12


def test_partitioned_files(spark, tmp_path):
    root = str(tmp_path / "parts")
    df = spark.createDataFrame([(FILE, "0001", "E0"), (FILE.replace("E0,", "D1,"), "2324", "D1")], "value string, season string, league string")
    df.write.partitionBy("season", "league").text(root)
    matches, _, problems = seasons.load_seasons(spark, root, ["D1"], partitioned=True)
    assert problems.isEmpty() and {(r.season, r.league) for r in matches.collect()} == {("2324", "D1")}
    assert {r.season for r in seasons.season_files(spark, root, partitioned=True).collect()} == {"0001", "2324"}


def test_the_league_that_a_file_tells(spark, tmp_path):
    row = "12/08/2023,15:00,A,B,2,1,x,1.5,4,7"
    files = {"one": f"E0,{row}\n,{row}\n", "two": f"E0,{row}\nD1,{row}\n", "none": f",{row}\n", "other": f'"D1",{row}\n'}
    folder = tmp_path / "2324"
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(f"{HEADER}\n{text}")
    (folder / "undivided.csv").write_text(f"{HEADER.replace('Div,', '')}\n{row}\n")
    matches, odds, problems = seasons.load_seasons(spark, str(tmp_path), league_from_div=True)
    assert sorted(r.league for r in matches.collect()) == ["D1", "E0", "E0"] and odds.count() == 9
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in problems.collect()} == {
        "two.csv": "expected one Div, got [D1, E0]", "none.csv": "no Div to tell the league", "undivided.csv": "no Div to tell the league"}
    assert {r.league for r in seasons.load_seasons(spark, str(tmp_path), ["D1"], league_from_div=True)[0].collect()} == {"D1"}


def test_counts_read_no_column(spark, tmp_path):
    seasons.write_by_league(spark.range(50).select("id", F.concat(F.lit("L"), F.col("id") % 3).alias("league")), str(tmp_path / "f"))
    counts = study.forecast_counts(spark.read.parquet(str(tmp_path / "f")))
    assert {(r.league, r.n_forecasts) for r in counts.collect()} == {("L0", 17), ("L1", 17), ("L2", 16)}
    assert "ReadSchema: struct<>" in counts._jdf.queryExecution().toString()


def test_the_stream_forgets_after_its_delay(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "archive" / "2324", str(tmp_path / "ck"), str(tmp_path / "out")
    folder.mkdir(parents=True)

    def add(name, day, at):
        row = f"{name},{day:02d}/08/2023,15:00,A,B,2,1,x,1.5,4,7\n"
        (folder / f"{name}.csv").write_text(f"{HEADER}\n{row}{row}")
        os.utime(folder / f"{name}.csv", (at, at))
        q = ingest.stream_odds(spark, str(tmp_path / "archive"), "10 days").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
        state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        return state[-1]["numRowsTotal"], sum(s["numRowsDroppedByWatermark"] for s in state), spark.read.parquet(out).count()

    day = 86_400
    assert add("E0", 1, 100 * day) == (3, 0, 3)
    assert add("D1", 2, 130 * day)[1:] == (0, 6)
    total, late, _ = add("I1", 3, 131 * day)
    assert total <= 6 and late == 0  # the first league's prices are forgotten
    assert add("F1", 4, 100 * day)[1:] == (6, 9)  # too late: both of its rows of each price are counted


def test_price_columns_are_told_once_a_file(spark):
    """They were told for each field of each record."""
    h = spark.createDataFrame([("a", ["Div", "PSH", "PSD", "PSA", "PH", "Mystery"]), ("b", ["Div", "Date"])], "path string, header array<string>")
    got = {r.path: sorted((x["at"], x.outcome) for x in r.priced) for r in seasons.price_columns(h, registry(spark)).collect()}
    assert got == {"a": [(1, "H"), (2, "D"), (3, "A")]}


def test_a_pairing_is_priced_once(spark):
    """Each match was priced on its own, though a pairing's rates are the same in all its matches."""
    plan = surrogate.forecasts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan
    m = surrogate.matches(spark, "/root/testdata/sf0.001")
    want = pricing.with_outcomes(surrogate.with_rates(m), "lambda_home", "lambda_away", "rho").select("seq", "p_home", "p_over25").collect()
    assert sorted(want) == sorted(surrogate.forecasts(spark, "/root/testdata/sf0.001").select("seq", "p_home", "p_over25").collect())
