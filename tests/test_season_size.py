"""What a record of a season file costs doesn't grow with its file."""

from oddsmith.plans import surrogate
from oddsmith.sources import seasons

SF = "/root/testdata/sf0.001"

def test_a_record_does_not_carry_its_file(spark):
    """Whether a file is empty was told again for each record, from the whole text."""
    files = spark.createDataFrame([("p", "2324", "E0", "Div,Date\nE0,1/2/2024"), ("q", "2324", "E1", "  ")], "path string, season string, league string, text string")
    lines = seasons.numbered_records(files)
    assert sorted(tuple(r) for r in lines.collect()) == [("p", "2324", "E0", False, 0, "Div,Date"), ("p", "2324", "E0", False, 1, "E0,1/2/2024"), ("q", "2324", "E1", True, 0, "")]
    above = lines._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "text" not in above


def test_a_kickoff_is_made_once(spark, tmp_path):
    """Conditions repeated what they judge, until no method of compiled code could hold it."""
    matches, odds, _ = seasons.load_seasons(spark, surrogate.season_archive(spark, SF), partitioned=True)
    for df in (matches, odds):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("timestamp(") <= 4 and plan.count("try_cast(") <= 4
    assert matches.count() > 0 and odds.where("decimal > 1").count() == odds.count() > 0


def test_places_of_a_file(spark):
    h = spark.createDataFrame([("a", ["HT", "", "Div", "HomeTeam", ""]), ("b", ["Date"])], "path string, header array<string>")
    got = {r.path: r for r in seasons.places(h).collect()}
    assert (got["a"].width, got["a"].blank, got["a"].at_home, got["a"].at_div, got["a"].at_date) == (5, [1, 4], 3, 2, None)
    assert (got["b"].width, got["b"].blank, got["b"].at_home, got["b"].at_date) == (1, [], None, 0)
    f = spark.createDataFrame([(["x", " nan "], 1), (["x", " y "], 1), (["x"], 1), (["x"], None)], "fields array<string>, at_home int")
    assert [r[0] for r in f.select(seasons._field("home")).collect()] == ["", "y", "", ""]
