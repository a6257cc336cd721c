"""What a run of the reports writes on its way doesn't stay."""

from pathlib import Path

from jobs import league_reports
from pyspark.sql import functions as F

from oddsmith.sources import shared

SF = "/root/testdata/sf0.001"


def test_a_run_leaves_its_reports_only(spark, tmp_path, monkeypatch):
    """Two runs of it left two sets of books, rows of cells and dealt rows, and each was read by shuffles that stayed too."""
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path / "shared"))
    made, real = [], shared.new_folder
    monkeypatch.setattr(shared, "new_folder", lambda spark, name: (made.append(name), real(spark, name))[1])
    wrote = league_reports.run(spark, SF, str(tmp_path / "out"))
    assert {"books", "cell-rows", "dealt"} <= set(made) and made.count("books") == made.count("cell-rows") == 1
    assert not [p for p in Path(tmp_path / "shared").iterdir() if p.name[:5] in ("books", "cell-", "dealt", "sizes", "ends-")]
    assert league_reports.read_back(spark, str(tmp_path / "out")).count() == wrote["rows"] > 0


def test_tables_go_with_what_they_were_written_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path))
    left = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    with shared.passing(spark):
        kept = shared.settled(spark, "kept", lambda: shared.written(spark.range(3), "way").withColumn("x", F.lit(1)))
        assert left() == ["kept"] and kept.count() == 3 and shared.written(kept, "again") is kept
    assert left() == []
    shared.written(spark.range(2), "stays")
    assert left() == ["stays"]
