import hashlib
from pathlib import Path

import pytest

from oddsmith.plans import catalogue
from oddsmith.sources import seasons


@pytest.mark.parametrize("large", [1 << 20, 10_000])
def test_manifest_lists_every_table(spark, monkeypatch, large):
    monkeypatch.setattr(seasons, "LARGE", large)
    files = list(Path("/root/testdata/sf0.001").glob("*.parquet"))
    want = sorted((f.name, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files)
    assert len(want) == 14
    assert sorted(tuple(r) for r in catalogue.QUERIES["manifest_sha256"](spark, "/root/testdata/sf0.001").collect()) == want
