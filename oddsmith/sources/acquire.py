"""Fetching season files. A driver-side, deliberately serial task; no Spark plan depends on it."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from urllib.error import HTTPError
from urllib.request import urlopen

# Fixed value: where the public archive keeps its season files.
ARCHIVE = "https://www.football-data.co.uk/mmz4281"


def season_code(year: int) -> str:
    return f"{year % 100:02d}{(year + 1) % 100:02d}"


def season_start_year(code: str) -> int:
    if len(code) != 4 or not code.isdigit() or (int(code[:2]) + 1) % 100 != int(code[2:]):
        raise ValueError(f"no season code: {code!r}")
    return (1900 if code[:2] >= "90" else 2000) + int(code[:2])


def season_codes(first: int, last: int) -> list[str]:
    return [season_code(y) for y in range(first, last + 1)]


def season_url(season: str, league: str, archive: str = ARCHIVE) -> str:
    return f"{archive}/{season}/{league}.csv"


def fetch(season: str, league: str, opener: Callable = urlopen, archive: str = ARCHIVE) -> bytes | None:
    """A file's bytes; None where the archive has none. Other failures are raised."""
    try:
        with opener(season_url(season, league, archive)) as reply:
            return reply.read()
    except HTTPError as e:
        if e.code == 404:
            return None
        raise


@dataclass
class Acquisition:
    downloaded: list[str] = field(default_factory=list)
    cached: list[str] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)

    @property
    def available(self) -> list[str]:
        return sorted(self.downloaded + self.cached)

    @property
    def summary(self) -> str:
        return ", ".join(f"{len(v)} {k}" for k, v in vars(self).items())


def acquire(root: str, leagues: Iterable[str], seasons: Iterable[str], delay: float = 0.25, opener: Callable = urlopen) -> Acquisition:
    """Fetch what isn't there yet. Missing and empty files count as absent, other failures as failed; neither stops it."""
    out = Acquisition()
    leagues = list(leagues)
    for season in seasons:
        for league in leagues:
            path = Path(root, season, f"{league}.csv")
            if path.exists() and path.stat().st_size:
                out.cached.append(str(path))
                continue
            try:
                body = fetch(season, league, opener)
            except OSError:
                out.failed.append(str(path))
                continue
            finally:
                time.sleep(delay)
            if not body or not body.strip():
                out.absent.append(str(path))
                continue
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body)
            out.downloaded.append(str(path))
    return out


def sha256_file(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
