"""Schemas and fixed values of the tables."""

from __future__ import annotations

MATCH_KEYS = ["league", "season", "kickoff", "home", "away"]
MATCHES = "league string, season string, kickoff timestamp_ntz, home string, away string, home_goals bigint, away_goals bigint"
ODDS = "league string, season string, kickoff timestamp_ntz, home string, away string, book string, market string, period string, outcome string, decimal double"

# Outcomes of each market in order, books that are no bookmakers, leagues of the archive.
OUTCOMES = {"1X2": ("H", "D", "A"), "OU25": ("O", "U")}
COMPOSITE_BOOKS = ("Market maximum", "Market average", "Betbrain maximum", "Betbrain average")
LEAGUES = ("E0", "E1", "D1", "D2", "SP1", "SP2", "I1", "I2", "F1", "F2", "N1", "B1", "P1", "T1", "SC0", "G1")
HALF_LIVES = (30.0, 60.0, 90.0, 150.0, 250.0, 400.0, 700.0, 1200.0, 2000.0, 40000.0)
MIN_RATE, MAX_RATE = 0.05, 6.0
BURN_IN, CALIBRATION = 3, 2
