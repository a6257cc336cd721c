"""The closed registry of season-file columns: what each name means, or that it is known and not priced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The archive's column stems and the bookmakers they stand for.
BOOKMAKERS = {
    "1XB": "1XBet", "B365": "Bet365", "BF": "Betfair", "BFD": "Betfred", "BMGM": "BetMGM", "BV": "BetVictor", "BS": "Blue Square", "BW": "Bet&Win",
    "CL": "Coral", "GB": "Gamebookers", "IW": "Interwetten", "LB": "Ladbrokes", "PP": "Paddy Power", "PS": "Pinnacle", "SK": "Skybet", "SKB": "Stake",
    "SO": "Sporting Odds", "SB": "Sportingbet", "SJ": "Stan James", "SY": "Stanleybet", "VC": "VC Bet", "WH": "William Hill", "BFE": "Betfair Exchange",
    "Max": "Market maximum", "Avg": "Market average", "BbMx": "Betbrain maximum", "BbAv": "Betbrain average",
}
# Names of results and statistics, of counts of bookmakers, and of handicap lines, none of which is a price.
RESULTS = (
    "Div", "Date", "Time", "HomeTeam", "AwayTeam", "HT", "AT", "HxG", "AxG", "FTHG", "HG", "FTAG", "AG", "FTR", "Res", "HTHG", "HTAG", "HTR",
    "Attendance", "Referee", "HS", "AS", "HST", "AST", "HHW", "AHW", "HC", "AC", "HF", "AF", "HFKC", "AFKC", "HO", "AO", "HY", "AY", "HR", "AR",
    "HBP", "ABP",
)
COUNTS = ("Bb1X2", "BbOU", "BbAH")
ASIAN_LINES = ("BbAHh", "AHh", "AHCh", "PAHH", "PAHA", "PCAHH", "PCAHA")
# The short stem of one bookmaker, and the group of full names that replaces each group of short ones.
SHORT_STEM, SHORT_BOOK = "P", "Pinnacle"
ALIAS_GROUPS = (
    (("PSH", "PSD", "PSA"), ("PH", "PD", "PA")),
    (("PS>2.5", "PS<2.5"), ("P>2.5", "P<2.5")),
    (("PSC>2.5", "PSC<2.5"), ("PC>2.5", "PC<2.5")),
)


def priced_names() -> dict[str, tuple[str, str, str, str]]:
    """name -> (book, market, outcome, period); a C after the stem marks closing prices."""
    goals = ((">2.5", "O"), ("<2.5", "U"))
    out = {}
    for stem, book in BOOKMAKERS.items():
        for mark, period in (("", "open"), ("C", "close")):
            out |= {f"{stem}{mark}{o}": (book, "1X2", o, period) for o in "HDA"}
            out |= {f"{stem}{mark}{sign}": (book, "OU25", o, period) for sign, o in goals}
    # the short stem has no closing 1X2 names
    out |= {f"{SHORT_STEM}{o}": (SHORT_BOOK, "1X2", o, "open") for o in "HDA"}
    for mark, period in (("", "open"), ("C", "close")):
        out |= {f"{SHORT_STEM}{mark}{sign}": (SHORT_BOOK, "OU25", o, period) for sign, o in goals}
    return out


def known_names() -> dict[str, str]:
    """name -> kind: odds, result, count or asian (known, never priced)."""
    asian = [f"{stem}{mark}{side}" for stem in BOOKMAKERS for mark in ("", "C") for side in ("AHH", "AHA", "AH")]
    kinds = {**dict.fromkeys([*asian, *ASIAN_LINES], "asian"), **dict.fromkeys(COUNTS, "count")}
    return kinds | dict.fromkeys(priced_names(), "odds") | dict.fromkeys(RESULTS, "result")


def registry(spark: SparkSession) -> DataFrame:
    """name, kind, book, market, outcome, period. A few hundred rows, so it may be broadcast."""
    priced = priced_names()
    rows = [(n, k, *priced.get(n, (None,) * 4)) for n, k in known_names().items()]
    return spark.createDataFrame(rows, "name string, kind string, book string, market string, outcome string, period string")
