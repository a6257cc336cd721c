"""Season files (root/season/league.csv) to tidy matches and odds, without leaving the DataFrame API.

Files that can't be used become rows of a report with the reason; they never stop the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import let
from .registry import ALIAS_GROUPS, registry
from .shared import written

# Spellings that stand for a missing text.
MISSING = ("nan", "NaN", "NAN", "None", "NaT", "<NA>", "null", "NULL")
LARGE = 256 << 20
# a quote that opens a field runs to the one that ends it, over commas and line ends, doubled ones inside; where no quote stands
# at a field's end it is an ordinary character
QUOTED = r'[ \t]*+"(?:[^"]++|"")*+"(?=[ \t]*(?:,|\n|\z))'
FIELD = rf"(?:{QUOTED}[^,]*+|[^,]*+),"
RECORD = rf"(?:{QUOTED}[^,\n]*+|[^,\n]*+)(?:,(?:{QUOTED}[^,\n]*+|[^,\n]*+))*+(?:\n|\z)"


def season_files(spark: SparkSession, root: str, leagues: list[str] | None = None, partitioned: bool = False) -> DataFrame:
    """path, season, league, text of every file; a league filter acts on paths. Files lie at season/league.csv, or below
    season=.../league=... as Spark's writers partition them."""
    path = F.col("_metadata.file_path").alias("path")
    if partitioned:
        files = spark.read.schema("value string, season string, league string").text(root, wholetext=True).select(path, "season", "league", "value")
    else:
        part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.csv$", i)
        files = spark.read.text(f"{root}/*/*.csv", wholetext=True).select(path, "value").select("path", part(1).alias("season"), part(2).alias("league"), "value")
    out = files.withColumn("text", F.regexp_replace("value", "^\ufeff+", "")).drop("value")
    return out.where(F.col("league").isin(*leagues)) if leagues else out


def text_lines(c: Column) -> Column:
    """Lines of a text, however they end; null for a null text."""
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n", -1)


def clean_text(c: Column) -> Column:
    return let(F.trim(F.coalesce(c, F.lit(""))), lambda t: F.when(t.isin(*MISSING), "").otherwise(t))


def parse_kickoff(date: Column, time: Column) -> Column:
    """Day-first dates with two- or four-digit years, or ISO dates, and an optional HH:MM[:SS]; a bad time counts as none.

    What is used twice is bound, or the expression grows beyond what a method of compiled code holds."""
    two = lambda d: let(F.regexp_extract(d, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3), lambda y: F.when(y == "", d).otherwise(
        F.concat(F.regexp_extract(d, r"^(\d{1,2}/\d{1,2}/)", 1), F.when(y.cast("int") >= 69, "19").otherwise("20"), y)))
    read = lambda d: F.coalesce(F.try_to_timestamp(d, F.lit("d/M/yyyy")), F.try_to_timestamp(d, F.lit("yyyy/M/d")))
    day = let(let(F.regexp_replace(clean_text(date), r"[-.]", "/"), two), read)
    part = lambda t, i: F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d{1,3}):(\d{1,2})(?::(\d{1,2}))?$", i), F.lit("")).cast("int"), F.lit(0))
    after = let(clean_text(time), lambda t: F.make_dt_interval(F.lit(0), part(t, 1), part(t, 2), part(t, 3).cast("decimal(18,6)")))
    return (day + after).cast("timestamp_ntz")


def records(text: Column) -> Column:
    """The records of a file: its lines, but for line ends within quotes. Only files that hold a quote need the pattern."""
    quoted = lambda own: F.transform(F.regexp_extract_all(own, F.lit(RECORD), 0), lambda x: F.regexp_replace(x, r"\n\z", ""))
    return let(F.rtrim(F.regexp_replace(text, r"\r\n?", "\n")), lambda own: F.when(F.contains(own, F.lit('"')), quoted(own)).otherwise(F.split(own, "\n", -1)))


def _fields(line: Column) -> Column:
    """Fields of a record; only records that hold a quote need the pattern."""
    quoted = F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(FIELD), 0), lambda x: F.regexp_replace(x, r",\z", ""))
    plain = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1)), lambda x: plain(F.trim(x)))


def numbered_records(files: DataFrame) -> DataFrame:
    """path, season, league, empty, line, raw: the records of files that aren't blank, the header is line 0.

    A file is split in one task and once. What its whole text tells is told before, as each record else carries the text with it.
    """
    texts = files.select("path", "season", "league", (F.trim("text") == "").alias("empty"), records(F.col("text")).alias("records"))
    lines = texts.select("path", "season", "league", "empty", F.posexplode_outer("records").alias("line", "raw"))
    return lines.where("coalesce(line, 0) = 0 or trim(raw) <> ''")


def parsed_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, rows): per file its header array and width; per record its fields with its number.

    The records of a file are dealt to all tasks, which take them apart and write them to the shared folder, as the checks and the
    tidy tables all read them.
    """
    lines = numbered_records(files)
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.sparkSession.sparkContext.defaultParallelism)
    # the number is stated, lest records be merged for being few bytes: they are much work
    parsed = written(lines.repartition(n, "path", "line").withColumn("fields", _fields(F.coalesce("raw", F.lit("")))).drop("raw"), "records")
    headers = written(parsed.where("coalesce(line, 0) = 0").select("path", "season", "league", F.col("fields").alias("header"), "empty"), "headers")
    return headers, parsed.where("line > 0").select("path", "season", "league", "line", "fields")


def header_problems(headers: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """(path, reason) of files that are empty, have unknown or repeated names, data beyond the header, no date, or another league."""
    names = headers.select("path", F.explode("header").alias("name")).where("name <> '' and not name rlike '^Unnamed:\\\\s*[0-9]+$'")
    unknown = names.join(F.broadcast(known.select("name")), "name", "left_anti").groupBy("path").agg(F.concat(F.lit("unknown columns: "), F.array_join(F.sort_array(F.collect_set("name")), ", ")).alias("reason"))
    repeated = names.groupBy("path", "name").count().where("count > 1").groupBy("path").agg(F.concat(F.lit("repeated columns: "), F.array_join(F.sort_array(F.collect_list("name")), ", ")).alias("reason"))
    joined = rows.join(places(headers), "path")
    beyond = F.exists(F.slice("fields", F.col("width") + 1, F.greatest(F.size("fields") - F.col("width"), F.lit(0))), lambda x: clean_text(x) != "")
    unnamed = F.exists("blank", lambda i: clean_text(F.get("fields", i)) != "")
    # most records are as wide as their header, so what is beyond it is looked at last
    flags = {"wide": F.size("fields") > F.col("width"), "beyond": (F.size("fields") > F.col("width")) & beyond, "unnamed": (F.size("blank") > 0) & unnamed,
             "other": let(_field("div"), lambda div: (div != "") & (div != F.col("league")))}
    seen = joined.groupBy("path").agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])
    reasons = F.array(F.when(F.expr("beyond or (wide and unnamed)"), "data in unnamed columns"), F.when(F.col("other"), "another league's rows"))
    found = seen.select("path", F.explode(reasons).alias("reason")).where("reason is not null")
    empty = headers.where("empty").select("path", F.lit("empty file").alias("reason"))
    undated = headers.where(~F.array_contains("header", "Date") & ~F.col("empty")).select("path", F.lit("no Date column").alias("reason"))
    goals = headers.where("not empty and not (arrays_overlap(header, array('FTHG', 'HG')) and arrays_overlap(header, array('FTAG', 'AG')))").select("path", F.lit("no goal columns").alias("reason"))
    teams = headers.where("not empty and not (arrays_overlap(header, array('HomeTeam', 'HT')) and arrays_overlap(header, array('AwayTeam', 'AT')))").select("path", F.lit("no team columns").alias("reason"))
    return reduce(DataFrame.unionByName, [repeated, found, empty, undated, goals, teams], unknown)


def _cell(*names: str) -> Column:
    """The field of the first of these columns that the file has; '' where it has none."""
    first = F.coalesce(*[F.nullif(F.array_position("header", n), F.lit(0)) for n in names])
    return clean_text(F.get("fields", (first - 1).cast("int")))


#: What a record tells, and the columns that may tell it, of which the first counts.
NAMES = {"div": ("Div",), "date": ("Date",), "time": ("Time",), "home": ("HomeTeam", "HT"), "away": ("AwayTeam", "AT"), "hg": ("FTHG", "HG"), "ag": ("FTAG", "AG")}


def places(headers: DataFrame) -> DataFrame:
    """(path, width, blank, at_...): where a file's records hold what NAMES lists, from 0, null where it has no such column, and the
    places without a name. Told once a file, not once a record."""
    first = lambda names: (F.coalesce(*[F.nullif(F.array_position("header", n), F.lit(0)) for n in names]) - 1).cast("int")
    blank = F.filter(F.transform("header", lambda x, i: F.when(x == "", i)), lambda i: i.isNotNull())
    return headers.select("path", F.size("header").alias("width"), blank.alias("blank"), *[first(names).alias(f"at_{k}") for k, names in NAMES.items()])


def _field(of: str) -> Column:
    """The field of a record that tells this, see NAMES; '' where its file has none."""
    return clean_text(F.get("fields", F.col(f"at_{of}")))


def told_leagues(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, league, reason): the one league that a file's own Div column names; where it names none or several, why there is none."""
    named = rows.join(places(headers), "path").select("path", _field("div").alias("div")).where("div <> ''")
    divs = headers.select("path").join(named.groupBy("path").agg(F.sort_array(F.collect_set("div")).alias("divs")), "path", "left")
    own, several = F.coalesce("divs", F.array().cast("array<string>")), F.concat(F.lit("expected one Div, got ["), F.array_join("divs", ", "), F.lit("]"))
    reason = F.when(F.size(own) == 0, "no Div to tell the league").when(F.size(own) > 1, several)
    return divs.select("path", F.when(F.size(own) == 1, F.get(own, F.lit(0))).alias("league"), reason.alias("reason"))


def load_seasons(spark: SparkSession, root: str, leagues: list[str] | None = None, partitioned: bool = False, league_from_div: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, odds, unreadable). Matches need a kickoff, both names and both goals from 0; prices must exceed 1.

    league_from_div: files bear any name, and their Div column tells the league; a filter by leagues then acts on that.
    """
    known = registry(spark)
    files = season_files(spark, root, None if league_from_div else leagues, partitioned)
    headers, rows = parsed_rows(files)
    untold = None
    if league_from_div:
        told = told_leagues(headers, rows)
        own = told.where(F.col("league").isin(*leagues)) if leagues else told.where("league is not null")
        headers, rows = (d.drop("league").join(own.select("path", "league"), "path") for d in (headers, rows))
        untold = told.where("reason is not null").select("path", "reason")
    problems = header_problems(headers, rows, known)
    if untold is not None:
        problems = problems.unionByName(untold)
    problems = written(problems, "problems")
    own = places(headers).join(price_columns(headers, known), "path", "left").join(problems.select("path").distinct(), "path", "left_anti")
    good = rows.join(written(own, "usable"), "path")
    number = lambda c: c.try_cast("double")
    whole = F.struct(
        parse_kickoff(_field("date"), _field("time")).alias("kickoff"), _field("home").alias("home"), _field("away").alias("away"),
        number(_field("hg")).alias("home_goals"), number(_field("ag")).alias("away_goals"),
    )
    # a match or price is made once, and judged as it stands; a condition on a column would make the column again
    kept = F.filter(F.array(whole), lambda m: m["kickoff"].isNotNull() & (m["home"] != "") & (m["away"] != "") & (m["home_goals"] >= 0) & (m["away_goals"] >= 0))
    tidy = good.select("league", "season", "priced", "fields", F.inline(kept))
    matches = tidy.select("league", "season", "kickoff", "home", "away", F.col("home_goals").cast("long").alias("home_goals"), F.col("away_goals").cast("long").alias("away_goals"))
    decimal = lambda z: clean_text(F.get("fields", z["at"])).try_cast("double")
    prices = F.transform("priced", lambda z: F.struct(*[z[c].alias(c) for c in ("book", "market", "period", "outcome")], decimal(z).alias("decimal")))
    odds = tidy.select("league", "season", "kickoff", "home", "away", F.inline(F.filter(prices, lambda z: _payable(z["decimal"]))))
    return matches, odds, problems


def price_columns(headers: DataFrame, known: DataFrame) -> DataFrame:
    """(path, priced): the price columns of each file that has some, told once a file and not for each of its fields."""
    names = headers.select("path", "header", F.posexplode("header").alias("at", "name")).where(~suppressed(F.col("header"), F.col("name")))
    names = names.join(F.broadcast(known.where("kind = 'odds'")), "name")
    return names.groupBy("path").agg(F.collect_list(F.struct("at", "book", "market", "period", "outcome")).alias("priced"))


def suppressed(header: Column, name: Column) -> Column:
    """Whether a short name gives way: all names of the full group that replaces it are in the header."""
    out = F.lit(False)
    for full, short in ALIAS_GROUPS:
        out = out | (name.isin(*short) & F.forall(F.array(*[F.lit(n) for n in full]), lambda n: F.array_contains(header, n)))
    return out


def price_rows(cells: DataFrame, known: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tidy odds from (match keys, header, name, value) rows, with the columns `keep`; the registry is joined by broadcast."""
    priced = known.where("kind = 'odds'").drop("kind")
    decimal = clean_text(F.col("value")).try_cast("double")
    out = cells.where(~suppressed(F.col("header"), F.col("name"))).join(F.broadcast(priced), "name").withColumn("decimal", decimal)
    return out.where(_payable(F.col("decimal"))).select("league", "season", "kickoff", "home", "away", "book", "market", "period", "outcome", "decimal", *keep)


def _payable(decimal: Column) -> Column:
    return (decimal > 1) & (decimal < float("inf")) & ~F.isnan(decimal)


def digests(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of a binaryFile relation. Executors hold a file in memory; one of over LARGE bytes is streamed by the driver's JVM."""
    small = files.where(F.col("length") <= LARGE).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > LARGE).select("path", "length").collect()
    if not large:
        return small
    spark = files.sparkSession
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in large:
        path = jvm.org.apache.hadoop.fs.Path(f["path"])
        stream = path.getFileSystem(conf).open(path)
        try:
            rows.append((f["path"], f["length"], jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return small.union(spark.createDataFrame(rows, "path string, bytes long, sha256 string"))


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 of every season file, read by Spark where the files lie."""
    return digests(spark.read.format("binaryFile").load(f"{root}/*/*.csv"))


def table_manifest(spark: SparkSession, root: str) -> DataFrame:
    """name (the path below root), bytes, sha256 of every Parquet file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString()
    return digests(files).select(F.expr(f"substring(path, {len(top) + 2})").alias("name"), "bytes", "sha256")


def write_manifest(spark: SparkSession, root: str, path: str) -> None:
    file_manifest(spark, root).coalesce(1).write.mode("overwrite").json(path)


def write_by_league(df: DataFrame, path: str) -> None:
    """A partition per league, each replaced as a whole: the restart point of a long run."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league").parquet(path)


def pending_leagues(leagues: DataFrame, done: DataFrame) -> DataFrame:
    return leagues.select("league").distinct().join(done.select("league").distinct(), "league", "left_anti")
