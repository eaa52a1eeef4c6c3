"""Parsing schedules written as text: rounds, dates and fixtures in lines that build on earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The format's fixed marks.
ROUND_MARK = "▪"
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _side(text: Column) -> Column:
    """name, country and rest of ``Name (ABC) rest``; the country is what the last bracket before the rest holds."""
    opened = F.instr(text, "(")
    name, inside = F.trim(F.left(text, opened - 1)), F.substr(text, opened + 1, F.lit(3))
    closed = F.substr(text, opened + 4, F.lit(1)) == ")"
    ok = (opened > 1) & (name != "") & closed & (F.char_length(inside) == 3) & (F.translate(inside, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") == "")
    return F.struct(ok.alias("ok"), name.alias("name"), inside.alias("country"), F.substr(text, opened + 5, F.char_length(text)).alias("rest"))


def fields(line: Column) -> Column:
    """What a trimmed line says: round, or weekday's date (month, day, year), or the two sides of a fixture."""
    words = F.split(line, r"\s+")
    number = lambda i: F.get(words, F.lit(i)).try_cast("int")
    dated = F.size(words).isin(3, 4) & F.get(words, F.lit(0)).isin(*DAYS) & F.get(words, F.lit(1)).isin(*MONTHS) & number(2).between(1, 31) & ((F.size(words) == 3) | number(3).between(1000, 9999))
    clock = F.get(words, F.lit(0))
    timed = (F.size(F.split(clock, ":")) == 2) & F.get(F.split(clock, ":"), F.lit(0)).try_cast("int").isNotNull() & F.get(F.split(clock, ":"), F.lit(1)).try_cast("int").isNotNull()
    teams = F.split(F.when(F.coalesce(timed, F.lit(False)), F.trim(F.substr(line, F.char_length(clock) + 1, F.char_length(line)))).otherwise(line), r"\s+v\s+", 2)
    home, away = _side(F.get(teams, F.lit(0))), _side(F.get(teams, F.lit(1)))
    meets = (F.size(teams) == 2) & home["ok"] & away["ok"] & (home["rest"] == "") & ((away["rest"] == "") | away["rest"].startswith("  "))
    is_round = line.startswith(ROUND_MARK)
    return F.struct(
        F.when(is_round, F.trim(F.substr(line, F.lit(2), F.char_length(line)))).alias("round"),
        F.when(~is_round & dated, F.struct(F.array_position(F.array(*map(F.lit, MONTHS)), F.get(words, F.lit(1))).cast("int").alias("month"), number(2).alias("day"), number(3).alias("year"))).alias("date"),
        F.when(~is_round & ~F.coalesce(dated, F.lit(False)) & F.coalesce(meets, F.lit(False)), F.struct(home.alias("home"), away.alias("away"))).alias("fixture"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 1) and line of text files; a file is one record, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("n", "line")).withColumn("n", F.col("n") + 1)


def parse(lines: DataFrame) -> DataFrame:
    """file, n, match_date, round, home_team, home_country, away_team, away_country of each fixture line.

    A round and a date hold until the next ones. A date without year has the year of the one
    before, or the next if its month is earlier. A fixture before any date or round, and a date
    without year before any with one, raise when they are read. Other lines are ignored.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.select("file", "n", text.alias("t")).where("t <> ''").select("file", "n", fields(F.col("t")).alias("f")).select("file", "n", "f.*")
    order = Window.partitionBy("file").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "file", "n", "fixture", F.last("round", ignorenulls=True).over(upto).alias("round"), F.col("date").isNotNull().alias("_date"),
        F.col("date.month").alias("_month"), F.col("date.day").alias("_day"), F.col("date.year").alias("_year"),
    )
    before = F.last("_month", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_roll", (F.col("_date") & F.col("_year").isNull() & (F.col("_month") < before)).cast("int"))
    rows = rows.withColumn("_part", F.count("_year").over(upto))
    within = Window.partitionBy("file", "_part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    year = F.first("_year", ignorenulls=True).over(within) + F.sum(F.coalesce("_roll", F.lit(0))).over(within)
    where = F.concat(F.col("file"), F.lit(":"), F.col("n").cast("string"), F.lit(": "))
    rows = rows.withColumn("_y", year)
    made = F.when(F.col("_date"), F.coalesce(F.make_date("_y", "_month", "_day"), F.raise_error(F.concat(where, F.lit("the year of this day is not known yet"))).cast("date")))
    rows = rows.withColumn("match_date", F.last(made, ignorenulls=True).over(upto))
    known = lambda c, type_: F.coalesce(F.col(c), F.raise_error(F.concat(where, F.lit(f"a match without a {'day' if type_ == 'date' else 'round'} above it"))).cast(type_))
    side = lambda s: [F.col(f"fixture.{s}.name").alias(f"{s}_team"), F.col(f"fixture.{s}.country").alias(f"{s}_country")]
    return rows.where(F.col("fixture").isNotNull()).select("file", "n", known("match_date", "date").alias("match_date"), known("round", "string").alias("round"), *side("home"), *side("away"))
