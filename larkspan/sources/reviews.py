"""Review sources. All give the same columns, so every operator is agnostic of where reviews come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import period as P
from ..functions import text as X

# The columns of a review file.
RAW_COLUMNS = ["Hotel_Address", "Additional_Number_of_Scoring", "Review_Date", "Average_Score", "Hotel_Name", "Reviewer_Nationality", "Negative_Review", "Review_Total_Negative_Word_Counts", "Total_Number_of_Reviews", "Positive_Review", "Review_Total_Positive_Word_Counts", "Total_Number_of_Reviews_Reviewer_Has_Given", "Reviewer_Score", "Tags", "days_since_review", "lat", "lng"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
#: No derived table may carry the texts.
TEXT_COLUMNS = {"Positive_Review", "Negative_Review", "review_text", "raw_review_text", "Review_Text", "text", "review"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Quoted fields may hold line breaks and doubled quotes; bad bytes become replacement characters."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=True, mode="PERMISSIVE")


def variant(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that a file has and that is not null."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def reviews(raw: DataFrame) -> DataFrame:
    """One row a review: ids, place, day, period, score, fold, and both texts."""
    address = variant(raw, "Hotel_Address", "hotel_address")
    positive, negative = variant(raw, "Positive_Review", "positive"), variant(raw, "Negative_Review", "negative")
    day_text, score_text, nation = variant(raw, "Review_Date", "review_date"), variant(raw, "Reviewer_Score", "reviewer_score"), variant(raw, "Reviewer_Nationality", "reviewer_nationality")
    city, country = X.parse_city_country(address)
    day = P.parse_date(day_text)
    return raw.select(
        X.unit_id(address).alias("unit"), F.coalesce(variant(raw, "Hotel_Name", "hotel_name"), F.lit("")).alias("unit_name"), city.alias("city"), country.alias("country"),
        variant(raw, "lat").try_cast("double").alias("lat"), variant(raw, "lng", "lon").try_cast("double").alias("lon"), day.alias("day"), P.quarter_label(day).alias("period"),
        score_text.try_cast("double").alias("score"), X.fold_of(X.review_fingerprint(address, day_text, score_text, nation, positive, negative)).alias("fold"), positive.alias("positive"), negative.alias("negative"),
    )


def rows(found: DataFrame) -> DataFrame:
    """A row for each review with a day, whatever its texts name: what counts and scores of reviews are taken from."""
    return found.where(F.col("period").isNotNull()).select("unit", "unit_name", "city", "period", P.quarter_ordinal(F.col("period")).alias("ord"), "score", "fold", F.col("day").alias("d"))


def fold_outcomes(raw: DataFrame) -> DataFrame:
    """Review counts and score sums of each unit, period and fold, in one pass over the columns of score and fingerprint."""
    found = reviews(raw).where("period IS NOT NULL AND score IS NOT NULL")
    return found.groupBy("unit", "period", "fold").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"))


def stream_counters(found: DataFrame) -> DataFrame:
    """Rows, days read and not, scores not read, sections that say nothing by side, and sections that name no aspect."""
    n = lambda c: F.count(F.when(c, 1))
    pos_empty, neg_empty = X.is_placeholder(F.col("positive"), X.POSITIVE_PLACEHOLDERS), X.is_placeholder(F.col("negative"), X.NEGATIVE_PLACEHOLDERS)
    each = found.select("day", "score", "fold", "lat", "lon", pos_empty.alias("pe"), neg_empty.alias("ne"), F.size(X.gate_aspects(F.col("positive"))).alias("pa"), F.size(X.gate_aspects(F.col("negative"))).alias("na"))
    return each.agg(
        F.count("*").alias("n"), n(F.col("day").isNotNull()).alias("days"), n(F.col("day").isNull()).alias("no_day"), n(F.col("score").isNull()).alias("no_score"), n(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("placed"),
        n(F.col("pe")).alias("positive_placeholders"), n(F.col("ne")).alias("negative_placeholders"), n(~F.col("pe") & (F.col("pa") == 0)).alias("positive_unnamed"), n(~F.col("ne") & (F.col("na") == 0)).alias("negative_unnamed"),
        F.sum(F.when(~F.col("pe"), F.col("pa")).otherwise(0)).alias("positive_mentions"), F.sum(F.when(~F.col("ne"), F.col("na")).otherwise(0)).alias("negative_mentions"), n(F.col("fold") == "A").alias("fold_a"))


def mentions(found: DataFrame) -> DataFrame:
    """A row for each aspect that a section names: unit, city, period, ord, aspect, neg, score, fold, day."""
    sections = found.select("*", F.explode(F.array(F.struct(F.lit(False).alias("neg"), F.col("positive").alias("t")), F.struct(F.lit(True).alias("neg"), F.col("negative").alias("t")))).alias("section"))
    said = ~F.when(F.col("section.neg"), X.is_placeholder(F.col("section.t"), X.NEGATIVE_PLACEHOLDERS)).otherwise(X.is_placeholder(F.col("section.t"), X.POSITIVE_PLACEHOLDERS))
    # An outer explode: of an inner one Spark infers a filter that names the aspects once more.
    named = sections.where(F.col("period").isNotNull() & said).withColumn("aspect", F.explode_outer(X.gate_aspects(F.col("section.t")))).where("aspect IS NOT NULL")
    return named.select("unit", "unit_name", "city", "period", P.quarter_ordinal(F.col("period")).alias("ord"), "aspect", F.col("section.neg").alias("neg"), "score", "fold", F.col("day").alias("d"))


def read_aspect_json(spark: SparkSession, path: str) -> DataFrame:
    """Mention counts by sentiment from JSON lines with a nested map of aspects."""
    schema = "review_id string, hotel_url string, aspects map<string, struct<sentiment: string>>"
    long = spark.read.schema(schema).json(path).select(X.clean_url(F.col("hotel_url")).alias("url"), F.explode("aspects").alias("aspect", "a"))
    one = lambda s: F.count(F.when(F.lower("a.sentiment") == s, 1)).alias(s)
    return long.groupBy("url", "aspect").agg(one("positive"), one("negative"), one("neutral"), F.count("*").alias("mentions"))


def fixture(spark: SparkSession) -> DataFrame:
    """A small review table: 6 cities of 4 units, 10 days, a review for each aspect: 1,680 rows in the raw schema."""
    cities = F.array(*[F.lit(c) for c in X.CITIES])
    aspects = F.array(*[F.lit(a) for a in X.ASPECTS])
    words = F.array(*[F.lit(w[0]) for w in X.ASPECT_KEYWORDS.values()])
    n = spark.range(6 * 4 * 10 * 7).select((F.col("id") % 7).cast("int").alias("a"), (F.floor(F.col("id") / 7) % 10).cast("int").alias("d"), (F.floor(F.col("id") / 70) % 4).cast("int").alias("h"), F.floor(F.col("id") / 280).cast("int").alias("c"))
    city, word = F.get(cities, F.col("c")), F.get(words, F.col("a"))
    good, bad = (F.col("h") + F.col("d")) % 3 != 0, (F.col("h") + F.col("d")) % 4 == 0
    day = F.date_add(F.lit("2016-02-10").cast("date"), F.col("d") * 30)
    made = {
        "Hotel_Address": F.concat(F.col("h").cast("string"), F.lit(" Main Street "), city, F.lit(" Netherlands")), "Hotel_Name": F.concat(F.lit("House "), city, F.lit(" "), F.col("h").cast("string")),
        "Review_Date": F.date_format(day, "M/d/yyyy"), "Reviewer_Score": F.when(good, "8.5").otherwise("6.2"), "Reviewer_Nationality": F.get(aspects, F.col("a")),
        "Positive_Review": F.when(good, F.concat(F.lit("The "), word, F.lit(" was very good"))).otherwise("No Positive"), "Negative_Review": F.when(bad, F.concat(F.lit("Poor "), word)).otherwise("No Negative"),
        "lat": (F.lit(45.0) + F.col("c") + F.col("h") / 100).cast("string"), "lng": (F.lit(4.0) + F.col("c") + F.col("h") / 50).cast("string"),
    }
    return n.select(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS])


#: Country of each city, and words of the made-up texts: three of each aspect's.
_COUNTRY = ["United Kingdom", "France", "Netherlands", "Spain", "Austria", "Italy"]
SAID = [w for words in X.ASPECT_KEYWORDS.values() for w in words[:3]]
SILENT = ["No Negative", " nothing. ", "N/A", "All Good"]


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review file's columns made from lineitem, a review a row: texts with one to four aspects, placeholders and fillers."""
    # A small file is one task's; the texts made of it are many times its size.
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    line = line.repartition(spark.sparkContext.defaultParallelism)
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(n, F.lit(len(xs))).cast("int"))
    c = F.col
    more = F.repeat(F.lit(" We came back from a long day of business and had a pleasant evening."), F.col("l_linenumber"))
    positive = F.when(c("l_partkey") % 5 == 0, "No Positive").otherwise(F.concat(F.lit("The "), pick(SAID, c("l_partkey")), F.lit(" was good, the "), pick(SAID, c("l_orderkey")), F.lit(" fine."), more))
    negative = F.when(c("l_returnflag") == "R", F.concat(F.lit("Poor "), pick(SAID, c("l_partkey") + c("l_linenumber")), F.lit("; order "), c("l_orderkey").cast("string"), F.lit("."), more)).otherwise(pick(SILENT, c("l_orderkey")))
    made = {
        "Hotel_Address": F.concat(c("l_suppkey").cast("string"), F.lit(" Main Street "), pick(X.CITIES, c("l_suppkey")), F.lit(" "), pick(_COUNTRY, c("l_suppkey"))), "Hotel_Name": F.concat(F.lit("House "), c("l_suppkey").cast("string")),
        "Review_Date": F.date_format("l_shipdate", "M/d/yyyy"), "Reviewer_Score": F.concat((c("l_quantity").cast("int") % 10 + 1).cast("string"), F.lit(".5")), "Reviewer_Nationality": c("l_linestatus"),
        "Positive_Review": positive, "Negative_Review": negative, "lat": F.when(c("l_suppkey") % 9 != 0, (c("l_suppkey") % 50).cast("string")), "lng": (c("l_suppkey") % 20).cast("string"),
    }
    return line.select(*[made.get(n, F.lit(None).cast("string")).alias(n) for n in RAW_COLUMNS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_star_schema(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    """Mentions from lineitem and its dimensions. A unit is a supplier by year or a nation by quarter, its city a
    region, the aspect a part's type; a returned item is a negative mention, the quantity its score.

    The dimensions are joined by their keys; Spark broadcasts those that are small by its own size check.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    dims = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(dims, F.col("l_suppkey") == F.col("s_suppkey"))
    mark = F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("d", "yyyy-MM-dd")).cast("binary"))
    if grain == "supplier":
        keys = [F.col("l_suppkey").alias("unit"), F.col("s_name").alias("unit_name"), F.col("r_name").alias("city"), F.year("d").cast("string").alias("period"), F.year("d").alias("ord")]
    else:
        keys = [F.col("n_nationkey").cast("bigint").alias("unit"), F.col("n_name").alias("unit_name"), F.col("r_name").alias("city"), P.quarter_label(F.col("d")).alias("period"), (F.year("d") * 4 + F.quarter("d")).alias("ord")]
    return both.select(*keys, F.col("p_type").alias("aspect"), (F.col("l_returnflag") == "R").alias("neg"), F.col("l_quantity").alias("score"), X.fold_of(mark).alias("fold"), "d")


def places(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    """Coordinates of units: unit, city, lat, lon; from the first two components of the vector with the unit's number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), (F.lit(45.0) + F.get("embedding", F.lit(0)).cast("double") * F.lit(5.0)).alias("lat"), (F.lit(10.0) + F.get("embedding", F.lit(1)).cast("double") * F.lit(5.0)).alias("lon"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if grain == "supplier":
        units = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("unit"), F.col("r_name").alias("city"))
    else:
        units = nation.select(F.col("n_nationkey").cast("bigint").alias("unit"), F.col("r_name").alias("city"))
    return units.join(vectors, "unit")
