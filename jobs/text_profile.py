"""Profiles of a growing folder of texts: which lengths and kinds of text each language holds.

Every run takes only the files that are new since the last one (a file stream with a checkpoint, until nothing is
left), measures their texts, and adds the counts.  Its results are those of one run over all files at once:

- counts/batch=N: what a batch adds, by language, measure and bucket.  Sums are whole numbers, so they add up
  exactly in any order; a batch that is repeated after a failure replaces its own folder.
- profile/lang=L: of each measure n, mean, population sd, least and largest value, the last peak of its histogram
  (where a mask's threshold is set) and how many texts lie in buckets below it.
- histogram/lang=L: every bucket with its centre, count and the share of texts up to and with it.

A null language goes by the name "none", a null text has no measures but counts in texts.  A file is known by its
name: one that is changed in place is not read again.

    python -m jobs.text_profile --source DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import back, log, main, new_folder, put, settings
from latticeflow.operators import stats

SETTINGS = "text_profile.json"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = "lang string, measure string, bucket int, n bigint, total decimal(38,0), squares decimal(38,0), low bigint, high bigint, batch bigint"


def measures(text: str = "text") -> dict[str, Column]:
    """Whole numbers of a text: characters, words, lines, and ASCII letters in a thousand characters (empty: 0)."""
    t = F.col(text)
    chars = F.length(t)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return {
        "chars": chars,
        "words": F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))),
        "lines": F.length(F.regexp_replace(t, "[^\n]", "")) + 1,
        "letters_per_mille": F.when(chars > 0, F.floor(letters * 1000 / chars)).otherwise(0),
    }


def counts(docs: DataFrame, config: dict) -> DataFrame:
    """One row for each language, measure and bucket; the row of measure `texts` counts all texts, null ones too."""
    lang = F.coalesce(F.nullif(F.col("lang").cast("string"), F.lit("")), F.lit("none")).alias("lang")
    found = measures()
    one = [F.struct(F.lit(m).alias("measure"), found[m].cast("bigint").alias("x"), F.lit(w).alias("width")) for m, w in config["widths"].items()]
    every = F.struct(F.lit("texts").alias("measure"), F.lit(1).cast("bigint").alias("x"), F.lit(1).alias("width"))
    rows = docs.select(lang, F.explode(F.array(every, *one)).alias("e")).select("lang", "e.*").where("x is not null")
    bucket = F.least(F.lit(config["buckets"] - 1), F.floor(F.col("x") / F.col("width"))).cast("int")
    x = F.col("x").cast("decimal(19,0)")
    return rows.groupBy("lang", "measure", bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(x).cast("decimal(38,0)").alias("total"), F.sum((x * x).cast("decimal(38,0)")).cast("decimal(38,0)").alias("squares"), F.min("x").alias("low"), F.max("x").alias("high"),
    )


def merged(spark: SparkSession, parts: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(profile, histogram) of the counts of all batches."""
    widths = F.create_map(*[F.lit(x) for m, w in {**config["widths"], "texts": 1}.items() for x in (m, w)])
    sums = parts.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("squares").cast("decimal(38,0)").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = sums.groupBy("lang", "measure").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.sum("squares").cast("double").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
    every = whole.where("measure != 'texts'").select("lang", "measure", F.col("n").alias("all"), F.explode(F.sequence(F.lit(0), F.lit(config["buckets"] - 1))).alias("bucket"))
    hist = every.join(sums.select("lang", "measure", "bucket", F.col("n").alias("freq")), ["lang", "measure", "bucket"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    hist = hist.withColumn("centre", (F.col("bucket") + 0.5) * widths[F.col("measure")])
    below = Window.partitionBy("lang", "measure").orderBy("bucket")
    hist = hist.withColumn("upto", F.sum("freq").over(below))
    peaks = stats.histogram_last_peak(hist, config["peak_window"], ["lang", "measure"])
    under = hist.join(peaks.select("lang", "measure", "peak", F.col("bucket").alias("at")), ["lang", "measure"]).where("bucket < at or bucket = 0")
    under = under.groupBy("lang", "measure").agg(F.first("peak").alias("peak"), F.sum(F.when(F.col("bucket") < F.col("at"), F.col("freq")).otherwise(0)).alias("under"))
    mean = F.col("total") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
    profile = whole.join(under, ["lang", "measure"], "left").select("measure", "n", F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), "low", "high", "peak", "under", "lang")
    return profile, hist.select("measure", "bucket", "centre", "freq", F.round(F.col("upto") / F.col("all"), 6).alias("share"), "lang")


def take_new(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> None:
    """Measure the files that are new, as batches of counts."""
    schema = spark.read.parquet(source).select("lang", "text").schema

    def add(batch: DataFrame, number: int) -> None:
        put(counts(batch, config).withColumn("batch", F.lit(number).cast("bigint")), f"{output}/counts", "batch")
        rows = batch.sparkSession.read.schema(COUNTS).parquet(f"{output}/counts").where((F.col("batch") == number) & (F.col("measure") == "texts")).agg(F.sum("n")).first()[0]
        log.info("batch %d: %s texts read, counts written to %s/counts", number, rows, output)

    folder, name = source.rstrip("/").rsplit("/", 1)
    named = f"{folder}/{{{name}}}"  # as a pattern it may be a single file too, which a stream doesn't take by its plain name
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(named)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> None:
    """Add the new files under source to the profiles under output."""
    config = config or settings(SETTINGS)
    take_new(spark, source, output, checkpoint, config)
    try:
        parts = spark.read.schema(COUNTS).parquet(f"{output}/counts")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.info("no file under %s yet", source)
        return
    for name, table in zip(("profile", "histogram"), merged(spark, parts, config), strict=True):
        put(table, f"{output}/{name}", "lang")
        log.info("%d rows written to %s/%s", back(spark, f"{output}/{name}", table).count(), output, name)


def output_of(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    """Both results as one table: rows of the profile have no bucket."""
    profile, hist = merged(spark, spark.read.schema(COUNTS).parquet(f"{output}/counts"), config or settings(SETTINGS))
    return back(spark, f"{output}/profile", profile).unionByName(back(spark, f"{output}/histogram", hist), allowMissingColumns=True)


def job1_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "text_profile")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return output_of(spark, f"{at}/out")


SQL = r"""
WITH d AS (SELECT coalesce(nullif(lang, ''), 'none') AS lang, text AS t FROM documents),
m AS (
  SELECT lang, 'texts' AS measure, 1 AS width, 1::BIGINT AS x FROM d
  UNION ALL SELECT lang, 'chars', 250, length(t) FROM d
  UNION ALL SELECT lang, 'words', 50, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) FROM d
  UNION ALL SELECT lang, 'lines', 2, length(t) - length(replace(t, chr(10), '')) + 1 FROM d
  UNION ALL SELECT lang, 'letters_per_mille', 25, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) * 1000 // length(t) ELSE 0 END FROM d WHERE t IS NOT NULL),
b AS (SELECT lang, measure, width, least(39, x // width) AS bucket, x FROM m WHERE x IS NOT NULL),
w AS (SELECT lang, measure, any_value(width) AS width, count(*) AS n, sum(x)::DOUBLE AS total, sum(x * x)::DOUBLE AS squares, min(x) AS low, max(x) AS high FROM b GROUP BY lang, measure),
f AS (SELECT lang, measure, bucket, count(*) AS freq FROM b GROUP BY ALL),
h AS (SELECT w.lang, w.measure, k AS bucket, (k + 0.5) * w.width AS centre, coalesce(f.freq, 0) AS freq, w.n AS n FROM w CROSS JOIN range(40) r(k) LEFT JOIN f ON f.lang = w.lang AND f.measure = w.measure AND f.bucket = k WHERE w.measure != 'texts'),
p AS (SELECT *, max(freq) OVER (PARTITION BY lang, measure ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, sum(freq) OVER (PARTITION BY lang, measure ORDER BY bucket) AS upto FROM h),
q AS (SELECT lang, measure, max(bucket) AS spot FROM p WHERE freq = top AND freq > 0 GROUP BY lang, measure),
u AS (SELECT lang, measure, max(centre) FILTER (WHERE bucket = spot) AS peak, coalesce(sum(freq) FILTER (WHERE bucket < spot), 0) AS under FROM p JOIN q USING (lang, measure) GROUP BY lang, measure)
SELECT measure, n::BIGINT AS n, round(total / n, 6) AS mean, round(sqrt(greatest(0, squares / n - (total / n) * (total / n))), 6) AS sd, low::BIGINT AS low, high::BIGINT AS high, peak::DOUBLE AS peak, under::BIGINT AS under, lang, NULL::INT AS bucket, NULL::DOUBLE AS centre, NULL::BIGINT AS freq, NULL::DOUBLE AS share
FROM w LEFT JOIN u USING (lang, measure)
UNION ALL SELECT measure, NULL, NULL, NULL, NULL, NULL, NULL, NULL, lang, bucket::INT, centre::DOUBLE, freq::BIGINT, round(upto / n, 6) FROM p
"""

if __name__ == "__main__":
    main(run, SETTINGS, ["source", "output", "checkpoint"])
