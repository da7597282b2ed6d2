"""Cross-validated report of how well labelled vectors are told apart by the nearest class mean.

- assignments/label=L: every labelled vector with its fold (its id modulo the number of folds), the class that the
  means without its fold give it, the squared distance to that, and the class that the means of all rows give it.
- confusion/label=L: for each class predicted for rows of label L the count, mean and sample sd of the folds'
  counts, the sum of distances, and the count in sample.

Both are written anew for every label that is in the input, so a second run leaves the same files' content.  Rows
without label or vector take no part.

    python -m jobs.class_report --source TABLE --output DIR [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import back, log, main, new_folder, put, settings
from latticeflow.operators import folds, stats

SETTINGS = "class_report.json"
ASSIGNED = "vec_id bigint, fold int, predicted int, dist double, in_sample int, label int"
CONFUSION = "predicted int, n bigint, mean_n double, sd_n double, total_dist double, in_sample_n bigint, label int"


def assigned(vectors: DataFrame, config: dict) -> DataFrame:
    """vec_id, label, fold, predicted, dist, in_sample of every labelled vector."""
    n = config["folds"]
    rows = vectors.select(F.col(config["key"]).cast("bigint").alias("vec_id"), F.col(config["label"]).cast("int").alias("label"), F.col(config["vector"]).alias("v")).where("label is not null and v is not null")
    fold = F.pmod(F.col("vec_id"), F.lit(n)).cast("int")
    apart = folds.left_out_centroids(rows, "v", "label", fold, n)
    seen = stats.nearest_centroid(rows.withColumn("fold", fold), apart, "v", "label", ["vec_id", "label", "fold", "v"], by="fold")
    whole = stats.centroid_vectors(rows, "v", "label")
    seen = seen.withColumnsRenamed({"predicted": "apart", "dist": "far"})
    both = stats.nearest_centroid(seen, whole, "v", "label", ["vec_id", "label", "fold", "apart", "far"])
    return both.select("vec_id", "fold", F.col("apart").alias("predicted"), F.round("far", 6).alias("dist"), F.col("predicted").alias("in_sample"), "label")


def confusion(found: DataFrame, config: dict) -> DataFrame:
    """One row for each label and class that some of its rows are given, apart or in sample."""
    apart = folds.confusion_over_folds(found, "label", config["folds"])
    far = found.groupBy("label", "predicted").agg(F.sum("dist").alias("total_dist"))
    inside = found.groupBy("label", F.col("in_sample").alias("predicted")).agg(F.count("*").alias("in_sample_n"))
    all_of = apart.join(far, ["label", "predicted"]).join(inside, ["label", "predicted"], "full")
    zero = {"n": 0, "mean_n": 0.0, "sd_n": 0.0, "in_sample_n": 0}
    return all_of.fillna(zero).select("predicted", "n", F.round("mean_n", 6).alias("mean_n"), F.round("sd_n", 6).alias("sd_n"), F.round("total_dist", 6).alias("total_dist"), "in_sample_n", "label")


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> None:
    """Write the report on the table at source to output."""
    config = config or settings(SETTINGS)
    put(assigned(spark.read.parquet(source), config), f"{output}/assignments", "label")
    found = spark.read.schema(ASSIGNED).parquet(f"{output}/assignments")
    put(confusion(found, config), f"{output}/confusion", "label")
    error = folds.error_over_folds(found, "label").first()
    log.info("%d rows of %s written to %s; error over folds: mean %s, sd %s", found.count(), source, output, error["mean"], error["sd"])


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """Both results as one table: rows of the confusion have no vec_id."""
    return spark.read.schema(ASSIGNED).parquet(f"{output}/assignments").unionByName(spark.read.schema(CONFUSION).parquet(f"{output}/confusion"), allowMissingColumns=True)


def job2_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "class_report")
    for _ in range(2):
        run(spark, f"{sf_dir}/embeddings.parquet", at)
    return output_of(spark, at)


SQL = """
WITH r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, ((vec_id % 5) + 5) % 5 AS fold FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT label, fold, unnest(range(len(v))) AS pos, unnest(v) AS x FROM r),
s AS (SELECT label, fold, pos, sum(x) AS s, count(x) AS n FROM e GROUP BY ALL),
a AS (SELECT label, pos, sum(s) AS s, sum(n) AS n FROM s GROUP BY ALL),
f AS (SELECT DISTINCT k AS fold FROM range(5) t(k)),
l AS (SELECT f.fold, a.label, a.pos, (a.s - coalesce(s.s, 0)) / (a.n - coalesce(s.n, 0)) AS m FROM a CROSS JOIN f LEFT JOIN s ON s.label = a.label AND s.pos = a.pos AND s.fold = f.fold WHERE a.n > coalesce(s.n, 0)),
c AS (SELECT fold, label, list(m ORDER BY pos) AS c FROM l GROUP BY ALL),
w AS (SELECT label, list(s / n ORDER BY pos) AS c FROM a GROUP BY label),
x AS (SELECT vec_id, r.label, r.fold, arg_min(c.label, (list_distance(v, c.c), c.label)) AS predicted, round(min(list_distance(v, c.c)) ** 2, 6) AS dist FROM r JOIN c ON c.fold = r.fold GROUP BY ALL),
y AS (SELECT vec_id, r.label, arg_min(w.label, (list_distance(v, w.c), w.label)) AS in_sample FROM r CROSS JOIN w GROUP BY ALL),
z AS (SELECT vec_id, label, fold, predicted, dist, in_sample FROM x JOIN y USING (vec_id, label)),
k AS (SELECT label, predicted, fold, count(*) AS n FROM z GROUP BY ALL),
g AS (SELECT label, predicted, sum(n) AS n, round(sum(n) / 5, 6) AS mean_n, round(sqrt(greatest(0, (sum(n * n) - sum(n) * sum(n) / 5) / 4)), 6) AS sd_n FROM k GROUP BY ALL),
d AS (SELECT label, predicted, round(sum(dist), 6) AS total_dist FROM z GROUP BY ALL),
i AS (SELECT label, in_sample AS predicted, count(*) AS in_sample_n FROM z GROUP BY ALL)
SELECT vec_id, CAST(fold AS INT) AS fold, predicted, dist, in_sample, label, NULL::BIGINT AS n, NULL::DOUBLE AS mean_n, NULL::DOUBLE AS sd_n, NULL::DOUBLE AS total_dist, NULL::BIGINT AS in_sample_n FROM z
UNION ALL SELECT NULL, NULL, predicted, NULL, NULL, label, coalesce(n, 0)::BIGINT, coalesce(mean_n, 0), coalesce(sd_n, 0), total_dist, coalesce(in_sample_n, 0)::BIGINT FROM g FULL JOIN i USING (label, predicted) LEFT JOIN d USING (label, predicted)
"""

if __name__ == "__main__":
    main(run, SETTINGS, ["source", "output"])
