"""Registered queries over the driver tables, each with its SQL where SQL can express it.

The tables hold no voxels, so lattice operators run on a derived lattice: voxel p_partkey, 20 columns and
10 rows a slice, value p_retailprice.  Vectors are the embeddings; a query set is every row whose id is
divisible by 50, compared with all rows.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, strings
from ..functions import vectors as V
from ..operators import graph, krylov, metric_index, neighbours, stats, tiles

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def probes(df: DataFrame) -> DataFrame:
    return df.where("vec_id % 50 = 0")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.floor(p / 200).cast("int").alias("slice"), F.pmod(F.floor(p / 20), F.lit(10)).cast("int").alias("row"), F.pmod(p, F.lit(20)).cast("int").alias("col"), p.alias("id"), F.col("p_retailprice").cast("double").alias("v"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


LATTICE_SQL = "lat AS (SELECT CAST(p_partkey // 200 AS INT) AS slice, CAST((p_partkey // 20) % 10 AS INT) AS row_, CAST(p_partkey % 20 AS INT) AS col_, p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS v FROM part)"
OFFSETS_SQL = "o AS (SELECT a.x AS ds, b.x AS dr, c.x AS dc FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x), (VALUES (-1), (0), (1)) c(x))"
NEAR_SQL = f"WITH {LATTICE_SQL}, {OFFSETS_SQL}, near AS (SELECT t.slice, t.row_, t.col_, t.v, n.v AS nv FROM lat t, o JOIN lat n ON n.slice = t.slice + ds AND n.row_ = t.row_ + dr AND n.col_ = t.col_ + dc)"
VEC_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
LONG_SQL = f"e AS ({VEC_SQL}), x AS (SELECT vec_id, label, CAST(p - 1 AS INT) AS pos, v[p] AS x FROM (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS p FROM e))"
NORM = "sqrt(list_dot_product({0}, {0}))"
ABSCOS = "least(1.0, abs(list_dot_product({0}, {1})) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"


@query("SELECT count(*) AS n, round(min(l_extendedprice), 6) AS min_v, round(max(l_extendedprice), 6) AS max_v, round(avg(l_extendedprice), 6) AS mean_v, round(stddev_pop(l_extendedprice), 6) AS sd_v FROM lineitem")
def scalar_stats(spark, sf):
    return rounded(stats.scalar_stats(read(spark, sf, "lineitem"), "l_extendedprice"), "min_v", "max_v", "mean_v", "sd_v")


@query("SELECT count(*) AS n, round(min(l_extendedprice), 6) AS min_v, round(max(l_extendedprice), 6) AS max_v, round(avg(l_extendedprice), 6) AS mean_v, round(stddev_pop(l_extendedprice), 6) AS sd_v FROM lineitem WHERE l_returnflag = 'R'")
def masked_stats(spark, sf):
    return rounded(stats.scalar_stats(read(spark, sf, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R"), "min_v", "max_v", "mean_v", "sd_v")


@query("SELECT arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS arg_min, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS arg_max FROM orders")
def arg_extremes(spark, sf):
    return stats.arg_extremes(read(spark, sf, "orders"), "o_totalprice", "o_orderkey")


@query("SELECT l_returnflag, round(CAST(median AS DOUBLE), 6) AS median FROM (SELECT l_returnflag, l_extendedprice AS median, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE r = n // 2 + 1")
def upper_median(spark, sf):
    return rounded(stats.upper_median(read(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double")), "l_extendedprice", ["l_returnflag"]), "median")


@query(f"WITH {LONG_SQL} SELECT pos, round(min(x), 6) AS min_v, round(max(x), 6) AS max_v FROM x GROUP BY pos")
def column_bounds(spark, sf):
    return rounded(stats.column_bounds(embeddings(spark, sf), "embedding"), "min_v", "max_v")


HIST_SQL = "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE isfinite(value)), c AS (SELECT CAST(least(99, greatest(0, floor(100 * (value - lo) / (hi - lo)))) AS INT) AS bucket, count(*) AS freq FROM events, b WHERE isfinite(value) GROUP BY 1), h AS (SELECT CAST(r AS INT) AS bucket, lo + (r + 0.5) * (hi - lo) / 100 AS centre, coalesce(freq, 0) AS freq FROM range(100) t(r) CROSS JOIN b LEFT JOIN c ON c.bucket = r)"


@query(HIST_SQL + " SELECT bucket, round(centre, 6) AS centre, freq FROM h")
def histogram_100(spark, sf):
    return rounded(stats.histogram(read(spark, sf, "events"), "value", 100), "centre")


@query(HIST_SQL + ", w AS (SELECT *, max(freq) OVER (ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top FROM h) SELECT round(arg_max(centre, bucket), 6) AS peak, max(bucket) AS bucket FROM w WHERE freq = top AND freq > 0")
def histogram_last_peak(spark, sf):
    return rounded(stats.histogram_last_peak(stats.histogram(read(spark, sf, "events"), "value", 100), 5), "peak")


@query(HIST_SQL + ", w AS (SELECT *, max(freq) OVER (ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top, min(freq) OVER (ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS low FROM h), p AS (SELECT min(bucket) AS fp FROM w WHERE freq = top AND freq > 0) SELECT round(arg_min(centre, bucket), 6) AS valley, min(bucket) AS bucket FROM w, p WHERE bucket > fp AND freq = low")
def histogram_first_min(spark, sf):
    """Beyond the reference, as its SQL has it; histogram_first_valley follows the reference."""
    return rounded(stats.histogram_local_min(stats.histogram(read(spark, sf, "events"), "value", 100), 100), "valley")


@query(f"WITH {LONG_SQL} SELECT label, pos, round(avg(x), 6) AS mean, count(*) AS n FROM x GROUP BY label, pos")
def label_centroids(spark, sf):
    return rounded(stats.centroids(embeddings(spark, sf), "embedding", "label"), "mean")


CENTROID_SQL = f"WITH {LONG_SQL}, c AS (SELECT label AS cl, list(m ORDER BY pos) AS cv FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos) GROUP BY label), d AS (SELECT vec_id, label, cl, list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM e, c), best AS (SELECT vec_id, label, arg_min(cl, struct_pack(d := dist, c := cl)) AS predicted, min(dist) AS dist FROM d GROUP BY vec_id, label)"


@query(CENTROID_SQL + " SELECT vec_id, label, predicted, round(dist, 6) AS dist FROM best")
def nearest_centroid(spark, sf):
    e = embeddings(spark, sf)
    return rounded(stats.nearest_centroid(e, stats.centroid_vectors(e, "embedding", "label"), "embedding", "label", ["vec_id", "label"]), "dist")


@query(CENTROID_SQL + " SELECT label, predicted, count(*) AS n FROM best GROUP BY label, predicted")
def confusion_matrix(spark, sf):
    e = embeddings(spark, sf)
    near = stats.nearest_centroid(e, stats.centroid_vectors(e, "embedding", "label"), "embedding", "label", ["vec_id", "label"])
    return stats.confusion(near, "label", "predicted")


@query(f"WITH e AS ({VEC_SQL}) SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE a.vec_id % 50 = 0")
def pair_sqdist(spark, sf):
    e = embeddings(spark, sf)
    return rounded(neighbours.pair_sqr_distances(probes(e), e, "vec_id", "embedding"), "d")


KNN_SQL = f"WITH e AS ({VEC_SQL}), a AS (SELECT p.vec_id, b.vec_id AS neighbour, round(acos({ABSCOS.format('p.v', 'b.v')}), 9) AS angle FROM e p JOIN e b ON p.vec_id != b.vec_id WHERE p.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY angle, neighbour) - 1 AS rank FROM a)"


@query(KNN_SQL + " SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, round(angle, 6) AS angle FROM k WHERE rank < 5")
def knn_axial(spark, sf):
    e = embeddings(spark, sf)
    return rounded(neighbours.nearest_axes(probes(e), e, "vec_id", "embedding", 5), "angle")


@query(f"WITH e AS ({VEC_SQL}) SELECT p.vec_id, b.vec_id AS neighbour, round(acos({ABSCOS.format('p.v', 'b.v')}), 6) AS angle FROM e p JOIN e b ON p.vec_id != b.vec_id WHERE p.vec_id % 50 = 0 AND acos({ABSCOS.format('p.v', 'b.v')}) <= 1.3")
def angle_range_join(spark, sf):
    e = embeddings(spark, sf)
    return rounded(neighbours.axes_within(probes(e), e, "vec_id", "embedding", 1.3), "angle")


@query(f"WITH e AS ({VEC_SQL}), a AS (SELECT p.vec_id, b.vec_id AS neighbour, round(acos({ABSCOS.format('p.v', 'b.v')}), 9) AS angle FROM e p, e b WHERE p.vec_id % 50 = 0), k AS (SELECT *, cos(angle) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY angle, neighbour) AS r FROM a) SELECT vec_id, neighbour, round(c / sum(c) OVER (PARTITION BY vec_id), 6) AS weight FROM (SELECT * FROM k WHERE r <= 4)")
def codify_directions(spark, sf):
    e = embeddings(spark, sf)
    return rounded(neighbours.codify(probes(e), e, "vec_id", "embedding", 4), "weight")


MOMENT_SQL = f"WITH {LONG_SQL}, n AS (SELECT count(*) AS n FROM e) SELECT a.pos AS i, b.pos AS j, round(sum(a.x * b.x) / (any_value(n) - 1), 6) AS s FROM x a JOIN x b ON a.vec_id = b.vec_id, n GROUP BY a.pos, b.pos"


@query(MOMENT_SQL)
def raw_second_moment(spark, sf):
    return rounded(stats.raw_second_moment(embeddings(spark, sf), "embedding"), "s")


@query(MOMENT_SQL)
def raw_second_moment_whole(spark, sf):
    """The same; the name is from when the other gave the first places only."""
    return raw_second_moment(spark, sf)


COVARIANCE_SQL = f"WITH {LONG_SQL} SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.x, b.x), 6) AS s FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos"


@query(COVARIANCE_SQL)
def centred_covariance(spark, sf):
    # A value that rounds to 0 keeps its sign, as the SQL's does.
    return stats.centred_covariance(embeddings(spark, sf), "embedding").withColumn("s", F.round(F.abs("s"), 6) * F.signum("s"))


@query(COVARIANCE_SQL)
def centred_covariance_whole(spark, sf):
    """The same; the name is from when the other gave the first places only."""
    return centred_covariance(spark, sf)


SCORES_SQL = f"WITH e AS ({VEC_SQL}), g AS (SELECT min(vec_id) AS vec_id FROM e GROUP BY label), s AS (SELECT round(list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS dist, CAST(p.label = q.label AS INT) AS same FROM e p, e q WHERE p.vec_id NOT IN (SELECT vec_id FROM g) AND q.vec_id IN (SELECT vec_id FROM g)), a AS (SELECT dist AS score, sum(1 - same) AS f, sum(same) AS t FROM s GROUP BY dist), r AS (SELECT score, sum(f) OVER (ORDER BY score) / (sum(f) OVER () + sum(t) OVER ()) AS far, sum(t) OVER (ORDER BY score) / sum(t) OVER () AS vr FROM a)"


def scores(spark, sf) -> DataFrame:
    return rounded(stats.verification_scores(embeddings(spark, sf), "vec_id", "embedding", "label"), "dist")


@query(SCORES_SQL + " SELECT score, round(far, 6) AS far, round(vr, 6) AS vr FROM r")
def roc_curve(spark, sf):
    return rounded(stats.roc_curve(scores(spark, sf)), "far", "vr")


@query(SCORES_SQL + " SELECT min(score) AS threshold, round(coalesce(arg_min(vr, score), 1.0), 6) AS rate FROM r WHERE far >= 0.01")
def verification_rate(spark, sf):
    return rounded(stats.verification_rate(scores(spark, sf), 0.01), "rate")


@query("SELECT count(*) FILTER (value <= 50) - 1 AS idx FROM events")
def greatest_at_most(spark, sf):
    return stats.greatest_at_most(read(spark, sf, "events"), "value", 50)


@query(f"WITH {LONG_SQL}, r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) - 1 AS rank, pos, x FROM x WHERE x > 0) SELECT vec_id, CAST(rank AS INT) AS rank, pos AS idx, round(x, 6) AS value FROM r WHERE rank < 3")
def topk_coefficients(spark, sf):
    return rounded(stats.top_coefficients(embeddings(spark, sf), "vec_id", "embedding", 3), "value")


@query(f"WITH {LONG_SQL}, k AS (SELECT vec_id, x FROM (SELECT vec_id, x, max(x) OVER (PARTITION BY vec_id) AS m FROM x) WHERE x >= 0.5 * m) SELECT vec_id, count(*) AS n_kept, round(max(x) / sum(x), 6) AS top_share FROM k GROUP BY vec_id")
def drop_small_peaks(spark, sf):
    kept = V.drop_small_peaks(V.doubles("embedding"), 0.5)
    return embeddings(spark, sf).select("vec_id", F.size(kept).cast("bigint").alias("n_kept"), F.round(F.array_max(kept), 6).alias("top_share"))


@query(f"WITH {LONG_SQL} SELECT vec_id, count(*) AS n_kept FROM (SELECT vec_id, x, max(x) OVER (PARTITION BY vec_id) AS m FROM x) WHERE x > 0.5 * m GROUP BY vec_id")
def big_peaks(spark, sf):
    return embeddings(spark, sf).select("vec_id", F.size(V.big_peaks(V.doubles("embedding"), 0.5)).cast("bigint").alias("n_kept"))


@query("SELECT user_id, row_number() OVER (ORDER BY seen, user_id) - 1 AS new_id FROM (SELECT user_id, min(event_id) AS seen FROM events GROUP BY user_id)")
def consecutive_ids(spark, sf):
    return stats.consecutive_ids(read(spark, sf, "events"), "user_id", "event_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 120) GROUP BY lang")
def drop_small_groups(spark, sf):
    return stats.drop_small_groups(read(spark, sf, "documents"), "lang", 120).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round(-1 + 2 * (CAST(p_retailprice AS DOUBLE) - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT CAST(min(p_retailprice) AS DOUBLE) AS lo, CAST(max(p_retailprice) AS DOUBLE) AS hi FROM part)")
def minmax_scale(spark, sf):
    return rounded(stats.minmax_scale(read(spark, sf, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("double")), "p_retailprice", -1.0, 1.0, "scaled").select("p_partkey", "scaled"), "scaled")


@query(NEAR_SQL + ' SELECT slice, row_ AS "row", col_ AS col, round(avg(nv), 6) AS mean FROM near GROUP BY ALL')
def lattice_mean26(spark, sf):
    return rounded(tiles.mean(lattice(spark, sf), "v"), "mean")


@query(NEAR_SQL + ' SELECT slice, row_ AS "row", col_ AS col, round(avg(nv) FILTER (abs(nv - v) <= 100), 6) AS mean, count(*) FILTER (abs(nv - v) > 100) AS dropped FROM near GROUP BY ALL')
def lattice_selective_mean(spark, sf):
    return rounded(tiles.selective_mean(lattice(spark, sf), "v", "v", 100.0), "mean")


@query(NEAR_SQL + ' SELECT slice, row_ AS "row", col_ AS col, round(median(nv), 6) AS median FROM near GROUP BY ALL')
def lattice_median26(spark, sf):
    return rounded(tiles.median(lattice(spark, sf), "v"), "median")


@query(NEAR_SQL + ' SELECT slice, row_ AS "row", col_ AS col, bool_and(nv > 950) AS kept FROM near GROUP BY ALL')
def lattice_erode(spark, sf):
    return tiles.erode(lattice(spark, sf).withColumn("on", F.col("v") > 950), "on")


@query(f'WITH {LATTICE_SQL} SELECT slice, row_ AS "row", col_ AS col, round(coalesce(lead(v) OVER (PARTITION BY slice, col_ ORDER BY row_), v) - v, 6) AS d_row, round(coalesce(lead(v) OVER (PARTITION BY slice, row_ ORDER BY col_), v) - v, 6) AS d_col FROM lat')
def lattice_gradient(spark, sf):
    return rounded(neighbours.gradient(lattice(spark, sf), "v").select("slice", "row", "col", "d_row", "d_col"), "d_row", "d_col")


@query(f'WITH {LATTICE_SQL} SELECT slice, row_ AS "row", col_ AS col, round(v - coalesce(lag(v) OVER (PARTITION BY slice, col_ ORDER BY row_), 0) + v - coalesce(lag(v) OVER (PARTITION BY slice, row_ ORDER BY col_), 0), 6) AS div FROM lat')
def lattice_divergence(spark, sf):
    return rounded(neighbours.divergence(lattice(spark, sf), "v", "v").select("slice", "row", "col", "div"), "div")


@query(KNN_SQL.replace(" WHERE p.vec_id % 50 = 0", "") + " SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, round(angle, 6) AS angle FROM k WHERE rank < 5")
def knn_axial_all(spark, sf):
    """The five nearest axes of every vector, exactly, through the metric index."""
    return rounded(metric_index.nearest_of_all(embeddings(spark, sf), "vec_id", "embedding", 5)[0], "angle")


def knn_graph(spark, sf) -> DataFrame:
    """The graph of every vector and its five nearest."""
    return graph.knn_graph(metric_index.nearest_of_all(embeddings(spark, sf), "vec_id", "embedding", 5)[0], "vec_id")


GRAPH_SQL = KNN_SQL.replace(" WHERE p.vec_id % 50 = 0", "") + ", g0 AS (SELECT vec_id AS src, neighbour AS dst, exp(-angle) AS w FROM k WHERE rank < 5), g AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM g0 UNION ALL SELECT dst, src, w FROM g0) GROUP BY src, dst)"


@query(GRAPH_SQL + " SELECT src, round(sum(w), 6) AS total FROM g GROUP BY src")
def graph_row_sums(spark, sf):
    return rounded(graph.row_sums(knn_graph(spark, sf)), "total")


@query(GRAPH_SQL + " SELECT dst, round(sum(w), 6) AS total FROM g GROUP BY dst")
def graph_column_sums(spark, sf):
    return rounded(graph.column_sums(knn_graph(spark, sf)), "total")


@query(GRAPH_SQL + " SELECT src AS id, round(sum(w * (1 + dst % 7)), 6) AS v FROM g GROUP BY src")
def graph_spmv(spark, sf):
    g = knn_graph(spark, sf)
    x = g.select(F.col("dst").alias("id")).distinct().withColumn("v", (1 + F.col("id") % 7).cast("double"))
    return rounded(graph.times_vector(g, x), "v")


@query(GRAPH_SQL + ", d AS (SELECT src, sum(w) AS t FROM g GROUP BY src) SELECT g.src, g.dst, round(w / sqrt(a.t * b.t), 6) AS w FROM g JOIN d a ON a.src = g.src JOIN d b ON b.src = g.dst")
def ncut_weights(spark, sf):
    return rounded(graph.normalized_cut(knn_graph(spark, sf)), "w")


@query(GRAPH_SQL + ", u AS (SELECT src, dst, w + src % 3 AS w FROM g), dd AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, sum(CASE WHEN src < dst THEN w ELSE -w END) AS d FROM u WHERE src != dst GROUP BY 1, 2) SELECT round(sum(abs(d)), 6) AS asymmetry FROM dd")
def graph_asymmetry(spark, sf):
    return rounded(graph.asymmetry(knn_graph(spark, sf).withColumn("w", F.col("w") + F.col("src") % 3)), "asymmetry")


@query()
def cut_eigenvalues(spark, sf):
    """The four leading eigenvalues of the normalised cut of the neighbour graph, and how many vertices their vectors have."""
    g = graph.settle(knn_graph(spark, sf))
    values, vectors = krylov.leading_eigenpairs(graph.normalized_cut(g), g.select(F.col("src").alias("id")).distinct(), 4, tolerance=1e-4)  # values err by the square of that
    table = F.array(*[F.lit(float(v)) for v in values])
    return vectors.agg(F.count("*").alias("n")).select(F.posexplode(table).alias("rank", "value"), "n").withColumn("value", F.round("value", 6))


def largest_part(spark, sf, over: bool) -> DataFrame:
    """Ids of the largest component, by six neighbours, of the voxels whose value is over the mean (or not), ties to the one with the least id."""
    voxels = lattice(spark, sf)
    mean = F.lit(voxels.agg(F.avg("v")).first()[0])
    part = voxels.where(F.col("v") > mean if over else F.col("v") <= mean).select("slice", "row", "col", "id")
    found = graph.settle(part.join(tiles.labels(part, near=6, size=(8, 10, 10)), ["slice", "row", "col"]))
    best = found.groupBy("comp").agg(F.count("*").alias("n"), F.min("id").alias("least")).orderBy(F.desc("n"), "least").limit(1)
    return found.join(F.broadcast(best.select("comp")), "comp", "left_semi").select("id")


def part_sql(mask: str) -> str:
    near = "SELECT p.id AS src, q.id AS dst FROM b p JOIN b q ON abs(p.slice - q.slice) + abs(p.row_ - q.row_) + abs(p.col_ - q.col_) = 1"
    return f"WITH RECURSIVE {LATTICE_SQL}, b AS (SELECT * FROM lat WHERE {mask}), ed AS ({near}), reach AS (SELECT id AS src, id AS dst FROM b UNION SELECT reach.src, ed.dst FROM reach JOIN ed ON ed.src = reach.dst), comp AS (SELECT src AS id, min(dst) AS c FROM reach GROUP BY src), best AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT id FROM comp WHERE c IN (SELECT c FROM best)"


@query(part_sql("v <= (SELECT avg(v) FROM lat)"))
def largest_component(spark, sf):
    return largest_part(spark, sf, False)


@query(part_sql("v > (SELECT avg(v) FROM lat)"))
def largest_bright_component(spark, sf):
    return largest_part(spark, sf, True)


@query()
def robust_volume(spark, sf):
    """The lattice of values smoothed by a membrane that breaks at edges, over tiles of several tasks; tests hold it against the whole array."""
    v = lattice(spark, sf).withColumn("v", F.col("v") / 100)
    return rounded(tiles.robust(v, ["v"], 0.5, "tukey", 4.0, size=(8, 10, 10), halo=8), "v")


@query()
def robust_vectors(spark, sf):
    """The first three places of the vectors as a field, smoothed together: one weight for each pair of voxels, outliers let go."""
    i = F.col("vec_id")
    at = [F.floor(i / 200).cast("int").alias("slice"), F.pmod(F.floor(i / 20), F.lit(10)).cast("int").alias("row"), F.pmod(i, F.lit(20)).cast("int").alias("col")]
    field = embeddings(spark, sf).select(*at, *[F.element_at(V.doubles("embedding"), k).alias(n) for k, n in enumerate("xyz", 1)])
    return rounded(tiles.robust(field, ["x", "y", "z"], 0.2, "geman", 2.0, data_scale=2.0, size=(8, 10, 10), halo=8), "x", "y", "z")


@query()
def shortest_path(spark, sf):
    g = knn_graph(spark, sf).withColumn("w", -F.log("w"))
    vertices = g.select(F.col("src").alias("id")).distinct()
    return rounded(graph.shortest_paths(vertices, g, 0), "dist")


@query("WITH c AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1) SELECT round(-sum(c / n * ln(c / n)), 6) AS entropy FROM c, (SELECT sum(c) AS n FROM c)")
def entropy(spark, sf):
    return rounded(stats.entropy(read(spark, sf, "events"), "event_type"), "entropy")


@query("SELECT page_id, CASE WHEN contains(url, '.') THEN '.' || regexp_extract(url, '\\.([^.]*)$', 1) ELSE '' END AS ext, CASE WHEN contains(url, '.') THEN regexp_replace(url, '\\.[^.]*$', '') ELSE url END AS base, split_part(url, '.', 1) AS head FROM pages")
def extension_parse(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", strings.extension(u).alias("ext"), strings.without_extension(u).alias("base"), strings.before_first_dot(u).alias("head"))


@query("WITH c AS (SELECT l_partkey, count(*) FILTER (l_linenumber % 2 = 1) AS a, count(*) FILTER (l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN a > 0 THEN greatest(b - a, 0) END AS over_count, CASE WHEN a > 0 THEN greatest(a - b, 0) END AS under_count, CAST(a > 0 AND b = 0 AS INT) AS missing, CAST(a = 0 AND b > 0 AS INT) AS extra FROM c")
def over_under_count(spark, sf):
    from ..operators import fields

    l = read(spark, sf, "lineitem")
    odd = l.where("l_linenumber % 2 = 1").groupBy("l_partkey").agg(F.count("*").alias("n"))
    even = l.where("l_linenumber % 2 = 0").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return fields.count_errors(odd, even, ["l_partkey"])


@query(f"WITH e AS ({VEC_SQL}) SELECT vec_id, round({NORM.format('v')}, 6) AS norm, round(list_sum(v), 6) AS total, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS arg_max, len(list_filter(v, lambda x: x > 1e-9)) AS n_positive FROM e")
def vector_measures(spark, sf):
    v = V.doubles("embedding")
    return embeddings(spark, sf).select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.total(v), 6).alias("total"), V.arg_max(v).cast("bigint").alias("arg_max"), F.size(F.filter(v, lambda x: x > 1e-9)).cast("bigint").alias("n_positive"))


EV_SQL = f"ev AS (SELECT vec_id, abs(v[1]) AS a, abs(v[2]) AS b, abs(v[3]) AS c FROM ({VEC_SQL})), s AS (SELECT vec_id, greatest(a, b, c) AS l1, a + b + c - greatest(a, b, c) - least(a, b, c) AS l2, least(a, b, c) AS l3, (a + b + c) / 3 AS md FROM ev)"


@query(f"WITH {EV_SQL} SELECT vec_id, round(sqrt(1.5 * ((l1 - md) ** 2 + (l2 - md) ** 2 + (l3 - md) ** 2) / (l1 ** 2 + l2 ** 2 + l3 ** 2)), 6) AS fa, CASE WHEN l1 - l2 >= 2 * (l2 - l3) AND l1 - l2 >= 3 * l3 THEN 1 WHEN 2 * (l2 - l3) >= 3 * l3 THEN 2 ELSE 3 END AS shape FROM s")
def anisotropy(spark, sf):
    ev = F.transform(F.slice(V.doubles("embedding"), 1, 3), lambda x: F.abs(x))
    return embeddings(spark, sf).select("vec_id", F.round(V.fractional_anisotropy(ev), 6).alias("fa"), V.shape_coefficients(ev)["shape"].alias("shape"))


@query("SELECT event_id, CAST(value > 50 AS INT) AS above, CAST(isfinite(value) AS BOOLEAN) AS finite FROM events")
def threshold_mask(spark, sf):
    return read(spark, sf, "events").select("event_id", scalars.threshold(F.col("value"), 50).alias("above"), scalars.is_number(F.col("value")).alias("finite"))


@query("SELECT event_id, round(2 + 3 * (-ln(1 - ((event_id % 1000) / 1000.0))) ** 0.5, 6) AS w FROM events")
def weibull_variates(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(scalars.weibull(F.pmod("event_id", F.lit(1000)) / 1000.0, 2.0, 3.0, 2.0), 6).alias("w"))


@query("SELECT event_type, day, n, total, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS running FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)")
def events_by_day(spark, sf):
    """Beyond the reference: what the streaming form of this query computes once its input is complete."""
    day = read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return day.withColumn("running", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))


def _load():
    """The other modules of queries, which add themselves to the table."""
    from . import experiments, fits, lattices, numerics, rules, stored

    return fits, lattices, rules, stored, experiments, numerics


def queries() -> dict:
    return QUERIES | _load()[0].QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
