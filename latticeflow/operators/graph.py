"""Sparse matrices and graphs as edge tables (src, dst, w); the diagonal is src = dst."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the session's shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/latticeflow/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has: few bytes that cost much work would else end up in one or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))  # by another key than a join's, whose shuffle is coalesced


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of settle() that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        delete(t.sparkSession, t.settled_path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="latticeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def row_sums(m: DataFrame, absolute: bool = False) -> DataFrame:
    w = F.abs("w") if absolute else F.col("w")
    return m.groupBy("src").agg(F.sum(w).alias("total"))


def column_sums(m: DataFrame, absolute: bool = False) -> DataFrame:
    w = F.abs("w") if absolute else F.col("w")
    return m.groupBy("dst").agg(F.sum(w).alias("total"))


def asymmetry(m: DataFrame) -> DataFrame:
    """Sum over pairs of |w_ij - w_ji|; an entry that is missing is 0."""
    up = m.where("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("a"))
    down = m.where("src > dst").select(F.col("dst").alias("i"), F.col("src").alias("j"), F.col("w").alias("b"))
    return up.join(down, ["i", "j"], "full").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("asymmetry"))


def times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """(id, v) of M x for x (id, v); rows without an entry are left out."""
    return m.join(x, m["dst"] == x["id"]).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def vector_times(x: DataFrame, m: DataFrame) -> DataFrame:
    """(id, v) of x' M, contributions summed."""
    return m.join(x, m["src"] == x["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def scaled(m: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """diag(left) M diag(right) for (id, v) tables."""
    l, r = left.select(F.col("id").alias("src"), F.col("v").alias("__l")), right.select(F.col("id").alias("dst"), F.col("v").alias("__r"))
    return m.join(l, "src").join(r, "dst").select("src", "dst", (F.col("__l") * F.col("w") * F.col("__r")).alias("w"))


def add_diagonal(m: DataFrame, d: DataFrame) -> DataFrame:
    """M + diag(d)."""
    rows = m.select("src", "dst", "w").unionByName(d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("v").alias("w")))
    return rows.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def first_edges(edges: DataFrame, most: int, order: str = "order") -> DataFrame:
    """(src, dst, w) as edges are added in order: a repeated one is refused, so is one past `most` of a vertex; a loop is
    never refused and the last one stays."""
    loops = edges.where("src = dst").groupBy("src", "dst").agg(F.max_by("w", order).alias("w"))
    once = edges.where("src != dst").groupBy("src", "dst").agg(F.min(F.struct(order, "w")).alias("e")).select("src", "dst", f"e.{order}", "e.w")
    kept = once.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy(order))).where(F.col("__r") <= most)
    return kept.select("src", "dst", "w").unionByName(loops)


def entry(m: DataFrame, r: int, c: int) -> DataFrame:
    """One entry, 0 if absent."""
    return m.where((F.col("src") == r) & (F.col("dst") == c)).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def induced(m: DataFrame, labels: DataFrame, keep: list[int]) -> DataFrame:
    """Edges between vertices (id, label) of the labels kept."""
    ids = labels.where(F.col("label").isin(keep)).select("id")
    return m.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def normalized_cut(m: DataFrame) -> DataFrame:
    """D^-1/2 M D^-1/2 with D the row sums."""
    d = row_sums(m).select(F.col("src").alias("id"), (1 / F.sqrt("total")).alias("v"))
    return scaled(m, d, d)


def eigen_residual(m: DataFrame, vector: DataFrame, value: float) -> DataFrame:
    """Largest |M v - value v|."""
    mv = times_vector(m, vector).withColumnRenamed("v", "mv")
    return vector.join(mv, "id", "left").agg(F.max(F.abs(F.coalesce("mv", F.lit(0.0)) - value * F.col("v"))).alias("residual"))


def knn_graph(near: DataFrame, key: str) -> DataFrame:
    """(src, dst, w = exp(-d)) of a neighbour table (key, neighbour, angle), both directions, each once."""
    e = near.select(F.col(key).alias("src"), F.col("neighbour").alias("dst"), F.exp(-F.col("angle")).alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable over edges (src, dst), by hooking to the least neighbour and jumping pointers."""
    both = settle(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    now = settle(vertices.select("id", F.col("id").alias("comp")))
    while True:
        near = both.join(now.select(F.col("id").alias("dst"), "comp"), "dst").groupBy("src").agg(F.min("comp").alias("m"))
        hooked = now.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = settle(hooked.join(jump, "comp").select("id", F.least("comp", "up").alias("comp")))
        still = new.join(now.withColumnRenamed("comp", "old"), "id").where("comp != old").isEmpty()
        discard(now)
        now = new
        if still:
            break
    discard(both)
    return now


def largest_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the largest component, ties to the least id."""
    comps = components(vertices, edges)
    best = comps.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(1).select("comp")
    return comps.join(best, "comp", "left_semi").select("id")


def largest_components(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, label): 1..k-1 for the k - 1 largest components, 0 for the rest."""
    comps = components(vertices, edges)
    top = comps.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(k - 1)
    ranked = top.withColumn("label", F.row_number().over(Window.orderBy(F.desc("n"), "comp"))).select("comp", "label")
    return comps.join(ranked, "comp", "left").select("id", F.coalesce("label", F.lit(0)).alias("label"))


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(id, dist) from one source by rounds of relaxation until none is nearer; -1 where it can't be reached.

    Weights are lengths; negative ones raise ValueError.
    """
    e = settle(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    now = settle(vertices.select("id", F.when(F.col("id") == source, 0.0).alias("dist")))
    if not e.where("w < 0").isEmpty():
        raise ValueError("lengths can't be negative")
    last = now
    while True:
        via = e.join(now.where("dist is not null").withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("d"))
        new = settle(now.join(via, "id", "left").select("id", F.least("dist", "d").alias("dist"), (F.coalesce(F.least("dist", "d"), F.lit(-1.0)) < F.coalesce("dist", F.lit(float("inf")))).alias("nearer"), "d"))
        still = new.where("d is not null and nearer").isEmpty()
        discard(last)
        last, now = new, new.select("id", "dist")
        if still:
            break
    discard(e)
    return now.select("id", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def power_iteration(m: DataFrame, vertices: DataFrame, rounds: int = 50, shift: float = 0.0) -> tuple[DataFrame, float]:
    """The dominant eigenvector (id, v) of a symmetric M + shift * I and its value; one scalar action a round."""
    now = settle(vertices.select("id", (1.0 + (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)).alias("v")))
    value = 0.0
    for _ in range(rounds):
        mv = now.join(times_vector(m, now).withColumnRenamed("v", "mv"), "id", "left").select("id", (F.coalesce("mv", F.lit(0.0)) + shift * F.col("v")).alias("v"))
        mv = settle(mv)
        size = mv.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 1.0
        now = mv.select("id", (F.col("v") / size).alias("v"))
        if abs(size - value) < 1e-10 * size:
            break
        value = size
    return now, value - shift
