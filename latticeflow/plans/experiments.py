"""Queries over whole experiments: simulated fields reconstructed and compared; SQL where the answer is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import experiment, fields, generate, graph, regularize
from .lattices import AXES_SQL, PAIR, VOX, degrees, field
from .queries import embeddings, query, rounded

KEY = ["slice", "row", "col"]
ERRORS = [f"{e}_{s}" for e in ("over_count", "under_count", "missing", "extra", "angle") for s in ("mean", "sd")]


def on_basis(spark, sf, basis) -> DataFrame:
    """One compartment a voxel, along a basis direction."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in basis])
    f = field(spark, sf, 0, (1.0,)).withColumn("d", F.element_at(table, (F.pmod("vec_id", F.lit(len(basis))) + 1).cast("int")))
    return f.select(*KEY, F.transform("compartments", lambda c: c.withField("dir", F.col("d"))).alias("compartments"))


@query("SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS {e}" for e in ERRORS))
def noise_free_reconstruction(spark, sf):
    """Simulate, fit, group and compare a field without noise: nothing is missed, added or turned, to two places."""
    basis, g = generate.sphere(24), generate.sphere(48)
    truth = on_basis(spark, sf, basis)
    settings = experiment.Settings(least_peak=0.5)
    found = experiment.reconstruct(experiment.simulated(truth, g, settings), g, basis, settings)
    return experiment.evaluate(truth, found).select(*[(F.round(e, 2) + F.lit(0.0)).alias(e) for e in ERRORS])


@query("SELECT 0 AS slice, CAST(r AS INT) AS \"row\", CAST(c AS INT) AS col, round((r + 0.5) / 60, 6) AS share, CAST(3 * (c + 1) AS DOUBLE) AS angle FROM range(30) a(r), range(30) b(c)")
def parameter_study(spark, sf):
    """The field of a study: the second compartment's share along rows and the angle along columns."""
    c = F.col("compartments")
    return rounded(experiment.parameter_study(spark).select(*KEY, F.element_at(c, 2)["fraction"].alias("share"), fields.smallest_angle(c).alias("angle")), "share", "angle")


@query(f"WITH {AXES_SQL} SELECT {VOX}, 2 AS truth_count, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END AS found_count, 0.6 AS first, CASE WHEN vec_id % 3 != 0 THEN round({degrees('c', 'd')}, 6) END AS angle FROM ax")
def training_table(spark, sf):
    """Counts, fractions and angles of a fit beside the true count, for learning from."""
    found = field(spark, sf, 2)
    found = found.withColumn("compartments", F.when(F.pmod("vec_id", F.lit(3)) == 0, F.slice("compartments", 1, 1)).otherwise(F.reverse("compartments")))
    rows = experiment.training_set(field(spark, sf), found)
    return rounded(rows.select(*KEY, "truth_count", "found_count", F.element_at("fractions", 1).alias("first"), F.try_element_at("angles", F.lit(1)).alias("angle")), "first", "angle")


def matched(x: str, y: str) -> str:
    return f"least({degrees('a', x)} + {degrees('b', y)}, {degrees('a', y)} + {degrees('b', x)}) / 2"


@query(f"WITH {AXES_SQL}, t AS (SELECT vec_id, vec_id % 3 != 0 AS r1, vec_id % 5 != 0 AS r2, {matched('c', 'd')} AS e1, {matched('v[13:15]', 'v[16:18]')} AS e2 FROM ax) SELECT count(*) FILTER (r1) AS first_right, count(*) FILTER (r2) AS second_right, round(avg(e2 - e1) FILTER (r1 AND r2), 6) AS mean_gain FROM t")
def reconstruction_comparison(spark, sf):
    """Two reconstructions of one truth: how often each has its count, and what the first gains in angle."""
    cut = lambda f, k: f.withColumn("compartments", F.when(F.pmod("vec_id", F.lit(k)) == 0, F.slice("compartments", 1, 1)).otherwise(F.col("compartments")))
    return rounded(fields.compare(field(spark, sf), cut(field(spark, sf, 2), 3), cut(field(spark, sf, 4), 5)), "mean_gain")


@query(f"WITH {AXES_SQL}, t AS (SELECT *, list_transform(v[2:33], lambda x: x / (1 + abs(v[1]))) AS x FROM ax) SELECT {VOX}, round(list_sum(list_transform(x, lambda y: (y - list_avg(x)) ** 2)) / 32, 6) AS variance FROM t")
def signal_variances(spark, sf):
    """The variance of each voxel's signal over its baseline."""
    v = V.doubles("embedding")
    e = embeddings(spark, sf).select("vec_id", (1 + F.abs(F.element_at(v, 1))).alias("s0"), F.slice(v, 2, 32).alias("dw"))
    return rounded(fields.signal_variance(field(spark, sf).join(e, "vec_id")), "variance")


@query(f"WITH {AXES_SQL}, t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in PAIR.items())}, round({degrees('a', 'b')}) AS crossing FROM ax) SELECT crossing, round(avg(least(ac + bd, ad + bc) / 2), 6) AS angle, count(*) AS n FROM t GROUP BY crossing")
def error_by_crossing(spark, sf):
    """Mean angular error by the truth's crossing angle, to a degree."""
    truth = field(spark, sf)
    return rounded(fields.error_by_crossing(truth, fields.angular_error(truth, field(spark, sf, 2)), "angle"), "angle")


def whole(spark, sf) -> DataFrame:
    return field(spark, sf).select(*KEY, "compartments")


@query()
def snr_sweep(spark, sf):
    """Errors of reconstructions of the field at two signal-to-noise ratios."""
    return experiment.snr_sweep(whole(spark, sf), generate.sphere(32), generate.sphere(64), experiment.Settings(refit=True), (10, 30))


@query()
def denoising_grid(spark, sf):
    """What denoising leaves of the noise, by its kind and strength."""
    return experiment.denoising_grid(whole(spark, sf), generate.sphere(16), experiment.Settings(snr=15.0), [1.0, 10.0], ("tv",))


@query()
def regularized_field(spark, sf):
    """A noisy field with coefficients smoothed over its neighbours, in steps."""
    g, basis = generate.sphere(24), generate.sphere(32)
    settings = experiment.Settings(regularization="robust", snr=20.0)
    signals = graph.settle(experiment.simulated(whole(spark, sf), g, settings))
    return experiment.reconstruct(signals, g, basis, settings)


@query()
def aligned_denoising(spark, sf):
    """Signals made anew from those of their neighbours whose shapes align best."""
    g = generate.sphere(12)
    return regularize.denoise_aligned(experiment.simulated(whole(spark, sf), g, experiment.Settings(snr=20.0)), g, lmax=2)
