"""Round trips of file formats and of the field operators."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.functions import scalars, strings
from latticeflow.functions import vectors as V
from latticeflow.operators import fields, fits, generate, graph, neighbours, stats, tiles
from latticeflow.sources import images, texts


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 5, dtype="i2").reshape(2, 3, 4, 5)
    raw = images.encode_nifti(data, affine=np.eye(4))
    assert (images.decode_nifti(gzip.compress(raw))[1] == data).all()
    (tmp_path / "a.nii").write_bytes(raw)
    (tmp_path / "b.nii.gz").write_bytes(images.encode_nifti(data, compress=True))
    rows = images.read_nifti(spark, str(tmp_path))
    assert rows.count() == 2 * 24
    one = rows.where("path like '%a.nii' and slice = 1 and row = 0 and col = 1").first()["values"]
    assert one == data[1, 2, 1].tolist()
    assert images.read_nifti(spark, str(tmp_path / "a.nii"), {"slice": (1, 2), "row": (0, 2)}).count() == 4
    assert images.read_nifti_headers(spark, str(tmp_path)).select("dim").distinct().first()[0] == [2, 3, 4, 5]
    split = images.split_baseline(rows.where("path like '%a.nii'"), [0, 2]).first()
    assert len(split["dw"]) == 3
    back = images.volume_bytes(rows.where("path like '%a.nii'").withColumn("volume", F.lit(1)), "values").first()["content"]
    assert (images.decode_nifti(bytes(back))[1] == data).all()
    with pytest.raises(ValueError):
        images.parse_nifti_header(b"\0" * 348)


def test_scaled_nifti(spark):
    raw = bytearray(images.encode_nifti(np.array([[[1, 2]]], dtype="u1")))
    import struct

    struct.pack_into("<ff", raw, 112, 2.0, 1.0)
    assert images.decode_nifti(bytes(raw))[1].reshape(-1).tolist() == [3, 5]
    assert images.decode_nifti(bytes(raw), legacy=True)[1].reshape(-1).tolist() == [1, 2]


def test_mrtrix_round_trip(spark, tmp_path):
    data = np.arange(24, dtype="f4").reshape(2, 3, 4)
    assert (images.decode_mrtrix(images.encode_mrtrix(data, transform=np.eye(4)))[1] == data).all()
    tracks = [np.array([[0, 0, 0], [1, 1, 1.0]]), np.array([[2, 2, 2.0]])]
    props, back = images.decode_tracks(images.encode_tracks(tracks, {"step": "0.1"}))
    assert props["step"] == "0.1" and all(np.allclose(a, b) for a, b in zip(tracks, back, strict=True))
    (tmp_path / "a.tck").write_bytes(images.encode_tracks(tracks))
    (tmp_path / "a.mif").write_bytes(images.encode_mrtrix(data))
    assert images.read_tracks(spark, str(tmp_path / "a.tck")).count() == 2
    assert images.read_mrtrix(spark, str(tmp_path / "a.mif")).where("slice = 3 and row = 2 and col = 1").first()["values"] == [23.0]
    assert (images.parse_plain_volume(images.plain_volume(data))[3, 2, 1] == 23).all()


def test_field_files(spark, tmp_path):
    c = [{"fraction": 0.6, "rotation": np.eye(3).reshape(-1).tolist(), "lambda": [1.0, 2.0, 3.0], "seg": 1}]
    a = [{"alpha": 0.5, "dir": [1.0, 0.0, 0.0], "grp": 2}]
    rows = {(0, 1, 2): (c, a)}
    text = texts.format_field(rows, 2, 3, 4)
    parsed = {r[:3]: r[3:] for r in texts.parse_field(text)}
    assert len(parsed) == 24 and parsed[0, 1, 2] == (c, a) and parsed[1, 0, 0] == ([], [])
    assert {r[:3]: r[3:] for r in texts.decode_binary_field(texts.encode_binary_field(rows, 2, 3, 4))} == parsed
    (tmp_path / "f.txt").write_text(text)
    (tmp_path / "g.bin").write_bytes(texts.encode_binary_field(rows, 2, 3, 4))
    field = texts.read_field(spark, str(tmp_path))
    assert field.count() == 48 and field.where("size(compartments) > 0").count() == 2
    again = texts.field_text(field.where("path like '%f.txt'").withColumn("id", F.lit(1)).drop("path")).first()["content"]
    assert texts.parse_field(again) == texts.parse_field(text)


def test_lists_and_settings(spark, tmp_path):
    (tmp_path / "g.txt").write_text("0 0 0\n2 0 0\n\n0 3 4\n")
    rows = texts.read_scheme(spark, str(tmp_path / "g.txt")).orderBy("idx").collect()
    assert [r["is_s0"] for r in rows] == [True, False, False] and rows[2]["z"] == pytest.approx(0.8)
    (tmp_path / "b.txt").write_text("0 0 1 0\n0 0 1 1000\n")
    assert texts.read_b_scheme(spark, str(tmp_path / "b.txt")).collect()[0]["b"] == 1000
    (tmp_path / "n.txt").write_text("a.nii b.nii\nc.nii\n")
    assert texts.read_names(spark, str(tmp_path / "n.txt")).count() == 3
    values, warned = texts.parse_settings("# x\nk 3\nflag true\nother 1\nr x\n", {"k": int, "flag": bool, "r": float})
    assert values == {"k": 3, "flag": True} and len(warned) == 2


def test_strings(spark):
    row = spark.createDataFrame([("a.b.nii.gz", "1-3, 2,7", "x<'&\n")], "n string, s string, t string").select(
        strings.extension(F.col("n")), strings.without_extension(F.col("n")), strings.change_extension(F.col("n"), ".x"), strings.before_first_dot(F.col("n")), strings.image_extension(F.col("n")), strings.image_base_name(F.col("n")), strings.is_gzip(F.col("n")),
        strings.slice_numbers(F.col("s")), strings.unescape_xml(strings.escape_xml(F.col("t"))), strings.split_any(F.lit("a,b;;c;"), ",;"), strings.datatype_name(F.lit(16)), strings.datatype_code(F.lit("FLOAT32")), strings.coded(F.lit(99), strings.UNITS),
    ).first()
    assert list(row) == [".gz", "a.b.nii", "a.b.nii.x", "a", ".nii.gz", "a.b", True, [1, 2, 3, 7], "x<'&\n", ["a", "b", "", "c"], "FLOAT32", 16, "Unknown"]


def test_vectors_and_scalars(spark):
    d = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    a, b, c = (F.col(x) for x in "abc")
    row = d.select(V.cross(a, b), V.axial_angle_degrees(a, c), V.point_segment_sqr_distance(a, b, c), V.point_line_distance(c, a, b), V.quadratic_form(F.array(*[F.lit(x) for x in (2.0, 0, 0, 0, 3, 0, 0, 0, 4)]), c), V.rescale(F.array(F.lit(1.0), F.lit(3.0))), V.triangle_normal(a, b, c), V.big_peaks(F.array(F.lit(1.0), F.lit(0.2)), 0.5), V.fractional_anisotropy(a), scalars.is_number(F.lit(float("nan"))), scalars.coherence_class(F.lit(30.0))).first()
    assert row[0] == [0, 0, 1] and row[1] == pytest.approx(45) and row[2] == pytest.approx(0.5) and row[3] == pytest.approx(0.5**0.5) and row[4] == 5 and row[5] == [0, 1] and [abs(x) for x in row[6]] == [0, 0, 1]
    assert row[7] == [1.0] and row[8] == pytest.approx(1.0) and row[9] is False and row[10] == 2
    mask = d.select(scalars.voxel_mask(F.lit(1), F.lit(10.0), F.lit(0.5), F.lit(3.0), 5, 0.2, 0, 0.6)).first()[0]
    assert mask == 1 | scalars.S0_BIT | scalars.FA_BIT | scalars.SIGNAL_BIT


def test_fields_and_fits(spark):
    truth = generate.random_field(spark, 1, 4, 4, least_angle=60.0, seed=3, crossing=lambda s, r, c: c > 1).cache()
    g = generate.sphere(60)
    signal = generate.simulate(truth, g, 2000.0)
    found = fits.fit_orientations(signal, g, generate.sphere(200), 2000.0, 1.7e-3, 3e-4)
    assert found.where("rmse > 0.01").count() == 0
    summary = fields.error_summary(truth, found).first()
    assert summary["missing_mean"] == 0 and summary["angle_mean"] < 10
    assert fields.error_summary(truth, truth).first()["angle_mean"] == pytest.approx(0, abs=1e-5)
    single = fits.fit_tensor(signal, g, 2000.0).where("col < 2").agg(F.min("fa"), F.max("fa")).first()
    assert single[0] == pytest.approx(single[1]) and single[0] > 0.7
    assert fields.counts(truth).first()["total"] == 8 + 16
    assert fields.counts(truth, [5]).first()["total"] is None
    assert fields.select_slices(truth, "row", [1, 3]).agg(F.max("row")).first()[0] == 1
    assert fields.coherence(truth, 45.0).where("lci < 0").count() == 0
    assert truth.select(fields.smallest_angle(F.col("compartments")).alias("a")).agg(F.min("a")).first()[0] >= 60 - 1e-6
    assert fits.smooth_coefficients(found, 0.1, 1).count() == 16
    assert fields.compare(truth, truth, found).first()["first_right"] == 16
    assert fields.drop_small(truth, 0.99).select(F.max(F.size("compartments"))).first()[0] <= 2
    assert fields.alpha_differences(found.select("slice", "row", "col", "alpha")).where("w < -1e-9 or w > 1").count() == 0
    assert fields.angle_volume(truth, 0).count() == 24 and fields.split_slice(truth, 0).count() == 24


def test_erosion_and_differences(spark):
    grid = generate.grid(spark, 1, 5, 5).withColumn("on", F.lit(True)).withColumn("v", (F.col("row") * 10 + F.col("col")).cast("double"))
    hole = grid.withColumn("on", ~((F.col("row") == 2) & (F.col("col") == 2)))
    assert tiles.erode(grid, "on", 3).where("kept").count() == 25
    assert tiles.erode(hole, "on").where("not kept").count() == 9
    d = neighbours.difference(grid, "v", "row", boundary="circular").where("row = 4").select("d_row").distinct().first()[0]
    assert d == -40
    assert neighbours.difference(grid, "v", "col", forward=False, boundary="dirichlet").where("col = 0 and row = 1").first()["d_col"] == 10


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 2.0)], "src long, dst long, w double")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "id long")
    assert {r["id"]: r["comp"] for r in graph.components(v, e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    assert sorted(r["id"] for r in graph.largest_component(v, e).collect()) == [1, 2, 3]
    assert {r["id"]: r["label"] for r in graph.largest_components(v, e, 2).collect()}[9] == 0
    assert {r["id"]: r["dist"] for r in graph.shortest_paths(v, both, 1).collect()} == {1: 0, 2: 1, 3: 2, 5: -1, 6: -1, 9: -1}
    assert graph.asymmetry(e).first()[0] == 4
    vector, value = graph.power_iteration(both, v.where("id < 4"), 100, shift=2.0)
    assert value == pytest.approx(2**0.5, abs=1e-3) and graph.eigen_residual(both.where("src < 4"), vector, value).first()[0] < 0.05
    assert graph.entry(e, 1, 2).first()[0] == 1 and graph.entry(e, 9, 9).first()[0] == 0
    assert graph.add_diagonal(e, v.select("id", F.lit(1.0).alias("v"))).count() == 9


def test_sampling(spark):
    d = spark.range(1000)
    assert stats.sample_no_replacement(d, 10, 1).count() == 10
    assert abs(stats.sample_replacement(d, 500, 1).count() - 500) < 120
    assert stats.random_permutation(d, 3).count() == 1000
    chosen = stats.category_sample(d.withColumn("label", F.col("id") % 10), "label", 0.3, 1)
    assert chosen.where("chosen").select("label").distinct().count() == 3
    assert stats.drop_small_groups(d.withColumn("label", F.when(F.col("id") < 3, 0).otherwise(1)), "label", 5).count() == 997


def test_streaming(spark, sf, tmp_path):
    from latticeflow.streaming import events

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = events.streaming_histogram(events.event_stream(spark, sf, schema), "value", 0.0, 100.0, 10)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(freq) from hist").first()[0] == spark.read.parquet(f"{sf}/events.parquet").where("value is not null").count()
    day = events.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"), "ts", "event_type", "value")
    assert day.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
