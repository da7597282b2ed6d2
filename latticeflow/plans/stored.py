"""Queries that write files to the shared folder, read them back, and answer from what was read; SQL says what must come back.

Images hold single precision, so the SQL casts to FLOAT.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import generate, graph
from ..operators import stats as S
from ..sources import fields, files, images, sinks, texts, volumes
from .lattices import AXES_SQL, VOX, field
from .queries import HIST_SQL, LATTICE_SQL, NORM, VEC_SQL, embeddings, lattice, query, read, rounded


def folder(spark, name: str) -> str:
    return f"{graph.shared_dir(spark)}/latticeflow/{name}-{uuid.uuid4().hex}"


GRID_SQL = f"{LATTICE_SQL}, gr AS (SELECT CAST(s AS INT) AS slice, CAST(r AS INT) AS row_, CAST(c AS INT) AS col_ FROM range((SELECT max(slice) + 1 FROM lat)) a(s), range((SELECT max(row_) + 1 FROM lat)) b(r), range((SELECT max(col_) + 1 FROM lat)) d(c)), full_ AS (SELECT gr.*, CAST(CAST(coalesce(v, 0) AS FLOAT) AS DOUBLE) AS v FROM gr LEFT JOIN lat USING (slice, row_, col_))"


def volume(spark, sf) -> DataFrame:
    return lattice(spark, sf).select(F.lit("lattice").alias("volume"), "slice", "row", "col", F.array("v", F.col("v") * 2, F.col("v") + 0.5).alias("x"), F.array("v").alias("one"))


def written(spark, sf) -> DataFrame:
    """The lattice for the image sink, which the session has to know."""
    volumes.register(spark)
    return volume(spark, sf)


@query(f"WITH {GRID_SQL}, d AS (SELECT *, coalesce((SELECT l.v FROM lat l WHERE l.slice = full_.slice AND l.row_ = full_.row_ AND l.col_ = full_.col_), 0) AS raw, EXISTS (SELECT 1 FROM lat l WHERE l.slice = full_.slice AND l.row_ = full_.row_ AND l.col_ = full_.col_) AS there FROM full_) SELECT {VOX}, round(CASE WHEN there THEN raw + 0.5 ELSE 0 END, 6) AS half, round(raw, 6) AS v, round(CASE WHEN there THEN raw + 0.5 ELSE 0 END, 6) AS again, round(raw * 2, 6) AS twice FROM d")
def image_sink(spark, sf):
    """The whole lattice as one 4D image in double precision, its bricks picked and repeated on writing, by as many tasks as there are ranges of slices; read back by another source."""
    at = f"{folder(spark, 'sink')}/lattice.nii"
    sinks.save_volume(written(spark, sf), "x", at, bricks="2,0,2..2,1", kind="f8")
    rows = images.read_nifti(spark, at)
    return rows.select("slice", "row", "col", *[F.round(F.element_at("values", i + 1), 6).alias(n) for i, n in enumerate(("half", "v", "again", "twice"))])


@query(f"WITH {GRID_SQL} SELECT 'nifti' AS kind, {VOX}, round(v, 4) AS v FROM full_ UNION ALL SELECT 'zipped', {VOX}, round(v, 4) FROM full_ UNION ALL SELECT 'mrtrix', {VOX}, round(v, 4) FROM full_")
def image_round_trip(spark, sf):
    """3D images written and read: plain, zipped, and in the other image format."""
    out = None
    for kind, how in (("nifti", {}), ("zipped", {"compress": True}), ("mrtrix", {"fmt": "mif", "flip": False})):
        at = folder(spark, kind)
        if kind == "nifti":
            sinks.save_volume(written(spark, sf), "one", f"{at}/lattice.nii")
        else:
            images.write_volumes(volume(spark, sf), "one", at, **how)
        rows = (images.read_mrtrix if kind == "mrtrix" else images.read_nifti)(spark, at)
        one = rows.select(F.lit(kind).alias("kind"), "slice", "row", "col", F.round(F.element_at("values", 1), 4).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {GRID_SQL}, d AS (SELECT *, CAST(CAST(coalesce((SELECT 2 * l.v FROM lat l WHERE l.slice = full_.slice AND l.row_ = full_.row_ AND l.col_ = full_.col_), 0) AS FLOAT) AS DOUBLE) AS v2 FROM full_) SELECT {VOX}, round(v2, 4) AS a, round(v, 4) AS b, round(v2, 4) AS c FROM d WHERE row_ >= 2 AND row_ < 5 AND col_ = 7")
def image_regions(spark, sf):
    """Bricks 1, 0 and 1 again of a box of a 4D image, by the data source that reads only these."""
    at = folder(spark, "regions")
    sinks.save_volume(written(spark, sf), "x", f"{at}/lattice.nii")
    rows = spark.read.format("volume").option("path", at.removeprefix("file://")).option("row", "2:5").option("bricks", "[1,0..0,1]").load().where("col = 7")
    return rows.select("slice", "row", "col", *[F.round(F.element_at("values", i + 1), 4).alias(n) for i, n in enumerate("abc")])


SIGNAL_SQL = "sg AS (SELECT slice, row_, col_, list_transform(v, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS v FROM ax)"


@query(f"WITH {AXES_SQL}, {SIGNAL_SQL}, g AS (SELECT CAST(s AS INT) AS slice, CAST(r AS INT) AS row_, CAST(c AS INT) AS col_ FROM range((SELECT max(slice) + 1 FROM ax)) a(s), range((SELECT max(row_) + 1 FROM ax)) b(r), range((SELECT max(col_) + 1 FROM ax)) d(c)), f AS (SELECT g.*, coalesce(v, list_transform(range(64), lambda i: 0.0)) AS v FROM g LEFT JOIN sg USING (slice, row_, col_)) SELECT {VOX}, round((v[1] + v[6]) / 2, 6) + 0.0 AS s0, 62 AS n, round(v[2], 6) + 0.0 AS first, round(v[64], 6) + 0.0 AS last, round(list_sum(v) - v[1] - v[6], 6) + 0.0 AS total FROM f")
def signal_round_trip(spark, sf):
    """A 4D signal image written, read and split in baselines (two of them) and signal."""
    at = folder(spark, "signal")
    e = field(spark, sf).join(embeddings(spark, sf).select("vec_id", V.doubles("embedding").alias("x")), "vec_id")
    images.write_volumes(e.select(F.lit("dw").alias("volume"), "slice", "row", "col", "x"), "x", at)
    s = images.split_baseline(images.read_nifti(spark, at), [0, 5])
    rows = s.select("slice", "row", "col", "s0", F.size("dw").alias("n"), F.element_at("dw", 1).alias("first"), F.element_at("dw", -1).alias("last"), V.total(F.col("dw")).alias("total"))
    return rounded(rows, "s0", "first", "last", "total")


def unit_sql(v: str, i: int) -> str:
    return f"{v}[{i}] / {NORM.format(v)}"


@query(f"WITH {AXES_SQL}, t AS (SELECT {VOX}, 0 AS k, 0.6 AS f, a AS x FROM ax UNION ALL SELECT {VOX}, 1, 0.4, b FROM ax), s AS (SELECT slice, \"row\", col, k, CAST(CAST(f AS FLOAT) AS DOUBLE) AS f, {', '.join(f'CAST(CAST({unit_sql(chr(120), i)} AS FLOAT) AS DOUBLE) AS u{i}' for i in (1, 2, 3))}, {', '.join(f'CAST(CAST(f * {unit_sql(chr(120), i)} AS FLOAT) AS DOUBLE) AS p{i}' for i in (1, 2, 3))} FROM t) SELECT 'set' AS kind, slice, \"row\", col, k, round(f, 5) AS fraction, {', '.join(f'round(u{i}, 5) + 0.0 AS d{i}' for i in (1, 2, 3))} FROM s UNION ALL SELECT 'peaks', slice, \"row\", col, k, round(sqrt(p1*p1 + p2*p2 + p3*p3), 5), {', '.join(f'round(p{i} / sqrt(p1*p1 + p2*p2 + p3*p3), 5) + 0.0' for i in (1, 2, 3))} FROM s UNION ALL SELECT 'legacy', slice, \"row\", col, k, round(sqrt(p1*p1 + p2*p2 + p2*p2), 5), {', '.join(f'round(p{i} / sqrt(p1*p1 + p2*p2 + p3*p3), 5) + 0.0' for i in (1, 2, 3))} FROM s")
def field_images(spark, sf):
    """A field as counts, fractions and axes, and as one image of peaks (with both ways to measure them), written and read."""
    at = folder(spark, "field")
    f = field(spark, sf)
    fields.write_field_set(f, at)
    fields.write_peaks(f, at)
    whole = fields.read_field_set(spark, *[f"{at}/field_{p}.nii" for p in ("counts", "fractions", "axes")])
    found = {"set": whole, "peaks": fields.read_peaks(spark, f"{at}/peaks.nii"), "legacy": fields.read_peaks(spark, f"{at}/peaks.nii", legacy=True)}
    out = None
    for kind, rows in found.items():
        one = rows.select(F.lit(kind).alias("kind"), "slice", "row", "col", F.posexplode("compartments").alias("k", "c"))
        one = one.select("kind", "slice", "row", "col", "k", F.round("c.fraction", 5).alias("fraction"), *[(F.round(F.element_at("c.dir", i), 5) + F.lit(0.0)).alias(f"d{i}") for i in (1, 2, 3)])
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {AXES_SQL}, t AS (SELECT {VOX}, vec_id, 0 AS k, v[1] AS f, v FROM ax UNION ALL SELECT {VOX}, vec_id, 1, v[2], v FROM ax), r AS (SELECT slice, \"row\", col, k, f, v[11 + k * 9:19 + k * 9] AS r, vec_id FROM t), q AS (SELECT slice, \"row\", col, k, round(f, 9) + 0.0 AS fraction, round(r[2], 9) + 0.0 AS r2, round(r[4], 9) + 0.0 AS r4, round(r[9], 9) + 0.0 AS r9, CAST(vec_id % 3 AS INT) AS seg, 5 AS atoms FROM r) SELECT 'text' AS kind, * FROM q UNION ALL SELECT 'binary', * FROM q UNION ALL SELECT 'slice', * FROM q WHERE slice = 0")
def field_files(spark, sf):
    """A field of two compartments and five atoms a voxel as text, as binary and one slice of it as text, written and read."""
    v = V.doubles("embedding")
    made = lambda k: F.struct(F.element_at(v, k + 1).alias("fraction"), F.slice(v, 11 + 9 * k, 9).alias("rotation"), F.array(F.lit(3e-4), F.lit(3e-4), F.lit(1.7e-3)).alias("lambda"), F.pmod("vec_id", F.lit(3)).cast("int").alias("seg"))
    atom = lambda k: F.struct(F.element_at(v, k + 1).alias("alpha"), F.slice(v, k + 1, 3).alias("dir"), F.lit(k).alias("grp"))
    place = field(spark, sf).select("vec_id", "slice", "row", "col")
    f = embeddings(spark, sf).join(place, "vec_id").select("vec_id", "slice", "row", "col", F.array(made(0), made(1)).alias("compartments"), F.array(*[atom(k) for k in range(5)]).alias("atoms"))
    at = folder(spark, "fields")
    fields.write_field(f.withColumn("name", F.lit("field.txt")), f"{at}/text")
    fields.write_field(f.withColumn("name", F.lit("field.bin")), f"{at}/binary", binary=True)
    fields.write_slice_text(f, 0, f"{at}/slice", "one")
    out = None
    for kind in ("text", "binary", "slice"):
        rows = texts.read_field(spark, f"{at}/{kind}").where(F.size("compartments") > 0)
        rows = rows.select(F.lit(kind).alias("kind"), "slice", "row", "col", F.size("atoms").alias("atoms"), F.posexplode("compartments").alias("k", "c"))
        at9 = lambda c: F.round(c, 9) + F.lit(0.0)
        one = rows.select("kind", "slice", "row", "col", "k", at9(F.col("c.fraction")).alias("fraction"), *[at9(F.element_at("c.rotation", i)).alias(f"r{i}") for i in (2, 4, 9)], F.col("c.seg").alias("seg"), "atoms")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {AXES_SQL} SELECT vec_id, " + ", ".join(f"floor(v[{i}] * 1000 + 0.5) + 0.0 AS {n}" for i, n in ((1, "fraction"), (3, "r2"), (5, "r4"), (13, "l3"))) + " FROM ax")
def tensor_files(spark, sf):
    """Single tensors (of whole numbers, which the lines hold exactly) as lines of text, written and read."""
    v = F.transform(V.doubles("embedding"), lambda x: F.floor(x * 1000 + 0.5).cast("double"))
    t = embeddings(spark, sf).select("vec_id", F.element_at(v, 1).alias("fraction"), F.slice(v, 2, 9).alias("rotation"), F.slice(v, 11, 3).alias("lambda"))
    at = folder(spark, "tensors")
    texts.tensor_lines(t, "vec_id").select(F.concat_ws("|", "vec_id", "line").alias("value")).write.text(at)
    lines = spark.read.text(at).select(F.substring_index("value", "|", 1).cast("bigint").alias("vec_id"), F.substring_index("value", "|", -1).alias("line"))
    rows = texts.parse_tensor_lines(lines)
    return rows.select("vec_id", *[(c + F.lit(0.0)).alias(n) for n, c in (("fraction", F.col("fraction")), ("r2", F.element_at("rotation", 2)), ("r4", F.element_at("rotation", 4)), ("l3", F.element_at("lambda", 3)))])


@query(f"WITH e AS ({VEC_SQL}), x AS (SELECT vec_id, p AS pos, v[p] AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS p FROM e)) SELECT 'matrix' AS what, row_number() OVER (ORDER BY vec_id) - 1 AS i, CAST(floor(x * 1000 + 0.5) AS DOUBLE) AS x FROM x WHERE pos = 3 UNION ALL SELECT 'array', row_number() OVER (ORDER BY vec_id) - 1, CAST(floor(x * 1000 + 0.5) AS DOUBLE) FROM x WHERE pos = 1 UNION ALL SELECT 'frequencies', bucket, CAST(freq AS DOUBLE) FROM h".replace("WITH e", HIST_SQL + ", e"))
def text_numbers(spark, sf):
    """A matrix, an array and a histogram as text, written and read."""
    v = V.doubles("embedding")
    e = embeddings(spark, sf)
    thousand = lambda c: F.floor(c * 1000 + 0.5).cast("double")
    at = folder(spark, "matrix")
    files.save_matrix(e.select("vec_id", F.transform(v, thousand).alias("x")), "vec_id", "x", f"{at}/m")
    files.save_matrix(e.select("vec_id", F.array(thousand(F.element_at(v, 1))).alias("x")), "vec_id", "x", f"{at}/a", "%E")
    files.save_frequencies(S.histogram(read(spark, sf, "events"), "value", 100), f"{at}/h")
    matrix = files.read_matrix(spark, f"{at}/m").select(F.lit("matrix").alias("what"), "i", F.element_at("x", 3).alias("x"))
    array = files.read_array(spark, f"{at}/a").select(F.lit("array").alias("what"), "i", "x")
    counts = files.read_matrix(spark, f"{at}/h").select(F.lit("frequencies").alias("what"), "i", F.element_at("x", 2).alias("x"))
    return matrix.unionByName(array).unionByName(counts)


@query("SELECT p_partkey, array_to_string(list_concat(range(p_partkey % 7, p_partkey % 7 + 5, 2), [19]), ',') AS picked FROM part")
def index_lists(spark, sf):
    """Index lists such as [2..6(2),$] of twenty places."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "picked": [",".join(map(str, images.int_list(f"[{k % 7}..{k % 7 + 4}(2), $]", 20))) for k in pdf["p_partkey"]]})

    return read(spark, sf, "part").select("p_partkey").mapInPandas(run, "p_partkey bigint, picked string")


@query(f"WITH e AS ({VEC_SQL}), t AS (SELECT vec_id, p, v[3 * p + 1:3 * p + 3] AS x FROM (SELECT vec_id, v, unnest(range(vec_id % 20 + 1)) AS p FROM e)) SELECT vec_id AS track, p AS place, " + ", ".join(f"round(CAST(CAST(x[{i + 1}] AS FLOAT) AS DOUBLE), 6) + 0.0 AS {n}" for i, n in enumerate("xyz")) + " FROM t")
def track_files(spark, sf):
    """Tracks of one to twenty points, a file for every hundred, written and read with their properties."""
    import numpy as np
    import pandas as pd

    v = V.doubles("embedding")
    e = embeddings(spark, sf).select("vec_id", F.floor(F.col("vec_id") / 100).alias("file"), F.slice(v, 1, ((F.pmod("vec_id", F.lit(20)) + 1) * 3).cast("int")).alias("x"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        content = images.encode_tracks([np.asarray(x, float).reshape(-1, 3) for x in pdf["x"]], {"first": str(pdf["vec_id"].iloc[0])})
        return pd.DataFrame({"name": [f"{pdf['file'].iloc[0]}.tck"], "content": [content]})

    at = folder(spark, "tracks")
    files.write_files(e.groupBy("file").applyInPandas(pack, "name string, content binary"), at)
    rows = images.read_tracks(spark, at).select((F.col("track_id") + F.col("properties")["first"].cast("bigint")).alias("track"), F.posexplode("points").alias("place", "p"))
    return rounded(rows.select("track", F.col("place").cast("bigint").alias("place"), "p.x", "p.y", "p.z"), "x", "y", "z")


@query(f"WITH {AXES_SQL}, d AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, vec_id, CASE WHEN vec_id % 9 = 0 THEN [0.0, 0.0, 0.0] ELSE list_transform(a, lambda x: floor(x * 1000 + 0.5)) END AS a FROM ax) SELECT CAST(idx AS INT) AS idx, vec_id % 9 = 0 AS is_s0, CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE round(a[1] / {NORM.format('a')}, 6) + 0.0 END AS x, CASE WHEN vec_id % 9 != 0 THEN round(atan2(a[2], a[1]), 6) + 0.0 END AS azimuth, CASE WHEN vec_id % 9 != 0 THEN round(acos(a[3] / {NORM.format('a')}), 6) + 0.0 END AS elevation FROM d")
def scheme_files(spark, sf):
    """A gradient scheme as text: baselines told from directions, those made unit, and azimuth and elevation where b > 0."""
    v = F.slice(V.doubles("embedding"), 1, 3)
    base = F.pmod("vec_id", F.lit(9)) == 0
    x = F.when(base, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.transform(v, lambda t: F.floor(t * 1000 + 0.5).cast("double")))
    b = F.concat(x, F.array(F.when(base, 0.0).otherwise(1500.0)))
    at = folder(spark, "scheme")
    rows = embeddings(spark, sf).select("vec_id", b.alias("b")).coalesce(1)
    files.number_lines(rows, "vec_id", "b").orderBy("vec_id").coalesce(1).select("line").write.text(at)
    scheme = texts.read_scheme(spark, at).select("idx", "is_s0", F.when(F.col("is_s0"), 0.0).otherwise(F.col("x")).alias("x"))
    order = F.row_number().over(S.Window.orderBy("idx")) - 1
    found = texts.read_b_scheme(spark, at).select("idx", "azimuth", "elevation")
    live = scheme.where("not is_s0").select(F.col("idx").alias("at"), order.alias("idx")).join(found, "idx").drop("idx").withColumnRenamed("at", "idx")
    return rounded(scheme.join(live, "idx", "left"), "x", "azimuth", "elevation")


@query("SELECT p.r_regionkey * 1000 + q.n_nationkey AS id, CASE WHEN (p.r_regionkey + q.n_nationkey) % 3 = 0 THEN 0 WHEN q.n_regionkey = p.r_regionkey THEN 255 ELSE 127 END AS code, c.pairs, c.zeroes, c.positives, c.negatives, c.counted FROM region p, nation q, (SELECT count(*) AS pairs, count(*) FILTER (code = 0) AS zeroes, count(*) FILTER (code = 255) AS positives, count(*) FILTER (code = 127) AS negatives, count(*) FILTER (code != 0) AS counted FROM (SELECT CASE WHEN (p.r_regionkey + q.n_nationkey) % 3 = 0 THEN 0 WHEN q.n_regionkey = p.r_regionkey THEN 255 ELSE 127 END AS code FROM region p, nation q)) c")
def pair_mask_files(spark, sf):
    """A mask of pairs (none, match or not) as a file, written and read, with its counts."""
    r = [x[0] for x in read(spark, sf, "region").orderBy("r_regionkey").select("r_regionkey").collect()]
    n = [tuple(x) for x in read(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()]
    codes = bytes(0 if (i + k) % 3 == 0 else 255 if g == i else 127 for i in r for k, g in n)
    at = folder(spark, "mask")
    files.write_files(spark.createDataFrame([("pairs.mask", bytearray(files.format_pair_mask(len(r), len(n), codes)))], "name string, content binary"), at)
    rows = files.read_pair_mask(spark, at)
    return rows.join(F.broadcast(S.mask_counts(rows))).select((F.col("i") * 1000 + F.col("j")).alias("id"), "code", "pairs", "zeroes", "positives", "negatives", "counted")


@query("SELECT n_nationkey, n_name AS named, CAST(n_nationkey AS DOUBLE) / 4 AS rate, n_regionkey AS many, n_regionkey % 2 = 1 AS flag, 1 AS warnings FROM nation")
def settings_files(spark, sf):
    """Settings with comments and an unknown name, parsed by kind; and written again."""
    import pandas as pd

    kinds = {"named": str, "rate": float, "many": int, "flag": bool}

    def run(batches):
        for pdf in batches:
            rows = []
            for k, name, g in zip(pdf["n_nationkey"], pdf["n_name"], pdf["n_regionkey"], strict=True):
                text = f"# settings of a nation\nnamed {name}\nrate {k / 4} # a quarter\nmany {g}\nflag {'true' if g % 2 else 'false'}\nother 3\n"
                values, _ = texts.parse_settings(text, kinds)
                again, warnings = texts.parse_settings(texts.format_settings(values | {"other": 3}), kinds)
                rows.append((k, again["named"], again["rate"], again["many"], again["flag"], len(warnings)))
            yield pd.DataFrame(rows, columns=["n_nationkey", "named", "rate", "many", "flag", "warnings"])

    return read(spark, sf, "nation").mapInPandas(run, "n_nationkey int, named string, rate double, many int, flag boolean, warnings int")


@query("SELECT n_nationkey, 1 AS kind, n_nationkey + 1 AS nx, 2 AS ny, n_regionkey + 1 AS nz, 16 AS datatype, 4 * 1 AS nbyper, (n_nationkey + 1) * 2 * (n_regionkey + 1) AS nvox, n_name AS noted, 2 AS extensions FROM nation")
def image_headers(spark, sf):
    """Headers of images of many extents: what the file is, its fields as text and back, and its extensions."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for k, name, g in zip(pdf["n_nationkey"], pdf["n_name"], pdf["n_regionkey"], strict=True):
                raw = images.encode_nifti(np.zeros((k + 1, 2, g + 1), "f4"), more=((6, name.encode()), (4, b"<x>" * 20)))
                h = images.parse_header_text(images.header_text(images.parse_nifti_header(raw)))
                found = images.extensions(raw)
                rows.append((k, images.sniff(raw), *[int(h[n]) for n in ("nx", "ny", "nz", "datatype", "nbyper", "nvox")], found[0][1].decode(), len(found)))
            yield pd.DataFrame(rows, columns=["n_nationkey", "kind", "nx", "ny", "nz", "datatype", "nbyper", "nvox", "noted", "extensions"])

    return read(spark, sf, "nation").mapInPandas(run, "n_nationkey int, kind int, nx int, ny int, nz int, datatype int, nbyper int, nvox int, noted string, extensions int")


@query(f"WITH {GRID_SQL}, s AS (SELECT slice, row_, col_, v FROM full_) SELECT {VOX}, round((v + CAST(CAST(v * 2 AS FLOAT) AS DOUBLE)) / 2, 4) AS mean, round(v, 4) AS s0, round(CAST(CAST(v * 2 AS FLOAT) AS DOUBLE), 4) AS dw, CAST(v > 1000 AS INT) AS masked FROM s")
def volume_sets(spark, sf):
    """Several 3D images: averaged, stacked to a signal by a list of names, and a mask volume of bits."""
    at = folder(spark, "set")
    rows = lattice(spark, sf)
    images.write_volumes(rows.select(F.lit("a").alias("volume"), "slice", "row", "col", "v"), "v", at)
    images.write_volumes(rows.select(F.lit("b").alias("volume"), "slice", "row", "col", (F.col("v") * 2).alias("v")), "v", at)
    voxels = images.read_nifti(spark, at)
    key = ["slice", "row", "col"]
    mean = images.average_volumes(voxels).select(*key, F.round(F.element_at("values", 1), 4).alias("mean"))
    stack = images.stack_volumes(voxels, ["a.nii", "b.nii"], [0]).select(*key, F.round("s0", 4).alias("s0"), F.round(F.element_at("dw", 1), 4).alias("dw"), F.col("s0").alias("raw"))
    bits = stack.withColumn("bits", F.when(F.col("raw") > 1000, 12).otherwise(4))
    masked = images.mask_volume(bits, "bits", 8, 8).withColumnRenamed("on", "masked")
    return mean.join(stack.drop("raw"), key).join(masked, key)


@query("SELECT 'all' AS what, 3 AS n UNION ALL SELECT 'pattern', 2 UNION ALL SELECT 'one', 1 UNION ALL SELECT 'there', 1 UNION ALL SELECT 'absent', 0 UNION ALL SELECT 'made', 1 UNION ALL SELECT 'listed', 3")
def file_listings(spark, sf):
    """Files of a folder by pattern, names listed in a file, and whether files and folders are there."""
    at = folder(spark, "listing")
    files.write_files(spark.createDataFrame([(n, n) for n in ("One.txt", "two.TXT", "three.nii")], "name string, content string"), at)
    files.write_files(spark.createDataFrame([("names", "One.txt two.TXT\n  three.nii\n")], "name string, content string"), f"{at}-list")
    count = lambda pattern: files.list_files(spark, at, pattern).count()
    rows = [("all", count("*")), ("pattern", count("*.txt")), ("one", count("t??.txt")), ("there", int(files.exists(spark, f"{at}/One.txt"))), ("absent", int(files.exists(spark, f"{at}/none"))), ("made", int(files.make_dir(spark, f"{at}/new"))), ("listed", texts.read_names(spark, f"{at}-list").count())]
    return spark.createDataFrame(rows, "what string, n int")


@query(f"WITH {AXES_SQL}, o AS (SELECT vec_id, slice, row_, col_, list_transform(v[1:8], lambda x: CASE WHEN x > 0.2 * list_max(v[1:8]) THEN x ELSE 0 END) AS w, list_max(v[1:8]) > 0 AS live FROM ax) SELECT {VOX}, 40 AS n, 1.0 AS total FROM o WHERE live AND vec_id % 4 != 0 UNION ALL SELECT {VOX}, 40, 0.0 FROM o WHERE live AND vec_id % 4 = 0")
def odf_fields(spark, sf):
    """Orientation distributions of coefficients on forty directions, scaled to sum 1, zeros for a voxel without any."""
    v = F.slice(V.doubles("embedding"), 1, 8)
    e = field(spark, sf).join(embeddings(spark, sf).select("vec_id", v.alias("alpha")), "vec_id").where(F.array_max("alpha") > 0)
    rows = e.withColumn("alpha", F.when(F.pmod("vec_id", F.lit(4)) != 0, F.col("alpha")))
    odf = fields.odf_of_alpha(rows, generate.sphere(40), generate.sphere(8))
    return odf.select("slice", "row", "col", F.size("odf").alias("n"), F.round(V.total(F.col("odf")), 6).alias("total"))


@query("WITH c AS (SELECT n_regionkey AS r, n_nationkey % 3 AS k, round(avg(n_nationkey * 1.5), 4) AS value FROM nation GROUP BY ALL), b AS (SELECT r, k, value FROM c ORDER BY value, r, k LIMIT 1) SELECT c.r, round(max(value) FILTER (c.k = 0), 4) AS c0, round(max(value) FILTER (c.k = 1), 4) AS c1, round(max(value) FILTER (c.k = 2), 4) AS c2, (SELECT value FROM b) AS best, (SELECT r FROM b) AS best_row, (SELECT k FROM b) AS best_column FROM c GROUP BY c.r")
def result_tables(spark, sf):
    """A table of results by row and column headers, and the cell of the least value."""
    n = read(spark, sf, "nation")
    cells = n.groupBy(F.col("n_regionkey").alias("r"), (F.col("n_nationkey") % 3).alias("k")).agg(F.round(F.avg(F.col("n_nationkey") * 1.5), 4).alias("value"))
    table = files.result_table(cells, "r", "k", "value", [0, 1, 2])
    best = files.best_cell(cells, "r", "k", "value").toDF("best", "best_row", "best_column")
    return table.select("r", *[F.col(str(i)).alias(f"c{i}") for i in range(3)]).join(F.broadcast(best))

