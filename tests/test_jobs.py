"""The jobs on growing copies of small tables, against one run over everything and plain loops."""

import numpy as np
import pandas as pd
import pytest

from jobs import class_report, text_profile
from jobs.common import settings
from latticeflow.operators import folds, stats

TEXTS = [(1, "one two three", "en"), (2, None, "en"), (3, "", "fr"), (4, "a\nb\nc", None), (5, "x " * 9000, "en"), (6, "été 123", "fr"), (7, "one two three", "en"), (8, "mot", "")]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def documents(spark, part):
    return spark.createDataFrame(part, "doc_id bigint, text string, lang string")


def test_two_runs_over_growing_input_equal_one(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    documents(spark, TEXTS[:4]).coalesce(1).write.parquet(source)
    text_profile.run(spark, source, out, mark)
    first = rows(text_profile.output_of(spark, out))
    text_profile.run(spark, source, out, mark)  # nothing new
    assert rows(text_profile.output_of(spark, out)) == first
    documents(spark, TEXTS[4:]).coalesce(1).write.mode("append").parquet(source)
    text_profile.run(spark, source, out, mark)
    grown = text_profile.output_of(spark, out)
    assert spark.read.parquet(f"{out}/counts").select("batch").distinct().count() == 2
    text_profile.run(spark, source, f"{out}-once", f"{mark}-once")
    assert rows(grown) == rows(text_profile.output_of(spark, f"{out}-once")) != first
    profile = {(r["lang"], r["measure"]): r for r in grown.where("bucket is null").collect()}
    assert profile["en", "texts"]["n"] == 4 and profile["en", "words"]["n"] == 3 and profile["en", "words"]["high"] == 9000
    assert profile["none", "lines"]["mean"] == 2.0 and profile["none", "texts"]["n"] == 2 and profile["fr", "chars"]["low"] == 0
    assert profile["fr", "letters_per_mille"]["high"] == 142  # one ASCII letter of seven characters


def test_a_batch_that_is_repeated_replaces_its_own_counts(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    documents(spark, TEXTS).write.parquet(source)
    text_profile.run(spark, source, out, mark)
    first = rows(text_profile.output_of(spark, out))
    text_profile.run(spark, source, out, f"{mark}-lost")  # the same batch 0 again, as after a lost commit
    assert rows(text_profile.output_of(spark, out)) == first


def test_no_files_yet(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "in"))
    text_profile.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))


def test_unknown_settings_are_refused(tmp_path):
    (tmp_path / "c.json").write_text('{"fold": 3}')
    with pytest.raises(ValueError, match="fold"):
        settings(class_report.SETTINGS, str(tmp_path / "c.json"))
    (tmp_path / "c.json").write_text('{"folds": 3}')
    assert settings(class_report.SETTINGS, str(tmp_path / "c.json"))["folds"] == 3


def vectors(n=60, dim=4):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, n)
    return pd.DataFrame({"vec_id": np.arange(n), "embedding": (rng.normal(size=(n, dim)) + label[:, None]).tolist(), "label": label})


def plain(pdf, fold, f):
    x, y = np.stack(pdf["embedding"]), pdf["label"].to_numpy()
    train = fold != f
    names = sorted(set(y[train]))
    means = np.stack([x[train & (y == c)].mean(0) for c in names])
    d = ((x[:, None] - means[None]) ** 2).sum(-1)
    return np.array(names)[d.argmin(1)], d.min(1)


def test_all_folds_at_once_equal_refitting(spark, tmp_path):
    pdf = vectors()
    pdf.loc[0, "label"] = 9  # a class that only one fold has
    pdf["fold"] = pdf["vec_id"] % 5
    spark.createDataFrame(pdf.drop(columns="fold")).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    class_report.run(spark, str(tmp_path / "in"), out)
    first = rows(class_report.output_of(spark, out))
    class_report.run(spark, str(tmp_path / "in"), out)
    assert rows(class_report.output_of(spark, out)) == first
    got = class_report.output_of(spark, out).where("vec_id is not null").toPandas().sort_values("vec_id")
    fold = pdf["fold"].to_numpy()
    for f in range(5):
        predicted, dist = plain(pdf, fold, f)
        own = got[got["fold"] == f]
        assert own["predicted"].tolist() == predicted[fold == f].tolist()
        assert np.allclose(own["dist"], dist[fold == f], atol=1e-6)
    assert got["in_sample"].tolist() == plain(pdf, fold, -1)[0].tolist()
    table = class_report.output_of(spark, out).where("vec_id is null and n > 0").toPandas()
    for r in table.itertuples():
        of = [int(((got["fold"] == f) & (got["label"] == r.label) & (got["predicted"] == r.predicted)).sum()) for f in range(5)]
        assert sum(of) == r.n and np.isclose(np.std(of, ddof=1), r.sd_n, atol=1e-6) and np.isclose(np.mean(of), r.mean_n)


def test_errors_over_folds(spark):
    found = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (1, 1, 1), (1, 2, 2)], "fold int, label int, predicted int")
    r = folds.error_over_folds(found, "label").first()
    assert (r["mean"], r["worst"], r["best"]) == (0.25, 0.5, 0.0) and np.isclose(r["sd"], np.std([0.5, 0.0], ddof=1))


def test_centroids_in_blocks(spark, monkeypatch):
    pdf = vectors()
    df = spark.createDataFrame(pdf)
    centres = stats.centroid_vectors(df, "embedding", "label")
    whole = rows(stats.nearest_centroid(df, centres, "embedding", "label", ["vec_id"]))
    monkeypatch.setattr(stats, "CENTROID_BYTES", 40)
    assert rows(stats.nearest_centroid(df, centres, "embedding", "label", ["vec_id"])) == whole


def test_peaks_of_each_group(spark):
    hist = spark.createDataFrame([(g, b, float(b), f) for g, fs in {"a": [1, 5, 1, 2, 0], "b": [0, 0, 7, 0, 0]}.items() for b, f in enumerate(fs)], "g string, bucket int, centre double, freq bigint")
    assert {r["g"]: r["bucket"] for r in stats.histogram_last_peak(hist, 1, ["g"]).collect()} == {"a": 3, "b": 2}


@pytest.mark.parametrize("name", ["job1_text_profile", "job2_class_report"])
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    import __spark_entry__
    from test_oracle import table

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours = table(__spark_entry__.queries()[name](spark, sf).toPandas())
    theirs = table(con.execute(__spark_entry__.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) > 0
    for c in ours.columns:
        same = (ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())
        if ours[c].dtype.kind == "f":
            same |= (ours[c] - theirs[c].astype(float)).abs() < 2e-6
        assert same.all(), c
