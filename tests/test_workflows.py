"""Sources, keys and workflows on small folders and frames with known results."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellframe.functions import stats, text
from wellframe.operators import diagnostics, distance, keys, latent, models, moa, preprocess, profiles, qc, synthetic
from wellframe.plans import workflows
from wellframe.sources import tables
from wellframe.streaming import drift


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Image.csv").write_text("﻿ImageNumber,Plate_Metadata,Well_Metadata,Mean_Intensity_DAPI\n1,P1,A1,0.5\n2,P1,a02,0.7\n1,P2,A001,0.1\n")
    with gzip.open(tmp_path / "Cells.tsv.gz", "wt") as f:
        f.write("ImageNumber\tObjectNumber\tMetadata_Plate\tAreaShape_Area\tExecutionTime_01\n1\t1\tP1\t1\t9\n1\t2\tP1\t3\t9\n1\t1\tP2\t11\t9\n1\t2\tP2\t13\t9\n")
    (tmp_path / "platemap.tsv").write_text("Plate_Metadata\tWell_Metadata\tCompound\nP1\tA01\tx\nP2\tA01\ty\n")
    (tmp_path / "._hidden.csv").write_text("a\n")
    return str(tmp_path)


def test_build_profiles_from_folder(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in tables.discover(folder)] == ["Cells.tsv.gz", "Image.csv", "platemap.tsv"]
    roles = {r["path"].rsplit("/", 1)[1]: r["role"] for r in tables.inspect_folder(spark, folder).collect()}
    assert roles == {"Cells.tsv.gz": "object", "Image.csv": "image", "platemap.tsv": "metadata"}
    built = workflows.build_profiles(spark, folder)
    got = {(r["Metadata_Plate"], r["Metadata_Well"]): r for r in built.data.collect()}
    assert got["P1", "A01"]["Cells__AreaShape_Area"] == 2.0 and got["P2", "A01"]["Cells__AreaShape_Area"] == 12.0
    assert got["P1", "A02"]["Cells__AreaShape_Area"] is None and got["P1", "A01"]["Cells__n_objects"] == 2
    assert got["P2", "A01"]["Compound"] == "y" and got["P1", "A02"]["Compound"] is None
    assert built.audits["platemap_unmatched"].first()[0] == 1
    assert "Cells__ExecutionTime_01" not in built.data.columns
    with pytest.raises(FileNotFoundError):
        tables.discover(folder + "/none")


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for name in ("t.parquet", "t.tsv", "t.tsv.gz"):
        tables.write_table(df, str(tmp_path / name), single=True)
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "t.csv"))
    assert "&lt;b&gt;" in tables.html_report("t", {"x": spark.createDataFrame([("<b>",)], "v string")}, warnings=["w"])
    tables.save_config({"a": 1}, str(tmp_path / "c.json"))
    assert tables.load_config(str(tmp_path / "c.json")) == {"a": 1}
    assert tables.parse_list("a, b;;c\n") == ["a", "b", "c"] and tables.parse_list(" ") is None


def test_duplicate_policies(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 1, None), ("B", 2, "y"), (None, 3, "z")], "k string, v int, w string")
    with pytest.raises(keys.KeyProblem):
        keys.collapse_duplicates(df, ["k"], "error")
    assert {r["k"]: r["w"] for r in keys.collapse_duplicates(df, ["k"], "identical").collect()} == {"A": "x", "B": "y", None: "z"}
    with pytest.raises(keys.KeyProblem):
        keys.collapse_duplicates(df.withColumn("v", F.monotonically_increasing_id()), ["k"], "identical")
    assert keys.collapse_duplicates(df, ["k"], "first", ["w"]).count() == 3
    joined = keys.join_checked(df, spark.createDataFrame([(None, 9), ("A", 8)], "k string, v int"), ["k"], "map")
    assert {(r["k"], r["map__v"]) for r in joined.collect()} == {("A", 8), ("B", None), (None, 9)}


def test_wells(spark):
    df = spark.createDataFrame([(w,) for w in ("A1", "a01", "A001", "AA1", " ", None, "control")], "w string")
    got = [tuple(r) for r in df.select(text.canonical_well(F.col("w")), text.plate_well(F.col("w")), text.plate_row(F.col("w")), text.plate_column(F.col("w"))).collect()]
    assert got == [("A01", "A01", "A", 1)] * 3 + [("AA1", "AA01", "AA", 1), ("", None, None, None), (None, None, None, None), ("control", "CONTROL", None, None)]


def test_preprocess_profiles(spark):
    rng = np.random.default_rng(1)
    rows = [(f"P{i % 2}", f"A{i % 9 + 1}", "dmso" if i % 3 == 0 else "cpd", float(rng.normal()), 1.0, float(i) if i % 10 else None, float("inf") if i == 5 else float(rng.normal() * 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "Metadata_Plate string, Metadata_Well string, Metadata_Compound string, Cells_Intensity_A double, Cells_Texture_Constant double, Cells_AreaShape_B double, Nuclei_Intensity_C double")
    df = df.withColumn("Nuclei_Texture_Twin", F.col("Cells_Intensity_A") * 3)
    p = workflows.Preprocessing(reference_method="robust_z", reference_column="Metadata_Compound", reference_values=("dmso",), reference_groups=("Metadata_Plate",))
    made = workflows.preprocess_profiles(df, p)
    kept = [c for c in made.data.columns if "_" in c and not c.startswith("Metadata")]
    assert "Cells_Texture_Constant" not in kept and len({"Cells_Intensity_A", "Nuclei_Texture_Twin"} & set(kept)) == 1
    assert made.audits["validation"].first()["n_bad_values"] == 0 and made.data.count() == 60
    assert {r["feature"]: r["n_infinite"] for r in made.audits["nonfinite"].collect()}["Nuclei_Intensity_C"] == 1
    with pytest.raises(ValueError):
        preprocess.validate_matrix(df.where("false"), ["Cells_Intensity_A"])


def test_reference_rows_have_median_zero(spark):
    df = spark.createDataFrame([("a", i % 4 == 0, float(i * i)) for i in range(40)] + [("b", i == 0, float(i)) for i in range(5)], "g string, ref boolean, x double")
    got = preprocess.reference_normalise(df, ["x"], F.col("ref"), ["g"]).collect()
    assert abs(np.median([r["x"] for r in got if r["g"] == "a" and r["ref"]])) < 1e-12
    assert sorted(r["x"] for r in got if r["g"] == "b") == [0, 1, 2, 3, 4]


def test_trim_drops_the_far_object(spark):
    df = spark.createDataFrame([(i, "P", float(v), float(w)) for i, (v, w) in enumerate([(1, 1), (1.1, 1.2), (0.9, 0.8), (1.05, 0.9), (50, 60)])], "id int, g string, a double, b double")
    got = {r["id"]: r["keep_object"] for r in profiles.trim_objects(df, "id", ["g"], ["a", "b"], keep=0.8).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_knn_imputation(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.1, None), (3, 0.2, 3.0), (4, 9.0, 50.0)], "id int, a double, b double")
    got = {r["id"]: r["b"] for r in preprocess.impute_knn(df, ["a", "b"], "id", 2).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: 50.0}


def test_neighbours_and_overlap(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(30, 5)), np.ones((2, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    for metric in ("cosine", "euclidean", "cityblock"):
        got = distance.nearest(df, "id", "v", 4, metric, block=7).collect()
        assert sorted({r["rank"] for r in got}) == [1, 2, 3, 4] and len(got) == 32 * 4 and all(r["query_id"] != r["neighbour_id"] for r in got)
        assert next(r for r in got if r["query_id"] == 30 and r["rank"] == 1)["neighbour_id"] == 31
        few = distance.nearest(df.limit(3), "id", "v", 10, metric).count()
        assert few == 6
    near = distance.nearest(df, "id", "v", 4)
    same = distance.neighbour_overlap(near, near).agg(F.min("jaccard"), F.min("rbo")).first()
    assert same[0] == 1.0 and abs(same[1] - (1 - 0.9**4)) < 1e-12
    edges = distance.topology_edges(near)
    assert edges.where("source >= target").count() == 0


def test_probabilities():
    assert abs(stats.spearman_p(0.5, 20) - 0.02477) < 2e-4
    assert stats.spearman_p(1.0, 10) == 0 and stats.spearman_p(None, 10) is None
    assert abs(stats.hypergeometric_tail(2, 10, 4, 3) - 1 / 3) < 1e-12
    assert abs(stats.normal_tail(1.959964) - 0.05) < 1e-6
    assert moa.permutation_p(1.0, [0.5, 1.0, 2.0]) == 0.75


def test_models(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], *(rng.normal(size=3) + (i % 2) * 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y string, a double, b double, c double")
    scored, shares = models.run_pca(df, ["a", "b", "c"], 2)
    assert abs(scored.agg(F.avg("PC1")).first()[0]) < 1e-9 and shares[0] > 0.5
    _, summary = models.cross_validate(df, "id", ["a", "b", "c"], "y", "logistic_regression", 3)
    assert summary.first()["accuracy"] > 0.9
    v = df.withColumn("v", F.array("a", "b", "c"))
    labels = {r["id"]: r["cluster"] for r in models.dbscan(v, "id", "v", 2.5, 3).collect()}
    assert len({labels[i] for i in range(60)} - {-1}) == 2
    with pytest.raises(ValueError):
        models.classifier("extra_trees")


def test_latent(spark):
    made = synthetic.synthetic_profiles(spark, synthetic.SyntheticConfig(n_compounds=6, n_features=10))
    assert made.count() == 48
    features = {d: [c for c in made.columns if c.startswith("Cells_")] for d in ("dataset_1", "dataset_2")}
    out = workflows.latent_space(spark, {d: made.where(F.col("Dataset") == d) for d in features}, features, 3)
    assert out.audits["status"].first()[0] == "pca_fallback" and {"latent_1", "latent_2", "latent_3"} <= set(out.data.columns)
    x, y = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1]]), np.array([0, 0, 1, 1])
    assert latent.supervised_contrastive_loss(x, y) < latent.supervised_contrastive_loss(x, np.array([0, 1, 0, 1]))
    with pytest.raises(ValueError):
        latent.align_features(spark, {"one": ["a"]})


def test_streaming_summaries(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1, 2.0), ("2024-01-01 00:01:00", 1, 4.0)], "t string, image int, x double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = drift.image_summaries(stream, "t", "image", ["x"]).writeStream.outputMode("complete").format("memory").queryName("summaries").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT n_objects, x FROM summaries").first() == (2, 3.0)


def test_order_of_rows_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    other = df.orderBy(F.desc("o_totalprice")).repartition(5)
    a, b = (sorted(map(tuple, qc.outliers(x, ["o_totalprice"], ["o_orderstatus"]).select("o_orderkey", "o_totalprice_robust_z").collect())) for x in (df, other))
    assert a == b
    mw = diagnostics.two_sample_statistics(df, ["o_totalprice"], F.col("o_orderstatus") == "F").first()
    assert 0 <= mw["p_value"] <= 1 and mw["q_value"] >= mw["p_value"]


def test_bracketed_quantiles_are_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    asked = {"a": 0.05, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.999}
    plain, large = (preprocess.quantile_facts(df, features, big, **asked) for big in (False, True))
    for f in features:
        assert np.allclose([plain[f][k] for k in asked], [large[f][k] for k in asked], rtol=1e-12)
