"""Named key columns, older column names, default keys and summaries of report folders."""

import csv

import pytest

from wellframe.operators import keys, latent
from wellframe.plans import workflows
from wellframe.sources import tables


@pytest.fixture(scope="module")
def plates(spark):
    return spark.createDataFrame([("old", "A01", "P1", "b2", 1.0), ("old", None, "P2", None, 2.0)], "Metadata_Plate string, well string, Barcode string, Pos string, Compound double")


def test_named_columns_become_keys_and_the_old_values_stay(plates):
    out, report = tables.explicit_keys(plates, plate="barcode", well=" POS ", source_plate="metadata_plate")
    rows = sorted((r["Metadata_Plate"], r["Metadata_Well"], r["Metadata_Source_Plate"], r["Metadata_Plate__before_explicit_override"], r["Metadata_Plate__raw"]) for r in out.collect())
    assert rows == [("P1", "b2", "old", "old", "P1"), ("P2", None, "old", "old", "P2")]
    assert {tuple(r) for r in report.collect()} == {
        ("Metadata_Plate", "Barcode", "set_from_explicit_column", 2), ("Metadata_Well", "Pos", "set_from_explicit_column", 1),
        ("Metadata_Source_Plate", "Metadata_Plate", "set_from_explicit_column", 2), ("Metadata_Source_Well", "", "not_requested", 0),
    }
    same, report = tables.explicit_keys(plates)
    assert same.columns == plates.columns and {r["n_non_missing"] for r in report.collect()} == {0}
    with pytest.raises(ValueError):
        tables.explicit_keys(plates, well="nowhere")
    assert [r["n_non_missing"] for r in tables.explicit_keys(plates.limit(0), well="pos")[1].where("action <> 'not_requested'").collect()] == [0]


def test_prepared_metadata_has_older_names_and_says_what_it_did(plates):
    made = workflows.prepare_metadata(plates, "plates", plate="Barcode", well="Pos", require_keys=True)
    rows = sorted((r["Plate_Metadata"], r["Well_Metadata"] or "", r["cpd_id"]) for r in made.data.collect())
    assert rows == [("P1", "B02", 1.0), ("P2", "", 2.0)]
    summary = made.audits["summary"].first()
    assert (summary["table_label"], summary["n_rows"], summary["has_Metadata_Well"], summary["has_Metadata_Source_Well"], summary["has_cpd_id"]) == ("plates", 2, True, False, True)
    assert ("Metadata_Compound", "Compound") in {tuple(r) for r in made.audits["aliases"].collect()}
    with pytest.raises(keys.KeyProblem):
        workflows.prepare_metadata(plates.drop("well"), require_keys=True)
    assert tables.source_like_keys([("Metadata_Plate", "Source_Plate"), ("Metadata_Well", "sw2"), ("Metadata_Well", "well"), ("Metadata_Source_Well", "sw")]) == [("Metadata_Plate", "Source_Plate"), ("Metadata_Well", "sw2")]


def test_default_keys_of_combined_tables():
    assert keys.combined_keys([["Metadata_Well", "x"], ["ImageNumber", "Metadata_Profile_Source"]]) == ["Metadata_Profile_Source", "ImageNumber", "Metadata_Well"]
    assert keys.combined_keys([["a", "b"]], ["b", "b", "c"]) == ["b"]


def write(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / f"{name}.tsv", "w", newline="") as f:
        csv.writer(f, delimiter="\t").writerows([header, *rows])


def test_strategies_are_ranked_by_their_report_folders(spark, tmp_path):
    good, bad, bare = tmp_path / "robust + batch", tmp_path / "plain", tmp_path / "bare"
    for folder, status, controls, median, eta in ((good, "ok", ["ok", "OK"], 0.6, 0.1), (bad, "ok", ["ok", "missing_controls"], 0.2, 0.5)):
        write(folder, "preprocessing_summary", ["item", "value"], [("n_rows_input", 200), ("n_rows_passing_qc", 150), ("n_features_input", 40), ("n_features_after_correlation_filter", 10), ("method", "robust")])
        write(folder, "final_matrix_validation", ["check", "status"], [("finite", status), ("rows", status)])
        write(folder, "control_qc_before_normalisation", ["plate", "status"], list(enumerate(controls)))
        write(folder, "before_after_replicate_summary", ["stage", "group", "median_correlation"], [("input", "g", 0.9), ("after_batch_correction", "g", median - 0.1), ("after_batch_correction", "h", median + 0.1), ("after_batch_correction", "i", "")])
        write(folder, "before_after_batch_pc_association", ["stage", "metadata_column", "component", "status", "eta_squared"],
              [("after_batch_correction", "Metadata_Plate", "PC1", "tested", eta - 0.05), ("after_batch_correction", "Metadata_Plate", "PC2", "tested", eta + 0.05), ("input", "Metadata_Plate", "PC1", "tested", 0.99),
               ("after_batch_correction", "Metadata_Plate", "PC3", "too_few", ""), ("after_batch_correction", "Metadata_Compound", "PC1", "tested", 0.3)])
    write(bare, "final_matrix_validation", ["check", "status"], [("finite", "not_finite"), ("rows", "ok")])
    got = {r["strategy"]: r for r in latent.summarise_strategies(spark, str(tmp_path)).collect()}
    assert set(got) == {"robust + batch", "plain", "bare"}
    g, b, e = got["robust + batch"], got["plain"], got["bare"]
    assert abs(g["score"] - (2 + 1 + 0.8 + 0.9 + 0.3)) < 1e-9 and g["recommendation"] == "candidate_strategy" and g["rank"] == 1
    assert abs(b["score"] - (2 + 0 + 0.6 + 0.5 + 0.3)) < 1e-9 and b["recommendation"] == "review_reference_controls" and b["rank"] == 2
    assert (e["score"], e["matrix_status"], e["control_status"], e["recommendation"], e["rows_input"]) == (0.0, "not_finite;ok", "not_reported", "do_not_use_matrix_not_ok", None)
    assert (g["rows_retained"], g["features_retained"], b["control_status"]) == (0.75, 0.25, "review")
    # the same folder as Parquet, by the workflow that also writes
    for name in latent.STRATEGY_REPORTS.values():
        spark.read.csv(str(good / f"{name}.tsv"), sep="\t", header=True).write.parquet(str(tmp_path / "other" / "s" / f"{name}.parquet"))
    made = workflows.strategy_summary(spark, str(tmp_path / "other"), path=str(tmp_path / "out.tsv")).data.collect()
    assert [(r["strategy"], round(r["score"], 9)) for r in made] == [("s", 5.0)]
    assert spark.read.csv(str(tmp_path / "out.tsv"), sep="\t", header=True).count() == 1
    assert latent.summarise_strategies(spark, str(tmp_path / "nothing")).count() == 0
