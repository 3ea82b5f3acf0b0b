import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import auditlog
from plumbline.plans.events import EventStore
from plumbline.plans.oplog import OperationLog
from plumbline.plans.registry import Registry, export


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(i, float(i) if i % 3 else None, f" n{i} ") for i in range(12)], "_rid long, v double, s string")


def test_registry(spark, df, tmp_path):
    reg = Registry(spark, str(tmp_path))
    reg.register(df)
    reg.update_working_copy(df.limit(2))
    assert reg.get("ds_primary").count() == 2 and reg.original().count() == 12
    with pytest.raises(ValueError):
        reg.update_working_copy(df, "ds_original_p")
    assert reg.write_result(df, "clean", "ds_primary") == "ds_result_clean_v1"
    assert reg.write_result(df.limit(1), "clean", "ds_primary") == reg.latest("clean") == "ds_result_clean_v2"
    assert reg.history("cl") == ["ds_result_clean_v1", "ds_result_clean_v2"]
    assert reg.undo_last("clean") == "ds_result_clean_v1" and not reg.exists("ds_result_clean_v2") and reg.undo_last("clean") == "ds_result_clean_v1"
    assert reg.query("select count(*) as n from ds_result_clean_v1").first()["n"] == 12
    reg.create_restore_point()
    reg.update_working_copy(df)
    assert reg.profile("ds_primary", "v")["n_unique"] == 8
    reg.restore()
    assert reg.get("ds_primary").count() == 2 and reg.profile("ds_primary", "v")["n_unique"] == 1  # the profile follows the version
    assert reg.numeric_columns("ds_primary") == ["_rid", "v"] and reg.string_columns("ds_primary") == ["s"]
    reg.remove("ds_primary")
    assert not reg.exists("ds_primary") and [x["operation"] for x in reg.lineage][0] == "LOAD"


def test_events(spark, df, tmp_path):
    store = EventStore(df, every=2)
    store.apply("DROP_ROWS", {"ids": [0, 99]})
    store.apply("IMPUTE", {"columns": ["v"], "method": "mean"})
    store.apply("CUSTOM", fn=lambda d: d.withColumn("z", F.lit(1)))
    store.apply("DROP_COLS", {"columns": ["s", "nothing"]})
    assert store.materialize().columns == ["_rid", "v", "z"] and store.materialize().count() == 11
    assert store.materialize(0).count() == 12 and store.materialize(3).columns == ["_rid", "v", "s", "z"]
    assert store.rollback().columns == ["_rid", "v", "s", "z"] and store.version == 3
    with pytest.raises(ValueError):
        store.rollback(0)
    with pytest.raises(ValueError):
        store.apply("NO_SUCH")
    store.apply("LOAD", {"df": df.limit(1)})
    assert store.materialize().count() == 1
    store.export_log(str(tmp_path / "log"))
    assert len((tmp_path / "log").read_text().splitlines()) == 4
    assert store.to_origin().count() == 12 and not store.can_undo()


def test_operation_log(spark, df):
    log = OperationLog().filter("_rid", ">", 2).impute(["v"], "median").normalize(["s"]).cast("_rid", "str").sort(["v"], False).deduplicate(["v"], ["_rid"]).custom("df = df.limit(100)", lambda d: d.limit(100))
    out = log.run(df)
    names = {"spark_df": df}
    code = log.to_pyspark().replace("spark = SparkSession.builder.getOrCreate()", "df = spark_df")
    exec(code, names)  # the emitted code does what ran
    assert sorted(map(tuple, names["df"].collect())) == sorted(map(tuple, out.collect()))
    compile(log.to_pandas(), "pandas", "exec")
    assert "desc(`v`)" in log.to_r() and log.summary()["impute"] == 1 and len(json.loads(log.to_json())) == 7
    log.clear()
    assert not log.steps


def test_audit_log(spark, tmp_path, df):
    log = auditlog.AuditLog(str(tmp_path))
    log.log_load("x.csv", 10, 2, 1.23456)
    log.log_normalize("s", 3, 12, ["strip_whitespace"], 2.0, {"cohen_d": -0.5})
    log.log_benford("v", {"suspicious": True, "mad": float("nan")}, 1.0)
    with pytest.raises(ZeroDivisionError):
        log.timed("impute", lambda: 1 / 0)
    records = auditlog.read_log(spark, str(log.path))
    q = auditlog.session_quality(records).first()
    assert (q["n"], q["n_errors"], q["n_warnings"], q["quality"]) == (4, 1, 1, 87)
    r = {x["operation"]: x for x in auditlog.rollup(records).collect()}
    assert r["NORMALIZE"]["mean_abs_d"] == 0.5 and r["BENFORD"]["n_warning"] == 1
    t = auditlog.TrustScore(96)
    assert t.apply("normalize") == 100 and t.apply("x", -200) == 0
    from plumbline.operators import profile

    text = auditlog.markdown_report("Report", {"rows": 12}, log, 80, profile.before_after(df, df.withColumn("v", F.col("v") * 2)), missing=profile.missing_summary(df), samples=[{"original": "a", "normalized": "b"}], steps=["check"])
    assert "Radical change" in text and "| NORMALIZE | 1 | 0 | 0 |" in text


def test_export(spark, df, tmp_path):
    from plumbline.sources.ingest import load_file

    export(df, str(tmp_path / "a.csv"), "csv", single_file=True)
    assert (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    export(df, str(tmp_path / "a.xlsx"), "xlsx")
    export(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 12
    for name in ("a.csv", "a.xlsx"):
        back, _ = load_file(spark, str(tmp_path / name))
        assert back.columns == ["rid", "v", "s"] and back.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    with pytest.raises(ValueError):
        export(df, "x", "odt")


def test_report_health_and_readiness(spark, tmp_path):
    from plumbline.operators import profile

    log = auditlog.AuditLog(str(tmp_path))
    df = spark.createDataFrame([(i, None if i % 2 else float(i), "a") for i in range(40)], "id long, v double, s string")
    text = auditlog.markdown_report("R", {}, log, 50, profiles=profile.column_profile(df))
    assert "## Column health" in text and "| v | 50.0 | 0.0 | fair (50.0 / 100) |" in text and "ready for" not in text
    log.log_normalize("s", 3, 40, ["turkish_lower"], 1.0)
    log.log_impute("v", "mean", 20, 40, 1.0)
    text = auditlog.markdown_report("R", {}, log, 50)
    assert "Regression: values were cleaned" in text and "gaps were filled in v;" in text
