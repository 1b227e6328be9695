"""H11 colour form per pillar and for the run; reports written by several tasks."""
import glob

from fairgauge.operators import policy as po
from fairgauge.operators.reweigh import reweigh_table
from fairgauge.sources.files import read_report, write_report


def test_colour_of_each_pillar_and_of_the_run(spark):
    rows = [("MAP", "PASS")] * 17 + [("MAP", "FAIL")] * 3 + [("MEASURE", "PASS"), ("MEASURE", "WARN")] + [("GOVERN", "FAIL")] * 2
    gates = spark.createDataFrame(rows, "pillar string, status string")
    got = {r.pillar: (r.passed, r.total, r.colour) for r in po.pillar_colours(gates).collect()}
    assert got == {"MAP": (17, 20, "green"), "MEASURE": (1, 2, "amber"), "GOVERN": (0, 2, "red"), "ALL": (18, 24, "amber")}


def test_colour_of_no_gates(spark):
    none = spark.createDataFrame([], "pillar string, status string")
    assert all(r.pillar == "ALL" and r.total == 0 for r in po.pillar_colours(none).collect())


def test_reports_are_written_in_parallel_unless_asked(spark, tmp_path):
    df = spark.range(0, 40, 1, 4)
    write_report(df, str(tmp_path / "many"))
    write_report(df, str(tmp_path / "one"), single_file=True)
    assert len(glob.glob(str(tmp_path / "many" / "*.json"))) == 4 and len(glob.glob(str(tmp_path / "one" / "*.json"))) == 1
    for name in ("many", "one"):
        assert sorted(r.id for r in read_report(spark, str(tmp_path / name), df.schema).collect()) == list(range(40))


def test_reweighing_with_very_many_labels(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "id % 1500 AS label")
    got = reweigh_table(df, "g").collect()
    assert len(got) == 1500 and all(abs(r.weight - 1 / 3) < 1e-12 for r in got)
