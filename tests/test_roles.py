"""Plan-time role rules (B4-B10, G2, G3) and small helpers."""
from fairgauge.operators import roles as ro
from fairgauge.operators.score import choose_model


def test_demographic_keyword_and_fallbacks(spark):
    df = spark.createDataFrame([("1", 10.0, "m", 1)], "PassengerId string, Fare double, Sex string, Survived int")
    assert ro.demographic_column(df, "Survived") == "Sex"
    h = spark.createDataFrame([("h1", 1.0, "Rural", 2.0)], "House_ID string, SquareFeet double, Neighborhood string, Price double")
    assert ro.demographic_column(h, "Price") == "House_ID"          # first text column
    n = spark.createDataFrame([(1, 2.0, 3.0)], "a int, b double, y double")
    assert ro.demographic_column(n, "y") == "a"                      # first non-target
    assert ro.demographic_column(n, "y", "b") == "b"                  # given name wins


def test_id_rule_needs_uniqueness(spark):
    rows = [(str(i), float(i % 5), i % 2) for i in range(20)] + [("0", 0.0, 0)]
    df = spark.createDataFrame(rows, "customer_id string, charges double, churn int")
    r = ro.detect_roles(df)
    assert r.target == "churn" and r.task == "classification"
    assert r.id_columns == ()                                        # repeated row -> not unique -> kept
    u = spark.createDataFrame([(str(i), float(i % 5), i % 2, 1) for i in range(20)],
                              "customer_id string, charges double, churn int, k int")
    r2 = ro.detect_roles(u, target="churn", demographic="charges")
    assert r2.id_columns == ("customer_id",) and r2.constant_columns == ("k",)
    assert r2.categorical == ("charges",)                            # demographic is always categorical


def test_task_rules():
    assert ro.task_type(2, False) == "classification"
    assert ro.task_type(11, True) == "regression"
    assert ro.task_type(11, False) == "classification"
    assert ro.task_type(10, True) == "classification"
    assert ro.task_type(2, True, "Regression") == "regression"


def test_name_helpers():
    assert ro.ordered_unique(["b", "a", "b"]) == ["b", "a"]
    assert ro.id_name_match("record_id") and ro.id_name_match("KeyCol") and not ro.id_name_match("price")
    assert choose_model("Logistic Regression") == "linear" and choose_model("Random Forest") == "ensemble"


def test_cluster_conf_sizes_partitions():
    from fairgauge.session import cluster_conf
    c = cluster_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert cluster_conf(1 << 20, 16)["spark.sql.shuffle.partitions"] == "32"
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
