"""What larger tables showed: shared steps are computed once, and tables of rare values agree with SQL."""

import duckdb

from tallyframe.plans import queries, records, roles  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_scores_round_as_sql_does(spark, tmp_path):
    prices = [2500.0 + 5000 * k for k in range(100)]  # halves of a hundredth, where engines' round() differ
    rows = ", ".join(f"({i}::bigint, 4::bigint, 'F', {p}::double, timestamp '2024-01-01', '1-URGENT')" for i, p in enumerate(prices))
    duck = duckdb.connect()
    duck.execute(f"create table orders as select * from (values {rows}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)")
    duck.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    got = queries.QUERIES["percentile_scores"](spark, str(tmp_path)).collect()
    want = duck.execute(queries.ORACLE_SQL["percentile_scores"]).fetchall()
    assert sorted((r.id, r.percentile_score) for r in got) == sorted(want)


def test_claims_are_made_once_for_a_feature_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "role", lambda spark, sf, name, made=queries.role: seen.append(name) or made(spark, sf, name))
    plan = queries._gold(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert seen.count("claims") == 1
    assert "lineitem" not in plan and "l_orderkey" not in plan  # what is ranked and joined reads written measures


def test_rows_of_a_logit_are_written_once(spark, monkeypatch):
    plans = []
    fit_all = queries.logits.fit_all
    monkeypatch.setattr(queries.logits, "fit_all", lambda rows, *args: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fit_all(rows, *args))
    queries.QUERIES["logit_balance"](spark, SF)
    assert len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]


def test_tasks_of_wide_rows_are_bounded(spark, monkeypatch):
    from tallyframe.operators import cleaning

    monkeypatch.setattr(cleaning, "ROWS_OF_A_TASK", 100)
    df = spark.range(10_000)
    assert cleaning.dealt(df, ["id"], 10_000).rdd.getNumPartitions() == 100


def test_activity_counts_distinct_values_without_copies_of_lines(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute("create table orders as select i::bigint o_orderkey, (i % 7)::bigint o_custkey, case when i % 11 > 0 then timestamp '1995-01-15' + to_days((i * 37 % 900)::int) end o_orderdate from range(300) t(i)")
    duck.execute("create table lineitem as select (i % 280)::bigint l_orderkey, case when i % 13 > 0 then (i * 29 % 211)::bigint - 100 end l_partkey, 1::bigint l_suppkey, 1.0::double l_quantity from range(900) t(i)")
    for t in ("orders", "lineitem"):
        duck.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = roles.role(spark, str(tmp_path), "activity")
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = duck.execute(roles.ctes("activity") + " select * from activity").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
