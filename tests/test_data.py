"""Checks on the driver's tables: parity with SQL, invariants, plans, stores and skew."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from marginflow.model import TABLE_NAMES
from marginflow.operators import accessors, customer, frames, kpis, views
from marginflow.operators.tenancy import ScopedTables
from marginflow.plans.catalog import all_queries, open_star
from marginflow.plans.oracle import oracle_texts
from marginflow.sources import store
from marginflow.sources.star import StarTables
from parity import compare, connect

QUERIES = all_queries()  # the text queries have tests of their own
ORACLE = oracle_texts()


@pytest.fixture(scope="module")
def star(spark):
    return open_star(spark, SMALL)


@pytest.fixture(scope="module")
def engine():
    return connect(SMALL)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_parity(spark, engine, name):
    assert compare(QUERIES[name](spark, SMALL), engine, ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 8


# --- invariants -------------------------------------------------------------


def test_waterfall_adds_up_to_the_cent(star):
    def cents(name):
        return F.rint(F.col(name) * 100).cast("bigint")

    off = star.transactions.filter(
        (F.col("invoice_price") > F.col("list_price"))
        | (
            cents("lowest_net_price")
            != cents("invoice_price") - cents("gpo_admin_fee") - cents("rebate_amount")
        )
        | (cents("margin") != cents("lowest_net_price") - cents("unit_cost"))
    )
    assert off.count() == 0


def test_totals_agree_between_views(star):
    def total(df, column):
        return df.agg(F.sum(F.rint(F.col(column) * 100).cast("bigint"))).first()[0]

    revenue = round(kpis.total_revenue(star).first().value * 100)
    assert total(views.portfolio_summary(star), "total_revenue") == revenue
    assert total(views.monthly_trends(star), "revenue") == revenue
    assert total(views.customer_performance(star), "total_revenue") == revenue
    assert total(views.contract_risk(star), "total_revenue") == revenue


def test_every_contract_has_one_risk_row(star):
    view = views.contract_risk(star)
    contracts = star.contracts.count()
    assert view.count() == view.select("contract_id").distinct().count() == contracts
    assert frames.risk_distribution(view).agg(F.sum("contract_count")).first()[0] == contracts


def test_tenants_partition_the_result(star):
    whole = views.portfolio_summary(star)
    parts = [views.portfolio_summary(ScopedTables(star, t)) for t in ("tenant_a", "tenant_b")]
    both = parts[0].unionByName(parts[1])
    assert both.exceptAll(whole).count() == 0 and whole.exceptAll(both).count() == 0
    assert {r.tenant_id for r in parts[0].select("tenant_id").distinct().collect()} == {"tenant_a"}


def test_kpi_row_equals_the_single_kpis(star):
    row = {r.metric: r.value for r in kpis.portfolio_kpis(star, "tenant_b").collect()}
    assert row == {
        "total_revenue": kpis.total_revenue(star, "tenant_b").first().value,
        "avg_margin": kpis.average_margin(star, "tenant_b").first().value,
        "active_contracts": kpis.active_contracts(star, "tenant_b").first().value,
        "at_risk_deals": kpis.at_risk_deals(star, "tenant_b").first().value,
    }


# --- plans ------------------------------------------------------------------


@pytest.mark.parametrize("name", QUERIES)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not re.search(r"CartesianProduct|NestedLoop|Python|ArrowEval", plan)


def test_large_tables_are_never_broadcast_beyond_the_threshold(spark):
    """With a tiny threshold only the literal rate card may still be broadcast."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    plan = plan_of(views.customer_performance(StarTables(session, SMALL)))
    assert plan.count("SortMergeJoin") >= 3
    for build in re.findall(r"BroadcastExchange.*\n(.*)", plan):
        assert "LocalTableScan" in build


def test_scan_reads_only_what_the_view_needs(star):
    plan = plan_of(views.price_waterfall(star))
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_tax:double>" in plan
    assert "nation" not in plan and "n_nationkey" not in plan


def test_top_rows_per_group_are_limited_before_the_shuffle(star):
    for df in (
        customer.recent_transactions(star),
        frames.top_customers(views.customer_performance(star)),
        frames.needing_attention(views.contract_risk(star)),
    ):
        assert re.search(r"WindowGroupLimit.*Partial", plan_of(df))


# --- store and CSV layer ----------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, star):
    path = store.scratch_folder(spark)
    store.write_store(star, path)
    return store.StoredTables(spark, path)


def test_scratch_folder_follows_the_session(spark):
    assert store.scratch_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("name", TABLE_NAMES)
def test_store_keeps_every_table(star, stored, name):
    ours, back = getattr(star, name), getattr(stored, name)
    assert ours.dtypes == back.dtypes
    assert ours.exceptAll(back).count() == 0 and back.exceptAll(ours).count() == 0


@pytest.mark.parametrize("name", views.VIEWS)
def test_views_agree_on_store_and_star(star, stored, name):
    ours, back = views.VIEWS[name](star), views.VIEWS[name](stored)
    assert ours.exceptAll(back).count() == 0 and back.exceptAll(ours).count() == 0


def test_tenant_prunes_partitions_of_both_scans(stored):
    plan = plan_of(accessors.contract_risk(stored, "tenant_a"))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*tenant_a", plan)) == 2


def test_year_prunes_partitions(stored):
    plan = plan_of(kpis.revenue_of_year(stored, 1999, "tenant_a"))
    assert re.search(r"PartitionFilters: \[[^\]]*\(year#\d+ = 1", plan)


def test_customer_filter_reaches_the_scans_of_sorted_files(spark, stored):
    plan = plan_of(customer.contract_portfolio(stored, "tenant_a", "12"))
    assert len(re.findall(r"PushedFilters: \[[^\]]*EqualTo\(idn_id,12\)", plan)) >= 2
    files = [r.f for r in stored.transactions.select(F.input_file_name().alias("f")).distinct().collect()]
    for file in files:
        # one file is one split here, so the rows arrive in file order
        ids = [r.idn_id for r in spark.read.parquet(file).select("idn_id").coalesce(1).collect()]
        assert ids == sorted(ids)


def test_stored_contracts_meet_their_totals_and_rebates_without_exchange(spark, stored):
    """Nothing moves below the joins by contract, with broadcasts switched off."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.contracts.join(stored.contract_totals, ["tenant_id", "contract_id"], "left")
        rebates = stored.rebate_programs.join(joined, "contract_id")
        for df in (joined, rebates, customer.rebates_of_customer(stored)):
            plan = plan_of(df)
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        risk = plan_of(views.contract_risk(stored))
        # below the join by contract only the bucketed scans; above it the join with the customers
        assert risk.count("Exchange hashpartitioning(idn_id") == 2 and risk.count("Exchange") == 2
        assert "transaction_id" not in risk and risk.count("Bucketed: true") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_is_read_by_a_session_that_did_not_write_it(spark, star):
    """The bucketed tables are registered again from the manifest alone."""
    path = store.scratch_folder(spark)
    store.write_store(star, path, buckets=3)
    for table in spark.catalog.listTables():
        if table.name.startswith("marginflow_") and table.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE {table.name}")
    again = store.StoredTables(spark.newSession(), path)
    for name in ("contracts", "rebate_programs"):
        assert getattr(again, name).count() == getattr(star, name).count()
    expected = {tuple(r) for r in star.contract_totals.collect()}
    assert {tuple(r) for r in again.contract_totals.collect()} == expected
    assert again.contracts.filter("tenant_id = 'tenant_b'").count() > 0


def test_failed_rebuild_leaves_the_old_version(spark, star):
    """Readers see whole versions only, whatever a rebuild has written before it fails."""
    path = store.scratch_folder(spark)
    with pytest.raises(FileNotFoundError):
        store.StoredTables(spark, path).gpos.count()
    assert store.write_store(star, path, ("gpos", "contracts")) == 1
    held = store.StoredTables(spark, path)
    counts = held.contracts.count(), held.gpos.count()

    class Broken(StarTables):
        @property
        def contracts(self):
            torn = F.when(F.col("contract_id") == super().contracts.first().contract_id, F.raise_error(F.lit("torn")))
            return super().contracts.limit(50).withColumn("contract_id", F.coalesce(torn, "contract_id"))

        @property
        def gpos(self):
            return super().gpos.limit(1)

    with pytest.raises(Exception, match="torn"):
        store.write_store(Broken(spark, SMALL), path, ("gpos", "contracts"))
    for tables in (held, store.StoredTables(spark, path)):
        assert (tables.contracts.count(), tables.gpos.count()) == counts
    assert store.current_version(spark, path)[0] == 1

    # a later rebuild takes over what it doesn't name, and open readers keep their version
    assert store.write_store(star, path, ("products",)) == 2
    assert store.write_store(Broken(spark, SMALL), path, ("gpos",)) == 3
    newest = store.StoredTables(spark, path)
    assert (newest.contracts.count(), newest.gpos.count()) == (counts[0], 1)
    assert newest.products.count() == star.products.count() and held.gpos.count() == counts[1]
    assert store.drop_old_versions(spark, path, keep=1) == [2, 1]
    again = store.StoredTables(spark, path)
    assert (again.contracts.count(), again.gpos.count()) == (counts[0], 1)


def test_two_rebuilds_do_not_make_one_version(spark, star):
    path = store.scratch_folder(spark)
    store.write_store(star, path, ("gpos",))

    class Slow(StarTables):
        @property
        def products(self):
            store.write_store(star, path, ("gpos",))  # another rebuild, done in the meantime
            return super().products

    with pytest.raises(Exception):
        store.write_store(Slow(spark, SMALL), path, ("products",))
    assert store.current_version(spark, path)[0] == 2


def test_csv_layer_keeps_every_table(spark, star):
    folder = store.scratch_folder(spark)
    store.write_csv(star, folder)
    for name in TABLE_NAMES:
        ours, back = getattr(star, name), store.read_csv(spark, folder, name)
        assert ours.dtypes == back.dtypes
        assert ours.exceptAll(back).count() == 0 and back.exceptAll(ours).count() == 0


def test_a_bad_row_costs_that_row(spark, star, tmp_path):
    """Readable rows and rejects make up all rows; the report counts rejects by reason."""
    store.write_csv(star, str(tmp_path), ("contracts", "gpos"))
    clean = store.read_csv_checked(spark, str(tmp_path), "contracts")
    assert clean.rows.exceptAll(star.contracts).count() == 0 and clean.rows.count() == star.contracts.count()
    assert clean.rejects.count() == 0
    good = "C1,t,I1,GPO-001,PV,Consumables,2020-01-31,2021-01-31,12,0.2,0.8,Active,100,true,Low"
    bad = {
        good.replace("2020-01-31", "2020-02-31"): "unreadable start_date",
        good.replace("2021-01-31", "soon"): "unreadable end_date",
        good.replace(",12,", ",a year,"): "unreadable duration_months",
        "C2,t": "malformed row",
        good + ",one more": "malformed row",
    }
    header = ",".join(star.contracts.columns)
    (tmp_path / "contracts" / "more.csv").write_text("\n".join([header, good, *bad, good.replace("2020-01-31", "")]) + "\n")
    checked = store.read_csv_checked(spark, str(tmp_path), "contracts")
    assert checked.rows.count() == star.contracts.count() + 2
    found = {r.record: r.reason for r in checked.rejects.collect()}
    assert sorted(found.values()) == sorted(bad.values())
    assert found == bad
    (tmp_path / "gpos" / "more.csv").write_text("gpo_id,name,admin_fee_pct,member_count\nG1,x,abc,3\n")
    report = store.reject_report([checked, store.read_csv_checked(spark, str(tmp_path), "gpos")])
    assert {tuple(r) for r in report.collect()} == {
        ("contracts", "malformed row", 2),
        ("contracts", "unreadable duration_months", 1),
        ("contracts", "unreadable start_date", 1),
        ("contracts", "unreadable end_date", 1),
        ("gpos", "unreadable admin_fee_pct", 1),
    }


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "gpos").mkdir()
    (tmp_path / "gpos" / "part.csv").write_text("gpo_id,name,admin_fee_pct,member_count\nG1,x,abc,3\n")
    with pytest.raises(Exception):
        store.read_csv(spark, str(tmp_path), "gpos").collect()


# --- skew -------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of the orders on one customer, a third of the lines on one order and one part."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    source = connect("/root/testdata/sf0.01")
    hot = source.execute(
        "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1998-06-01' AND '1999-12-31' LIMIT 1"
    ).fetchone()[0]
    texts = {
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM orders",
        "lineitem": f"""
            SELECT * REPLACE (
                CASE WHEN l_suppkey % 3 = 0 THEN {hot} ELSE l_orderkey END AS l_orderkey,
                CASE WHEN l_suppkey % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey)
            FROM lineitem
        """,
    }
    for table in ("region", "nation", "customer", "supplier", "part"):
        texts[table] = f"SELECT * FROM {table}"
    for table, text in texts.items():
        source.execute(f"COPY ({text}) TO '{folder}/{table}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 4096)")
    return folder, hot


@pytest.fixture(scope="module")
def skew_session(spark):
    session = spark.newSession()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "24",
        "spark.sql.session.timeZone": "UTC",
        # several map tasks, so that there are map ranges to split at
        "spark.sql.files.maxPartitionBytes": "100k",
        "spark.sql.files.openCostInBytes": "0",
    }
    for key, value in settings.items():
        session.conf.set(key, value)
    return session


@pytest.mark.parametrize(
    "name",
    (
        "v1_portfolio_summary",
        "v3_customer_performance",
        "v5_contract_risk",
        "q2_contract_portfolio",
        "q4_recent_transactions",
        "n10_highest_price_erosion",
        "c9_concentration",
        "k_portfolio_row",
    ),
)
def test_results_hold_under_skew(skew_session, skewed, name):
    folder, _ = skewed
    engine = connect(folder)
    assert compare(QUERIES[name](skew_session, folder), engine, ORACLE[name]) == ""


@pytest.mark.parametrize(
    ("name", "split"),
    (("v1_portfolio_summary", 4), ("v5_contract_risk", 5), ("q4_recent_transactions", 4)),
)
def test_heavy_keys_are_split_at_run_time(skew_session, skewed, name, split):
    """Every join that meets the lines or the orders splits its heavy partitions."""
    df = QUERIES[name](skew_session, skewed[0])
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin(skew=true)") == split


def test_fixture_is_skewed(skewed):
    folder, hot = skewed
    share = connect(folder).execute(
        f"SELECT avg((l_orderkey = {hot})::int), avg((l_partkey = 11)::int) FROM lineitem"
    ).fetchone()
    assert min(share) > 0.3
