import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from conftest import SMALL
from marginflow.functions.calendar import contract_status
from marginflow.functions.keys import has_id, key_of
from marginflow.operators import accessors, conformance, customer, derive, frames, kpis, questions, views
from marginflow.operators.fusion import scalar_of
from marginflow.operators.predicates import Filters, apply_filters, for_tenant, in_range
from marginflow.operators.tenancy import ScopedTables, TenantSession
from marginflow.plans.catalog import all_queries
from marginflow.sources import star as star_source
from marginflow.sources.star import StarTables


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- derivations ------------------------------------------------------------


def test_waterfall_of_one_line(spark):
    line = spark.createDataFrame(
        [(100.0, 0.2, "G1", 0.05, 40.0)],
        "list_price double, base_discount_pct double, gpo_id string, rebate_pct double, unit_cost double",
    )
    gpos = spark.createDataFrame(fx.GPOS, "gpo_id string, name string, admin_fee_pct double, m int")
    row = derive.waterfall(line, gpos).first()
    assert (row.invoice_price, row.gpo_admin_fee, row.rebate_amount) == (80.0, 2.4, 4.0)
    assert (row.lowest_net_price, row.margin, row.margin_pct) == (73.6, 33.6, 45.7)
    assert row.total_discount_pct == 0.264


def test_zero_net_and_zero_list_do_not_divide(spark):
    line = spark.createDataFrame(
        [(0.0, 0.0, 10.0)], "list_price double, lowest_net_price double, unit_cost double"
    )
    row = line.transform(derive.with_margin).transform(derive.with_total_discount).first()
    assert (row.margin, row.margin_pct, row.total_discount_pct) == (-10.0, 0.0, 0.0)


def test_negative_margin_rounds_away_from_zero(spark):
    line = spark.createDataFrame([(80.0, 80.2)], "lowest_net_price double, unit_cost double")
    assert derive.with_margin(line).first().margin_pct == -0.3  # exactly -0.25 percent


def test_quantity_is_whole_and_clamped(spark):
    df = spark.createDataFrame([(0.4,), (2.7,), (200.9,), (5000.0,), (-5.0,), (None,)], "quantity double")
    assert rows(derive.with_quantity_clamped(df)) == [(1,), (2,), (200,), (200,), (1,), (None,)]
    assert rows(derive.with_whole_quantity(df)) == [(0,), (2,), (200,), (5000,), (-5,), (None,)]


def test_totals_are_rounded_once(spark):
    from marginflow.functions.numeric import avg_percent, sum_money
    from marginflow.operators.views import contract_totals, risk_status

    prices = spark.createDataFrame([(0.004, 1000), (80.125, 8)], "price double, quantity int")
    assert prices.agg(sum_money("price", "quantity")).first()[0] == 645.0
    lines = spark.createDataFrame(
        [("t", "c", "x", 14.96, 1.0, 1)],
        "tenant_id string, contract_id string, transaction_id string, margin_pct double, "
        "invoice_price double, quantity int",
    )
    rated = contract_totals(lines).selectExpr("*", "'Low' as aks_risk_flag", "0.1D as base_discount_pct")
    assert rated.select(risk_status(rated.margin_units, rated.margin_count)).first()[0] == "At Risk"
    assert lines.agg(avg_percent("margin_pct")).first()[0] == 15.0


def test_unknown_structure_has_no_discount(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("PV", "Large"), ("?", "Large"), ("PV", None)], "deal_structure string, idn_tier string")
    found = derive.with_base_discount(df, F.lit(0.0)).select("base_discount_pct")
    assert rows(found) == [(0.28,), (None,), (None,)]


def test_tier_limits(spark):
    df = spark.createDataFrame([(10,), (11,), (30,), (31,)], "facility_count int")
    assert [r.tier for r in derive.with_idn_tier(df).collect()] == ["Small", "Medium", "Medium", "Large"]


def test_status_at_a_date(spark):
    as_of = dt.date(2025, 1, 15)
    day = dt.timedelta(days=1)
    data = [
        (as_of - 9 * day, as_of - day, False, "Expired"),
        (as_of - 9 * day, as_of - day, True, "Renewed"),
        (as_of, as_of + day, True, "Active"),
        (as_of - day, as_of, False, "Active"),
        (as_of + day, as_of + 9 * day, True, "Pending"),
    ]
    df = spark.createDataFrame(data, "s date, e date, r boolean, expected string")
    status = contract_status(F.col("s"), F.col("e"), F.col("r"), as_of)
    assert df.filter(status != F.col("expected")).count() == 0


def test_discount_is_clipped(spark):
    data = [("PV", "Large", 0.2, 0.4), ("All Play", "Small", -0.05, 0.02), ("DV", "Medium", 0.013, 0.203)]
    df = spark.createDataFrame(
        data, "deal_structure string, idn_tier string, adj double, expected double"
    )
    got = derive.with_base_discount(df, F.col("adj"))
    assert got.filter(F.col("base_discount_pct") != F.col("expected")).count() == 0


def test_checks_flag_values_outside_their_band(spark):
    deals = spark.createDataFrame(
        [("PV", 0.8), ("PV", 0.96), ("Access", 0.0), ("Other", 0.1)],
        "deal_structure string, market_share_commitment double",
    )
    assert [r.commitment_in_band for r in derive.with_commitment_check(deals).collect()] == [
        True,
        False,
        True,
        False,
    ]
    rebates = spark.createDataFrame(
        [("Volume", "units_threshold", 0.05), ("Volume", "other", 0.03), ("Growth", "yoy_volume_increase", 0.2)],
        "rebate_type string, trigger_type string, rebate_pct double",
    )
    assert [r.rebate_conforms for r in derive.with_rebate_check(rebates).collect()] == [True, False, False]


def test_broken_rules_are_counted_in_one_pass(spark):
    lines = spark.createDataFrame(
        [
            (0.02, 1.0, 5, 10.0, 10.0),  # meets all rules
            (0.019999, 0.5, 1, 10.01, 10.0),  # breaks all
            (None, None, None, None, None),  # what is unknown doesn't hold, without an order nothing is asked of it
            (0.40, 200.0, 3, 9.0, 10.0),
        ],
        "discount double, quantity double, day int, amount double, order_total double",
    ).withColumns(
        {
            "sold": F.date_add(F.lit(fx.DAY), F.col("day")),
            "ordered": F.when(F.col("day").isNotNull(), F.date_add(F.lit(fx.DAY), 3)),
        }
    )
    report = conformance.violation_report(lines, conformance.line_rules())
    assert {r.rule: (r.checked, r.violations) for r in report.collect()} == {
        "discount in bounds": (4, 2),
        "quantity in bounds": (4, 2),
        "quantity whole": (4, 2),
        "sold after ordered": (3, 1),
        "within order total": (3, 1),
    }
    broken = conformance.violations(lines, conformance.line_rules()).collect()
    assert sorted(len(r.broken) for r in broken) == [3, 5]
    assert conformance.violation_report(lines.limit(0), conformance.line_rules()).count() == 5


def test_real_shares_and_rates_keep_to_their_bands(spark):
    lines = spark.createDataFrame(
        [(1, 1, 8.0, 0.02), (1, 2, 2.0, 0.08), (2, 1, 9.0, 0.02), (2, 1, 0.5, 0.02), (2, 3, 0.5, 0.02), (3, 1, None, None)],
        "k int, p int, quantity double, rate double",
    )
    shares = conformance.unit_shares(lines, "k", "p")
    deals = spark.createDataFrame([(1, "PV"), (2, "PV"), (3, "PV"), (1, "DV"), (1, "Access")], "k int, deal_structure string")
    found = conformance.violation_report(deals.join(shares, "k"), conformance.commitment_rules())
    assert {tuple(r) for r in found.collect()} == {("PV commitment", 2, 0), ("DV commitment", 1, 1), ("TV commitment", 0, 0)}
    rates = conformance.average_rates(lines, "k", "rate")
    programs = spark.createDataFrame([(1, "Volume"), (1, "Growth"), (2, "Bundle"), (3, "Loyalty")], "k int, rebate_type string")
    found = conformance.violation_report(programs.join(rates, "k"), conformance.rebate_rules())
    assert {tuple(r) for r in found.collect()} == {
        ("Volume rate", 1, 0), ("Loyalty rate", 0, 0), ("Bundle rate", 1, 0), ("Growth rate", 1, 1)
    }


def test_surrogate_ids_keep_long_keys(spark):
    df = spark.createDataFrame([(7,), (123456,)], "k bigint")
    ids = [r.i for r in df.select(derive.surrogate_id("CTR", F.col("k"), 4).alias("i")).collect()]
    assert ids == ["CTR-0007", "CTR-123456"]


# --- risk -------------------------------------------------------------------


def test_risk_rule_in_order(spark):
    contracts = [
        fx.contract("C1", flag="High"),
        fx.contract("C2"),
        fx.contract("C3", discount=0.301),
        fx.contract("C4"),
        fx.contract("C5", discount=0.3),
        fx.contract("C6", flag="High"),
    ]
    lines = [
        fx.line("L1", "C1", margin_pct=40.0),
        fx.line("L2", "C2", margin_pct=14.9),
        fx.line("L3", "C2", margin_pct=15.0),  # mean 14.95 shows as 15.0 and is still below 15
        fx.line("L4", "C3", margin_pct=15.0),
        fx.line("L5", "C5", margin_pct=15.0),
    ]
    view = views.contract_risk(fx.tables(spark, contracts, lines))
    got = {r.contract_id: (r.risk_status, r.avg_margin_pct, r.total_revenue, r.transaction_count) for r in view.collect()}
    assert got == {
        "C1": ("Critical", 40.0, 80.0, 1),
        "C2": ("At Risk", 15.0, 160.0, 2),
        "C3": ("Watch", 15.0, 80.0, 1),
        "C4": ("Healthy", None, None, 0),
        "C5": ("Healthy", 15.0, 80.0, 1),
        "C6": ("Critical", None, None, 0),
    }


def test_contract_of_unknown_customer(spark):
    tables = fx.tables(
        spark, [fx.contract("C1"), fx.contract("C2", idn="I9", flag="High")], [fx.line("L1", "C2", idn="I9")]
    )
    assert [r.contract_id for r in views.contract_risk(tables).collect()] == ["C1"]
    portfolio = {r.contract_id: r for r in customer.contract_portfolio(tables, "t1").collect()}
    assert (portfolio["C2"].risk_status, portfolio["C2"].total_revenue) == ("Unknown", 0.0)
    assert (portfolio["C1"].risk_status, portfolio["C1"].avg_margin_pct) == ("Healthy", 0.0)


# --- predicates and tenancy -------------------------------------------------


@pytest.fixture(scope="module")
def two_tenants(spark):
    contracts = [
        fx.contract("A1", "t1", "I1"),
        fx.contract("A2", "t1", "I2", status="Expired"),
        fx.contract("B1", "t2", "I1", flag="High"),
    ]
    lines = [
        fx.line("a", "A1", "t1", "I1", 2),
        fx.line("b", "A2", "t1", "I2", 3, device_category="Consumables", region="East"),
        fx.line("c", "B1", "t2", "I1", 5, year=2023),
    ]
    rebates = [
        ("R1", "A1", "Volume", 0.03, "units_threshold", 0.6, "Offensive", True),
        ("R2", "B1", "Volume", 0.05, "units_threshold", 0.6, "Defensive", False),
        ("R3", "A1", "Growth", 0.01, "yoy_volume_increase", 0.6, "Offensive", False),
    ]
    return fx.tables(spark, contracts, lines, rebates)


def test_extra_condition_with_or_stays_in_the_tenant(two_tenants):
    either = (F.col("status") == "Active") | (F.col("aks_risk_flag") == "High")
    got = for_tenant(two_tenants.contracts, "t1", either)
    assert [r.contract_id for r in got.collect()] == ["A1"]


def test_gpo_name_with_apostrophe(two_tenants):
    chosen = Filters(gpo="Buyers' Union")
    lines = apply_filters(two_tenants.transactions, chosen, ("gpo",), two_tenants.gpos)
    assert sorted(r.transaction_id for r in lines.collect()) == ["a", "c"]
    view = accessors.customer_performance(two_tenants, "t1", chosen)
    assert [r.idn_id for r in view.collect()] == ["I1"]


def test_unknown_selection_gives_nothing(two_tenants):
    chosen = Filters(category="no such' OR '1'='1")
    assert accessors.portfolio_summary(two_tenants, "t1", chosen).count() == 0
    assert kpis.total_revenue(two_tenants, "t1", chosen).first().value == 0.0
    assert kpis.average_margin(two_tenants, "t1", chosen).first().value == 0.0
    assert frames.waterfall_category(views.price_waterfall(two_tenants), "none").count() == 0


def test_all_means_no_filter(two_tenants):
    everything = accessors.portfolio_summary(two_tenants, "t1", Filters("All", "All", "All", "All"))
    assert everything.count() == accessors.portfolio_summary(two_tenants, "t1").count() == 2


def test_value_lists(two_tenants):
    assert rows(accessors.device_categories(two_tenants, "t1")) == [("Cardiovascular",), ("Consumables",)]
    assert rows(accessors.regions(two_tenants, "t2")) == [("West",)]
    assert rows(accessors.gpo_names(two_tenants, "t1")) == [("Buyers' Union",), ("Second",)]
    assert rows(accessors.idn_list(two_tenants, "t2")) == [("I1", "North Health", "Large", "West")]


def test_scoped_tables_reach_rebates_through_contracts(two_tenants):
    scoped = ScopedTables(two_tenants, "t1")
    assert sorted(r.rebate_id for r in scoped.rebate_programs.collect()) == ["R1", "R3"]
    assert scoped.gpos.count() == 2


def test_reports_on_held_transactions(two_tenants):
    with ScopedTables(two_tenants, "t1", "I1").held() as scope:
        pricing = customer.pricing_by_category(scope)
        assert "InMemoryTableScan" in pricing._jdf.queryExecution().executedPlan().toString()
        assert [(r.tenant_id, r.idn_id, r.txn_count) for r in pricing.collect()] == [("t1", "I1", 1)]
        assert [r.contract_id for r in customer.contract_portfolio(scope).collect()] == ["A1"]
        assert [r.rebate_id for r in customer.rebates_of_customer(scope).collect()] == ["R3", "R1"]
    assert not scope.transactions.is_cached


TEXTS = (
    "SELECT tenant_id, count(*) AS n FROM transactions WHERE quantity > 0 OR 1 = 1 GROUP BY tenant_id",
    "select tenant_id, count(*) as n from transactions where tenant_id = 't2' or true group by tenant_id;",
    "WITH x AS (SELECT * FROM transactions) SELECT tenant_id, count(*) AS n FROM x GROUP BY tenant_id",
    "SELECT t.tenant_id, count(*) AS n FROM transactions t JOIN contracts c USING (contract_id) "
    "GROUP BY t.tenant_id -- trailing remark",
    "SELECT tenant_id, n FROM (SELECT tenant_id, count(*) AS n FROM transactions GROUP BY 1)",
    "SELECT tenant_id, sum(transaction_count) AS n FROM v_contract_risk GROUP BY tenant_id",
)


@pytest.fixture(scope="module")
def tenant_session(spark):
    def open_tables(child):
        return fx.tables(
            child,
            [fx.contract("A1", "t1"), fx.contract("B1", "t2")],
            [fx.line("a", "A1", "t1"), fx.line("c", "B1", "t2"), fx.line("d", "B1", "t2")],
        )

    return TenantSession(spark, open_tables, "t1")


@pytest.mark.parametrize("text", TEXTS)
def test_free_text_sees_one_tenant(tenant_session, text):
    assert [(r.tenant_id, r.n) for r in tenant_session.sql(text).collect()] == [("t1", 1)]


@pytest.mark.parametrize(
    "text",
    (
        "SET spark.sql.runSQLOnFiles = true",
        "CREATE TABLE leak AS SELECT * FROM transactions",
        "INSERT INTO contracts SELECT * FROM contracts",
        "SELECT 1; SELECT 2",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    ),
)
def test_free_text_cannot_leave_a_select(tenant_session, text):
    with pytest.raises(Exception):
        tenant_session.sql(text).collect()


def test_parent_views_are_hidden(spark, tenant_session):
    spark.range(3).createOrReplaceTempView("parent_secret")
    with pytest.raises(Exception):
        tenant_session.sql("SELECT * FROM parent_secret").collect()


def test_scalar(tenant_session):
    assert tenant_session.scalar("SELECT count(*) FROM transactions").first().value == 1
    none = tenant_session.scalar("SELECT quantity FROM transactions WHERE quantity > ?", [99])
    assert none.first().value == 0


@pytest.mark.parametrize(
    "text, value",
    (
        ("SELECT 'a' AS x, 2 AS x", "a"),
        ("SELECT DATE '2024-02-29'", dt.date(2024, 2, 29)),
        ("SELECT cast(NULL AS int)", None),
        ("SELECT tenant_id FROM transactions WHERE quantity > 99", None),
    ),
)
def test_scalar_keeps_its_type(tenant_session, text, value):
    assert tenant_session.scalar(text).first().value == value


@pytest.mark.parametrize(
    "text",
    (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.name')",
        "SELECT `Java_Method`('java.lang.System', 'getProperty', 'user.name')",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.name')",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.name')",
        "SELECT 1 WHERE 'x' = (SELECT java_method('java.lang.System', 'lineSeparator'))",
        "SELECT t.* FROM transactions t WHERE EXISTS (SELECT reflect('java.lang.System', 'lineSeparator') = t.tenant_id)",
        "WITH a AS (SELECT reflect('java.lang.System', 'lineSeparator') AS x) SELECT count(*) FROM a",
        "SELECT transform(array(1), x -> reflect('java.lang.System', 'lineSeparator'))",
        "SELECT TRANSFORM (tenant_id) USING 'cat' AS (x STRING) FROM transactions",
    ),
)
def test_free_text_cannot_call_java(tenant_session, text):
    with pytest.raises(ValueError):
        tenant_session.sql(text)


@pytest.mark.parametrize(
    "text, value",
    (
        ("SELECT 'please reflect' AS x", "please reflect"),
        ("SELECT max(tenant_id) AS java_method FROM transactions -- reflect", "t1"),
        ("SELECT IDENTIFIER('up' || 'per')('a')", "A"),
        ("SELECT sum(id) FROM range(4)", 6),
        ("SELECT count(*) FROM IDENTIFIER('trans' || 'actions') /* transactions */", 1),
        ("SELECT max(x) FROM (SELECT explode(array(1, 2)) AS x UNION ALL VALUES (5))", 5),
        ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT max(n) FROM r", 4),
        ("SELECT (SELECT count(*) FROM contracts) + count(*) FROM transactions WHERE tenant_id IN (SELECT tenant_id FROM contracts)", 2),
    ),
)
def test_free_text_may_mention_anything(tenant_session, text, value):
    assert tenant_session.sql(text).first()[0] == value


def test_free_text_reads_no_table_of_the_catalogue(spark, tenant_session, tmp_path):
    """Tables and stored views of the catalogue are shared by all sessions; a tenant reads neither."""
    spark.range(3).write.option("path", str(tmp_path / "leak")).saveAsTable("leak")
    spark.sql("CREATE VIEW contracts AS SELECT * FROM leak")
    try:
        for text in ("SELECT * FROM leak", "SELECT * FROM default.contracts", "SELECT (SELECT max(id) FROM leak)"):
            with pytest.raises(ValueError):
                tenant_session.sql(text)
        assert tenant_session.sql("SELECT count(*) AS n FROM contracts").first().n == 1
    finally:
        spark.sql("DROP VIEW contracts")
        spark.sql("DROP TABLE leak")


def test_tenant_session_has_the_settings_of_its_parent(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "7m")
    try:
        child = TenantSession(spark, lambda s: fx.tables(s, [fx.contract("A1")]), "t1").spark
        assert child.conf.get(name) == "7m"
    finally:
        spark.conf.set(name, before)


def test_lines_that_are_not_priced_are_counted(spark):
    contracts = spark.createDataFrame(
        [("C1", "G1", "Active"), ("C2", "G1", "Expired"), ("C3", None, "Active"), ("C4", "G1", None)],
        "contract_id string, gpo_id string, status string",
    )
    products = spark.createDataFrame([("P1",)], "product_id string")
    gpos = spark.createDataFrame([("G1",)], "gpo_id string")
    lines = [("C1", "P1"), ("C1", "P9"), ("C2", "P1"), ("C3", "P1"), ("C9", "P1"), (None, None), ("C4", "P1")]
    lines = spark.createDataFrame(lines, "contract_id string, product_id string")
    assert rows(derive.line_outcomes(lines, contracts, products, gpos)) == [
        ("unknown contract", 2),
        ("contract not billable", 2),
        ("unknown product", 1),
        ("unknown buying group", 1),
        ("priced", 1),
    ]


def test_unscoped_drill_downs_are_not_sorted(two_tenants):
    for report in (
        customer.contract_portfolio,
        customer.pricing_by_category,
        customer.recent_transactions,
        customer.rebates_of_customer,
    ):
        assert "rangepartitioning" not in report(two_tenants)._jdf.queryExecution().executedPlan().toString()


def test_metrics_from_config(tenant_session, tmp_path):
    path = tmp_path / "metrics.json"
    path.write_text(
        '{"kpis": {"lines": {"label": "Lines", "sql": "SELECT count(*) FROM transactions", '
        '"delta_sql": "SELECT 7", "alert_threshold": 0}}}'
    )
    table = kpis.metric_table(tenant_session, kpis.load_metrics(str(path))).first()
    assert (table.metric, table.value, table.delta_base, table.alert, table.text) == (
        "lines",
        1.0,
        7.0,
        True,
        "1",
    )


YAML_METRICS = """
kpis:
  total_revenue:
    label: "Total Revenue"
    sql: "SELECT ROUND(SUM(invoice_price * quantity), 2) FROM transactions"
    format: "currency"
    delta_sql: "SELECT ROUND(SUM(invoice_price * quantity), 2) FROM transactions WHERE year = 2024"
  avg_margin:
    label: "Avg Margin %"
    sql: "SELECT ROUND(AVG(margin_pct), 1) FROM transactions"
    format: "percent"
  active_contracts:
    label: "Active Contracts"
    sql: "SELECT COUNT(*) FROM contracts WHERE status = 'Active'"
    format: "integer"
  at_risk_deals:
    label: "At-Risk Deals"
    sql: "SELECT COUNT(*) FROM v_contract_risk WHERE risk_status IN ('Critical', 'At Risk')"
    format: "integer"
    alert_threshold: 0
"""


def test_metrics_of_a_yaml_file(tenant_session, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "metrics.yaml"
    path.write_text(YAML_METRICS)
    metrics = kpis.load_metrics(str(path))
    assert [m.key for m in metrics] == ["total_revenue", "avg_margin", "active_contracts", "at_risk_deals"]
    found = {r.metric: r for r in kpis.metric_table(tenant_session, metrics).collect()}
    base = {r.metric: r for r in kpis.metric_table(tenant_session).collect()}
    for name in base:
        assert (found[name].label, found[name].format) == (base[name].label, base[name].format)
        assert found[name].value == pytest.approx(base[name].value)
    assert found["at_risk_deals"].alert == (found["at_risk_deals"].value > 0)


@pytest.mark.parametrize(
    "text, value",
    (
        ("SELECT count(*) FROM t", "count(*)"),
        ("select Count(DISTINCT x) AS n from T where a = 'it, (is' and b in (1, 2);", "Count(DISTINCT x) FILTER (WHERE a = 'it, (is' and b in (1, 2))"),
        ("SELECT round(sum(cast(p AS decimal(18, 4)) * q), 2) / nullif(count(*), 0) FROM t WHERE y = 1",
         "round(sum(cast(p AS decimal(18, 4)) * q) FILTER (WHERE y = 1), 2) / nullif(count(*) FILTER (WHERE y = 1), 0)"),
        ("SELECT coalesce(max(if(a > 0, b, 0)), -1)\nFROM\tt", "coalesce(max(if(a > 0, b, 0)), -1)"),
    ),
)
def test_fusible_texts(text, value):
    found = scalar_of(text)
    assert (found.source, found.value) == ("t", value)


@pytest.mark.parametrize(
    "text",
    (
        "SELECT 7",
        "SELECT x FROM t",
        "SELECT count(*), 1 FROM t",
        "SELECT count(*) FROM t, u",
        "SELECT count(*) FROM t JOIN u USING (x)",
        "SELECT count(*) FROM t GROUP BY x",
        "SELECT count(*) FROM t WHERE x = 1 GROUP BY y",
        "SELECT count(*) FROM t HAVING count(*) > 1",
        "SELECT count(*) FROM t LIMIT 0",
        "SELECT count(*) FROM t WHERE x IN (SELECT 1)",
        "SELECT sum(count(*)) FROM t",
        "SELECT count(*) OVER () FROM t",
        "SELECT count(*) FILTER (WHERE x) FROM t",
        "SELECT percentile(x, 0.5) FROM t",
        "SELECT count(*) FROM (SELECT 1)",
        "SELECT count(*) FROM a.t",
        "SELECT count(*) FROM t u",
        "SELECT count(*) FROM t -- where",
        'SELECT count("x") FROM t',
        "SELECT count(*) FROM t WHERE a = 'x",
        "SELECT DISTINCT count(*) FROM t WHERE a = :b",
        "SELECT count(*) FROM t UNION SELECT 1",
        "SELECT (count(*) FROM t",
    ),
)
def test_other_texts_are_not_fused(text):
    assert scalar_of(text) is None


def test_fused_metrics_equal_single_ones(tenant_session):
    """Values, NULLs and zeros are those of each text run alone; texts that don't fuse still answer."""
    texts = [
        "SELECT sum(quantity) FROM transactions WHERE quantity > 99",
        "SELECT count(*) FROM transactions WHERE quantity > 99 OR tenant_id = 't2'",
        "SELECT round(avg(list_price), 1) + count(*) FROM transactions",
        "SELECT max(quantity) FROM transactions GROUP BY tenant_id",
        "SELECT quantity FROM transactions WHERE quantity > 99",
        "SELECT count(DISTINCT status) FROM contracts",
        "SELECT 2",
    ]
    metrics = [kpis.Metric(str(i), "", text) for i, text in enumerate(texts)]
    found = {r.metric: r.value for r in kpis.metric_table(tenant_session, metrics).collect()}
    alone = [tenant_session.scalar(text).first().value for text in texts]
    assert [found[str(i)] for i in range(len(texts))] == [None if v is None else float(v) for v in alone]


def test_default_metrics_scan_the_lines_once(spark):
    table = kpis.metric_table(TenantSession(spark, lambda s: StarTables(s, SMALL), "tenant_a"))
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0] if "== Initial Plan ==" in plan else plan
    assert len(set(re.findall(r"FileScan parquet \[l_[^\n]*", final))) == 1


# --- KPIs, frames, questions -------------------------------------------------


@pytest.mark.parametrize(
    "chosen",
    (
        Filters(),
        Filters(category="Consumables"),
        Filters(gpo="Buyers' Union"),
        Filters(region="East", structure="PV"),
        Filters(category="none"),
    ),
)
@pytest.mark.parametrize("tenant", ("t1", "t2", None))
def test_kpi_row_equals_the_single_kpis(two_tenants, tenant, chosen):
    row = {r.metric: r.value for r in kpis.portfolio_kpis(two_tenants, tenant, chosen).collect()}
    assert row == {
        "total_revenue": kpis.total_revenue(two_tenants, tenant, chosen).first().value,
        "avg_margin": kpis.average_margin(two_tenants, tenant, chosen).first().value,
        "active_contracts": kpis.active_contracts(two_tenants, tenant).first().value,
        "at_risk_deals": kpis.at_risk_deals(two_tenants, tenant, chosen).first().value,
    }


def test_mean_of_categories_and_weighted_mean_differ(spark):
    lines = [fx.line("x", list_price=10.0)] + [
        fx.line(f"y{i}", list_price=20.0, device_category="Consumables") for i in range(9)
    ]
    tables = fx.tables(spark, [fx.contract("C1")], lines)
    view = views.price_waterfall(tables)
    assert frames.waterfall_all(view).first().avg_list_price == 15.0
    assert frames.waterfall_weighted(view, tables.transactions).first().avg_list_price == 19.0
    by_lines = frames.waterfall_by_lines(views.waterfall_states(tables))
    assert rows(by_lines) == rows(frames.waterfall_weighted(view, tables.transactions))


def test_waterfall_steps(spark):
    tables = fx.tables(spark, [fx.contract("C1")], [fx.line("x")])
    steps = frames.waterfall_steps(views.price_waterfall(tables)).orderBy("step").collect()
    assert [s.running_total for s in steps] == [100.0, 80.0, 77.6, 73.6, 73.6, 33.6, 33.6]
    assert [s.value for s in steps] == [100.0, -20.0, -2.4, -4.0, None, -40.0, None]
    assert [s.text for s in steps] == ["$100", "-$20", "-$2", "-$4", "$74", "-$40", "$34"]


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 14.9, 15.0, 24.9, 25.0, 60.0, 60.1)], "v double")
    got = [r.b for r in df.select(frames.margin_band(F.col("v")).alias("b")).collect()]
    assert got == [None, "red", "red", "amber", "amber", "green", "green", None]


def test_ties_are_settled_by_the_last_key(spark):
    df = spark.createDataFrame([("t", c, 5.0) for c in "cab"], "tenant_id string, idn_id string, total_revenue double")
    assert sorted(r.idn_id for r in frames.top_customers(df, 2).collect()) == ["a", "b"]


def test_long_top_lists_are_cut_before_the_one_shuffle(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("tenant_id"),
        F.col("id").cast("string").alias("idn_id"),
        (F.col("id") * 7 % 6000).cast("double").alias("total_revenue"),
    )
    n = 1500
    expected = set()
    for tenant in ("hot", "cold"):
        mine = [(r.total_revenue, r.idn_id) for r in df.filter(F.col("tenant_id") == tenant).collect()]
        expected |= {(tenant, i) for _, i in sorted(mine, key=lambda x: (-x[0], x[1]))[:n]}
    got = frames.top_customers(df, n)
    assert {(r.tenant_id, r.idn_id) for r in got.collect()} == expected
    for most in (20, n):
        plan = frames.top_customers(df, most)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"WindowGroupLimit.*Partial", plan) and re.search(r"WindowGroupLimit.*Final", plan)
        assert plan.count("Exchange hashpartitioning") == 1


def test_risk_distribution_is_zero_filled(two_tenants):
    view = views.contract_risk(two_tenants)
    counts = rows(frames.risk_distribution(view, "t2").select("risk_status", "contract_count"))
    assert counts == [("Critical", 1), ("At Risk", 0), ("Watch", 0), ("Healthy", 0)]
    nobody = frames.risk_distribution(view, "nobody")
    assert [r.contract_count for r in nobody.collect()] == [0, 0, 0, 0]


def test_attention_order(spark):
    contracts = [fx.contract("C1", flag="High"), fx.contract("C2"), fx.contract("C3", flag="High")]
    lines = [fx.line("a", "C1"), fx.line("b", "C2", margin_pct=1.0)]
    view = views.contract_risk(fx.tables(spark, contracts, lines))
    assert frames.needing_attention(view, 1).first().contract_id == "C2"
    assert frames.needing_attention(view, 1, by_severity=True).first().contract_id == "C1"


def test_drill_down_of_one_customer(two_tenants):
    assert [r.idn_id for r in customer.customer_overview(two_tenants, "t1", "I1").collect()] == ["I1"]
    assert [r.contract_id for r in customer.contract_portfolio(two_tenants, "t1", "I2").collect()] == ["A2"]
    assert [r.txn_count for r in customer.pricing_by_category(two_tenants, "t1", "I1").collect()] == [1]
    recent = customer.recent_transactions(two_tenants, "t2", "I1").collect()
    assert [(r.transaction_id, r.product_name) for r in recent] == [("c", "Stent")]
    rebates = customer.rebates_of_customer(two_tenants, "t1", "I1")
    assert [r.rebate_id for r in rebates.collect()] == ["R3", "R1"]
    assert rows(frames.rebate_summary(rebates)) == [("t1", "I1", 1, 2, 50.0, 2.0)]
    assert customer.customer_overview(two_tenants, "t1", "I9").count() == 0


REPORTS = (
    customer.customer_overview,
    customer.contract_portfolio,
    customer.pricing_by_category,
    customer.recent_transactions,
    customer.rebates_of_customer,
)


@pytest.mark.parametrize("text, key", (("12", 12), ("-3", -3), ("0", 0), ("012", None), ("+1", None), ("", None),
                                       ("-", None), (" 1", None), ("1.0", None), ("٣", None), (str(1 << 63), None)))
def test_keys_of_ids(spark, text, key):
    """An id has a key exactly if that key's text is the id."""
    assert key_of(text) == key
    found = spark.range(-5, 20).filter(has_id(F.col("id"), text)).collect()
    assert [r.id for r in found] == ([] if key is None else [key])


@pytest.mark.parametrize("report", REPORTS)
def test_customer_reaches_the_scans_of_the_star_source(spark, report):
    """The id becomes a predicate on the raw keys; few orders are sent to the lines, which stay in place."""
    star = StarTables(spark, SMALL)
    heaviest = star.transactions.groupBy("idn_id").count().orderBy(F.desc("count"), "idn_id").first().idn_id
    one = report(star, None, heaviest)
    rows_of_one = one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(o_custkey,{heaviest})" in plan
    if report is customer.customer_overview:
        assert f"EqualTo(c_custkey,{heaviest})" in plan
    whole = report(star).filter(F.col("idn_id") == heaviest).collect()
    assert len(whole) > 0 and sorted(map(str, rows_of_one)) == sorted(map(str, whole))
    assert report(star, None, "0" + heaviest).count() == 0
    lines = star.of_customer(heaviest).transactions._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in lines and "hashpartitioning(l_orderkey" not in lines


def test_many_orders_of_a_customer_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(star_source, "FEW_ORDERS", 0)
    star = StarTables(spark, SMALL)
    some = star.contracts.first().idn_id
    scoped = star.of_customer(some)
    assert not scoped._few_orders
    assert scoped.transactions.count() == star.transactions.filter(F.col("idn_id") == some).count()


def test_customer_of_any_tables(two_tenants):
    own = two_tenants.of_customer("I1")
    for name in ("idns", "contracts", "transactions"):
        assert {r.idn_id for r in getattr(own, name).collect()} == {"I1"}
    ids = {r.contract_id for r in own.contracts.collect()}
    assert {r.contract_id for r in own.rebate_programs.collect()} <= ids
    scoped = ScopedTables(two_tenants, "t1").of_customer("I1")
    assert {(r.tenant_id, r.idn_id) for r in scoped.contracts.collect()} == {("t1", "I1")}
    with pytest.raises(ValueError):
        scoped.of_customer("I2")


def test_recent_transactions_newest_first(spark):
    days = [fx.DAY - dt.timedelta(days=i) for i in range(5)]
    lines = [fx.line(f"L{i}", transaction_date=d) for i, d in enumerate(days)]
    tables = fx.tables(spark, [fx.contract("C1")], lines)
    got = customer.recent_transactions(tables, "t1", "I1", n=3).collect()
    assert [r.transaction_id for r in got] == ["L0", "L1", "L2"]


def test_earn_rates_with_and_without_tenant(two_tenants):
    assert rows(questions.rebate_earn_rates(two_tenants)) == [
        ("Volume", 2, 1, 4.0, 50.0),
        ("Growth", 1, 0, 1.0, 0.0),
    ]
    assert rows(questions.rebate_earn_rates(two_tenants, "t2")) == [("Volume", 1, 0, 5.0, 0.0)]


def test_quarters_are_chronological(spark):
    lines = [
        fx.line("a", transaction_date=dt.date(2024, 1, 5), quarter="Q1 2024", year=2024),
        fx.line("b", transaction_date=dt.date(2023, 4, 5), quarter="Q2 2023", year=2023),
        fx.line("c", transaction_date=dt.date(2023, 1, 5), quarter="Q1 2023", year=2023),
    ]
    got = questions.margin_by_quarter(fx.tables(spark, [fx.contract("C1")], lines)).collect()
    assert [r.quarter for r in got] == ["Q1 2023", "Q2 2023", "Q1 2024"]


def test_expiring_contracts(spark):
    as_of = dt.date(2025, 1, 15)
    ends = {"past": -1, "today": 0, "soon": 30, "later": 31}
    contracts = [fx.contract(k, end_date=as_of + dt.timedelta(days=d)) for k, d in ends.items()]
    got = questions.expiring_contracts(fx.tables(spark, contracts), as_of).collect()
    assert [(r.contract_id, r.days_until_expiration) for r in got] == [("today", 0), ("soon", 30)]


def test_customers_of_one_name_are_merged(spark):
    """The catalogue question groups by name and tier, not by id."""
    idns = [("I1", "Same", "G1", 31, 1, "West", "CA", "Large"), ("I2", "Same", "G2", 31, 1, "West", "CA", "Large")]
    lines = [fx.line(f"L{i}", idn="I1" if i % 2 else "I2") for i in range(12)]
    tables = fx.tables(spark, [fx.contract("C1")], lines, idns=idns)
    assert rows(questions.lowest_margin_customers(tables)) == [("Same", "Large", 30.0, 960.0)]


def test_revenue_growth_skips_gaps(spark):
    lines = [fx.line("a", year=2020), fx.line("b", year=2021, quantity=2), fx.line("c", year=2023)]
    got = kpis.revenue_growth(fx.tables(spark, [fx.contract("C1")], lines)).orderBy("year")
    assert [(r.year, r.growth) for r in got.collect()] == [(2020, None), (2021, 1.0), (2023, None)]


# --- ranges -----------------------------------------------------------------


def test_range_keeps_its_bounds_and_no_null(spark):
    nets = [100.0, 100.0, 100.0, 100.0, 0.0, 100.0, 100.0]
    costs = [70.0, 69.9, 100.0, 100.1, 5.0, None, 80.0]
    lines = spark.createDataFrame(
        list(zip(range(7), nets, costs, strict=True)), "id int, lowest_net_price double, unit_cost double"
    )
    priced = derive.with_margin(lines).select("margin_pct", "id")
    kept = in_range(priced.unionAll(priced.filter("id = 6")), "margin_pct", 0, 30)
    assert kept.schema == priced.schema
    assert sorted(rows(kept)) == [(0.0, 2), (0.0, 4), (20.0, 6), (20.0, 6), (30.0, 0)]


def test_range_query_computes_the_margin_once(spark, tmp_path):
    ordered, shipped = dt.datetime(1998, 5, 1), dt.datetime(1998, 6, 1)
    tables = {
        "region": [(0, "ASIA")],
        "nation": [(0, "INDIA", 0)],
        "customer": [(1, "One", 0, 7000.0, "BUILDING"), (2, "Two", 0, 10.0, "MACHINERY")],
        "orders": [
            (n, 1 + n % 2, "O", 1.0, ordered, priority)
            for n, priority in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), start=1)
        ],
        "part": [(n, f"part {n}", "B", "T", 5 * n, 900.0) for n in range(1, 11)] + [(11, "free", "B", "T", 1, 0.0)],
        "lineitem": [
            (order, part, 1, part, float(part), 1.0, 0.0, tax, "N", "O", shipped)
            for order in range(1, 5)
            for part, tax in zip(range(1, 12), [0.0, 0.08, None, 0.05] * 3)
        ],
    }
    for name, data in tables.items():
        spark.createDataFrame(data, star_source.RAW_SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    priced = StarTables(spark, str(tmp_path)).transactions.select("transaction_id", "margin_pct")
    kept = all_queries()["p7_range"](spark, str(tmp_path))

    expected = [r for r in rows(priced) if r[1] is not None and 0 <= r[1] <= 30]
    assert 0 < len(expected) < priced.count()
    assert sorted(rows(kept)) == sorted(expected)

    def divisions(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count(" div ")

    assert divisions(kept) == divisions(priced)
