"""SQL counterparts of the named queries, for an independent engine.

Each text works on the star tables alone: the pricing tables and views it needs are
prepended as common table expressions.  Money is kept in decimals and averages are
rounded in whole numbers, so the texts share no arithmetic with the Spark side.
"""

from __future__ import annotations

import re

TENANT = "tenant_a"
AS_OF = "DATE '2000-01-15'"


# --- rounding ---------------------------------------------------------------


def quotient(numerator: str, denominator: str) -> str:
    """Whole-number quotient, half away from zero; NULL for a zero denominator."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (
        f"CASE WHEN {n} < 0 THEN -((2 * -({n}) + {d}) // (2 * NULLIF({d}, 0))) "
        f"ELSE (2 * {n} + {d}) // (2 * NULLIF({d}, 0)) END"
    )


def rounded(numerator: str, denominator: str, places: int) -> str:
    return f"CAST({quotient(numerator, denominator)} AS DOUBLE) / {10**places}"


def avg_money(value: str) -> str:
    return rounded(f"SUM(({value}) * 100)", f"COUNT({value})", 2)


def avg_percent(value: str = "margin_pct") -> str:
    return rounded(f"SUM(({value}) * 10)", f"COUNT({value})", 1)


def avg_share(value: str = "total_discount_pct") -> str:
    return rounded(f"SUM(({value}) * 1000)", f"COUNT({value})", 1)


def total(value: str) -> str:
    return f"CAST(SUM({value}) AS DOUBLE)"


REVENUE = total("invoice_price * quantity")


def mean(value: str, places: int) -> str:
    scale = 10**places
    units = f"SUM(CAST(ROUND({value} * {scale}) AS BIGINT))"
    return f"CAST({units} AS DOUBLE) / CAST(COUNT({value}) * {scale} AS DOUBLE)"


def half_up(value: str, places: int) -> str:
    scale = float(10**places)
    return f"SIGN({value}) * FLOOR(ABS({value}) * {scale} + 0.5) / {scale}"


# --- tables -----------------------------------------------------------------

_MEASURES = f"""
    {avg_money("list_price")} AS avg_list_price,
    {avg_money("list_price - invoice_price")} AS avg_contract_discount,
    {avg_money("gpo_admin_fee")} AS avg_gpo_fee,
    {avg_money("rebate_amount")} AS avg_rebate,
    {avg_money("lowest_net_price")} AS avg_lowest_net
"""
_MARGIN_TENTHS = quotient("(lowest_net_price - unit_cost) * 100000", "lowest_net_price * 100")
_GIVEN_THOUSANDTHS = quotient("(list_price - lowest_net_price) * 100000", "list_price * 100")

#: Totals of lines in whole units, to be divided or added up again.
_TOTALS = """
    COUNT(*) AS lines, COUNT(margin_pct) AS margins, SUM(margin_pct * 10) AS margin_tenths,
    COUNT(total_discount_pct) AS shares, SUM(total_discount_pct * 1000) AS share_thousandths,
    SUM(invoice_price * quantity) AS earned, SUM(margin * quantity) AS kept
"""
_MEAN_MARGIN = rounded("margin_tenths", "margins", 1)
_MEAN_SHARE = rounded("share_thousandths", "shares", 1)

CTES: dict[str, str] = {
    "rate_card": """
        SELECT * FROM (VALUES
            ('GPO-001', 'AUTOMOBILE', CAST(0.030 AS DECIMAL(4,3))),
            ('GPO-002', 'BUILDING', 0.025), ('GPO-003', 'FURNITURE', 0.020),
            ('GPO-004', 'HOUSEHOLD', 0.015), ('GPO-005', 'MACHINERY', 0.020)
        ) AS v(gpo_id, name, fee)
    """,
    "gpos": """
        SELECT r.gpo_id, r.name, CAST(r.fee AS DOUBLE) AS admin_fee_pct,
               CAST(COUNT(c.c_custkey) AS INTEGER) AS member_count
        FROM rate_card r LEFT JOIN customer c ON c.c_mktsegment = r.name
        GROUP BY r.gpo_id, r.name, r.fee
    """,
    "sized": """
        SELECT c.*, CAST(CASE
                WHEN c_acctbal > 6500 THEN 31 + FLOOR((CAST(c_acctbal AS DECIMAL(12,2)) - 6500) / 100)
                WHEN c_acctbal > 2500 THEN 11 + FLOOR((CAST(c_acctbal AS DECIMAL(12,2)) - 2500) / 250)
                ELSE 2 + FLOOR((CAST(c_acctbal AS DECIMAL(12,2)) + 1000) / 500)
            END AS INTEGER) AS facility_count
        FROM customer c
    """,
    "idns": """
        SELECT CAST(s.c_custkey AS VARCHAR) AS idn_id, s.c_name AS name, r.gpo_id, s.facility_count,
               CAST(s.facility_count AS BIGINT) * (2000000 + s.c_custkey % 6000000) AS annual_spend,
               g.r_name AS region, n.n_name AS state,
               CASE WHEN s.facility_count > 30 THEN 'Large'
                    WHEN s.facility_count > 10 THEN 'Medium' ELSE 'Small' END AS tier
        FROM sized s
        JOIN nation n ON n.n_nationkey = s.c_nationkey
        JOIN region g ON g.r_regionkey = n.n_regionkey
        LEFT JOIN rate_card r ON r.name = s.c_mktsegment
    """,
    "facilities": """
        SELECT 'FAC-' || LPAD(CAST(s_suppkey AS VARCHAR), CAST(GREATEST(5, LENGTH(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0')
                   AS facility_id,
               CAST(s_suppkey AS VARCHAR) AS idn_id, s_name || ' - ' || kind AS name,
               kind AS facility_type,
               CAST(CASE kind WHEN 'Hospital' THEN s_suppkey % 750 + 50
                              WHEN 'ASC' THEN s_suppkey % 16 + 4 ELSE 0 END AS INTEGER) AS bed_count,
               n_name AS state, r_name AS region
        FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'Hospital' WHEN 1 THEN 'ASC' ELSE 'Clinic' END
                            AS kind FROM supplier) s
        JOIN nation ON n_nationkey = s_nationkey
        JOIN region ON r_regionkey = n_regionkey
    """,
    "products": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_type AS category,
               CAST(p_retailprice AS DECIMAL(10,2)) AS list_price,
               CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2))
                          * CAST(0.25 + 0.01 * p_size AS DECIMAL(4,2)), 2) AS DECIMAL(10,2)) AS cost,
               UPPER('SKU-' || p_brand || '-' || p_partkey) AS sku
        FROM part
    """,
    "contract_dates": """
        SELECT o.*, CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN o_orderkey % 10 < 3 THEN 12 WHEN o_orderkey % 10 < 8 THEN 24 ELSE 36 END AS months,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'PV' WHEN '2-HIGH' THEN 'DV'
                    WHEN '3-MEDIUM' THEN 'TV' WHEN '4-NOT SPECIFIED' THEN 'Access'
                    WHEN '5-LOW' THEN 'All Play' END AS deal_structure
        FROM orders o
    """,
    "contracts": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS contract_id,
               CASE WHEN o_orderkey % 7 < 4 THEN 'tenant_a' ELSE 'tenant_b' END AS tenant_id,
               CAST(o_custkey AS VARCHAR) AS idn_id, i.gpo_id, deal_structure,
               CASE o_orderkey % 4 WHEN 0 THEN 'Orthopedic Implants' WHEN 1 THEN 'Cardiovascular'
                    WHEN 2 THEN 'Surgical Instruments' ELSE 'Consumables' END AS device_category,
               start_date, CAST(start_date + CAST(months * 30 AS INTEGER) AS DATE) AS end_date,
               CAST(months AS INTEGER) AS duration_months,
               CASE WHEN structure_share + size_share IS NULL THEN NULL  -- unknown: no discount
                    WHEN structure_share + size_share + extra_share < 0.02 THEN 0.02
                    WHEN structure_share + size_share + extra_share > 0.40 THEN 0.40
                    ELSE structure_share + size_share + extra_share END AS base_discount_pct,
               CAST(CASE deal_structure WHEN 'PV' THEN 0.80 + 0.01 * (o_orderkey % 16)
                         WHEN 'DV' THEN 0.40 + 0.01 * (o_orderkey % 21)
                         WHEN 'TV' THEN 0.25 + 0.01 * (o_orderkey % 11) ELSE 0 END AS DECIMAL(4,2))
                   AS market_share_commitment,
               CASE WHEN start_date + CAST(months * 30 AS INTEGER) < {AS_OF}
                        THEN CASE WHEN o_orderstatus = 'F' THEN 'Expired' ELSE 'Renewed' END
                    WHEN start_date > {AS_OF} THEN 'Pending' ELSE 'Active' END AS status,
               CAST(o_orderkey % 4900 + 100 AS INTEGER) AS annual_volume_target,
               TRUE AS safe_harbor_compliant,
               CASE WHEN o_orderkey % 19 = 0 THEN 'High' WHEN o_orderkey % 19 BETWEEN 1 AND 5 THEN 'Medium'
                    ELSE 'Low' END AS aks_risk_flag,
               o_orderkey, i.region, i.tier, i.name AS idn_name
        FROM contract_dates LEFT JOIN idns i ON i.idn_id = CAST(o_custkey AS VARCHAR)
        LEFT JOIN (VALUES ('PV', CAST(0.20 AS DECIMAL(5,3))), ('DV', 0.15), ('TV', 0.12), ('Access', 0.05),
                          ('All Play', 0.03)) AS d(structure, structure_share) ON structure = deal_structure
        LEFT JOIN (VALUES ('Large', CAST(0.08 AS DECIMAL(5,3))), ('Medium', 0.04), ('Small', 0.0))
             AS z(size, size_share) ON size = i.tier
        CROSS JOIN LATERAL (SELECT CAST(0.01 * (o_orderkey % 9 - 4) AS DECIMAL(5,3)) AS extra_share) e
    """,
    "rebate_programs": """
        SELECT o_orderkey || '-' || j AS rebate_id, CAST(o_orderkey AS VARCHAR) AS contract_id, rebate_type,
               CAST(CASE rebate_type WHEN 'Volume' THEN 0.020 + 0.006 * (o_orderkey % 6)
                         WHEN 'Loyalty' THEN 0.010 + 0.004 * (o_orderkey % 6)
                         WHEN 'Bundle' THEN 0.010 + 0.002 * (o_orderkey % 6)
                         ELSE 0.005 + 0.002 * (o_orderkey % 6) END AS DECIMAL(4,3)) AS rebate_pct,
               CASE rebate_type WHEN 'Volume' THEN 'units_threshold'
                    WHEN 'Loyalty' THEN 'market_share_threshold'
                    WHEN 'Bundle' THEN 'cross_category_purchase' ELSE 'yoy_volume_increase' END
                   AS trigger_type,
               CAST(CAST(0.50 + 0.01 * ((o_orderkey + j) % 41) AS DECIMAL(4,2)) AS DOUBLE)
                   AS trigger_threshold,
               CASE WHEN (o_orderkey % 17 + j) % 5 < 2 THEN 'Offensive' ELSE 'Defensive' END AS orientation,
               (o_orderkey % 23 + j) % 20 < 13 AS earned
        FROM (SELECT o_orderkey, j, CASE (o_orderkey % 11 + j) % 4 WHEN 0 THEN 'Volume'
                     WHEN 1 THEN 'Loyalty' WHEN 2 THEN 'Bundle' ELSE 'Growth' END AS rebate_type
              FROM orders JOIN (VALUES (0), (1), (2)) AS s(j) ON j <= o_orderkey % 3) p
    """,
    "invoiced": """
        SELECT l.*, c.*, p.product_id, p.list_price, p.cost AS unit_cost, r.fee,
               CAST(l_tax AS DECIMAL(4,2)) AS rebate_rate,
               CAST(ROUND(p.list_price * (1 - c.base_discount_pct), 2) AS DECIMAL(10,2)) AS invoice_price
        FROM lineitem l
        JOIN contracts c ON c.o_orderkey = l.l_orderkey AND c.status IN ('Active', 'Renewed')
        JOIN products p ON p.product_id = CAST(l.l_partkey AS VARCHAR)
        JOIN rate_card r ON r.gpo_id = c.gpo_id
    """,
    "netted": """
        SELECT *, CAST(ROUND(invoice_price * fee, 2) AS DECIMAL(10,2)) AS gpo_admin_fee,
               CAST(ROUND(invoice_price * rebate_rate, 2) AS DECIMAL(10,2)) AS rebate_amount,
               CAST(invoice_price - ROUND(invoice_price * fee, 2)
                    - ROUND(invoice_price * rebate_rate, 2) AS DECIMAL(10,2)) AS lowest_net_price
        FROM invoiced
    """,
    "transactions": f"""
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
                   || CAST(FLOOR(l_quantity) AS INTEGER) AS transaction_id,
               tenant_id, contract_id, idn_id, gpo_id, product_id,
               CAST(l_shipdate AS DATE) AS transaction_date,
               CAST(FLOOR(l_quantity) AS INTEGER) AS quantity,
               list_price, base_discount_pct, rebate_rate, invoice_price, gpo_admin_fee, rebate_amount,
               lowest_net_price, unit_cost, lowest_net_price - unit_cost AS margin,
               CAST(CASE WHEN lowest_net_price > 0 THEN ({_MARGIN_TENTHS}) * 0.1 ELSE 0 END
                    AS DECIMAL(9,1)) AS margin_pct,
               CAST(CASE WHEN list_price > 0 THEN ({_GIVEN_THOUSANDTHS}) * 0.001 ELSE 0 END
                    AS DECIMAL(9,3)) AS total_discount_pct,
               deal_structure, device_category, region, tier AS idn_tier,
               'Q' || QUARTER(l_shipdate) || ' ' || YEAR(l_shipdate) AS quarter,
               CAST(YEAR(l_shipdate) AS INTEGER) AS year, CAST(MONTH(l_shipdate) AS INTEGER) AS month
        FROM netted
    """,
    "v_portfolio_summary": f"""
        SELECT tenant_id, device_category, deal_structure,
               COUNT(DISTINCT contract_id) AS contract_count, COUNT(*) AS transaction_count,
               {REVENUE} AS total_revenue, {avg_percent()} AS avg_margin_pct,
               {avg_share()} AS avg_discount_pct, {total("margin * quantity")} AS total_margin
        FROM transactions GROUP BY ALL
    """,
    "v_price_waterfall": f"""
        SELECT tenant_id, device_category, {_MEASURES},
               {avg_money("margin")} AS avg_margin, {avg_money("unit_cost")} AS avg_cost
        FROM transactions GROUP BY ALL
    """,
    "buyer_totals": f"""
        SELECT tenant_id, idn_id, gpo_id, COUNT(DISTINCT contract_id) AS active_contracts,
               {_TOTALS} FROM transactions GROUP BY tenant_id, idn_id, gpo_id
    """,
    "v_customer_performance": f"""
        SELECT b.tenant_id, idn_id, idns.name AS idn_name, tier AS idn_tier, region,
               rate_card.name AS gpo_name, active_contracts, lines AS transaction_count,
               CAST(earned AS DOUBLE) AS total_revenue, {_MEAN_MARGIN} AS avg_margin_pct,
               {_MEAN_SHARE} AS avg_discount_pct, CAST(kept AS DOUBLE) AS total_margin
        FROM buyer_totals b JOIN idns USING (idn_id) JOIN rate_card ON rate_card.gpo_id = b.gpo_id
    """,
    "v_monthly_trends": f"""
        SELECT tenant_id, year, month, quarter, device_category, COUNT(*) AS transactions,
               {REVENUE} AS revenue, {avg_percent()} AS avg_margin_pct, {avg_share()} AS avg_discount_pct
        FROM transactions GROUP BY ALL
    """,
    "same_name_totals": """
        SELECT name AS customer, tier, SUM(lines) AS lines, SUM(margins) AS margins,
               SUM(margin_tenths) AS margin_tenths, SUM(earned) AS earned
        FROM buyer_totals JOIN idns USING (idn_id) GROUP BY ALL
    """,
    "group_totals": f"""
        SELECT gpo_id, COUNT(DISTINCT contract_id) AS contracts, {_TOTALS}
        FROM transactions GROUP BY gpo_id
    """,
    "product_totals": f"SELECT product_id, {_TOTALS} FROM transactions GROUP BY product_id",
    "same_product_totals": """
        SELECT name AS product, category, SUM(lines) AS lines, SUM(shares) AS shares,
               SUM(share_thousandths) AS share_thousandths
        FROM product_totals JOIN products USING (product_id) GROUP BY ALL
    """,
    "deal_totals": f"SELECT contract_id, {_TOTALS} FROM transactions GROUP BY contract_id",
    "deal_results": f"""
        SELECT contracts.*, COALESCE(lines, 0) AS lines, {_MEAN_MARGIN} AS mean_margin,
               CAST(earned AS DOUBLE) AS earned, margin_tenths < 150 * margins AS thin
        FROM contracts LEFT JOIN deal_totals USING (contract_id)
    """,
    "deal_classes": """
        SELECT *, CASE WHEN aks_risk_flag = 'High' THEN 'Critical' WHEN thin THEN 'At Risk'
                       WHEN base_discount_pct > 0.30 THEN 'Watch' ELSE 'Healthy' END AS class
        FROM deal_results
    """,
    "v_contract_risk": """
        SELECT tenant_id, contract_id, idn_name, deal_structure, device_category, status,
               CAST(market_share_commitment AS DOUBLE) AS market_share_commitment,
               CAST(base_discount_pct AS DOUBLE) AS base_discount_pct, aks_risk_flag, end_date,
               lines AS transaction_count, mean_margin AS avg_margin_pct, earned AS total_revenue,
               class AS risk_status
        FROM deal_classes WHERE idn_name IS NOT NULL
    """,
    "portfolio": """
        SELECT tenant_id, idn_id, contract_id, deal_structure, device_category, status,
               CAST(base_discount_pct AS DOUBLE) AS base_discount_pct,
               CAST(market_share_commitment AS DOUBLE) AS market_share_commitment,
               start_date, end_date, aks_risk_flag,
               CASE WHEN idn_name IS NULL THEN 0 ELSE COALESCE(mean_margin, 0) END AS avg_margin_pct,
               CASE WHEN idn_name IS NULL THEN 0 ELSE COALESCE(earned, 0) END AS total_revenue,
               CASE WHEN idn_name IS NULL THEN 'Unknown' ELSE class END AS risk_status
        FROM deal_classes
    """,
    "pricing": f"""
        SELECT tenant_id, idn_id, device_category, {avg_money("list_price")} AS avg_list,
               {avg_money("invoice_price")} AS avg_invoice,
               {avg_money("lowest_net_price")} AS avg_lowest_net,
               {avg_percent()} AS avg_margin_pct, {avg_share()} AS avg_total_discount,
               COUNT(*) AS txn_count
        FROM transactions GROUP BY ALL
    """,
    "recent": """
        SELECT t.tenant_id, t.idn_id, t.transaction_id, t.transaction_date, p.name AS product_name,
               p.category, t.quantity, CAST(t.list_price AS DOUBLE) AS list_price,
               CAST(t.invoice_price AS DOUBLE) AS invoice_price,
               CAST(t.lowest_net_price AS DOUBLE) AS lowest_net_price,
               CAST(t.margin_pct AS DOUBLE) AS margin_pct, t.deal_structure
        FROM transactions t JOIN products p ON p.product_id = t.product_id
        QUALIFY ROW_NUMBER() OVER (PARTITION BY t.tenant_id, t.idn_id
                                   ORDER BY t.transaction_date DESC, t.transaction_id) <= 50
    """,
    "customer_rebates": """
        SELECT c.tenant_id, c.idn_id, r.rebate_id, r.contract_id, r.rebate_type, r.rebate_pct,
               r.trigger_type, r.trigger_threshold, r.orientation, r.earned
        FROM rebate_programs r JOIN contracts c ON c.contract_id = r.contract_id
    """,
}

def text(body: str) -> str:
    """Prepend the common table expressions that ``body`` needs, in order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.IGNORECASE):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()


def doubles(*names: str) -> str:
    return ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in names)


# --- named queries ----------------------------------------------------------

_CONTRACTS = f"""
    SELECT contract_id, tenant_id, idn_id, gpo_id, deal_structure, device_category, start_date, end_date,
           duration_months, {doubles("base_discount_pct", "market_share_commitment")}, status,
           annual_volume_target, safe_harbor_compliant, aks_risk_flag
    FROM contracts
"""
_PRICES = (
    "list_price",
    "invoice_price",
    "gpo_admin_fee",
    "rebate_amount",
    "lowest_net_price",
    "unit_cost",
    "margin",
    "margin_pct",
    "total_discount_pct",
)
_TRANSACTIONS = f"""
    SELECT transaction_id, tenant_id, contract_id, idn_id, gpo_id, product_id, transaction_date, quantity,
           {doubles(*_PRICES)}, deal_structure, device_category, region, idn_tier, quarter, year, month
    FROM transactions
"""
_REBATES = f"""
    SELECT rebate_id, contract_id, rebate_type, {doubles("rebate_pct")}, trigger_type, trigger_threshold,
           orientation, earned
    FROM rebate_programs
"""
_CHOSEN_LINES = """
    tenant_id = 'tenant_a' AND device_category = 'Cardiovascular' AND region = 'ASIA'
    AND deal_structure = 'PV' AND gpo_id IN (SELECT gpo_id FROM gpos WHERE name = 'BUILDING')
"""
_RISKY = "risk_status IN ('Critical', 'At Risk')"
_WATERFALL_MEANS = ", ".join(
    f"{mean(name, 2)} AS {name}"
    for name in (
        "avg_list_price",
        "avg_contract_discount",
        "avg_gpo_fee",
        "avg_rebate",
        "avg_lowest_net",
        "avg_margin",
        "avg_cost",
    )
)
_ALL_CATEGORIES = f"""
    SELECT tenant_id, 'All' AS device_category, {_WATERFALL_MEANS} FROM v_price_waterfall GROUP BY tenant_id
"""


def _grouped(value: str) -> str:
    """Whole number with thousands separators."""
    return f"FORMAT('{{:,}}', CAST({value} AS BIGINT))"


def _currency(value: str) -> str:
    def scaled(divisor: str, suffix: str) -> str:
        tenths = f"CAST(CAST({half_up(f'({value} / {divisor})', 1)} AS DECIMAL(28,1)) AS VARCHAR)"
        return f"'$' || {tenths} || '{suffix}'"

    return (
        f"CASE WHEN {value} >= 1e9 THEN {scaled('1e9', 'B')} WHEN {value} >= 1e6 THEN {scaled('1e6', 'M')} "
        f"WHEN {value} >= 1e3 THEN {scaled('1e3', 'K')} "
        f"ELSE '$' || {_grouped(half_up(value, 0))} END"
    )


def _millions(value: str) -> str:
    return f"'$' || CAST(CAST({half_up(f'(({value}) / 1e6)', 1)} AS DECIMAL(28,1)) AS VARCHAR) || 'M'"


def _percent(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(18,1)) AS VARCHAR) || '%'"


def _weighted_margin(revenue: str) -> str:
    weight = f"CAST(ROUND({revenue} * 100) AS HUGEINT)"
    tenths = "CAST(ROUND(avg_margin_pct * 10) AS HUGEINT)"
    return half_up(
        f"(CAST(SUM({tenths} * {weight}) AS DOUBLE) / CAST(SUM({weight}) AS DOUBLE) / 10.0)", 1
    )


def _steps(source: str) -> str:
    """The seven waterfall steps of every row of ``source``."""
    steps = (  # fixed values: the labels of the steps
        (1, "List Price", "absolute", "avg_list_price", 1),
        (2, "Contract Discount", "relative", "avg_contract_discount", -1),
        (3, "GPO Admin Fee", "relative", "avg_gpo_fee", -1),
        (4, "Rebates", "relative", "avg_rebate", -1),
        (5, "Lowest Net", "total", "avg_lowest_net", 0),
        (6, "Unit Cost", "relative", "avg_cost", -1),
        (7, "Margin", "total", "avg_margin", 0),
    )
    rows = " UNION ALL ".join(
        f"SELECT tenant_id, device_category, {step} AS step, '{name}' AS label, '{kind}' AS measure, "
        f"{f'{column} * {sign}' if sign else 'CAST(NULL AS DOUBLE)'} AS value, "
        f"'{'-' if sign < 0 else ''}$' || {_grouped(half_up(column, 0))} AS text FROM w"
        for step, name, kind, column, sign in steps
    )
    return f"""
        SELECT *, CAST(SUM(CAST(ROUND(COALESCE(value, 0) * 1e6) AS BIGINT)) OVER (
                     PARTITION BY tenant_id, device_category ORDER BY step
                     ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e6 AS running_total
        FROM (WITH w AS ({source}) {rows}) s
    """


def _portfolio_row(lines: str, risk: str) -> str:
    return f"""
        WITH_PARTS SELECT metric, label, value, format, metric = 'at_risk_deals' AND value > 10 AS alert,
               CASE format WHEN 'currency' THEN {_currency("value")}
                    WHEN 'percent' THEN {_percent("value")} ELSE {_grouped("value")} END AS text,
               CASE metric WHEN 'at_risk_deals' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || ' need attention' END AS note
        FROM (
            SELECT 'total_revenue' AS metric, 'Total Revenue' AS label,
                   COALESCE({REVENUE}, 0) AS value, 'currency' AS format
            FROM transactions WHERE {lines}
            UNION ALL
            SELECT 'avg_margin', 'Avg Margin %', COALESCE({avg_percent()}, 0), 'percent'
            FROM transactions WHERE {lines}
            UNION ALL
            SELECT 'active_contracts', 'Active Contracts', CAST(COUNT(*) AS DOUBLE), 'integer'
            FROM contracts WHERE tenant_id = '{TENANT}' AND status = 'Active'
            UNION ALL
            SELECT 'at_risk_deals', 'At-Risk Deals', CAST(COUNT(*) AS DOUBLE), 'integer'
            FROM v_contract_risk WHERE tenant_id = '{TENANT}' AND {_RISKY} AND {risk}
        ) k
    """.replace("WITH_PARTS ", "")


def _bodies() -> dict[str, str]:
    q: dict[str, str] = {}

    q["table_gpos"] = "SELECT * FROM gpos"
    q["table_idns"] = "SELECT * FROM idns"
    q["table_facilities"] = "SELECT * FROM facilities"
    q["table_products"] = (
        f"SELECT product_id, name, category, {doubles('list_price', 'cost')}, sku FROM products"
    )
    q["table_contracts"] = _CONTRACTS
    q["table_rebate_programs"] = _REBATES
    q["table_transactions"] = _TRANSACTIONS

    q["s1_csv_layer_contracts"] = _CONTRACTS
    q["s2_csv_layer_transactions"] = _TRANSACTIONS
    q["s3_store_portfolio_summary"] = "SELECT * FROM v_portfolio_summary"
    q["s4_parse_contract_dates"] = "SELECT contract_id, start_date, end_date FROM contracts"
    tables = ("gpos", "idns", "facilities", "products", "contracts", "rebate_programs", "transactions")
    views = (
        "v_portfolio_summary",
        "v_price_waterfall",
        "v_customer_performance",
        "v_monthly_trends",
        "v_contract_risk",
    )
    for name in tables:
        q[f"s2_csv_{name}"] = q[f"s3_store_{name}"] = q[f"table_{name}"]
    q["s6_registered_views"] = " UNION ALL ".join(
        f"SELECT '{name}' AS view_name, COUNT(*) AS row_count FROM {name}" for name in views
    )
    q["s6_registered_view"] = """
        SELECT tenant_id, idn_tier, COUNT(*) AS customers,
               CAST(SUM(transaction_count) AS BIGINT) AS transactions
        FROM v_customer_performance GROUP BY tenant_id, idn_tier
    """
    q["s7_row_counts"] = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {name}"
        for name in (
            "gpos",
            "idns",
            "facilities",
            "products",
            "contracts",
            "rebate_programs",
            "transactions",
        )
    )
    q["s8_parameterised_query"] = f"""
        SELECT contract_id, status, end_date FROM contracts
        WHERE tenant_id = '{TENANT}' AND deal_structure = 'PV'
    """
    q["s9_scalar_query"] = f"""
        SELECT COUNT(*) AS value FROM contracts WHERE tenant_id = '{TENANT}' AND status = 'Active'
    """
    q["s9_scalar_query_no_row"] = f"""
        SELECT CAST(CASE WHEN COUNT(*) = 0 THEN 0 ELSE ANY_VALUE(quantity) END AS INTEGER) AS value
        FROM transactions WHERE tenant_id = '{TENANT}' AND device_category = 'no such category'
    """
    q["s9_scalar_text"] = f"SELECT MAX(device_category) AS value FROM transactions WHERE tenant_id = '{TENANT}'"
    q["s9_scalar_date"] = f"SELECT MAX(transaction_date) AS value FROM transactions WHERE tenant_id = '{TENANT}'"
    q["s9_scalar_null"] = f"""
        SELECT MAX(quantity) AS value FROM transactions
        WHERE tenant_id = '{TENANT}' AND device_category = 'no such category'
    """
    q["s10_metric_table"] = f"""
        SELECT metric, label, value, format, delta_base, metric = 'at_risk_deals' AND value > 10 AS alert,
               CASE format WHEN 'currency' THEN {_currency("value")}
                    WHEN 'percent' THEN {_percent("value")} ELSE {_grouped("value")} END AS text
        FROM (
            SELECT 'total_revenue' AS metric, 'Total Revenue' AS label, {REVENUE} AS value,
                   'currency' AS format,
                   CAST(SUM(CASE WHEN year = 1999 THEN invoice_price * quantity END) AS DOUBLE) AS delta_base
            FROM transactions WHERE tenant_id = '{TENANT}'
            UNION ALL
            SELECT 'avg_margin', 'Avg Margin %', {avg_percent()}, 'percent', NULL
            FROM transactions WHERE tenant_id = '{TENANT}'
            UNION ALL
            SELECT 'active_contracts', 'Active Contracts', CAST(COUNT(*) AS DOUBLE), 'integer', NULL
            FROM contracts WHERE tenant_id = '{TENANT}' AND status = 'Active'
            UNION ALL
            SELECT 'at_risk_deals', 'At-Risk Deals', CAST(COUNT(*) AS DOUBLE), 'integer', NULL
            FROM v_contract_risk WHERE tenant_id = '{TENANT}' AND {_RISKY}
        ) k
    """

    derived = {
        "d1_invoice_price": ("list_price", "base_discount_pct", "invoice_price"),
        "d2_gpo_admin_fee": ("invoice_price", "gpo_admin_fee"),
        "d4_lowest_net_price": ("invoice_price", "gpo_admin_fee", "rebate_amount", "lowest_net_price"),
        "d5_margin": ("lowest_net_price", "unit_cost", "margin", "margin_pct"),
        "d6_total_discount": ("list_price", "lowest_net_price", "total_discount_pct"),
    }
    for name, columns in derived.items():
        key = ", gpo_id" if name == "d2_gpo_admin_fee" else ""
        q[name] = f"SELECT transaction_id{key}, {doubles(*columns)} FROM transactions"
    q["d3_rebate_amount"] = f"""
        SELECT transaction_id, CAST(rebate_rate AS DOUBLE) AS rebate_pct,
               {doubles("invoice_price", "rebate_amount")} FROM transactions
    """
    q["d7_calendar"] = """
        SELECT contract_id, start_date, 'Q' || QUARTER(start_date) || ' ' || YEAR(start_date) AS quarter,
               CAST(YEAR(start_date) AS INTEGER) AS year, CAST(MONTH(start_date) AS INTEGER) AS month
        FROM contracts
    """
    q["d8_denormalised"] = """
        SELECT transaction_id, tenant_id, gpo_id, deal_structure, device_category, region, idn_tier
        FROM transactions
    """
    q["d8_line_outcomes"] = """
        SELECT o.outcome, COUNT(l.outcome) AS lines
        FROM (VALUES ('unknown contract'), ('contract not billable'), ('unknown product'),
                     ('unknown buying group'), ('priced')) AS o(outcome)
        LEFT JOIN (
            SELECT CASE WHEN o_orderkey IS NULL THEN 'unknown contract'
                        WHEN status NOT IN ('Active', 'Renewed') THEN 'contract not billable'
                        WHEN p_partkey IS NULL THEN 'unknown product'
                        WHEN gpo_id IS NULL THEN 'unknown buying group' ELSE 'priced' END AS outcome
            FROM lineitem LEFT JOIN contracts ON o_orderkey = l_orderkey
            LEFT JOIN part ON p_partkey = l_partkey
        ) l ON l.outcome = o.outcome
        GROUP BY o.outcome
    """
    q["d9_eligible_contracts"] = """
        SELECT contract_id, tenant_id, status FROM contracts WHERE status IN ('Active', 'Renewed')
    """
    q["d10_contract_end"] = "SELECT contract_id, start_date, duration_months, end_date FROM contracts"
    q["d11_contract_status"] = "SELECT contract_id, start_date, end_date, status FROM contracts"
    q["d12_base_discount"] = f"""
        SELECT contract_id, deal_structure, tier AS idn_tier, {doubles("base_discount_pct")} FROM contracts
    """
    q["d13_commitment_check"] = """
        SELECT contract_id, deal_structure, CAST(market_share_commitment AS DOUBLE) AS market_share_commitment,
               CAST(low AS DOUBLE) AS commitment_low, CAST(high AS DOUBLE) AS commitment_high,
               market_share_commitment BETWEEN low AND high AS commitment_in_band
        FROM contracts JOIN (VALUES ('PV', 0.80, 0.95), ('DV', 0.40, 0.60), ('TV', 0.25, 0.35),
                                    ('Access', 0.0, 0.0), ('All Play', 0.0, 0.0)) AS b(structure, low, high)
             ON structure = deal_structure
    """
    q["d14_idn_tier"] = "SELECT idn_id, facility_count, tier FROM idns"
    q["d15_quantity_clamp"] = """
        SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, CAST(l_linenumber AS BIGINT) AS line_number,
               CAST(l_quantity AS BIGINT) AS ordered,
               CAST(CASE WHEN FLOOR(l_quantity) < 5 THEN 5 WHEN FLOOR(l_quantity) > 40 THEN 40
                         ELSE FLOOR(l_quantity) END AS INTEGER) AS quantity
        FROM lineitem
    """
    q["d16_rebate_check"] = """
        SELECT rebate_id, r.rebate_type, trigger_type, CAST(rebate_pct AS DOUBLE) AS rebate_pct,
               b.trigger AS expected_trigger, CAST(low AS DOUBLE) AS rebate_low,
               CAST(high AS DOUBLE) AS rebate_high,
               trigger_type = b.trigger AND rebate_pct BETWEEN low AND high AS rebate_conforms
        FROM rebate_programs r
        JOIN (VALUES ('Volume', 'units_threshold', 0.020, 0.050),
                     ('Loyalty', 'market_share_threshold', 0.010, 0.030),
                     ('Bundle', 'cross_category_purchase', 0.010, 0.020),
                     ('Growth', 'yoy_volume_increase', 0.005, 0.015)) AS b(kind, trigger, low, high)
          ON b.kind = r.rebate_type
    """
    q["d13_commitment_conformance"] = """
        SELECT * FROM (
        WITH shares AS (
            SELECT k, MAX(n) AS most, SUM(n) AS total
            FROM (SELECT l_orderkey AS k, l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)
            GROUP BY k
        ), bands(rule, structure, low, high) AS (
            VALUES ('PV commitment', 'PV', 80, 95), ('DV commitment', 'DV', 40, 60), ('TV commitment', 'TV', 25, 35)
        )
        SELECT rule, COUNT(k) AS checked,
               COUNT(k) FILTER (WHERE NOT (100 * most BETWEEN low * total AND high * total)) AS violations
        FROM bands LEFT JOIN (shares JOIN contracts c ON CAST(c.contract_id AS BIGINT) = k)
             ON c.deal_structure = structure
        GROUP BY rule
        ) report
    """
    q["d16_rebate_conformance"] = """
        SELECT * FROM (
        WITH rates AS (
            SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, COUNT(*) AS n,
                   SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS hundredths
            FROM lineitem GROUP BY l_orderkey
        ), bands(kind, low, high) AS (
            VALUES ('Volume', 20, 50), ('Loyalty', 10, 30), ('Bundle', 10, 20), ('Growth', 5, 15)
        )
        SELECT kind || ' rate' AS rule, COUNT(n) AS checked,
               COUNT(n) FILTER (WHERE hundredths * 10 < low * n OR hundredths * 10 > high * n) AS violations
        FROM bands LEFT JOIN rebate_programs p ON p.rebate_type = kind
        LEFT JOIN rates r ON r.contract_id = p.contract_id
        GROUP BY kind
        ) report
    """
    q["d_line_conformance"] = """
        SELECT UNNEST(['discount in bounds', 'quantity in bounds', 'quantity whole', 'sold after ordered',
                       'within order total']) AS rule,
               UNNEST([COUNT(*), COUNT(*), COUNT(*), COUNT(o_orderkey), COUNT(o_orderkey)]) AS checked,
               UNNEST([SUM(CASE WHEN ROUND(l_discount * 100) BETWEEN 2 AND 40 THEN 0 ELSE 1 END),
                       SUM(CASE WHEN l_quantity BETWEEN 1 AND 200 THEN 0 ELSE 1 END),
                       SUM(CASE WHEN l_quantity = FLOOR(l_quantity) THEN 0 ELSE 1 END),
                       SUM(CASE WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 1 ELSE 0 END),
                       SUM(CASE WHEN ROUND(l_extendedprice * 100) > ROUND(o_totalprice * 100) THEN 1 ELSE 0 END)
                      ])::BIGINT AS violations
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
    """
    q["d17_surrogate_ids"] = """
        SELECT contract_id,
               'CTR-' || LPAD(contract_id, CAST(GREATEST(4, LENGTH(contract_id)) AS INTEGER), '0') AS contract_code,
               'IDN-' || LPAD(idn_id, CAST(GREATEST(3, LENGTH(idn_id)) AS INTEGER), '0') AS idn_code
        FROM contracts
    """
    q["d18_price_transactions"] = _TRANSACTIONS

    for number, name in enumerate(
        ("portfolio_summary", "price_waterfall", "customer_performance", "monthly_trends", "contract_risk"),
        start=1,
    ):
        q[f"v{number}_{name}"] = f"SELECT * FROM v_{name}"
        q[f"a{number}_{name}"] = f"SELECT * FROM v_{name} WHERE tenant_id = '{TENANT}'"
    chosen = {
        "a1_portfolio_summary": "device_category = 'Cardiovascular' AND deal_structure = 'PV'",
        "a2_price_waterfall": "device_category = 'Cardiovascular'",
        "a3_customer_performance": "region = 'ASIA' AND gpo_name = 'BUILDING'",
        "a4_monthly_trends": "device_category = 'Cardiovascular'",
        "a5_contract_risk": "device_category = 'Cardiovascular' AND deal_structure = 'PV'",
    }
    for name, condition in chosen.items():
        q[f"{name}_filtered"] = f"{q[name]} AND {condition}"

    q["p1_tenant_predicate"] = f"""
        SELECT contract_id, tenant_id, status FROM contracts
        WHERE tenant_id = '{TENANT}' AND (status = 'Active' OR aks_risk_flag = 'High')
    """
    q["p2_dimension_filters"] = """
        SELECT transaction_id, device_category, region, deal_structure FROM transactions
        WHERE device_category = 'Cardiovascular' AND region = 'ASIA'
    """
    q["p3_gpo_filter_on_table"] = """
        SELECT contract_id, gpo_id FROM contracts
        WHERE gpo_id IN (SELECT gpo_id FROM gpos WHERE name = 'BUILDING')
    """
    q["p4_gpo_filter_on_view"] = "SELECT * FROM v_customer_performance WHERE gpo_name = 'BUILDING'"
    q["p5_dimensions_per_view"] = (
        "SELECT * FROM v_price_waterfall WHERE device_category = 'Cardiovascular'"
    )
    q["p6_in_list"] = f"SELECT contract_id, risk_status FROM v_contract_risk WHERE {_RISKY}"
    q["p7_range"] = f"""
        SELECT transaction_id, {doubles("margin_pct")} FROM transactions WHERE margin_pct BETWEEN 0 AND 30
    """
    q["p8_having"] = """
        SELECT idn_id, COUNT(*) AS transactions FROM transactions GROUP BY idn_id HAVING COUNT(*) > 20
    """
    q["p9_tenant_sql"] = f"""
        SELECT tenant_id, risk_status, COUNT(*) AS contract_count FROM v_contract_risk
        WHERE tenant_id = '{TENANT}' GROUP BY tenant_id, risk_status
    """
    own = f"WHERE tenant_id = '{TENANT}'"
    seen = {name: f"FROM {name}" for name in tables} | {
        name: f"FROM {name} {own}" for name in ("contracts", "transactions", *views)
    }
    seen["customer_contracts"] = seen["contracts"]
    seen["rebate_programs"] = (
        f"FROM rebate_programs WHERE contract_id IN (SELECT contract_id FROM contracts {own})"
    )
    q["p10_scoped_tables"] = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count {rows}" for name, rows in seen.items()
    )

    q["a6_device_categories"] = (
        f"SELECT DISTINCT device_category FROM transactions WHERE tenant_id = '{TENANT}'"
    )
    q["a7_regions"] = f"SELECT DISTINCT region FROM transactions WHERE tenant_id = '{TENANT}'"
    q["a8_gpo_names"] = f"""
        SELECT DISTINCT g.name FROM gpos g JOIN transactions t ON t.gpo_id = g.gpo_id
        WHERE t.tenant_id = '{TENANT}'
    """
    q["a9_idn_list"] = f"""
        SELECT DISTINCT i.idn_id, i.name, i.tier, i.region
        FROM idns i JOIN transactions t ON t.idn_id = i.idn_id WHERE t.tenant_id = '{TENANT}'
    """

    q["k1_total_revenue"] = f"SELECT COALESCE({REVENUE}, 0) AS value FROM transactions WHERE {_CHOSEN_LINES}"
    q["k2_average_margin"] = f"""
        SELECT COALESCE({avg_percent()}, 0) AS value FROM transactions WHERE {_CHOSEN_LINES}
    """
    q["k3_active_contracts"] = q["s9_scalar_query"]
    chosen_risk = "device_category = 'Cardiovascular' AND deal_structure = 'PV'"
    q["k4_at_risk_deals"] = f"""
        SELECT COUNT(*) AS value FROM v_contract_risk
        WHERE tenant_id = '{TENANT}' AND {_RISKY} AND {chosen_risk}
    """
    q["k5_revenue_of_year"] = f"""
        SELECT COALESCE({REVENUE}, 0) AS value FROM transactions
        WHERE tenant_id = '{TENANT}' AND year = 1999
    """
    q["k5_revenue_growth"] = f"""
        SELECT tenant_id, year, revenue, prior_revenue,
               CASE WHEN prior_revenue > 0 THEN {half_up("(revenue / prior_revenue - 1)", 3)} END AS growth
        FROM (SELECT a.tenant_id, a.year, a.revenue, b.revenue AS prior_revenue
              FROM (SELECT tenant_id, year, {REVENUE} AS revenue FROM transactions GROUP BY ALL) a
              LEFT JOIN (SELECT tenant_id, year, {REVENUE} AS revenue FROM transactions GROUP BY ALL) b
                ON b.tenant_id = a.tenant_id AND b.year = a.year - 1) y
    """
    q["k6_at_risk_alert"] = f"""
        SELECT COUNT(*) AS value, COUNT(*) > 10 AS alert FROM v_contract_risk WHERE {_RISKY}
    """
    q["k7_display_text"] = f"""
        SELECT contract_id, {_currency("COALESCE(total_revenue, 0)")} AS revenue_text,
               {_grouped("ROUND(COALESCE(total_revenue, 0) * 100)")} AS cents_text,
               {_percent("COALESCE(avg_margin_pct, 0)")} AS margin_text
        FROM v_contract_risk
    """
    q["k_portfolio_row"] = _portfolio_row(f"tenant_id = '{TENANT}'", "TRUE")
    q["k_portfolio_row_filtered"] = _portfolio_row(_CHOSEN_LINES, chosen_risk)
    q["k8_customer_kpis"] = f"""
        SELECT tenant_id, idn_id, idn_name, gpo_name, {_currency("total_revenue")} AS revenue_text,
               {_percent("avg_margin_pct")} AS margin_text,
               CASE WHEN avg_margin_pct < 20 THEN 'Below target' ELSE 'On target' END AS margin_target,
               CAST(active_contracts AS VARCHAR) AS contracts_text,
               {_grouped("transaction_count")} AS transactions_text
        FROM v_customer_performance
    """

    q["c1_waterfall_category"] = "SELECT * FROM v_price_waterfall WHERE device_category = 'Consumables'"
    q["c2_waterfall_all"] = _ALL_CATEGORIES
    weighted = ", ".join(
        f"CAST(SUM(CAST(ROUND({name} * 100) AS BIGINT) * n) AS DOUBLE) / CAST(SUM(n) * 100 AS DOUBLE) AS {name}"
        for name in (
            "avg_list_price",
            "avg_contract_discount",
            "avg_gpo_fee",
            "avg_rebate",
            "avg_lowest_net",
            "avg_margin",
            "avg_cost",
        )
    )
    q["c2_waterfall_weighted"] = f"""
        SELECT v.tenant_id, 'All' AS device_category, {weighted}
        FROM v_price_waterfall v
        JOIN (SELECT tenant_id, device_category, COUNT(*) AS n FROM transactions GROUP BY ALL) c
          ON c.tenant_id = v.tenant_id AND c.device_category = v.device_category
        GROUP BY v.tenant_id
    """
    q["c3_waterfall_steps"] = _steps("SELECT * FROM v_price_waterfall")
    q["c3_waterfall_steps_all"] = _steps(_ALL_CATEGORIES)
    trend = f"""
        SELECT tenant_id, year, month, {mean("avg_margin_pct", 1)} AS avg_margin,
               CAST(SUM(CAST(ROUND(revenue * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue,
               MAKE_DATE(year, month, 1) AS date
        FROM v_monthly_trends GROUP BY tenant_id, year, month
    """
    q["c4_margin_trend"] = trend
    q["c4_margin_trend_weighted"] = trend.replace(
        mean("avg_margin_pct", 1), _weighted_margin("revenue")
    )
    q["c5_margin_alerts"] = f"""
        SELECT tenant_id, date, avg_margin,
               CASE WHEN avg_margin < 0 OR avg_margin > 60 THEN NULL WHEN avg_margin < 15 THEN 'red'
                    WHEN avg_margin < 25 THEN 'amber' ELSE 'green' END AS band,
               avg_margin < 15 AS below_minimum, avg_margin >= 25 AS on_target
        FROM ({trend}) m
    """
    cents_total = "CAST(SUM(CAST(ROUND(total_revenue * 100) AS BIGINT)) AS DOUBLE) / 100"
    q["c6_revenue_by_category"] = f"""
        SELECT tenant_id, device_category, {cents_total} AS total_revenue,
               {mean("avg_margin_pct", 1)} AS avg_margin, {_millions(cents_total)} AS label
        FROM v_portfolio_summary GROUP BY tenant_id, device_category
    """
    q["c6_revenue_by_category_weighted"] = q["c6_revenue_by_category"].replace(
        mean("avg_margin_pct", 1), _weighted_margin("total_revenue")
    )
    q["c7_deal_structure_mix"] = f"""
        SELECT tenant_id, deal_structure, CAST(contract_count AS BIGINT) AS contract_count,
               CAST({quotient("contract_count * 1000", "tenant_total")} AS DOUBLE) / 10 AS share_pct
        FROM (SELECT s.*, SUM(contract_count) OVER (PARTITION BY tenant_id) AS tenant_total
              FROM (SELECT tenant_id, deal_structure, SUM(contract_count) AS contract_count
                    FROM v_portfolio_summary GROUP BY ALL) s) x
    """
    top = """
        SELECT * FROM v_customer_performance
        QUALIFY ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY total_revenue DESC, idn_id) <= 20
    """
    q["c8_top_customers"] = top
    colour = _weighted_margin("total_revenue")
    q["c9_concentration"] = f"""
        SELECT tenant_id, gpo_name, idn_name, 'idn' AS level, {cents_total} AS total_revenue,
               {colour} AS avg_margin_pct
        FROM ({top}) t GROUP BY tenant_id, gpo_name, idn_name
        UNION ALL
        SELECT tenant_id, gpo_name, NULL, 'gpo', {cents_total}, {colour}
        FROM ({top}) t GROUP BY tenant_id, gpo_name
    """
    q["c10_risk_distribution"] = """
        SELECT t.tenant_id, CAST(s.position AS INTEGER) AS position, s.risk_status,
               COUNT(v.contract_id) AS contract_count
        FROM (SELECT DISTINCT tenant_id FROM contracts) t
        JOIN (VALUES (1, 'Critical'), (2, 'At Risk'), (3, 'Watch'), (4, 'Healthy')) AS s(position, risk_status)
          ON TRUE
        LEFT JOIN v_contract_risk v ON v.tenant_id = t.tenant_id AND v.risk_status = s.risk_status
        GROUP BY t.tenant_id, s.position, s.risk_status
    """
    q["c11_revenue_by_region"] = f"""
        SELECT tenant_id, region, {cents_total} AS total_revenue, {mean("avg_margin_pct", 1)} AS avg_margin,
               CAST(SUM(active_contracts) AS BIGINT) AS contracts, {_millions(cents_total)} AS label
        FROM v_customer_performance GROUP BY tenant_id, region
    """
    q["c11_revenue_by_region_weighted"] = q["c11_revenue_by_region"].replace(
        mean("avg_margin_pct", 1), _weighted_margin("total_revenue")
    )
    q["c12_needing_attention"] = f"""
        SELECT tenant_id, contract_id AS "Contract", idn_name AS "Customer", deal_structure AS "Structure",
               device_category AS "Category", avg_margin_pct AS "Margin %", total_revenue AS "Revenue",
               risk_status AS "Risk", aks_risk_flag AS "AKS Flag"
        FROM v_contract_risk WHERE {_RISKY}
        QUALIFY ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY risk_status,
                                   total_revenue DESC NULLS LAST, contract_id) <= 10
    """
    q["c12_needing_attention_by_severity"] = f"""
        SELECT * FROM v_contract_risk WHERE {_RISKY}
        QUALIFY ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY risk_status DESC,
                                   total_revenue DESC NULLS LAST, contract_id) <= 10
    """
    q["c13_display_contracts"] = """
        SELECT tenant_id, idn_id, contract_id AS "Contract", deal_structure AS "Structure",
               device_category AS "Category", status AS "Status", base_discount_pct AS "Base Discount",
               market_share_commitment AS "Share Commit", avg_margin_pct AS "Margin %",
               total_revenue AS "Revenue", risk_status AS "Risk", end_date AS "Expires"
        FROM portfolio
    """
    q["c13_display_pricing"] = """
        SELECT tenant_id, idn_id, device_category AS "Category", avg_list AS "Avg List ($)",
               avg_invoice AS "Avg Invoice ($)", avg_lowest_net AS "Avg Lowest Net ($)",
               avg_margin_pct AS "Margin %", avg_total_discount AS "Total Discount %",
               txn_count AS "Transactions"
        FROM pricing
    """
    q["c13_display_recent"] = """
        SELECT tenant_id, idn_id, transaction_id AS "TXN ID", transaction_date AS "Date", product_name AS "Product",
               category AS "Category", quantity AS "Qty", list_price AS "List ($)",
               invoice_price AS "Invoice ($)", lowest_net_price AS "Lowest Net ($)",
               margin_pct AS "Margin %", deal_structure AS "Structure"
        FROM recent
    """
    q["c13_display_rebates"] = """
        SELECT tenant_id, idn_id, rebate_id AS "Rebate ID", contract_id AS "Contract", rebate_type AS "Type",
               CAST(rebate_pct AS DOUBLE) AS "Rate", trigger_type AS "Trigger",
               trigger_threshold AS "Threshold", orientation AS "Orientation", earned AS "Earned?"
        FROM customer_rebates
    """
    for name, column in (("c14_structure_counts", "deal_structure"), ("c15_risk_counts", "risk_status")):
        q[name] = f"SELECT tenant_id, idn_id, {column}, COUNT(*) AS count FROM portfolio GROUP BY ALL"
    q["c16_price_series"] = " UNION ALL ".join(
        f"SELECT tenant_id, idn_id, device_category, '{label}' AS series, {column} AS price FROM pricing"
        for label, column in (
            ("List Price", "avg_list"),
            ("Invoice Price", "avg_invoice"),
            ("Lowest Net", "avg_lowest_net"),
        )
    )
    q["c17_rebate_summary"] = f"""
        SELECT tenant_id, idn_id, COUNT(*) FILTER (WHERE earned) AS earned_count,
               COUNT(*) AS total_programs,
               {half_up("(CAST(COUNT(*) FILTER (WHERE earned) AS DOUBLE) * 100 / COUNT(*))", 0)}
                   AS earn_rate_pct,
               {avg_share("rebate_pct")} AS avg_rebate_pct
        FROM customer_rebates GROUP BY tenant_id, idn_id
    """

    q["q1_customer_overview"] = "SELECT * FROM v_customer_performance"
    q["q2_contract_portfolio"] = "SELECT * FROM portfolio"
    q["q3_pricing_by_category"] = "SELECT * FROM pricing"
    q["q4_recent_transactions"] = "SELECT * FROM recent"
    q["q5_rebate_programs"] = """
        SELECT tenant_id, idn_id, rebate_id, contract_id, rebate_type,
               CAST(rebate_pct AS DOUBLE) AS rebate_pct, trigger_type, trigger_threshold, orientation, earned
        FROM customer_rebates
    """
    for name in ("q1_customer_overview", "q2_contract_portfolio", "q3_pricing_by_category",
                 "q4_recent_transactions", "q5_rebate_programs"):
        q[f"{name}_one"] = f"SELECT * FROM ({q[name]}) report WHERE idn_id = '12'"

    q["n1_revenue_by_category"] = f"""
        SELECT device_category, {REVENUE} AS total_revenue FROM transactions GROUP BY device_category
    """
    q["n2_margin_by_structure"] = f"""
        SELECT deal_structure, {avg_percent()} AS avg_margin_pct, COUNT(*) AS transactions
        FROM transactions GROUP BY deal_structure
    """
    q["n3_lowest_margin_customers"] = f"""
        SELECT customer, tier, {_MEAN_MARGIN} AS avg_margin, CAST(earned AS DOUBLE) AS revenue
        FROM same_name_totals WHERE lines > 10 ORDER BY avg_margin, customer, tier LIMIT 10
    """
    q["n4_category_waterfall"] = f"""
        SELECT {_MEASURES} FROM transactions WHERE device_category = 'Orthopedic Implants'
    """
    q["n5_contracts_at_risk"] = (
        "SELECT risk_status, COUNT(*) AS contract_count FROM v_contract_risk GROUP BY risk_status"
    )
    q["n6_margin_by_quarter"] = f"""
        SELECT quarter, year, CAST(QUARTER(transaction_date) AS INTEGER) AS quarter_of_year,
               {avg_percent()} AS avg_margin, {REVENUE} AS total_revenue, COUNT(*) AS transactions
        FROM transactions GROUP BY quarter, year, QUARTER(transaction_date)
    """
    q["n7_margin_by_gpo"] = f"""
        SELECT name AS gpo_name, {_MEAN_MARGIN} AS avg_margin, CAST(earned AS DOUBLE) AS total_revenue,
               contracts
        FROM group_totals JOIN rate_card USING (gpo_id)
    """
    earn_rates = f"""
        SELECT rebate_type, COUNT(*) AS total_programs, COUNT(*) FILTER (WHERE earned) AS earned_count,
               {avg_share("rebate_pct")} AS avg_rebate_pct,
               {rounded("COUNT(*) FILTER (WHERE earned) * 1000", "COUNT(*)", 1)} AS earn_rate_pct
        FROM SOURCE GROUP BY rebate_type
    """
    q["n8_rebate_earn_rates"] = earn_rates.replace("SOURCE", "rebate_programs")
    q["n8_rebate_earn_rates_tenant"] = earn_rates.replace(
        "SOURCE", f"(SELECT * FROM customer_rebates WHERE tenant_id = '{TENANT}') r"
    )
    q["n9_revenue_by_region"] = f"""
        SELECT region, {REVENUE} AS total_revenue, {avg_percent()} AS avg_margin,
               COUNT(DISTINCT idn_id) AS customers
        FROM transactions GROUP BY region
    """
    q["n10_highest_price_erosion"] = f"""
        SELECT product, category, {_MEAN_SHARE} AS avg_discount_pct
        FROM same_product_totals WHERE lines > 20 ORDER BY avg_discount_pct DESC, product, category LIMIT 10
    """
    q["n11_expiring_contracts"] = f"""
        SELECT contract_id, start_date, end_date,
               CAST(DATE_DIFF('day', {AS_OF}, end_date) AS INTEGER) AS days_until_expiration
        FROM contracts WHERE DATE_DIFF('day', {AS_OF}, end_date) BETWEEN 0 AND 30
    """
    return q


def oracle_texts() -> dict[str, str]:
    return {name: text(body) for name, body in _bodies().items()}
