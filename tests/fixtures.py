"""Small hand-made tables."""

import datetime as dt

from marginflow.model import SCHEMAS, FrameTables

DAY = dt.date(2024, 5, 17)

GPOS = [("G1", "Buyers' Union", 0.03, 10), ("G2", "Second", 0.02, 5)]
IDNS = [
    ("I1", "North Health", "G1", 31, 100, "West", "CA", "Large"),
    ("I2", "South Health", "G2", 5, 50, "East", "NY", "Small"),
]
PRODUCTS = [
    ("P1", "Stent", "Cardiovascular", 100.0, 40.0, "SKU-1"),
    ("P2", "Kit", "Consumables", 50.0, 20.0, "SKU-2"),
]


def contract(key, tenant="t1", idn="I1", flag="Low", discount=0.2, status="Active", **other):
    row = {
        "contract_id": key,
        "tenant_id": tenant,
        "idn_id": idn,
        "gpo_id": "G1" if idn == "I1" else "G2",
        "deal_structure": "PV",
        "device_category": "Cardiovascular",
        "start_date": dt.date(2024, 1, 1),
        "end_date": dt.date(2025, 12, 21),
        "duration_months": 24,
        "base_discount_pct": discount,
        "market_share_commitment": 0.85,
        "status": status,
        "annual_volume_target": 100,
        "safe_harbor_compliant": True,
        "aks_risk_flag": flag,
    }
    row.update(other)
    return tuple(row.values())


def line(key, contract_id="C1", tenant="t1", idn="I1", quantity=1, margin_pct=30.0, **other):
    row = {
        "transaction_id": key,
        "tenant_id": tenant,
        "contract_id": contract_id,
        "idn_id": idn,
        "gpo_id": "G1" if idn == "I1" else "G2",
        "product_id": "P1",
        "transaction_date": DAY,
        "quantity": quantity,
        "list_price": 100.0,
        "invoice_price": 80.0,
        "gpo_admin_fee": 2.4,
        "rebate_amount": 4.0,
        "lowest_net_price": 73.6,
        "unit_cost": 40.0,
        "margin": 33.6,
        "margin_pct": margin_pct,
        "total_discount_pct": 0.264,
        "deal_structure": "PV",
        "device_category": "Cardiovascular",
        "region": "West",
        "idn_tier": "Large",
        "quarter": "Q2 2024",
        "year": 2024,
        "month": 5,
    }
    row.update(other)
    return tuple(row.values())


def tables(spark, contracts=(), lines=(), rebates=(), gpos=GPOS, idns=IDNS, products=PRODUCTS):
    rows = {
        "gpos": gpos,
        "idns": idns,
        "products": products,
        "facilities": [],
        "contracts": contracts,
        "transactions": lines,
        "rebate_programs": rebates,
    }
    return FrameTables(
        **{name: spark.createDataFrame(list(data), SCHEMAS[name]) for name, data in rows.items()}
    )
