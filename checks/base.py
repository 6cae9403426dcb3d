"""The canonical tables themselves, engine against engine."""

PAIRS = {
    "tenants": "t_tenants", "customers": "t_customers", "fact_orders": "t_orders",
    "fact_order_items": "t_items", "products": "t_products", "variants": "t_variants",
    "fact_shipments": "t_shipments", "fact_payments": "t_payments", "fact_refunds": "t_refunds",
    "dim_campaigns": "t_campaigns", "fact_messages": "t_messages", "fact_consent": "t_consent",
    "fact_tickets": "t_tickets", "fact_reviews": "t_reviews", "fact_nps": "t_nps",
    "experiments": "t_experiments", "dim_customers": "t_dim_customers", "score_runs": "t_runs",
    "predictions": "t_predictions",
}
DROP = {"customers": ["merged_into_customer_id"],
        "fact_orders": ["delivered_at", "customer_order_index"], "predictions": ["total_spent_paise"]}
SQL_DROP = {"t_orders": ["buyer_id"]}

QUERIES = {
    f"table_{name}": (lambda n: lambda t: getattr(t, n).drop(*DROP.get(n, [])))(name) for name in PAIRS
}
SQL = {
    f"table_{name}": f"SELECT * EXCLUDE ({', '.join(SQL_DROP[sql])}) FROM {sql}" if sql in SQL_DROP
    else f"SELECT * FROM {sql}"
    for name, sql in PAIRS.items()
}
