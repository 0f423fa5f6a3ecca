"""Build tiny retail tables from Python rows for unit tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from basketlens.sources.schemas import TABLE_SCHEMAS
from basketlens.sources.tables import RetailTables


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def m(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def tables(spark, customers=(), orders=(), items=(), products=(), sellers=()) -> RetailTables:
    """customers: (id, reg); orders: (id, cust, date, subtotal); items: (id, order, product, status, total);
    products: (id, name, category, seller); sellers: (id, type, fbs)."""
    def frame(name, rows):
        schema = TABLE_SCHEMAS[name]
        width = len(schema.fields)
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)
    return RetailTables(
        frame("customers", [(c, d(r) if r else None) for c, r in customers]),
        frame("orders", [(o, c, d(dd), m(s)) for o, c, dd, s in orders]),
        frame("order_items", [(i, o, p, st, m(v)) for i, o, p, st, v in items]),
        frame("products", list(products)),
        frame("sellers", list(sellers)),
    )
