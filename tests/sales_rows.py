"""Rows of the retail tables and small readers, for the sales tests."""

from __future__ import annotations

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def order(order_id, date, customer="A", employee=1):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "employee_id": employee,
        "order_date": day(date) if date else None,
    }


def line(order_id, product_id, price, quantity=1, discount=0.0):
    return {
        "order_id": order_id,
        "product_id": product_id,
        "unit_price": float(price),
        "quantity": quantity,
        "discount": float(discount),
    }


def product(product_id, name, category, price=10.0):
    return {
        "product_id": product_id,
        "product_name": name,
        "category_id": category,
        "unit_price": float(price),
        "discontinued": 0,
    }


def category(category_id, name):
    return {"category_id": category_id, "category_name": name}


def customer(customer_id, name=None):
    return {"customer_id": customer_id, "company_name": name or customer_id}


def employee(employee_id, first, last):
    return {"employee_id": employee_id, "first_name": first, "last_name": last}


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def final_plan(df) -> str:
    """Physical plan after adaptive execution has run it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
