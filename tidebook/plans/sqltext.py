"""Shared SQL fragments for oracle queries; each mirrors one Column function."""

from __future__ import annotations

from ..sources.derived import TICKS_SQL

T = TICKS_SQL


def R(x: str, dp: int) -> str:
    return f"(floor(({x})*1e{dp} + 0.5000001e0)/1e{dp})"


def clamp(x: str, lo="0.0", hi="1.0") -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least({hi}, greatest({lo}, {x})) END)"


def mid(b: str, a: str) -> str:
    raw = (
        f"CASE WHEN {b} IS NOT NULL AND {a} IS NOT NULL THEN ({b}+{a})/2.0 "
        f"WHEN {b} IS NOT NULL THEN {b}+0.005e0 WHEN {a} IS NOT NULL THEN {a}-0.005e0 END"
    )
    return clamp(raw, "0.0e0", "1.0e0")


TSM = R(clamp("((up_bid+up_ask)/2.0e0 + (1.0e0-(dn_bid+dn_ask)/2.0e0))/2.0e0", "0.0e0", "1.0e0"), 4)
DEC = "CAST(floor(({x})*1e4 + 0.5000001e0) AS INT)"


def dec(x: str) -> str:
    return DEC.format(x=x)


def resting_up(m: str, off) -> str:
    return R(clamp(f"{m}-{off}e0", "0.01e0", "0.99e0"), 3)


def resting_dn(m: str, off) -> str:
    return R(clamp(f"(1.0e0-{m})-{off}e0", "0.01e0", "0.99e0"), 3)


def queue(ladder: str, price: str) -> str:
    return (
        f"(CASE WHEN len({ladder})>0 AND ({price}) IS NOT NULL THEN "
        f"coalesce(list_sum(list_transform(list_filter({ladder}, lambda q: q.price >= {price}), lambda q: q.size)), 0.0e0) END)"
    )


def classify(mx: str, mn: str) -> str:
    return (
        f"CASE WHEN {mx} IS NULL THEN 'no_data' WHEN {dec(mx)}-5000>=200 AND 5000-{dec(mn)}>=200 THEN 'oscillating' "
        f"WHEN {dec(mx)}-5000>=200 OR 5000-{dec(mn)}>=200 THEN 'monotonic' ELSE 'flat' END"
    )


def day_of(epoch: str) -> str:
    return f"strftime(make_timestamp(CAST(floor({epoch}) AS BIGINT)*1000000), '%Y-%m-%d')"
