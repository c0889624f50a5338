"""Tenant scope, access control and attribute safety as predicates, so that they reach the scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text


@dataclass(frozen=True)
class Principal:
    """Who asks: a tenant and instance, the groups and roles held, and the highest level that may be read."""

    tenant_id: str
    instance_id: str
    groups: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    max_level: int = 1


def acl_allowed(level: Column, groups: Column, roles: Column, p: Principal) -> Column:
    """Level within reach; groups and roles, where a row names any, must meet the caller's."""

    def meets(row: Column, own: tuple[str, ...]) -> Column:
        held = F.array(*[F.lit(x) for x in own]).cast("array<string>")
        return (F.size(F.coalesce(row, F.array().cast("array<string>"))) == 0) | F.coalesce(F.arrays_overlap(row, held), F.lit(False))

    return (level <= p.max_level) & meets(groups, p.groups) & meets(roles, p.roles)


def scoped(df: DataFrame, p: Principal) -> DataFrame:
    """Rows of the caller's tenant and instance, active where the table says so and within the caller's level."""
    ok = (F.col("tenant_id") == p.tenant_id) & (F.col("instance_id") == p.instance_id)
    if "security_level" in df.columns:
        ok &= F.col("security_level") <= p.max_level
    if "active" in df.columns:
        ok &= F.col("active")
    return df.where(ok)


def safe_attributes(attributes: Column) -> Column:
    """Entries of a map whose key has a safe form and names no secret."""
    return F.map_filter(attributes, lambda k, v: k.rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,63}$") & ~text.sensitive_key(k) & v.isNotNull())
