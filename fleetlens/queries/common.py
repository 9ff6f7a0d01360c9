"""Shared inputs of the registered queries: Spark frames and the matching SQL CTEs."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..fixtures import fixture
from ..operators import inventory as I
from ..operators import profiles as P
from ..session import session_key

_SHARED: dict[tuple, object] = {}


def shared(fn):
    """Build a derived input once per session and scale factor (frames are immutable)."""

    @functools.wraps(fn)
    def wrapper(spark, sf):
        key = (*session_key(spark), sf.rstrip("/"), fn.__module__, fn.__name__)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf)
        return _SHARED[key]

    return wrapper


# ---------------------------------------------------------------- Spark side


@shared
def profiles_with_role(spark, sf):
    return P.role_lookup(fixture(spark, sf, "fx_profile"), fixture(spark, sf, "fx_role_alias"))


@shared
def resolved_raw(spark, sf):
    prof = fixture(spark, sf, "fx_profile")
    return P.resolve_profiles(prof, fixture(spark, sf, "fx_deployment"), fixture(spark, sf, "fx_role_alias"),
                              keep_raw=True)[0]


@shared
def desired(spark, sf):
    return I.vm_queue(fixture(spark, sf, "fx_deployment"), profiles_with_role(spark, sf))


@shared
def disk_listing(spark, sf):
    """fx_disk with the attached instance as an ``instance_ids`` array, as listings give it."""
    d = fixture(spark, sf, "fx_disk")
    ids = F.when(F.col("attached_instance_id").isNull(), F.array().cast("array<bigint>")).otherwise(
        F.array(F.col("attached_instance_id")))
    return d.withColumn("instance_ids", ids)


@shared
def inventory(spark, sf):
    return I.vm_inventory(desired(spark, sf), fixture(spark, sf, "fx_instance"), fixture(spark, sf, "fx_deployment"))


# ---------------------------------------------------------------- SQL side

PR_CTE = """pr AS (SELECT p.*, coalesce(a.role, p.role_in) AS role
             FROM fx_profile p LEFT JOIN fx_role_alias a ON p.role_in = a.alias)"""

DESIRED_CTE = """dq AS (
  SELECT pr.deploy_id, d.deploy_name, pr.role,
         CASE pr.role WHEN 'monitoring' THEN 'monitor' ELSE pr.role END AS prefix,
         CAST(unnest(generate_series(1, coalesce(pr.vm_count, 0))) AS INTEGER) AS idx
  FROM pr JOIN fx_deployment d ON d.deploy_id = pr.deploy_id
  WHERE coalesce(pr.vm_count, 0) > 0
    AND (pr.role = 'observer' OR (pr.role = 'obproxy' AND coalesce(pr.vm_count, 0) > 0)
         OR (pr.role = 'configserver' AND coalesce(pr.dedicated, false))
         OR (pr.role IN ('monitoring', 'ocp') AND coalesce(pr.enabled, false)))),
desired AS (
  SELECT deploy_id, role, prefix, idx, deploy_name || '-' || prefix || '-' || CAST(idx AS VARCHAR) AS name
  FROM dq)"""

DISKS_CTE = """disks AS (
  SELECT *, CASE WHEN attached_instance_id IS NULL THEN CAST([] AS BIGINT[])
                 ELSE [attached_instance_id] END AS instance_ids
  FROM fx_disk)"""

LAST_INSTANCE_CTE = """last_inst AS (
  SELECT name, arg_max({'ip_address': ip_address, 'nat_address': nat_address}, instance_id) AS l
  FROM fx_instance GROUP BY name)"""

INVENTORY_CTE = f"""{LAST_INSTANCE_CTE},
inv AS (
  SELECT q.deploy_id, q.role, q.prefix, q.idx, q.name, d.zone,
         coalesce(nullif(l.l.ip_address, ''), nullif(l.l.nat_address, ''), '') AS ip
  FROM desired q LEFT JOIN last_inst l ON q.name = l.name
  LEFT JOIN fx_deployment d ON d.deploy_id = q.deploy_id)"""


def region_sql(zone: str) -> str:
    return f"regexp_replace(coalesce({zone}, ''), '-[^-]*$', '')"


def fqdn_sql(host: str, zone: str) -> str:
    r = region_sql(zone)
    return f"CASE WHEN {r} <> '' THEN {host} || '.' || {r} || '.internal' ELSE {host} END"


def host_sql(name: str, ip: str, zone: str) -> str:
    return f"CASE WHEN nullif({name}, '') IS NOT NULL THEN {fqdn_sql(name, zone)} ELSE nullif({ip}, '') END"
