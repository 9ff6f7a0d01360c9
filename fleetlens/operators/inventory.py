"""Inventory: desired VMs, listings, differences, readiness and host facts.

SURVEY #21-#42, #44, #46-#53, #55, #56, #64, #66, #67, #70-#75, #91.

Listings are logs of snapshots: one resource name can appear many times.
Every operator that needs one row per name first reduces the listing with
a grouped ``max_by`` (map-side partial aggregation, one row per name and
task shuffled), never with a driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    disk_state,
    host_address,
    internal_fqdn,
    op_line_class,
    vm_key,
)

# VM name prefix per role and the order of sections in the host list.
ROLE_PREFIX = {"observer": "observer", "obproxy": "obproxy", "configserver": "configserver",
               "monitoring": "monitor", "ocp": "ocp"}
SECTION_ORDER = {"observer": 1, "obproxy": 2, "configserver": 3, "monitoring": 4}
READY_INSTANCE = ("RUNNING", "STOPPED")
READY_DISK = "READY"
DELETING = "DELETING"


def prefix_of(role: Column) -> Column:
    expr = None
    for r, p in ROLE_PREFIX.items():
        expr = (F.when(role == r, F.lit(p)) if expr is None else expr.when(role == r, F.lit(p)))
    return expr.otherwise(role)


# ---------------------------------------------------------------- desired VMs


def vm_queue(deploy: DataFrame, profiles: DataFrame) -> DataFrame:
    """#42 desired VMs: role x 1..count behind the gates of the provisioner.

    ``profiles``: ``deploy_id, role`` (canonical) and the raw keys
    ``vm_count, enabled, dedicated`` (NULL or a missing column = absent). Gates: observers always,
    proxies when count > 0, the config server when dedicated, monitoring and
    management when enabled. A missing count reads as 0, and ``count > 0`` is
    tested before ``sequence`` because ``sequence(1, 0)`` is not empty.
    """
    from .profiles import col_or_null

    role = F.col("role")
    count = F.coalesce(col_or_null(profiles, "vm_count", "int"), F.lit(0))
    gate = (
        (role == "observer")
        | ((role == "obproxy") & (count > 0))
        | ((role == "configserver") & F.coalesce(col_or_null(profiles, "dedicated", "boolean"), F.lit(False)))
        | (role.isin("monitoring", "ocp") & F.coalesce(col_or_null(profiles, "enabled", "boolean"), F.lit(False)))
    )
    p = profiles.where(gate & (count > 0)).select("deploy_id", "role", count.alias("_n"))
    q = p.join(deploy.select("deploy_id", "deploy_name"), "deploy_id").select(
        "deploy_id", "deploy_name", "role", prefix_of(role).alias("prefix"),
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("idx"),
    )
    name = F.concat_ws("-", F.col("deploy_name"), F.col("prefix"), F.col("idx").cast("string"))
    return q.select("deploy_id", "role", "prefix", "idx", name.alias("name")).withColumn(
        "vm_key", vm_key("role", "prefix", "idx", "name")
    )


def latest_by_name(listing: DataFrame, order_col: str, cols: list[str]) -> DataFrame:
    """One row per name: the fields of the row with the highest ``order_col``."""
    s = F.struct(*[F.col(c) for c in cols])
    return listing.groupBy("name").agg(F.max_by(s, F.col(order_col)).alias("_l")).select("name", "_l.*")


def existing(listing: DataFrame, wanted: DataFrame, skip_status=()) -> DataFrame:
    """#38/#39 listing rows whose name is wanted (semi join); ``skip_status`` drops e.g. DELETING.

    An empty wish list gives an empty result (the semi join does it).
    """
    rows = listing
    if skip_status:
        rows = rows.where(~F.col("status").isin(*skip_status) | F.col("status").isNull())
    return rows.join(wanted.select("name").distinct(), "name", "left_semi")


def new_vms(desired: DataFrame, listing: DataFrame) -> DataFrame:
    """#40 desired minus existing, by exact name (anti join).

    The listing side is reduced to distinct names first (partial
    aggregation map-side), so a name repeated in many snapshots is one row
    before the shuffle.
    """
    return desired.join(listing.select("name").distinct(), "name", "left_anti")


def disk_names(vms: DataFrame, resolved: DataFrame) -> DataFrame:
    """``<vm>-data`` / ``<vm>-log`` for each VM whose resolved role profile enables the disk."""
    r = resolved.select(
        "deploy_id", "role", "data_enabled", "data_type", "data_size_gb", "log_enabled", "log_type", "log_size_gb"
    )
    j = vms.join(r, ["deploy_id", "role"])
    d = F.array(
        F.when(F.coalesce(F.col("data_enabled"), F.lit(False)),
               F.struct(F.concat(F.col("name"), F.lit("-data")).alias("disk_name"),
                        F.col("data_type").alias("disk_type"), F.col("data_size_gb").alias("size_gb"))),
        F.when(F.coalesce(F.col("log_enabled"), F.lit(False)),
               F.struct(F.concat(F.col("name"), F.lit("-log")).alias("disk_name"),
                        F.col("log_type").alias("disk_type"), F.col("log_size_gb").alias("size_gb"))),
    )
    return j.select("deploy_id", "role", F.col("name").alias("vm_name"),
                    F.explode(F.filter(d, lambda x: x.isNotNull())).alias("d")).select(
        "deploy_id", "role", "vm_name", "d.*")


def disks_to_create(new: DataFrame, resolved: DataFrame, disks: DataFrame) -> DataFrame:
    """#41 disks of the new VMs minus disks that exist (a DELETING or id-less disk is absent)."""
    live = disks.where((F.col("status") != DELETING) & F.col("disk_id").isNotNull()).select(
        F.col("name").alias("disk_name")).distinct()
    return disk_names(new, resolved).join(live, "disk_name", "left_anti")


def pending_disks(listing: DataFrame, wanted: DataFrame, key: str = "deploy_id") -> DataFrame:
    """#51 per ``key``: wanted disks listed but not READY (counted over listing rows, as the
    poller does) and, apart, wanted disks missing from the listing.

    The listing is reduced to one row per name (rows, rows not ready) by a
    partial aggregation, then joined once with the distinct wanted names.
    """
    w = wanted.select(key, F.col("disk_name").alias("name")).distinct()
    by_name = listing.groupBy("name").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("status") != READY_DISK).alias("_not_ready"))
    return w.join(by_name, "name", "left").groupBy(key).agg(
        F.coalesce(F.sum("_not_ready"), F.lit(0)).cast("bigint").alias("pending"),
        F.count_if(F.col("_rows").isNull()).cast("bigint").alias("missing"),
    )


def pending_instances(status: DataFrame, expect: DataFrame | None = None) -> DataFrame:
    """#52 per deployment: latest status per resource, pending = not RUNNING and not STOPPED."""
    s = status
    if expect is not None:
        s = s.join(expect.select("resource_id").distinct(), "resource_id", "left_semi")
    latest = s.groupBy("deploy_id", "resource_id").agg(F.max_by("status", "seq").alias("status"))
    return latest.groupBy("deploy_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_resources"),
        F.count_if(~F.col("status").isin(*READY_INSTANCE)).cast("bigint").alias("pending"),
    )


def readiness(status: DataFrame, timeout_s: float = 3600, chunk: Column | None = None) -> DataFrame:
    """#52 + #73 per deployment, one row: ``ready`` at the first status (by time, then ``seq``) after
    which none of its resources is pending, if that is within ``timeout_s`` of first sight; else ``timed_out``
    with what was pending at the deadline.

    Each status changes the pending count by the difference to the resource's
    status before. The counts run along a deployment in chunks of time
    (``chunk``, default the hour) and are carried over one row a chunk, so a large
    deployment is not one task. The streaming form is
    :func:`fleetlens.streaming.streams.readiness_stream`.
    """
    first = status.groupBy("deploy_id").agg(F.min("ts").alias("first_seen")).where("deploy_id IS NOT NULL")
    late = F.timestamp_diff("MICROSECOND", F.col("first_seen"), F.col("ts")) > F.lit(int(timeout_s * 1e6))
    s = status.join(first, "deploy_id").where(~late)
    pending = F.when(F.col("status").isin(*READY_INSTANCE), 0).otherwise(1)
    mine = Window.partitionBy("deploy_id", "resource_id").orderBy("ts", "seq")
    s = s.withColumn("_pending", pending).withColumn("_before", F.lag("_pending").over(mine))
    s = s.select("deploy_id", "ts", "seq", "first_seen", (chunk if chunk is not None else F.date_trunc("hour", "ts")).alias("_chunk"),
                 (F.col("_pending") - F.coalesce("_before", F.lit(0))).alias("_more"), F.col("_before").isNull().cast("int").alias("_new"))
    here = Window.partitionBy("deploy_id", "_chunk").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_p", F.sum("_more").over(here)).withColumn("_n", F.sum("_new").over(here))
    ahead = Window.partitionBy("deploy_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = s.groupBy("deploy_id", "_chunk").agg(F.sum("_more").alias("_m"), F.sum("_new").alias("_w"))
    carry = carry.select("deploy_id", "_chunk", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_p0"),
                         F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_n0"))
    s = s.join(carry, ["deploy_id", "_chunk"]).withColumn("_p", F.col("_p") + F.col("_p0")).withColumn("_n", F.col("_n") + F.col("_n0"))
    at = F.struct("ts", "seq", "_n", "_p")
    out = s.groupBy("deploy_id").agg(F.min("first_seen").alias("first_seen"), F.min(F.when(F.col("_p") == 0, at)).alias("_ready"),
                                     F.max(at).alias("_last"))
    end = F.coalesce("_ready", "_last")
    return out.select("deploy_id", end["_n"].alias("n_resources"), end["_p"].cast("bigint").alias("pending"),
                      F.when(F.col("_ready").isNotNull(), "ready").otherwise("timed_out").alias("state"), "first_seen", end["ts"].alias("last_seen"))


def role_counts(vms: DataFrame) -> DataFrame:
    """#53 VM count per deployment and role; 0 for roles that are off.

    The pivot values are given, so no extra pass finds them.
    """
    roles = list(ROLE_PREFIX)
    p = vms.groupBy("deploy_id").pivot("role", roles).agg(F.count(F.lit(1)))
    return p.select("deploy_id", *[
        F.coalesce(F.col(r), F.lit(0)).cast("bigint").alias(f"{ROLE_PREFIX[r]}_count") for r in roles])


def scale_out(vms: DataFrame, listing: DataFrame, add: int, role: str = "observer") -> DataFrame:
    """#49 new indexes current+1 .. current+add per deployment, marked when they exist already."""
    cur = vms.where(F.col("role") == role).groupBy("deploy_id", "deploy_name").agg(
        F.max("idx").alias("current"))
    new = cur.select(
        "deploy_id", "deploy_name", "current",
        F.explode(F.sequence(F.col("current") + 1, F.col("current") + F.lit(add))).alias("idx"),
    ).withColumn("name", F.concat_ws("-", "deploy_name", F.lit(ROLE_PREFIX[role]), F.col("idx").cast("string")))
    listed = listing.select("name").distinct().withColumn("exists", F.lit(True))
    return new.join(listed, "name", "left").select(
        "deploy_id", "idx", "name", F.coalesce("exists", F.lit(False)).alias("exists"),
        (F.col("current") + F.lit(add)).alias("new_total"),
    )


# ---------------------------------------------------------------- addresses


def vm_inventory(vms: DataFrame, listing: DataFrame, deploy: DataFrame) -> DataFrame:
    """Desired VMs with the address of their latest listing row and the deployment zone.

    ``ip`` is the private address, else the NAT one, else ''. An empty
    address is an error of the inventory (the rejects of
    :func:`fleetlens.sinks.documents.render_inventory`).
    """
    last = latest_by_name(listing, "instance_id", ["ip_address", "nat_address"])
    ip = F.coalesce(F.nullif(F.col("ip_address"), F.lit("")), F.nullif(F.col("nat_address"), F.lit("")), F.lit(""))
    return (
        vms.join(last, "name", "left")
        .join(deploy.select("deploy_id", "zone"), "deploy_id", "left")
        .select("deploy_id", "role", "prefix", "idx", "name", "zone", ip.alias("ip"))
    )


def with_host(inv: DataFrame) -> DataFrame:
    """#23 host = FQDN of the name (else the IP); NULL when neither is set."""
    return inv.withColumn("host", host_address("name", "ip", "zone"))


def cluster_hosts(inv: DataFrame) -> DataFrame:
    """#75 observers, proxies, config servers, monitors in this order; duplicates kept.

    A config server without an address is skipped; the others must have one.
    """
    sec = None
    for r, k in SECTION_ORDER.items():
        sec = F.when(F.col("role") == r, F.lit(k)) if sec is None else sec.when(F.col("role") == r, F.lit(k))
    h = with_host(inv).where(F.col("role").isin(*SECTION_ORDER))
    h = h.where(~((F.col("role") == "configserver") & F.col("host").isNull()))
    return h.select("deploy_id", sec.alias("section"), "idx", "role", "host")


def host_lists(inv: DataFrame) -> DataFrame:
    """#64 ordered host list per deployment and role (sorted by VM index)."""
    return with_host(inv).groupBy("deploy_id", "role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "host"))), lambda s: s["host"]).alias("hosts"))


def server_positions(observers: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """Position of each server in VM index order within its deployment (``server_pos``) and the
    number of servers (``n_servers``).

    Positions come from :func:`ordered_index`, so even a deployment with a
    huge number of servers is numbered in chunks of its VM index.
    """
    from .sequence import ordered_index

    return ordered_index(observers, ["idx", "name"], F.floor(F.col("idx") / F.lit(chunk_size)), ("deploy_id",),
                         out="server_pos", total="n_servers")


def server_name_col(pos: Column) -> Column:
    return F.concat(F.lit("server"), pos.cast("string"))


def zone_col(pos: Column, n: Column) -> Column:
    return F.concat(F.lit("zone"), (F.pmod(pos - 1, n) + 1).cast("string"))


def server_names(observers: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """#66 ``server<i>`` by position (VM index order) within the deployment."""
    s = server_positions(observers, chunk_size)
    return s.withColumn("server_name", server_name_col(F.col("server_pos"))).drop("server_pos", "n_servers")


def zone_assign(servers: DataFrame, n_zones: int | None = None, chunk_size: int = 10_000) -> DataFrame:
    """#67 server i -> ``zone<((i-1) mod n) + 1>``; n defaults to the number of servers."""
    s = server_positions(servers, chunk_size)
    n = F.lit(n_zones) if n_zones else F.col("n_servers")
    return s.withColumn("zone_name", zone_col(F.col("server_pos"), n)).drop("server_pos", "n_servers")


# ---------------------------------------------------------------- listings


def by_deployment(df: DataFrame, name) -> DataFrame:
    """#35 rows whose ``deployment`` label equals ``name`` (a literal or a column); no label -> out."""
    target = name if isinstance(name, Column) else F.lit(name)
    return df.where(F.col("label_deployment") == target)


def orphan_disks(disks: DataFrame, deployment=None) -> DataFrame:
    """#36 labelled disks with no instance and not being deleted.

    ``deployment`` (a name or a Column, e.g. the deployment name joined in)
    keeps the disks labelled with that deployment; without it every
    labelled disk counts.
    """
    d = disks if deployment is None else by_deployment(disks, deployment)
    return d.where(
        F.col("label_deployment").isNotNull()
        & (F.coalesce(F.size("instance_ids"), F.lit(0)) == 0)
        & ((F.col("status") != DELETING) | F.col("status").isNull())
    )


def disk_states(disks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """#25 state per disk name (latest row per name); with ``wanted`` absent names are ``missing``.

    ``exists_strict`` is the strict lookup: a disk being deleted or without
    an id counts as absent.
    """
    last = latest_by_name(disks, "disk_id", ["disk_id", "status", "instance_ids"])
    strict = F.col("disk_id").isNotNull() & (F.coalesce(F.col("status"), F.lit("")) != DELETING)
    if wanted is None:
        return last.select("name", disk_state("status", "instance_ids").alias("state"), strict.alias("exists_strict"))
    w = wanted.select(F.col("disk_name").alias("name")).distinct()
    j = w.join(last.withColumn("_present", F.lit(True)), "name", "left")
    present = F.coalesce("_present", F.lit(False))
    return j.select("name", disk_state("status", "instance_ids", present).alias("state"),
                    (present & strict).alias("exists_strict"))


def delete_candidates(kv: DataFrame, instances: DataFrame, deploy: DataFrame,
                      files: DataFrame | None = None) -> DataFrame:
    """#37 names from the inventory when the deployment has one, else names by label.

    ``kv``: parsed inventory (``deploy_id, key, value``). ``DEPLOY_NAME`` is
    not a VM name and is left out. ``files`` (``deploy_id``) lists the
    deployments that have an inventory file at all - a file without any
    ``KEY=value`` line still means "use the inventory" (it names nothing);
    without it, having a parsed key is taken as having the file.
    """
    from_inv = kv.where(F.col("key").rlike("_NAME$") & (F.col("key") != "DEPLOY_NAME")).select(
        "deploy_id", F.col("value").alias("name"), F.lit("inventory").alias("source"))
    has_inv = (files if files is not None else kv).select("deploy_id").distinct()
    by_label = (
        instances.join(deploy.select("deploy_id", F.col("deploy_name").alias("_dn")), "deploy_id")
        .where(F.col("label_deployment") == F.col("_dn"))
        .join(has_inv, "deploy_id", "left_anti")
        .select("deploy_id", "name", F.lit("label").alias("source"))
    )
    return from_inv.unionByName(by_label)


def disk_attachments(disks: DataFrame, instances: DataFrame) -> DataFrame:
    """#48 disk <-> instance by id; unattached disks and dangling ids kept on both ends.

    The same rows as a full outer join, built as an inner join plus two
    anti joins: AQE can split a hot instance id on the inner and anti
    joins (it cannot on a full outer join), and the id list of the other
    side is made distinct before the anti join.
    """
    d = disks.select("disk_id", F.col("name").alias("disk_name"),
                     F.explode_outer("instance_ids").alias("instance_id"))
    i = instances.select("instance_id", F.col("name").alias("instance_name")).distinct()
    matched = d.join(i, "instance_id")
    d_only = d.join(i.select("instance_id").distinct(), "instance_id", "left_anti").withColumn(
        "instance_name", F.lit(None).cast("string"))
    i_only = i.join(d.select("instance_id").where(F.col("instance_id").isNotNull()).distinct(), "instance_id",
                    "left_anti").select(F.lit(None).cast(d.schema["disk_id"].dataType).alias("disk_id"),
                                        F.lit(None).cast("string").alias("disk_name"), "instance_id", "instance_name")
    cols = ["disk_id", "disk_name", "instance_id", "instance_name"]
    return matched.select(*cols).unionByName(d_only.select(*cols)).unionByName(i_only.select(*cols))


def image_availability(deploy: DataFrame, images: DataFrame) -> DataFrame:
    """#44 matches of the wanted image name (else family) in the image list; 0 -> warning.

    Images are counted per name and per family first (an image counts once
    for ``family`` and ``family_id`` together), so the join with the wanted
    values has one row per value and no pair of deployment and image is made.
    """
    name = F.nullif(F.nullif(F.col("image_name"), F.lit("")), F.lit("null"))
    fam = F.nullif(F.nullif(F.col("image_family"), F.lit("")), F.lit("null"))
    want = deploy.select(
        "deploy_id",
        F.when(name.isNotNull(), F.lit("name")).when(fam.isNotNull(), F.lit("family")).alias("kind"),
        F.coalesce(name, fam).alias("wanted"),
    ).where(F.col("kind").isNotNull())
    labels = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("name").alias("wanted")),
        F.struct(F.lit("family").alias("kind"), F.col("family").alias("wanted")),
        F.when(~F.col("family_id").eqNullSafe(F.col("family")), F.struct(F.lit("family").alias("kind"), F.col("family_id").alias("wanted"))))
    hits = images.select(F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("x")).select("x.*").groupBy("kind", "wanted").agg(
        F.count(F.lit(1)).cast("bigint").alias("matches"))
    return want.join(hits, ["kind", "wanted"], "left").select(
        "deploy_id", "kind", "wanted", F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"),
    ).withColumn("warn", F.col("matches") == 0)


# ---------------------------------------------------------------- logs and waits


def classify_op_lines(lines: DataFrame) -> DataFrame:
    """#30 each log line as rate_limited / error / ok."""
    return lines.withColumn("line_class", op_line_class("line"))


def failed_hosts(jobs: DataFrame) -> DataFrame:
    """#55 per run: the failed hosts, their number and their logs.

    ``jobs`` has one row per host job (``run_id, host, log_name, failed``).
    The result has one row per failed host with the run's count beside it
    (a per-run aggregate joined back), so no run's hosts are gathered into
    one value.
    """
    f = jobs.where(F.col("failed")).select("run_id", "host", "log_name")
    n = f.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_failed"))
    return f.join(n, "run_id")


def log_tail(lines: DataFrame, n: int = 40, key: str = "op_id") -> DataFrame:
    """#70 last ``n`` lines of each log.

    ``row_number() <= n`` right after the window lets Spark plan a window
    group limit: each task keeps only its top ``n`` per key before the
    shuffle, so a huge log never moves whole.
    """
    w = Window.partitionBy(key).orderBy(F.col("line_no").desc())
    return lines.withColumn("rn_from_end", F.row_number().over(w)).where(F.col("rn_from_end") <= n)


def last_line(lines: DataFrame, key: str = "op_id") -> DataFrame:
    """#71 last line per log, kept only when it is not empty."""
    return lines.groupBy(key).agg(F.max_by("line", "line_no").alias("last_line")).where(
        F.col("last_line").isNotNull() & (F.trim(F.col("last_line")) != ""))


def retry_outcome(lines: DataFrame, max_tries: int = 60, sleep_s: int = 10, key: str = "op_id") -> DataFrame:
    """#72 attempts per operation until the first success or fatal error.

    Each line is one attempt. Rate-limited attempts are retried; after
    ``max_tries`` of them the operation gives up. Only the first
    ``max_tries + 1`` attempts can matter, so a window group limit keeps
    those per operation before the shuffle.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    first = lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_tries + 1)
    first = first.withColumn("line_class", op_line_class("line"))
    stop = F.col("line_class") != "rate_limited"
    agg = first.groupBy(key).agg(
        F.min(F.when(stop, F.col("rn"))).alias("_stop_rn"),
        F.min_by(F.col("line_class"), F.when(stop, F.col("rn"))).alias("_stop_class"),
        F.count(F.lit(1)).alias("_n"),
    )
    rl = F.coalesce(F.col("_stop_rn") - 1, F.col("_n"))
    gave_up = rl >= max_tries
    outcome = (
        F.when(gave_up, F.lit("gave_up"))
        .when(F.col("_stop_rn").isNull(), F.lit("incomplete"))
        .when(F.col("_stop_class") == "ok", F.lit("success"))
        .otherwise(F.lit("failed"))
    )
    tries = F.when(gave_up, F.lit(max_tries)).otherwise(rl)
    attempts = F.when(gave_up, F.lit(max_tries)).when(F.col("_stop_rn").isNull(), rl).otherwise(rl + 1)
    return agg.select(
        key,
        outcome.alias("outcome"),
        attempts.cast("int").alias("attempts"),
        (tries * F.lit(sleep_s)).cast("int").alias("waited_s"),
    )


def ready_after(status: DataFrame, timeout_s: int = 3600, poll_s: int = 5,
                ready=("READY", "RUNNING", "STOPPED")) -> DataFrame:
    """#73 per resource: first sight, first ready status, the wait rounded up to the poll step,
    and whether it passed the timeout (never ready counts as timed out)."""
    is_ready = F.col("status").isin(*ready)
    agg = status.groupBy("deploy_id", "resource_id").agg(
        F.min("ts").alias("first_seen"),
        F.min(F.when(is_ready, F.col("ts"))).alias("first_ready"),
    )
    secs = F.timestamp_diff("MICROSECOND", F.col("first_seen"), F.col("first_ready")) / F.lit(1e6)
    wait = (F.ceil(secs / F.lit(poll_s)) * poll_s).cast("bigint")
    return agg.select(
        "deploy_id", "resource_id", "first_seen", "first_ready", wait.alias("wait_s"),
        (F.col("first_ready").isNull() | (wait > timeout_s)).alias("timed_out"),
    )


def first_candidate(items: DataFrame, key: str, item: str, priority: str, usable: Column) -> DataFrame:
    """#74 first usable item per key by priority (``min_by`` under a filter)."""
    return items.groupBy(key).agg(F.min_by(F.when(usable, F.col(item)), F.when(usable, F.col(priority))).alias(item))


# ---------------------------------------------------------------- fleet sizes


def fleet_totals(resolved: DataFrame) -> DataFrame:
    """#56 VMs, vCPU and memory by deployment and role, by deployment, and overall (ROLLUP).

    A role has no VM when it is off, or for a config server that is not
    dedicated (it runs on the first observer).
    """
    vms = (
        F.when((F.col("role") == "configserver") & ~F.col("dedicated"), F.lit(0))
        .when(~F.col("enabled"), F.lit(0))
        .otherwise(F.col("vm_count"))
    )
    # dealt by deployment first: the rows of a short file come from one task, whose groups would all be its own
    r = resolved.select("deploy_id", "role", vms.alias("vms"), "cores", "memory_gb").repartition("deploy_id")
    return r.rollup("deploy_id", "role").agg(
        F.sum("vms").cast("bigint").alias("vms"),
        F.sum(F.col("vms") * F.col("cores")).cast("bigint").alias("vcpu"),
        F.sum(F.col("vms") * F.col("memory_gb")).cast("bigint").alias("memory_gb"),
        F.grouping_id().cast("int").alias("level"),
    )


def feature_flags(deploy: DataFrame, resolved: DataFrame) -> DataFrame:
    """#27 per deployment: management, prometheus, grafana, exporter, production mode, and the
    switches of config server, database, proxy and agent (on unless switched off).

    ``deploy``: ``ocp_enabled, prometheus_component`` (and optionally
    ``grafana_component, node_exporter_enabled, configserver_component,
    database_component, proxy_component, agent_component``); ``resolved`` gives the
    raw monitoring / management flags and the observer count.
    """
    from .profiles import col_or_null

    if "_raw_enabled" not in resolved.columns:
        raise ValueError("feature_flags needs resolve_profiles(..., keep_raw=True): the gates read raw keys")
    p = resolved.groupBy("deploy_id").agg(
        F.bool_or((F.col("role") == "monitoring") & F.coalesce(F.col("_raw_enabled"), F.lit(False))).alias("_mon_vm"),
        F.bool_or((F.col("role") == "ocp") & F.coalesce(F.col("_raw_enabled"), F.lit(False))).alias("_ocp_vm"),
        F.max(F.when(F.col("role") == "observer", F.col("_raw_count"))).alias("_obs"),
    )
    j = deploy.join(p, "deploy_id", "left")
    mon_vm = F.coalesce(F.col("_mon_vm"), F.lit(False))
    prom = F.coalesce(col_or_null(deploy, "prometheus_component", "boolean"), F.lit(False)) | mon_vm
    graf = F.coalesce(col_or_null(deploy, "grafana_component", "boolean"), F.lit(False)) | mon_vm
    exporter = F.coalesce(col_or_null(deploy, "node_exporter_enabled", "boolean"), F.lit(True)) & (
        mon_vm | F.coalesce(col_or_null(deploy, "prometheus_component", "boolean"), F.lit(False)))
    return j.select(
        "deploy_id",
        (F.coalesce(F.col("ocp_enabled"), F.lit(False)) & F.coalesce(F.col("_ocp_vm"), F.lit(False))).alias("management"),
        prom.alias("prometheus"),
        graf.alias("grafana"),
        exporter.alias("node_exporter"),
        *[F.coalesce(col_or_null(deploy, f"{c}_component", "boolean"), F.lit(True)).alias(c)
          for c in ("configserver", "database", "proxy", "agent")],
        (F.coalesce(F.col("_obs"), F.lit(3)) >= 3).alias("production_mode"),
    )


def role_disk_needs(vms: DataFrame, resolved: DataFrame) -> DataFrame:
    """#26 which VM needs a data and a log disk, and where they are mounted.

    Observers follow the observer profile (data always, log when enabled);
    proxies and config servers need none; monitoring needs data when its
    data disk is enabled; management likewise, log never.
    """
    r = resolved.select("deploy_id", "role", "data_enabled", "data_mount", "log_enabled", "log_mount")
    j = vms.join(r, ["deploy_id", "role"], "left")
    role = F.col("role")
    data_on = F.coalesce(F.col("data_enabled"), F.lit(False))
    need_data = (
        F.when(role == "observer", F.lit(True))
        .when(role.isin("obproxy", "configserver"), F.lit(False))
        .otherwise(data_on)
    )
    need_log = F.when(role == "observer", F.coalesce(F.col("log_enabled"), F.lit(False))).otherwise(F.lit(False))
    # Default mount points per role.
    data_mount = (
        F.when(role == "ocp", F.coalesce(F.col("data_mount"), F.lit("/ocp-data")))
        .otherwise(F.coalesce(F.col("data_mount"), F.lit("/data")))
    )
    return j.select(
        "deploy_id", "role", "name",
        need_data.alias("need_data"),
        F.when(need_data, data_mount).alias("data_mount"),
        need_log.alias("need_log"),
        F.when(need_log, F.coalesce(F.col("log_mount"), F.lit("/data/log1"))).alias("log_mount"),
    )


def fqdn_frame(instances: DataFrame, deploy: DataFrame) -> DataFrame:
    """#22 internal DNS name of each listed instance."""
    return instances.join(deploy.select("deploy_id", "zone"), "deploy_id", "left").select(
        "instance_id", "name", "zone", internal_fqdn("name", "zone").alias("fqdn"))
