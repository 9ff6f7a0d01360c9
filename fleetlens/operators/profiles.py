"""Role profiles: resolve, tune and audit.

Profiles come in long form: one row per deployment and role with the
fields of a profile (``vm_count, enabled, dedicated, platform, cores,
memory_gb, core_fraction, image_*`` and the three disks flattened as
``boot_* / data_* / log_*``). A column that is missing from the input is a
key that is absent everywhere. Deployment-level defaults come from the
deployment table (``default_platform, default_core_fraction, image_*`` and
optional ``default_<disk>_<field>`` columns).

No join is hinted: Catalyst / AQE broadcast a side (the few rows of the alias
and minimum tables, say) only when its size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import absent_or
from ..functions.scalars import image_spec, round_if_sized

# Canonical roles, role aliases and role minimums (cores, memory GB, data disk GB).
ROLE_ALIASES = [
    ("observers", "observer"),
    ("obproxy", "obproxy"),
    ("monitoring", "monitoring"),
    ("monitor", "monitoring"),
    ("configserver", "configserver"),
    ("observer", "observer"),
    ("ocp", "ocp"),
]
ROLE_MINIMUMS = [
    ("observer", 4, 16, 100),
    ("obproxy", 2, 4, None),
    ("configserver", 2, 4, None),
    ("monitoring", 4, 8, None),
    ("ocp", 4, 16, None),
]
# Profile defaults of the resolver and of the 15-line rendering.
DEFAULT_PLATFORM = "standard-v3"
DEFAULT_CORES = 4
DEFAULT_MEMORY_GB = 16
DEFAULT_CORE_FRACTION = 100
DEFAULT_COUNT = 1
NONREPLICATED = "network-ssd-nonreplicated"
IO_M3 = "network-ssd-io-m3"

DISKS = ("boot", "data", "log")
DISK_FIELDS = {"enabled": "boolean", "type": "string", "size_gb": "int", "mount": "string"}


def alias_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_ALIASES, "alias string, role string")


def minimum_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ROLE_MINIMUMS, "role string, min_cores int, min_memory_gb int, min_data_disk_gb int"
    )


def col_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    """The column when the frame has it, else a typed NULL (an absent key)."""
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def role_lookup(df: DataFrame, aliases: DataFrame, col: str = "role_in", out: str = "role") -> DataFrame:
    """#43 alias -> canonical role; unknown names pass through."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("role").alias("_role"))
    return (
        df.join(a, F.col(col) == F.col("_alias"), "left")
        .withColumn(out, F.coalesce(F.col("_role"), F.col(col)))
        .drop("_alias", "_role")
    )


def resolve_profiles(
    profiles: DataFrame, deploy: DataFrame, aliases: DataFrame, role_col: str = "role_in", keep_raw: bool = False
) -> tuple[DataFrame, DataFrame]:
    """#18 resolved profiles and the rejects (requested roles that are unknown).

    Semantics kept from the resolver: the alias applies to the requested
    role; defaults of the deployment sit below the profile (absent-key
    fallback); each disk is merged over its default disk (NULL fields skip)
    and rounded when it has both a type and a non-zero size; image text falls
    back through profile, deployment and constant with empty text counting
    as missing.
    """
    a = aliases.select(F.col("alias").alias("_alias"), F.col("role").alias("role"))
    joined = profiles.join(a, F.col(role_col) == F.col("_alias"), "left")
    rejects = joined.where(F.col("role").isNull()).select(
        "deploy_id", F.col(role_col).alias("role_in"), F.lit("unknown vm profile role").alias("reason")
    )
    p = joined.where(F.col("role").isNotNull())

    dcols = ["deploy_id"] + [
        c for c in deploy.columns if c.startswith("default_") or c.startswith("image_")
    ]
    d = deploy.select(*dcols).select(
        "deploy_id",
        *[F.col(c).alias(f"_d_{c}") for c in dcols[1:]],
    )
    p = p.join(d, "deploy_id", "left")

    def dflt(name: str, dtype: str) -> Column:
        return col_or_null(p, f"_d_default_{name}", dtype)

    def prof(name: str, dtype: str) -> Column:
        return col_or_null(p, name, dtype)

    out = [
        F.col("deploy_id"),
        F.col("role"),
        absent_or(prof("platform", "string"), absent_or(dflt("platform", "string"), DEFAULT_PLATFORM)).alias("platform"),
        absent_or(prof("cores", "int"), absent_or(dflt("cores", "int"), DEFAULT_CORES)).alias("cores"),
        absent_or(prof("memory_gb", "int"), absent_or(dflt("memory_gb", "int"), DEFAULT_MEMORY_GB)).alias("memory_gb"),
        image_spec(
            prof("image_folder_id", "string"),
            prof("image_name", "string"),
            prof("image_family", "string"),
            col_or_null(p, "_d_image_folder_id", "string"),
            col_or_null(p, "_d_image_name", "string"),
            col_or_null(p, "_d_image_family", "string"),
        ).alias("image_spec"),
        absent_or(prof("core_fraction", "int"), absent_or(dflt("core_fraction", "int"), DEFAULT_CORE_FRACTION)).alias(
            "core_fraction"
        ),
    ]
    for disk in DISKS:
        merged = {}
        for f, t in DISK_FIELDS.items():
            merged[f] = F.coalesce(prof(f"{disk}_{f}", t), dflt(f"{disk}_{f}", t))
        merged["size_gb"] = round_if_sized(merged["size_gb"], merged["type"])
        out += [merged[f].alias(f"{disk}_{f}") for f in DISK_FIELDS]
    out += [
        absent_or(prof("vm_count", "int"), DEFAULT_COUNT).alias("vm_count"),
        absent_or(prof("enabled", "boolean"), True).alias("enabled"),
        absent_or(prof("dedicated", "boolean"), True).alias("dedicated"),
    ]
    if keep_raw:
        # the validator reads some keys before resolving (absent = 0 / off)
        out += [
            prof("vm_count", "int").alias("_raw_count"),
            prof("enabled", "boolean").alias("_raw_enabled"),
            prof("dedicated", "boolean").alias("_raw_dedicated"),
        ]
    return p.select(*out), rejects


def auto_tune(resolved: DataFrame) -> DataFrame:
    """#19 tuning values from the resolved observer profile of each deployment."""
    m = F.col("memory_gb")
    mem_limit = F.greatest(F.lit(4), m - F.greatest(F.lit(4), F.expr("memory_gb div 8").cast("int")))
    system = F.least(F.lit(4), F.greatest(F.lit(2), F.expr("memory_gb div 8").cast("int")))
    data_gb = F.coalesce(F.col("data_size_gb"), F.lit(100))
    log_gb = F.when(F.coalesce(F.col("log_enabled"), F.lit(False)), F.coalesce(F.col("log_size_gb"), F.lit(0))).otherwise(0)
    datafile = F.greatest(F.lit(20), F.floor(data_gb * F.lit(0.85)).cast("int"))
    log_disk = F.when(log_gb != 0, F.greatest(F.lit(15), F.floor(log_gb * F.lit(0.9)).cast("int"))).otherwise(
        F.greatest(F.lit(15), mem_limit * 3)
    )

    def gb(c: Column) -> Column:
        return F.concat(c.cast("string"), F.lit("G"))

    return resolved.where(F.col("role") == "observer").select(
        "deploy_id",
        gb(mem_limit).alias("memory_limit"),
        gb(system).alias("system_memory"),
        gb(datafile).alias("datafile_size"),
        gb(log_disk).alias("log_disk_size"),
        F.col("cores").alias("cpu_count"),
    )


TUNING_COLS = ("memory_limit", "system_memory", "datafile_size", "log_disk_size", "cpu_count")


def effective_tuning(cfg: DataFrame, tuned: DataFrame) -> DataFrame:
    """#20 computed values replace configured ones when auto-tune is on (default on)."""
    t = tuned.select("deploy_id", *[F.col(c).alias(f"_t_{c}") for c in TUNING_COLS])
    j = cfg.join(t, "deploy_id", "left")
    on = F.coalesce(col_or_null(cfg, "auto_tune", "boolean"), F.lit(True))
    cols = []
    for c in TUNING_COLS:
        dtype = "int" if c == "cpu_count" else "string"
        cols.append(F.when(on, F.col(f"_t_{c}").cast(dtype)).otherwise(col_or_null(cfg, c, dtype)).alias(c))
    return j.select("deploy_id", on.alias("auto_tune_on"), *cols)


def audit_profiles(profiles: DataFrame, deploy: DataFrame, aliases: DataFrame, minimums: DataFrame) -> DataFrame:
    """#45 issues of resolved profiles against the role minimums.

    One pass: each row builds an array of the rules it breaks and the array
    is exploded, instead of one join per rule. The observer-count rule reads
    the raw count (absent = 0) and the skip rules read the raw flags
    (absent = off) as the validator does; the checks read resolved values.
    """
    resolved, _ = resolve_profiles(profiles, deploy, aliases, keep_raw=True)
    r = resolved.join(minimums, "role")
    checked = (
        ~((F.col("role") == "configserver") & ~F.coalesce(F.col("_raw_dedicated"), F.lit(False)))
        & ~((F.col("role") == "monitoring") & ~F.coalesce(F.col("_raw_enabled"), F.lit(False)))
        & ~((F.col("role") == "ocp") & ~F.coalesce(F.col("_raw_enabled"), F.lit(False)))
    )
    obs = F.col("role") == "observer"
    data_on = obs & F.coalesce(F.col("data_enabled"), F.lit(False))
    data_size = F.coalesce(F.col("data_size_gb"), F.lit(0))
    dtype = F.coalesce(F.col("data_type"), F.lit(""))
    ltype = F.coalesce(F.col("log_type"), F.lit(""))
    count = F.coalesce(F.col("_raw_count"), F.lit(0))

    def issue(cond: Column, rule: str, severity: str, message: Column) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message")))

    def txt(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    rules = F.array(
        issue(obs & (count < 3), "observer_count", "WARN", txt("observer.count=", count.cast("string"), " < 3")),
        issue(checked & (F.col("cores") < F.col("min_cores")), "min_cores", "ERROR",
              txt(F.col("role"), ": cores=", F.col("cores").cast("string"), " < ", F.col("min_cores").cast("string"))),
        issue(checked & (F.col("memory_gb") < F.col("min_memory_gb")), "min_memory", "ERROR",
              txt(F.col("role"), ": memory_gb=", F.col("memory_gb").cast("string"), " < ",
                  F.col("min_memory_gb").cast("string"))),
        issue(data_on & (data_size < F.col("min_data_disk_gb")), "min_data_disk", "ERROR",
              txt("observer data_disk.size_gb=", data_size.cast("string"), " < ", F.col("min_data_disk_gb").cast("string"))),
        issue(data_on & (dtype != NONREPLICATED), "data_disk_type", "WARN", txt("observer data_disk.type=", dtype)),
        issue(data_on & F.coalesce(F.col("log_enabled"), F.lit(False)) & (ltype != IO_M3), "log_disk_type", "WARN",
              txt("observer log_disk.type=", ltype)),
    )
    broken = F.transform(F.filter(rules, lambda x: x.isNotNull()), lambda x: F.struct(
        F.col("role").alias("role"), x["rule"].alias("rule"), x["severity"].alias("severity"), x["message"].alias("message")))
    # a config without an observer profile reads as observer count 0: known once a deployment's
    # roles are together (as many rows as roles)
    none = F.array(F.struct(F.lit("observer").alias("role"), F.lit("observer_count").alias("rule"), F.lit("WARN").alias("severity"),
                            F.lit("observer.count=0 < 3").alias("message")))
    per = deploy.select("deploy_id", F.lit(True).alias("_listed")).join(r.select("deploy_id", obs.alias("_obs"), broken.alias("_i")),
                                                                       "deploy_id", "full_outer")
    per = per.groupBy("deploy_id").agg(F.flatten(F.collect_list("_i")).alias("_i"),
                                       F.bool_or(F.coalesce("_obs", F.lit(False)) | F.col("_listed").isNull()).alias("_has"))
    every = F.when(F.col("_has"), F.col("_i")).otherwise(F.concat("_i", none))
    return per.select("deploy_id", F.explode(every).alias("i")).select("deploy_id", "i.role", "i.rule", "i.severity", "i.message")


def routed(issues: DataFrame) -> DataFrame:
    """#14 each issue with its ``route``: errors to one output, the rest to another; one pass."""
    return issues.withColumn("route", F.when(F.col("severity") == "ERROR", F.lit("errors")).otherwise(F.lit("others")))


def route_issues(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two outputs of :func:`routed`."""
    err = F.col("severity") == "ERROR"
    return issues.where(err), issues.where(~err)


def audit_status(issues: DataFrame, deployments: DataFrame | None = None) -> DataFrame:
    """#54 per deployment: errors, warnings, and failed when any error.

    With ``deployments`` every deployment gets a row (0 / 0 / passed).
    """
    agg = issues.groupBy("deploy_id").agg(
        F.count_if(F.col("severity") == "ERROR").cast("bigint").alias("n_errors"),
        F.count_if(F.col("severity") != "ERROR").cast("bigint").alias("n_warnings"),
    )
    if deployments is not None:
        agg = deployments.select("deploy_id").join(agg, "deploy_id", "left").select(
            "deploy_id",
            F.coalesce("n_errors", F.lit(0).cast("bigint")).alias("n_errors"),
            F.coalesce("n_warnings", F.lit(0).cast("bigint")).alias("n_warnings"),
        )
    return agg.withColumn("failed", F.col("n_errors") > 0)
