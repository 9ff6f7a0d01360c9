"""Deployment config documents.

YAML needs a Python parser, so decoding is the one place where rows go
through Python: ``mapInPandas`` turns each YAML text into JSON text in
Arrow batches on the executors; everything after (typing, lookups) is
``from_json`` / VARIANT in the JVM. Password fields are dropped while
decoding so they never reach a DataFrame.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The section and key names of the deployment config files (their format),
# as the typed view the operators read.
DISK = "struct<enabled:boolean,type:string,size_gb:int,mount_point:string>"
PROFILE = (
    "struct<enabled:boolean,dedicated:boolean,count:int,platform:string,cores:int,memory_gb:int,"
    f"core_fraction:int,image_folder_id:string,image_name:string,image_family:string,"
    f"boot_disk:{DISK},data_disk:{DISK},log_disk:{DISK}>"
)
TENANT = "struct<tenant_name:string,max_cpu:double,memory_size:string,username:string,database:string>"
CONFIG_SCHEMA = (
    "struct<yandex_cloud:struct<folder_id:string,zone:string,network_name:string,subnet_name:string,"
    "nat_enabled:boolean,ssh_user:string,image_folder_id:string,image_family:string,image_name:string>,"
    "deployment:struct<name:string,control_mode:string>,"
    "vm_defaults:struct<platform:string,cores:int,memory_gb:int,core_fraction:int,"
    f"boot_disk:{DISK},data_disk:{DISK},log_disk:{DISK}>,"
    f"vm_profiles:map<string,{PROFILE}>,"
    "oceanbase:struct<deploy_user:string,auto_tune:boolean,cluster_name:string,home_path:string,data_dir:string,"
    "redo_dir:string,memory_limit:string,system_memory:string,datafile_size:string,log_disk_size:string,cpu_count:int,"
    "ports:struct<mysql:int,rpc:int,obshell:int,obproxy:int>,"
    "components:struct<ob_configserver:boolean,oceanbase_ce:boolean,obproxy_ce:boolean,obagent:boolean,"
    "prometheus:boolean,grafana:boolean>>,"
    "ocp:struct<enabled:boolean,port:int,home_path:string,soft_dir:string,log_dir:string,memory_size:string,version:string,"
    f"meta_tenant:{TENANT},monitor_tenant:{TENANT}>,"
    "monitoring:struct<node_exporter:struct<enabled:boolean,port:int>,"
    "obagent:struct<http_port:int,basic_auth_user:string>,prometheus:struct<port:int>>,"
    "ssh:struct<port:int,private_key_file:string>>"
)


def _drop_secrets(node):
    if isinstance(node, dict):
        return {k: _drop_secrets(v) for k, v in node.items() if "password" not in str(k).lower()}
    if isinstance(node, list):
        return [_drop_secrets(v) for v in node]
    return node


def _yaml_to_json(batches):
    import yaml

    # the C parser when the worker has libyaml (same results, several times faster)
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for pdf in batches:
        out, why = [], []
        for text in pdf["doc"]:
            try:
                data = yaml.load(text, Loader=loader) if text is not None else None
                data = data or {}
                if not isinstance(data, dict):
                    raise ValueError("the document is not a mapping")
                out.append(json.dumps(_drop_secrets(data), default=str))
                why.append(None)
            except (yaml.YAMLError, ValueError, RecursionError) as e:  # ValueError: a date or number that does not exist
                out.append(None)
                why.append(f"not a config: {type(e).__name__}")
        yield pdf.drop(columns=["doc"]).assign(config_json=out, reject=why)


def read_config_docs(docs: DataFrame, text_col: str = "doc", schema: str = CONFIG_SCHEMA) -> DataFrame:
    """YAML documents -> one typed row per document (``config`` struct plus the raw JSON).

    An empty document gives an empty config; a document that can't be read
    gives a NULL config and the reason in ``reject``. Other columns of
    ``docs`` are kept.
    """
    d = docs.withColumnRenamed(text_col, "doc") if text_col != "doc" else docs
    keep = [f"{c} {t}" for c, t in d.dtypes if c != "doc"]
    out_schema = ", ".join(keep + ["config_json string", "reject string"])
    js = d.mapInPandas(_yaml_to_json, out_schema)
    return js.withColumn("config", F.from_json("config_json", schema))


def read_config_files(spark, path: str) -> DataFrame:
    """One row per YAML file of a folder (``wholetext``), decoded in parallel by file."""
    docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc").withColumn(
        "source_file", F.input_file_name())
    return read_config_docs(docs)


def json_path(path: str) -> str:
    """Dotted path -> JSON path; empty parts are skipped (``a..b`` is ``a.b``)."""
    parts = [p for p in path.split(".") if p]
    return "$" + "".join(f"['{p}']" if not p.replace("_", "").isalnum() else f".{p}" for p in parts)


def read_config_json(docs: DataFrame, text_col: str = "doc", schema: str = CONFIG_SCHEMA) -> DataFrame:
    """JSON documents -> one typed row per document (``config`` struct, ``variant``, ``reject``).

    The text is parsed once to a VARIANT for lookups and once by schema for
    the struct; malformed text has a NULL config and a reason in ``reject``."""
    d = docs.withColumn("variant", F.try_parse_json(F.col(text_col)))
    bad = F.col("variant").isNull() & F.col(text_col).isNotNull()
    d = d.withColumn("reject", F.when(bad, F.lit("not a config: malformed JSON")))
    return d.withColumn("config", F.when(F.col("reject").isNull(), F.from_json(F.col(text_col), schema)))


def variant_text(variant, path: str) -> Column:
    """Dotted-path lookup on a parsed document: missing or null -> '', booleans -> 'true'/'false',
    anything else -> its text."""
    c = F.col(variant) if isinstance(variant, str) else variant
    return F.coalesce(F.try_variant_get(c, json_path(path), "string"), F.lit(""))


def config_get(doc_json, path: str) -> Column:
    """:func:`variant_text` on JSON text; malformed text has no values (its reject is in
    :func:`read_config_json`, which also parses a text once for many lookups)."""
    c = F.col(doc_json) if isinstance(doc_json, str) else doc_json
    return variant_text(F.try_parse_json(c), path)


# Where the columns that the operators read stand in a config.
DEPLOY_FIELDS = {
    "deploy_name": "deployment.name", "zone": "yandex_cloud.zone", "ssh_user": "yandex_cloud.ssh_user",
    "image_folder_id": "yandex_cloud.image_folder_id", "image_name": "yandex_cloud.image_name",
    "image_family": "yandex_cloud.image_family",
    "default_platform": "vm_defaults.platform", "default_cores": "vm_defaults.cores",
    "default_memory_gb": "vm_defaults.memory_gb", "default_core_fraction": "vm_defaults.core_fraction",
    "deploy_user": "oceanbase.deploy_user", "auto_tune": "oceanbase.auto_tune", "cluster_name": "oceanbase.cluster_name",
    "home_path": "oceanbase.home_path", "data_dir": "oceanbase.data_dir", "redo_dir": "oceanbase.redo_dir",
    "memory_limit": "oceanbase.memory_limit", "system_memory": "oceanbase.system_memory",
    "datafile_size": "oceanbase.datafile_size", "log_disk_size": "oceanbase.log_disk_size", "cpu_count": "oceanbase.cpu_count",
    "mysql_port": "oceanbase.ports.mysql", "rpc_port": "oceanbase.ports.rpc", "obshell_port": "oceanbase.ports.obshell",
    "proxy_port": "oceanbase.ports.obproxy",
    "configserver_component": "oceanbase.components.ob_configserver", "database_component": "oceanbase.components.oceanbase_ce",
    "proxy_component": "oceanbase.components.obproxy_ce", "agent_component": "oceanbase.components.obagent",
    "prometheus_component": "oceanbase.components.prometheus", "grafana_component": "oceanbase.components.grafana",
    "ocp_enabled": "ocp.enabled", "management_port": "ocp.port", "management_home": "ocp.home_path",
    "management_soft_dir": "ocp.soft_dir", "management_log_dir": "ocp.log_dir", "management_memory": "ocp.memory_size",
    "management_version": "ocp.version",
    **{f"{k}_{n}": f"ocp.{k}_tenant.{n}" for k in ("meta", "monitor") for n in ("tenant_name", "max_cpu", "memory_size", "username", "database")},
    "node_exporter_enabled": "monitoring.node_exporter.enabled", "exporter_port": "monitoring.node_exporter.port",
    "agent_port": "monitoring.obagent.http_port", "agent_user": "monitoring.obagent.basic_auth_user",
    "prometheus_port": "monitoring.prometheus.port", "ssh_port": "ssh.port", "key_file": "ssh.private_key_file",
}


def _disk(prefix: str, disk: str) -> list[Column]:
    return [F.col(f"{disk}.{src}").alias(f"{prefix}_{name}") for name, src in (
        ("enabled", "enabled"), ("type", "type"), ("size_gb", "size_gb"), ("mount", "mount_point"))]


def config_frames(configs: DataFrame, key: str = "deploy_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read configs (``key, config, reject``) -> (deploy, profiles, rejects), as the operators take them.

    ``deploy`` has a row per config, ``profiles`` one per config and role (the
    requested name in ``role_in``); an absent key is NULL. ``rejects`` has the
    key and the reason of each document that could not be read."""
    rejects = configs.where(F.col("reject").isNotNull()).select(key, F.col("reject").alias("reason"))
    ok = configs.where(F.col("reject").isNull())
    defaults = [c for d in ("boot", "data", "log") for c in _disk(f"default_{d}", f"config.vm_defaults.{d}_disk")]
    deploy = ok.select(key, *[F.col(f"config.{path}").alias(name) for name, path in DEPLOY_FIELDS.items()], *defaults)
    p = ok.select(key, F.explode("config.vm_profiles").alias("role_in", "p"))
    profiles = p.select(key, "role_in", F.col("p.count").alias("vm_count"),
                        *[F.col(f"p.{c}").alias(c) for c in ("enabled", "dedicated", "platform", "cores", "memory_gb", "core_fraction",
                                                             "image_folder_id", "image_name", "image_family")],
                        *[c for d in ("boot", "data", "log") for c in _disk(d, f"p.{d}_disk")])
    return deploy, profiles, rejects
