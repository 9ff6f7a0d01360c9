"""Source queries: text and JSON built from the fixtures, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import fixture
from ..operators import bench as B
from ..session import ensure_checkpoint_dir
from ..sources import config as CF
from ..sources import json_array as JA
from ..sources import listings as L
from ..sources import logs as LG
from ..sources.kv import parse_kv
from .bench_q import _tx

NL = "\n"


def _yaml_docs(spark, sf):
    """One YAML text per deployment (with a password field that must be dropped); every
    tenth is empty."""
    d = fixture(spark, sf, "fx_deployment")
    b = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.col(c).cast("string"))
    text = F.concat(
        F.lit("yandex_cloud:" + NL + "  zone: "), F.col("zone"), F.lit(NL + "  ssh_user: "), F.col("ssh_user"),
        F.lit(NL + "  image_family: "), b("image_family"),
        F.lit(NL + "deployment:" + NL + "  name: "), F.col("deploy_name"),
        F.lit(NL + "vm_defaults:" + NL + "  core_fraction: "), b("default_core_fraction"),
        F.lit(NL + "oceanbase:" + NL + "  deploy_user: '"), F.col("deploy_user"), F.lit("'"),
        F.lit(NL + "  auto_tune: "), b("auto_tune"),
        F.lit(NL + "  root_password: secret" + NL + "ssh:" + NL + "  port: 22" + NL),
    )
    broken = F.when(F.col("deploy_id") % 50 == 1, F.lit("a: 2024-13-45")).when(F.col("deploy_id") % 50 == 2, F.lit("a: ["))
    return d.select("deploy_id", F.when(F.col("deploy_id") % 10 == 0, F.lit("")).otherwise(F.coalesce(broken, text)).alias("doc"))


@query(
    "config_docs",
    """WITH d AS (SELECT *, deploy_id % 10 = 0 OR deploy_id % 50 IN (1, 2) AS none FROM fx_deployment)
       SELECT deploy_id,
              CASE WHEN none THEN NULL ELSE deploy_name END AS deploy_name,
              CASE WHEN none THEN NULL ELSE zone END AS zone,
              CASE WHEN none THEN NULL ELSE deploy_user END AS deploy_user,
              CASE WHEN none THEN NULL ELSE auto_tune END AS auto_tune,
              CASE WHEN none THEN NULL ELSE default_core_fraction END AS core_fraction,
              false AS has_secret,
              CASE deploy_id % 50 WHEN 1 THEN 'not a config: ValueError' WHEN 2 THEN 'not a config: ParserError' END AS reject
       FROM d""",
    ("fx_deployment",),
)
def q_config_docs(spark, sf):
    c = CF.read_config_docs(_yaml_docs(spark, sf))
    return c.select(
        "deploy_id",
        F.col("config.deployment.name").alias("deploy_name"),
        F.col("config.yandex_cloud.zone").alias("zone"),
        F.col("config.oceanbase.deploy_user").alias("deploy_user"),
        F.col("config.oceanbase.auto_tune").alias("auto_tune"),
        F.col("config.vm_defaults.core_fraction").alias("core_fraction"),
        F.coalesce(F.col("config_json").contains("password"), F.lit(False)).alias("has_secret"),
        "reject",
    )


def _json_docs(spark, sf):
    d = fixture(spark, sf, "fx_deployment")
    doc = F.to_json(F.struct(
        F.struct("zone", "ssh_user", "image_family").alias("yandex_cloud"),
        F.struct("deploy_user", "auto_tune").alias("oceanbase"),
        F.struct(F.col("default_core_fraction").alias("core_fraction")).alias("vm_defaults"),
    ))
    return d.select("deploy_id", F.when(F.col("deploy_id") % 50 == 3, F.lit('{"a":')).otherwise(doc).alias("doc"))


PATHS = {
    "zone": "yandex_cloud.zone",
    "family": "yandex_cloud..image_family",
    "deploy_user": "oceanbase.deploy_user",
    "auto_tune": "oceanbase.auto_tune",
    "core_fraction": "vm_defaults.core_fraction",
    "ocp_port": "ocp.port",
}


@query(
    "config_get",
    """WITH j AS (SELECT deploy_id, to_json({'yandex_cloud': {'zone': zone, 'ssh_user': ssh_user, 'image_family': image_family},
                                           'oceanbase': {'deploy_user': deploy_user, 'auto_tune': auto_tune},
                                           'vm_defaults': {'core_fraction': default_core_fraction}}) AS doc
                  FROM fx_deployment WHERE deploy_id % 50 <> 3)
       SELECT deploy_id,
              coalesce(json_extract_string(doc, '$.yandex_cloud.zone'), '') AS zone,
              coalesce(json_extract_string(doc, '$.yandex_cloud.image_family'), '') AS family,
              coalesce(json_extract_string(doc, '$.oceanbase.deploy_user'), '') AS deploy_user,
              coalesce(json_extract_string(doc, '$.oceanbase.auto_tune'), '') AS auto_tune,
              coalesce(json_extract_string(doc, '$.vm_defaults.core_fraction'), '') AS core_fraction,
              coalesce(json_extract_string(doc, '$.ocp.port'), '') AS ocp_port, CAST(NULL AS VARCHAR) AS reject
       FROM j
       UNION ALL
       SELECT deploy_id, '', '', '', '', '', '', 'not a config: malformed JSON' FROM fx_deployment WHERE deploy_id % 50 = 3""",
    ("fx_deployment",),
)
def q_config_get(spark, sf):
    d = CF.read_config_json(_json_docs(spark, sf))
    return d.select("deploy_id", *[CF.variant_text("variant", p).alias(k) for k, p in PATHS.items()], "reject")


def _full_json_docs(spark, sf):
    """The whole config of each deployment as JSON text, roles under their canonical names; every
    fiftieth text is broken."""
    from . import common as C

    d = fixture(spark, sf, "fx_deployment")
    disk = lambda k: F.struct(*[F.col(f"{k}_{c}").alias(c) for c in ("enabled", "type", "size_gb") if not (k == "boot" and c == "enabled")])
    p = C.profiles_with_role(spark, sf).select("deploy_id", F.struct("role", F.struct(
        F.col("vm_count").alias("count"), "enabled", "dedicated", "platform", "cores", "memory_gb", disk("boot").alias("boot_disk"),
        disk("data").alias("data_disk"), disk("log").alias("log_disk"))).alias("e"))
    roles = p.groupBy("deploy_id").agg(F.map_from_entries(F.collect_list("e")).alias("vm_profiles"))  # five roles
    doc = F.to_json(F.struct(
        F.struct("zone", "ssh_user", "image_folder_id", "image_name", "image_family").alias("yandex_cloud"),
        F.struct(F.col("deploy_name").alias("name")).alias("deployment"),
        F.struct(F.col("default_platform").alias("platform"), F.col("default_cores").alias("cores"),
                 F.col("default_memory_gb").alias("memory_gb"), F.col("default_core_fraction").alias("core_fraction")).alias("vm_defaults"),
        "vm_profiles",
        F.struct("deploy_user", "auto_tune", "memory_limit", "system_memory", "datafile_size", "log_disk_size", "cpu_count").alias("oceanbase")))
    j = d.join(roles, "deploy_id")
    return j.select("deploy_id", F.when(F.col("deploy_id") % 50 == 3, F.lit('{"a":')).otherwise(doc).alias("doc"))


def _config_audit_sql() -> str:
    from .profiles_q import ISSUES_CTE, RESOLVED_CTE, TUNED_CTE

    return f"""WITH {RESOLVED_CTE}, {ISSUES_CTE}, {TUNED_CTE}
        SELECT i.deploy_id, i.role, i.rule, i.severity, i.message,
               CASE WHEN coalesce(d.auto_tune, true) THEN t.memory_limit ELSE d.memory_limit END AS memory_limit,
               CAST(NULL AS VARCHAR) AS reason
        FROM issues i JOIN fx_deployment d ON d.deploy_id = i.deploy_id LEFT JOIN tuned t ON t.deploy_id = i.deploy_id
        WHERE i.deploy_id % 50 <> 3
        UNION ALL
        SELECT deploy_id, NULL, NULL, NULL, NULL, NULL, 'not a config: malformed JSON' FROM fx_deployment WHERE deploy_id % 50 = 3"""


@query("config_audit", _config_audit_sql(), ("fx_profile", "fx_deployment", "fx_role_alias", "fx_role_min"))
def q_config_audit(spark, sf):
    """Config texts -> deployments and profiles -> audit and tuning, with a row for each text that can't be read."""
    from ..operators import profiles as P

    deploy, profiles, rejects = CF.config_frames(CF.read_config_json(_full_json_docs(spark, sf)))
    aliases = fixture(spark, sf, "fx_role_alias")
    issues = P.audit_profiles(profiles, deploy, aliases, fixture(spark, sf, "fx_role_min"))
    tuning = P.effective_tuning(deploy, P.auto_tune(P.resolve_profiles(profiles, deploy, aliases)[0]))
    found = issues.join(tuning.select("deploy_id", "memory_limit"), "deploy_id", "left")
    return found.unionByName(rejects, allowMissingColumns=True)


@query(
    "inventory_parse",
    """WITH kv AS (SELECT file_id, line_no, regexp_replace(split_part(line, '=', 1), '^\\s+|\\s+$', '', 'g') AS key,
                          regexp_replace(substr(line, strpos(line, '=') + 1), '^\\s+|\\s+$', '', 'g') AS value
                   FROM fx_kv_line WHERE strpos(line, '=') > 0)
       SELECT file_id, key, arg_max(value, line_no) AS value FROM kv GROUP BY file_id, key""",
    ("fx_kv_line",),
)
def q_inventory_parse(spark, sf):
    return parse_kv(fixture(spark, sf, "fx_kv_line"), keep="last", key_cols=("file_id",))


MARKER_KEYS = {"OBSERVER_1_IP": "", "OBSERVER_COUNT": "0", "OPTS": "none", "role": None}


@query(
    "marker_parse",
    """WITH l AS (SELECT file_id, line_no, replace(line, chr(13), '') AS line FROM fx_kv_line),
            fw AS (SELECT file_id, unnest([{'key': 'OBSERVER_1_IP', 'dflt': ''}, {'key': 'OBSERVER_COUNT', 'dflt': '0'},
                                           {'key': 'OPTS', 'dflt': 'none'},
                                           {'key': 'role', 'dflt': CAST(NULL AS VARCHAR)}]) AS w
                   FROM (SELECT DISTINCT file_id FROM fx_kv_line)),
            wanted AS (SELECT file_id, w.key AS key, w.dflt AS dflt FROM fw),
            f AS (SELECT l.file_id, k.key, arg_min(substr(l.line, length(k.key) + 2), l.line_no) AS value
                  FROM l JOIN wanted k ON k.file_id = l.file_id AND starts_with(l.line, k.key || '=')
                  GROUP BY l.file_id, k.key)
       SELECT k.file_id, k.key, coalesce(f.value, k.dflt) AS value
       FROM wanted k LEFT JOIN f ON f.file_id = k.file_id AND f.key = k.key""",
    ("fx_kv_line",),
)
def q_marker_parse(spark, sf):
    return parse_kv(fixture(spark, sf, "fx_kv_line"), keep="first", key_cols=("file_id",), defaults=MARKER_KEYS)


def _instance_docs(spark, sf, of=None, note=None):
    i = fixture(spark, sf, "fx_instance")
    labels = F.when(F.col("label_deployment").isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("deployment"), F.col("label_deployment")))
    if note is not None:
        labels = F.map_concat(labels, F.create_map(F.lit("note"), note))
    el = F.struct(
        F.col("instance_id").cast("string").alias("id"), "name", "status", labels.alias("labels"),
        F.array(F.struct(F.struct(F.col("ip_address").alias("address"),
                                  F.struct(F.col("nat_address").alias("address")).alias("one_to_one_nat"))
                         .alias("primary_v4_address"))).alias("network_interfaces"),
    )
    # a listing document holds up to four instances (bounded group)
    return i.groupBy((F.expr("instance_id div 4") if of is None else of).alias("doc_id")).agg(
        F.to_json(F.collect_list(el)).alias("doc"))


@query(
    "instance_listing",
    """SELECT CAST(instance_id AS VARCHAR) AS instance_id, name, status, label_deployment,
              coalesce(nullif(ip_address, ''), nullif(nat_address, ''), '') AS ip
       FROM fx_instance""",
    ("fx_instance",),
)
def q_instance_listing(spark, sf):
    return L.instance_rows(_instance_docs(spark, sf))


@query(
    "instance_listing_array",
    """SELECT CAST(instance_id AS VARCHAR) AS instance_id, name, status, label_deployment,
              coalesce(nullif(ip_address, ''), nullif(nat_address, ''), '') AS ip
       FROM fx_instance""",
    ("fx_instance",),
)
def q_instance_listing_array(spark, sf):
    """Files of one JSON array each (20,000 instances, a single line, strings with brackets and quotes), read back by size."""
    n = fixture(spark, sf, "fx_instance").count() // 20_000 + 2
    note = F.concat(F.lit('a "}],[{\\'), F.col("instance_id").cast("string"))
    docs = _instance_docs(spark, sf, F.col("instance_id") % n, note)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    docs.repartition(n, "doc_id").write.partitionBy("doc_id").text(path)
    return L.listed_instances(JA.read_listing_array(spark, path, L.INSTANCE_SCHEMA))


@query(
    "disk_listing",
    """SELECT CAST(disk_id AS VARCHAR) AS disk_id, name, status, label_deployment,
              CASE WHEN attached_instance_id IS NULL THEN 0 ELSE 1 END AS n_instances
       FROM fx_disk""",
    ("fx_disk",),
)
def q_disk_listing(spark, sf):
    d = fixture(spark, sf, "fx_disk")
    ids = F.when(F.col("attached_instance_id").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.col("attached_instance_id").cast("string")))
    el = F.struct(F.col("disk_id").cast("string").alias("id"), "name", "status",
                  F.create_map(F.lit("deployment"), F.col("label_deployment")).alias("labels"),
                  ids.alias("instance_ids"))
    docs = d.groupBy(F.expr("disk_id div 10").alias("doc_id")).agg(F.to_json(F.collect_list(el)).alias("doc"))
    return L.disk_rows(docs).select("disk_id", "name", "status", "label_deployment",
                                    F.size("instance_ids").alias("n_instances"))


@query("image_listing", "SELECT name, family, family_id FROM fx_image", ("fx_image",))
def q_image_listing(spark, sf):
    i = fixture(spark, sf, "fx_image")
    # image lists of up to ten images each (grouped by the last digit of the name)
    doc = i.groupBy(F.substring("name", -1, 1).alias("doc_id")).agg(
        F.to_json(F.collect_list(F.struct("name", "family", "family_id"))).alias("doc"))
    return L.image_rows(doc)


STEP_LINES_SQL = """sl AS (
  SELECT op_id, line_no,
         CASE WHEN line_no % 7 = 0 THEN '=== step-' || CAST(op_id AS VARCHAR) || ' ==='
              WHEN line_no % 7 = 1 THEN 'plain output ' || line
              ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] '
                   || CASE WHEN contains(line, 'ERROR:') THEN 'ERROR' WHEN contains(line, 'limit') THEN 'WARN'
                           ELSE 'INFO' END || ': ' || line END AS line
  FROM fx_op_line)"""


def step_lines(spark, sf):
    o = fixture(spark, sf, "fx_op_line")
    level = (F.when(F.col("line").contains("ERROR:"), F.lit("ERROR"))
             .when(F.col("line").contains("limit"), F.lit("WARN")).otherwise(F.lit("INFO")))
    line = (
        F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("=== step-"), F.col("op_id").cast("string"), F.lit(" ===")))
        .when(F.col("line_no") % 7 == 1, F.concat(F.lit("plain output "), F.col("line")))
        .otherwise(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), level,
                            F.lit(": "), F.col("line")))
    )
    return o.select("op_id", "line_no", line.alias("line"))


@query(
    "step_log_parse",
    f"""WITH {STEP_LINES_SQL},
        p AS (SELECT op_id, line_no, line,
                     regexp_matches(line, '^\\[(\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d)\\] (INFO|WARN|ERROR): (.*)$') AS ok
              FROM sl)
        SELECT op_id, line_no,
               CASE WHEN ok THEN strptime(regexp_extract(line, '^\\[([^\\]]*)\\]', 1), '%Y-%m-%d %H:%M:%S') END AS ts,
               CASE WHEN ok THEN regexp_extract(line, '^\\[[^\\]]*\\] (INFO|WARN|ERROR): ', 1) END AS level,
               CASE WHEN ok THEN regexp_extract(line, '^\\[[^\\]]*\\] (INFO|WARN|ERROR): (.*)$', 2) ELSE line END AS message,
               CASE WHEN regexp_matches(line, '^=== (.*) ===$') THEN regexp_extract(line, '^=== (.*) ===$', 1) END AS step
        FROM p""",
    ("fx_op_line",),
)
def q_step_log_parse(spark, sf):
    return LG.parse_step_log(step_lines(spark, sf))


def _parsed_sql(cut: str = "") -> str:
    return f"""{STEP_LINES_SQL},
        p AS (SELECT op_id, line_no, line,
                     regexp_matches(line, '^\\[(\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d)\\] (INFO|WARN|ERROR): (.*)$') AS ok,
                     CASE WHEN regexp_matches(line, '^=== (.*) ===$') THEN regexp_extract(line, '^=== (.*) ===$', 1) END AS step FROM sl),
        l AS (SELECT op_id, line_no,
                     CASE WHEN ok THEN strptime(regexp_extract(line, '^\\[([^\\]]*)\\]', 1), '%Y-%m-%d %H:%M:%S') END AS ts,
                     CASE WHEN ok THEN regexp_extract(line, '^\\[[^\\]]*\\] (INFO|WARN|ERROR): ', 1) END AS level,
                     last_value(step IGNORE NULLS) OVER w AS in_step,
                     last_value(CASE WHEN step IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS step_line
              FROM p WINDOW w AS (PARTITION BY op_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


@query("step_of_line", f"WITH {_parsed_sql()} SELECT op_id, line_no, ts, level, in_step, step_line FROM l", ("fx_op_line",))
def q_step_of_line(spark, sf):
    # chunks of 1000 line numbers, so that logs cross many chunk edges
    return LG.lines_in_steps(LG.parse_step_log(step_lines(spark, sf)), chunk_lines=1000).drop("message", "step")


@query(
    "step_times",
    f"""WITH {_parsed_sql()}
        SELECT op_id, step_line, in_step AS step, count(*) AS n_lines, count(*) FILTER (WHERE level = 'ERROR') AS n_errors,
               count(*) FILTER (WHERE level = 'WARN') AS n_warnings, min(ts) AS first_ts, max(ts) AS last_ts,
               date_diff('second', min(ts), max(ts)) AS seconds
        FROM l GROUP BY op_id, step_line, in_step""",
    ("fx_op_line",),
)
def q_step_times(spark, sf):
    return LG.step_times(LG.lines_in_steps(LG.parse_step_log(step_lines(spark, sf)), chunk_lines=1000))


@query(
    "result_log_parse",
    """SELECT run_id, line_no,
              regexp_extract(line, 'info:\\s+(\\w+): OK=', 1) AS tx_type,
              CAST(regexp_extract(line, 'OK=(\\d+)', 1) AS BIGINT) AS ok_count,
              CAST(regexp_extract(line, 'Failed=(\\d+)', 1) AS BIGINT) AS failed_count,
              CAST(regexp_extract(line, 'p50=(\\d+)ms', 1) AS INTEGER) AS p50,
              CAST(regexp_extract(line, 'p90=(\\d+)ms', 1) AS INTEGER) AS p90,
              CAST(regexp_extract(line, 'p99=(\\d+)ms', 1) AS INTEGER) AS p99
       FROM fx_result_line WHERE regexp_matches(line, 'OK=\\d+ Failed=\\d+ p50=')""",
    ("fx_result_line",),
)
def q_result_log_parse(spark, sf):
    return LG.parse_result_log(fixture(spark, sf, "fx_result_line"))


def result_table_lines(spark, sf):
    """Render each run's counts and percentiles as a box-drawn table (as a load tool prints it)."""
    from ..sinks.documents import render_result_table

    # counts and type names wider than a table's headings
    tx = _tx(spark, sf).withColumn("tx_type", F.when(F.col("tx_type") == "StockLevel", F.lit("StockLevelReadOnly")).otherwise(F.col("tx_type")))
    counts = B.tx_summary(tx, total=True).withColumn("ok_count", F.col("ok_count") * 1000003)
    return render_result_table(counts, B.tx_percentiles(tx))


@query(
    "result_table_parse",
    """WITH tx AS (SELECT * REPLACE (CASE tx_type WHEN 'StockLevel' THEN 'StockLevelReadOnly' ELSE tx_type END AS tx_type) FROM fx_tx),
            c AS (SELECT run_id, CASE WHEN grouping(tx_type) = 1 THEN 'TOTAL' ELSE tx_type END AS tx_type,
                         CAST(1000003 * count(*) FILTER (WHERE ok) AS BIGINT) AS ok_count,
                         CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed_count
                  FROM tx GROUP BY GROUPING SETS ((run_id, tx_type), (run_id))),
            p AS (SELECT run_id, tx_type,
                         CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS INTEGER) AS p50,
                         CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY latency_ms) AS INTEGER) AS p90,
                         CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY latency_ms) AS INTEGER) AS p99
                  FROM tx GROUP BY run_id, tx_type)
       SELECT c.run_id, c.tx_type, c.ok_count, c.failed_count, p.p50, p.p90, p.p99, c.tx_type = 'TOTAL' AS is_total
       FROM c LEFT JOIN p ON c.run_id = p.run_id AND c.tx_type = p.tx_type""",
    ("fx_tx",),
)
def q_result_table_parse(spark, sf):
    rows, _ = LG.parse_result_table(result_table_lines(spark, sf))
    return rows.drop("line_no")
