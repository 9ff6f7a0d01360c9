"""Sinks write per-deployment / per-host files that read back to the same rows."""

from pyspark.sql import functions as F

from fleetlens.fixtures import fixture
from fleetlens.queries import common as C
from fleetlens.sinks import documents as D
from fleetlens.plans.cluster_config import cluster_documents

SF = "/root/testdata/sf0.001"


def _addressed(spark):
    """The inventory with an address for every VM of every second deployment."""
    inv = C.inventory(spark, SF)
    return inv.withColumn("ip", F.when(F.col("deploy_id") % 2 == 0, F.concat(F.lit("10.0.0."), F.col("idx").cast("string"))).otherwise(F.col("ip")))


def test_inventory_lines_round_trip(spark, scratch):
    inv = _addressed(spark)
    lines, rejects = D.render_inventory(inv, fixture(spark, SF, "fx_deployment"), C.profiles_with_role(spark, SF))
    folder = D.write_lines(lines, f"{scratch}/inv")
    back = spark.read.text(folder)
    assert back.count() == lines.count()
    assert "deploy_id" in back.columns  # one folder per deployment
    # every VM is a line or a reject, and a deployment has only one of them
    names = lines.where(F.col("line").rlike("^[A-Z]+_[0-9]+_NAME=")).count()
    assert names + rejects.count() == inv.count() and names > 0
    assert lines.join(rejects, "deploy_id").count() == 0


def test_inventory_lines_parse_back(spark, scratch):
    from fleetlens.sources.kv import parse_kv

    lines, _ = D.render_inventory(_addressed(spark), fixture(spark, SF, "fx_deployment"), C.profiles_with_role(spark, SF))
    numbered = lines.withColumn("line_no", F.col("section") * 100000 + F.col("idx") * 10 + F.col("kind"))
    kv = parse_kv(numbered, key_cols=("deploy_id",))
    counts = kv.where("key = 'OBSERVER_COUNT'").select("deploy_id", F.col("value").cast("int").alias("n"))
    obs = C.desired(spark, SF).where("role = 'observer'").groupBy("deploy_id").count()
    assert counts.join(obs, "deploy_id").where("n <> count").count() == 0


def test_profile_lines_round_trip(spark):
    from fleetlens.queries.profiles_q import resolved

    r = resolved(spark, SF)
    back = D.read_profile_lines(D.render_profile(r))
    assert back.count() == r.count()
    j = back.join(r.select("deploy_id", "role", F.col("cores").cast("string").alias("c")), ["deploy_id", "role"])
    assert j.where("cores <> c").count() == 0


def test_host_logs_written_by_role_and_host(spark, scratch):
    lines = fixture(spark, SF, "fx_op_line").select(
        F.lit("observer").alias("role"), F.concat(F.lit("h-"), F.col("op_id").cast("string"), F.lit(".x:22")).alias("host"),
        "line_no", "line")
    D.write_host_logs(lines, f"{scratch}/logs")
    back = D.read_host_logs(spark, f"{scratch}/logs")
    assert back.count() == lines.count()
    assert back.where(F.col("host_safe").rlike("[.:/]")).count() == 0


def test_host_logs_are_cut_by_size_and_keep_their_order(spark, scratch):
    """A large host is several files in order, small hosts share a task; no folder beside those of the hosts."""
    import glob

    lines = spark.createDataFrame([("observer", "h.x", i, f"line {i}") for i in range(950)] + [("observer", f"s.{k}", 3, "other") for k in range(30)],
                                  "role string, host string, line_no long, line string").orderBy(F.rand(1))
    folder = D.write_host_logs(lines, f"{scratch}/split", part_lines=100)
    parts = sorted(glob.glob(f"{folder}/role=observer/host_safe=h_x/part-*"))
    text = "".join(open(f).read() for f in parts)
    assert 6 <= len(parts) <= 11 and text.splitlines() == [f"line {i}" for i in range(950)]
    assert len(glob.glob(f"{folder}/role=observer/*")) == 31
    back = D.read_host_logs(spark, f"{scratch}/split").where("host_safe = 'h_x'").orderBy("part", "pos")
    assert [r.line for r in back.collect()] == [f"line {i}" for i in range(950)]


def test_a_failed_publication_leaves_the_last_version(spark, scratch):
    import os

    from fleetlens.sinks.published import publish, published

    path = f"{scratch}/pub"
    import pytest

    with pytest.raises(FileNotFoundError):
        published(spark, path)
    first = publish(spark, path, lambda folder: spark.range(10).write.parquet(folder))
    assert published(spark, path) == first

    def breaks(folder):
        spark.range(5).write.parquet(folder)
        raise RuntimeError("killed half way")

    with pytest.raises(RuntimeError, match="half way"):
        publish(spark, path, breaks)
    bad = spark.range(100).select(F.assert_true(F.col("id") < 50))
    with pytest.raises(Exception):
        publish(spark, path, lambda folder: bad.write.mode("overwrite").parquet(folder))
    assert published(spark, path) == first and spark.read.parquet(first).count() == 10
    assert [x for x in os.listdir(path) if x.startswith("version-")] == [os.path.basename(first)]
    second = publish(spark, path, lambda folder: spark.range(20).write.parquet(folder))
    assert spark.read.parquet(first).count() == 10  # readers of the version before go on
    third = publish(spark, path, lambda folder: spark.range(30).write.parquet(folder))
    assert published(spark, path) == third and spark.read.parquet(published(spark, path)).count() == 30
    assert sorted(x for x in os.listdir(path) if x.startswith("version-")) == [os.path.basename(second), os.path.basename(third)]


def test_cluster_docs_or_rejects(spark, scratch):
    """Every deployment has a document or reject rows; no document holds a null address."""
    from fleetlens.catalog import load_all

    rows = load_all()["cluster_docs"].build(spark, SF).collect()
    docs = [r for r in rows if r.doc is not None]
    rejects = [r for r in rows if r.doc is None]
    every = {r.deploy_id for r in fixture(spark, SF, "fx_deployment").collect()}
    assert {r.deploy_id for r in docs} | {r.deploy_id for r in rejects} == every
    assert not {r.deploy_id for r in docs} & {r.deploy_id for r in rejects}
    assert len(docs) > 50 and rejects and all(r.reason and r.component for r in rejects)
    assert not any('"servers":[null' in r.doc or '"ip":null' in r.doc or ",null" in r.doc or "password" in r.doc for r in docs)
    folder = D.write_cluster_docs(spark.createDataFrame([(r.deploy_id, r.doc) for r in docs], "deploy_id long, doc string"), f"{scratch}/docs")
    assert len(spark.read.text(folder).collect()) == len(docs)


def test_listing_without_addresses_gives_rejects_only(spark):
    docs, rejects = cluster_documents(fixture(spark, SF, "fx_deployment"), fixture(spark, SF, "fx_profile"),
                                      fixture(spark, SF, "fx_role_alias"), fixture(spark, SF, "fx_instance").where("false"))
    assert docs.count() == 0
    assert rejects.select("deploy_id").distinct().count() == fixture(spark, SF, "fx_deployment").count()


def test_a_missing_management_server_is_named(spark):
    docs, rejects = _rendered(spark, vms=[("observer", 1), ("observer", 2), ("monitoring", 1)])
    assert docs.count() == 0
    assert [tuple(r) for r in rejects.collect()] == [(1, "ocp-server-ce", 1, D.NO_SERVER)]


VMS = [("observer", 1), ("observer", 2), ("monitoring", 1), ("ocp", 1)]


def _one_document(spark, **config):
    """The document of one deployment with two observers, a monitoring VM and a management VM."""
    import json

    docs, rejects = _rendered(spark, **config)
    assert rejects.count() == 0
    return json.loads(docs.first().doc)


def _rendered(spark, vms=VMS, **config):
    inv = spark.createDataFrame([(1, r, i, f"p-{r}-{i}", "z-a", f"10.0.0.{k}") for k, (r, i) in enumerate(vms)],
        "deploy_id long, role string, idx int, name string, zone string, ip string")
    flags = spark.createDataFrame([(1, *[config.pop(k, True) for k in ("configserver", "agent", "prometheus", "management")], True)],
                                  "deploy_id long, configserver boolean, agent boolean, prometheus boolean, management boolean, "
                                  "production_mode boolean")
    profiles = spark.createDataFrame([(1, "monitoring", None, True)], "deploy_id long, role string, dedicated boolean, enabled boolean")
    tuning = spark.createDataFrame([(1, "8G", "2G", "85G", "24G", 4)], "deploy_id long, memory_limit string, system_memory string, "
                                   "datafile_size string, log_disk_size string, cpu_count int")
    deploy = spark.createDataFrame([(1, "adm", *config.values())], ", ".join(
        ["deploy_id long", "ssh_user string", *(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in config.items())]))
    return D.render_cluster_docs(inv, flags, deploy, tuning, profiles)


def test_cluster_document_follows_config_and_switches(spark):
    doc = _one_document(spark, mysql_port=3306, agent_port=9000, key_file="/k")
    assert list(doc) == ["user", "ob-configserver", "oceanbase-ce", "obproxy-ce", "obagent", "prometheus", "ocp-server-ce"]
    assert doc["user"] == {"username": "adm", "port": 22, "timeout": 60, "key_file": "/k"}
    ob = doc["oceanbase-ce"]
    assert [s["name"] for s in ob["servers"]] == ["server1", "server2"] and ob["server2"]["mysql_port"] == 3306
    assert ob["server2"]["zone"] == "zone2" and ob["global"]["ocp_meta_tenant"]["max_cpu"] == 2.0
    jobs = {j["job_name"]: j for j in doc["prometheus"]["global"]["config"]["scrape_configs"]}
    assert jobs["node"]["static_configs"][0]["targets"] == ["p-observer-1.z.internal:9000", "p-observer-2.z.internal:9000"]
    assert len(jobs["node_exporter"]["static_configs"][0]["targets"]) == 3 and doc["prometheus"]["servers"] == ["10.0.0.2"]
    assert doc["ocp-server-ce"]["global"]["ocp_site_url"] == "http://10.0.0.3:8080" and "version" not in doc["ocp-server-ce"]
    off = _one_document(spark, configserver=False, agent=False, management=False)
    assert list(off) == ["user", "oceanbase-ce", "obproxy-ce", "prometheus"]
    assert off["oceanbase-ce"]["depends"] == [] and off["prometheus"]["depends"] == [] and "key_file" not in off["user"]
    assert [j["job_name"] for j in off["prometheus"]["global"]["config"]["scrape_configs"]] == ["prometheus", "node_exporter"]
    assert "ocp_meta_tenant" not in off["oceanbase-ce"]["global"]


def test_printed_table_shortens_nothing(spark):
    from fleetlens.sources.logs import parse_result_table

    counts = spark.createDataFrame([(1, "AVeryLongTransactionName", 12345678, 9999999), (1, "TOTAL", 12345678901, 0), (2, "A", 1, 0)],
                                   "run_id int, tx_type string, ok_count long, failed_count long")
    pct = spark.createDataFrame([(1, "AVeryLongTransactionName", 123456789, 2, 3)], "run_id int, tx_type string, p50 int, p90 int, p99 int")
    rows, foot = parse_result_table(D.render_result_table(counts, pct))
    got = {(r.run_id, r.tx_type): (r.ok_count, r.failed_count, r.p50) for r in rows.collect()}
    assert got == {(1, "AVeryLongTransactionName"): (12345678, 9999999, 123456789), (1, "TOTAL"): (12345678901, 0, None), (2, "A"): (1, 0, None)}
    assert [(r.key, r.value, r.starred) for r in foot.collect()] == [("total_ok", "12345678901", True)]


def test_provisioning_and_validation_plans(spark):
    from fleetlens.plans.provisioning import provisioning_plan
    from fleetlens.plans.validation import validate

    dep, prof, ali = (fixture(spark, SF, n) for n in ("fx_deployment", "fx_profile", "fx_role_alias"))
    p = provisioning_plan(dep, prof, ali, fixture(spark, SF, "fx_instance"), fixture(spark, SF, "fx_disk"))
    assert p["new"].count() + p["desired"].join(p["existing"].select("name").distinct(), "name", "left_semi").count() \
        == p["desired"].count()
    assert p["profile_rejects"].count() == 0
    v = validate(dep, prof, ali, fixture(spark, SF, "fx_role_min"))
    assert v["errors"].count() + v["warnings"].count() == v["issues"].count()
    assert v["status"].count() == dep.count()


def test_listing_files_and_lines_agree(spark, scratch):
    import json

    from fleetlens.sources import listings as L

    items = [{"id": str(i), "name": f"vm-{i}", "status": "RUNNING", "labels": {"deployment": "d"},
              "network_interfaces": [{"primary_v4_address": {"address": f"10.0.0.{i}", "one_to_one_nat": None}}]}
             for i in range(20)]
    import os

    os.makedirs(f"{scratch}/arr")
    os.makedirs(f"{scratch}/lines")
    with open(f"{scratch}/arr/a.json", "w") as f:
        json.dump(items, f)
    with open(f"{scratch}/lines/a.json", "w") as f:
        f.write("\n".join(json.dumps(x) for x in items))
    a = L.read_listing_files(spark, f"{scratch}/arr", L.INSTANCE_SCHEMA).select("name", "status")
    b = L.read_listing_lines(spark, f"{scratch}/lines", L.INSTANCE_SCHEMA).select("name", "status")
    assert a.count() == 20 and a.exceptAll(b).count() == 0


def test_inventory_file_order(spark, scratch):
    import glob

    lines, _ = D.render_inventory(_addressed(spark), fixture(spark, SF, "fx_deployment"), C.profiles_with_role(spark, SF))
    folder = D.write_lines(lines, f"{scratch}/inv_order")
    one = sorted(glob.glob(f"{folder}/deploy_id=*"))[0]
    dep = int(one.rsplit("=", 1)[1])
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{one}/part-*")))
    want = [r.line for r in lines.where(F.col("deploy_id") == dep).orderBy("section", "idx", "kind").collect()]
    assert text.splitlines() == want
    assert want[-8].startswith("OBSERVER_COUNT=") and want[-1].startswith("CONFIGSERVER_DEDICATED=")
