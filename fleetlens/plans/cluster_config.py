"""The cluster-configuration pipeline: config + listing -> one document per deployment.

inventory -> addresses -> servers, zones, tuning, scrape jobs and component
hosts -> cluster document, or a reject row for each missing address. The resolved profiles and the inventory, which
several parts read, are written once as tables in the shared folder, so the
listing and the profiles are worked once and no cache is left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.inventory import feature_flags, vm_inventory, vm_queue
from ..operators.profiles import auto_tune, effective_tuning, resolve_profiles, role_lookup
from ..session import stored
from ..sinks.documents import render_cluster_docs, scrape_targets


def cluster_inputs(deploy: DataFrame, profiles: DataFrame, aliases: DataFrame, listing: DataFrame) -> dict:
    """The shared intermediates of the pipeline, each worked once."""
    raw = role_lookup(profiles, aliases)
    resolved, rejects = resolve_profiles(profiles, deploy, aliases, keep_raw=True)
    resolved = stored(resolved)
    inv = stored(vm_inventory(vm_queue(deploy, raw), listing, deploy))
    flags = feature_flags(deploy, resolved)
    return dict(deploy=deploy, raw=raw, resolved=resolved, rejects=rejects, inventory=inv, flags=flags)


def cluster_documents(deploy: DataFrame, profiles: DataFrame, aliases: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of :func:`fleetlens.sinks.documents.render_cluster_docs`."""
    x = cluster_inputs(deploy, profiles, aliases, listing)
    tuning = effective_tuning(deploy, auto_tune(x["resolved"]))
    return render_cluster_docs(x["inventory"], x["flags"], deploy, tuning, x["raw"])


def cluster_scrape_targets(deploy, profiles, aliases, listing) -> DataFrame:
    x = cluster_inputs(deploy, profiles, aliases, listing)
    return scrape_targets(x["inventory"], x["flags"], deploy)
