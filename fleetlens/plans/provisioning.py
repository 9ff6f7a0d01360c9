"""The provisioning decisions as one lazy plan: config + listings -> what to do.

desired VMs -> which exist / are new -> disks to create -> what is still
pending -> the inventory lines of the deployment. Nothing here talks to a
cloud; the frames are the decisions a provisioner would act on, for every
deployment at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.inventory import (
    disk_names,
    disks_to_create,
    existing,
    new_vms,
    pending_disks,
    vm_inventory,
    vm_queue,
)
from ..operators.profiles import resolve_profiles, role_lookup
from ..sinks.documents import render_inventory


def provisioning_plan(deploy: DataFrame, profiles: DataFrame, aliases: DataFrame, instances: DataFrame,
                      disks: DataFrame) -> dict[str, DataFrame]:
    """Frames: ``desired``, ``existing``, ``new``, ``new_disks``, ``pending_disks``,
    ``inventory_lines`` and ``inventory_rejects`` (VMs without an address)."""
    raw = role_lookup(profiles, aliases)
    resolved, rejects = resolve_profiles(profiles, deploy, aliases)
    desired = vm_queue(deploy, raw)
    new = new_vms(desired, instances)
    lines, no_address = render_inventory(vm_inventory(desired, instances, deploy), deploy, raw)
    return {
        "desired": desired,
        "existing": existing(instances, desired),
        "new": new,
        "new_disks": disks_to_create(new, resolved, disks),
        "pending_disks": pending_disks(disks, disk_names(desired, resolved)),
        "profile_rejects": rejects,
        "inventory_lines": lines,
        "inventory_rejects": no_address,
    }
