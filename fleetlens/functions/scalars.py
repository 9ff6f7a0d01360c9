"""Column functions.

All are built from Spark's own expressions, so they stay inside whole-stage
codegen and push no work to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import blank, blank_or, shell_blank_or

# Cloud disk sizing rule and image defaults.
DISK_STEP_GB = 93
STEP_DISK_TYPES = ("network-ssd-nonreplicated", "network-ssd-io-m3")
DEFAULT_IMAGE_FOLDER = "standard-images"
DEFAULT_IMAGE_FAMILY = "ubuntu-2204-lts"
# The two log markers of the cloud CLI (rate limit, then error).
RATE_LIMIT_TEXT = "The limit on maximum number of active operations has exceeded"
ERROR_TEXT = "ERROR:"
# Standard terminal colour / control sequences (CSI ... final letter).
ANSI_PATTERN = "\u001b\\[[0-9;?]*[A-Za-z]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(text) -> Column:
    """Whitespace (space, tab, CR, LF, VT, FF) removed at both ends, as text splitting of
    config files does (``trim`` alone removes spaces only)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def round_disk(size, disk_type) -> Column:
    """#15 ``max(1, size)``; step types go up to a multiple of 93 GB, at least 93."""
    s = F.greatest(F.lit(1), _c(size).cast("int"))
    stepped = F.greatest(F.lit(DISK_STEP_GB), (F.ceil(s / F.lit(DISK_STEP_GB)) * DISK_STEP_GB).cast("int"))
    return F.when(_c(disk_type).isin(*STEP_DISK_TYPES), stepped).otherwise(s).cast("int")


def round_if_sized(size, disk_type) -> Column:
    """Rounding as the resolver applies it: only when type and size are both set (truthy)."""
    t, s = _c(disk_type), _c(size)
    return F.when((blank(t).isNotNull()) & s.isNotNull() & (s != 0), round_disk(s, t)).otherwise(s)


def merge_disk(base: dict[str, Column], over: dict[str, Column]) -> Column:
    """#16 on disks given as field -> Column maps: ``coalesce(over.f, base.f)`` per field."""
    names = list(dict.fromkeys([*base, *over]))
    fields = []
    for n in names:
        o, b = over.get(n), base.get(n)
        if o is not None and b is not None:
            fields.append(F.coalesce(o, b).alias(n))
        else:
            fields.append((o if o is not None else b).alias(n))
    return F.struct(*fields)


def merge_open_maps(base: Column, over: Column) -> Column:
    """#16 for open key sets (map columns): override value unless NULL, keys of both.

    A key that only the override has, with a NULL value, is skipped (it is
    not added), as the merge skips NULL overrides.
    """
    merged = F.map_zip_with(base, over, lambda k, b, o: F.coalesce(o, b))
    return F.map_filter(merged, lambda k, v: v.isNotNull() | F.map_contains_key(base, k))


def image_spec(profile_folder, profile_name, profile_family, deploy_folder, deploy_name, deploy_family) -> Column:
    """#17 folder, then name, else family; profile over deployment over constant; '' is missing."""
    folder = blank_or(_c(profile_folder), _c(deploy_folder), F.lit(DEFAULT_IMAGE_FOLDER))
    name = blank_or(_c(profile_name), _c(deploy_name))
    family = blank_or(_c(profile_family), _c(deploy_family), F.lit(DEFAULT_IMAGE_FAMILY))
    return F.when(
        name.isNotNull(), F.concat(F.lit("image-folder-id="), folder, F.lit(",image-name="), name)
    ).otherwise(F.concat(F.lit("image-folder-id="), folder, F.lit(",image-family="), family))


def zone_region(zone) -> Column:
    """#21 drop the last ``-part``; no dash -> unchanged; empty or NULL -> ''."""
    return F.regexp_replace(F.coalesce(_c(zone), F.lit("")), "-[^-]*$", "")


def internal_fqdn(host, zone) -> Column:
    """#22 ``host.region.internal``, or the plain host when there is no region."""
    region = zone_region(zone)
    return F.when(region != "", F.concat(_c(host), F.lit("."), region, F.lit(".internal"))).otherwise(_c(host))


def host_address(name, ip, zone, strict: bool = False) -> Column:
    """#23 FQDN from the name when set, else the IP; NULL means "no address" (an error row).

    ``strict=True`` takes only the IP (the cluster document needs addresses).
    """
    ip_c = blank(_c(ip))
    if strict:
        return ip_c
    return F.when(blank(_c(name)).isNotNull(), internal_fqdn(_c(name), zone)).otherwise(ip_c)


def pick_ip(interfaces) -> Column:
    """#24 first non-empty address over the interfaces in order; private before NAT; '' if none.

    ``interfaces``: ``array<struct<primary_v4_address: struct<address,
    one_to_one_nat: struct<address>>>>``.
    """
    per_iface = F.transform(
        _c(interfaces),
        lambda ni: F.coalesce(
            blank(ni["primary_v4_address"]["address"]),
            blank(ni["primary_v4_address"]["one_to_one_nat"]["address"]),
        ),
    )
    found = F.filter(per_iface, lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def disk_state(status, instance_ids, present=None) -> Column:
    """#25 missing / deleting / attached / orphan."""
    st = F.when(_c(status) == "DELETING", F.lit("deleting")).when(
        F.coalesce(F.size(_c(instance_ids)), F.lit(0)) > 0, F.lit("attached")
    ).otherwise(F.lit("orphan"))
    if present is not None:
        st = F.when(~_c(present), F.lit("missing")).otherwise(st)
    return st


def op_line_class(line) -> Column:
    """#30 rate limit is tested before error."""
    c = _c(line)
    return (
        F.when(c.contains(RATE_LIMIT_TEXT), F.lit("rate_limited"))
        .when(c.contains(ERROR_TEXT), F.lit("error"))
        .otherwise(F.lit("ok"))
    )


def ansi_clean(line) -> Column:
    """#31 strip all standard terminal control sequences."""
    return F.regexp_replace(_c(line), ANSI_PATTERN, "")


def word_match(line, word: str) -> Column:
    """#31 whole word between spaces or line ends, after cleaning."""
    import re

    return ansi_clean(line).rlike(f"(^|\\s){re.escape(word)}(\\s|$)")


def host_log_name(role, host) -> Column:
    """#32 ``role-host.log`` with ``.``, ``/`` and ``:`` replaced by ``_``."""
    return F.concat(_c(role), F.lit("-"), F.translate(_c(host), "./:", "___"), F.lit(".log"))


def vm_key(role, prefix, idx, name) -> Column:
    """#33 pack a queue entry as ``role:prefix:idx:name``."""
    return F.concat_ws(":", _c(role), _c(prefix), _c(idx).cast("string"), _c(name))


def split_vm_key(key) -> dict[str, Column]:
    """#33 unpack a queue entry; the name itself may not hold ``:``."""
    parts = F.split(_c(key), ":", 4)
    return {
        "role": parts[0],
        "prefix": parts[1],
        "idx": parts[2].cast("int"),
        "name": parts[3],
    }


def name_index(name) -> Column:
    """#33 index = text after the last ``-`` of the name."""
    return F.substring_index(_c(name), "-", -1)


def user_effective(deploy_user, ssh_user) -> Column:
    """#28 deploy user, defaulting to the ssh user ('' and 'null' count as missing)."""
    return shell_blank_or(_c(deploy_user), _c(ssh_user))
