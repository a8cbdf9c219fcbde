"""Country and region by the longest network that holds an address, IPv4 and IPv6 alike.

An address is its family and its bits as text (`4` and 32 digits, or `6` and 128), a network the beginning of that. So
"lies in" is "begins with", and the networks that may hold an address are its prefixes of the lengths that the table
has: one equality join, of which the longest match counts. IPv4 addresses written as IPv6 (`::ffff:1.2.3.4`) are IPv4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.values import once

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DOTTED = rf"{OCTET}(?:\.{OCTET}){{3}}"
#: Networks of at most so many bits are broadcast: there are no more than 2^(SHORT + 1) of them in each family.
SHORT = 16
MAPPED = "6" + "0" * 80 + "1" * 16


def _numbers(dotted: Column) -> Column:
    return F.transform(F.split(dotted, r"\."), lambda x: x.cast("int"))


def _groups(side: Column) -> Column:
    return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: (side != "") & side.isNotNull())


def _four(text: Column) -> Column:
    return F.concat(F.lit("4"), F.array_join(F.transform(_numbers(text), lambda x: F.lpad(F.bin(x), 8, "0")), ""))


def _undotted(text: Column) -> Column:
    """An address of which the last two groups may be dotted, in groups of hexadecimal digits only."""

    def last(tail: Column) -> Column:
        pairs = once(_numbers(tail), lambda n: F.concat_ws(":", F.hex(n[0] * 256 + n[1]), F.hex(n[2] * 256 + n[3])))
        return F.when(tail == "", text).otherwise(F.concat(F.left(text, F.length(text) - F.length(tail)), F.lower(pairs)))

    return once(F.regexp_extract(text, f"^.*:({DOTTED})$", 1), last)


def _six(text: Column) -> Column:
    """Eight groups of hexadecimal digits, of which one run of zeros may be `::`; null for anything else."""

    def whole(p: Column) -> Column:
        missing = F.lit(8) - F.size(p.left) - F.size(p.right)
        right_size = F.when(p.sides == 2, missing > 0).otherwise((p.sides == 1) & (missing == 0))
        every = F.concat(p.left, F.array_repeat(F.lit("0"), missing), p.right)
        return F.when(right_size, every)

    def parts(sides: Column) -> Column:
        return F.struct(F.size(sides).alias("sides"), _groups(F.get(sides, F.lit(0))).alias("left"), _groups(F.get(sides, F.lit(1))).alias("right"))

    def digits(groups: Column) -> Column:
        bits = F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
        return F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.concat(F.lit("6"), bits))

    return once(once(once(F.split(_undotted(text), "::"), parts), whole), digits)


def address_bits(address: Column) -> Column:
    """Family and bits of an address as text; null for what is no address. A zone (`%eth0`) is no part of it."""
    plain = F.lower(F.trim(F.substring_index(address, "%", 1)))
    bits = once(plain, lambda text: F.when(text.rlike(f"^{DOTTED}$"), _four(text)).when(text.contains(":"), _six(text)))
    return once(bits, lambda b: F.when(b.startswith(MAPPED), F.concat(F.lit("4"), F.substring(b, len(MAPPED) + 1, 32))).otherwise(b))


def network_bits(network: Column) -> Column:
    """Family and leading bits of `address/length`, or of a single address; null for what is no network."""

    def cut(n: Column) -> Column:
        as_six = n.bits.startswith("4") & n.said[0].contains(":")
        length = F.get(n.said, F.lit(1)).try_cast("int") - F.when(as_six, 96).otherwise(0)
        return F.when(F.size(n.said) == 1, n.bits).when((F.size(n.said) == 2) & length.between(0, F.length(n.bits) - 1), F.left(n.bits, length + 1))

    return once(F.struct(F.split(network, "/").alias("said"), address_bits(F.substring_index(network, "/", 1)).alias("bits")), cut)


def locate(hits: DataFrame, networks: DataFrame) -> DataFrame:
    """The hits with country_code and region of their address; both empty where nothing is known.

    networks: (network, country, region, registered). They may nest and overlap; the longest one that holds an address
    decides alone, so one without a country hides those around it. A missing country is the one of registration. Of
    rows for the same network the first by country, registration and region counts; malformed networks and addresses
    match nothing. Columns of these two names that the hits have are replaced.
    """
    place = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("country", "registered", "region")))
    known = networks.select(network_bits(F.col("network")).alias("_net"), place.alias("_place")).where("_net is not null").groupBy("_net").agg(F.min("_place").alias("_place"))
    # at most 33 + 129 rows
    present = {(r[0], r[1]) for r in known.select(F.left("_net", F.lit(1)), F.length("_net") - 1).distinct().collect()}
    asked = hits.select("address").distinct().select("address", address_bits(F.col("address")).alias("_bits")).where("_bits is not null")

    def matches(short: bool) -> DataFrame:
        of = {f: [F.left("_bits", F.lit(n + 1)) for g, n in sorted(present) if g == f and (n <= SHORT) == short] for f in "46"}
        none = F.array().cast("array<string>")
        prefixes = F.when(F.col("_bits").startswith("4"), F.array(*of["4"]) if of["4"] else none).otherwise(F.array(*of["6"]) if of["6"] else none)
        nets = known.where((F.length("_net") <= SHORT + 1) if short else (F.length("_net") > SHORT + 1))
        return asked.select("address", F.explode(prefixes).alias("_net")).join(F.broadcast(nets) if short else nets, "_net")

    found = matches(True).unionByName(matches(False)).groupBy("address").agg(F.max_by("_place", F.length("_net")).alias("_place"))
    country = F.coalesce(F.nullif(F.col("_place.country"), F.lit("")), F.col("_place.registered"), F.lit(""))
    region = F.when(country != "", F.col("_place.region")).otherwise("")
    own = [c for c in hits.columns if c not in ("country_code", "region")]
    return hits.select(*own).join(found, "address", "left").select(*own, country.alias("country_code"), region.alias("region"))
