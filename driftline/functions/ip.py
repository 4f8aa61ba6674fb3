"""Addresses and prefixes. IPv4 stays in native expressions; IPv6 text goes through one Arrow function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def version(ip: Column) -> Column:
    return F.when(ip.contains(":"), F.lit("v6")).otherwise(F.lit("v4"))


def parse_v4(ip: Column) -> Column:
    """Dotted quad as a number, null for anything else."""
    quad = F.transform(F.split(ip, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    return F.when(ip.rlike(IPV4), F.aggregate(quad, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def format_v4(n: Column) -> Column:
    byte = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def mask_v4(n: Column, bits: Column) -> Column:
    """Network of an address number: the leading ``bits`` of 32."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - bits).cast("int"))
    return n - F.pmod(n, size)


@F.pandas_udf(T.StructType().add("hi", T.LongType()).add("lo", T.LongType()).add("len", T.IntegerType()))
def parse(ips: pd.Series) -> pd.DataFrame:
    """(hi, lo, bytes) of an address of either family, nulls for garbage."""

    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return (None, None, None)
        n, signed = int(a), lambda v: v - (1 << 64) if v >> 63 else v
        return (signed(n >> 64), signed(n & (1 << 64) - 1), 4 if a.version == 4 else 16)

    return pd.DataFrame([one(x) for x in ips], columns=["hi", "lo", "len"]).astype({"hi": "Int64", "lo": "Int64", "len": "Int32"})


def mask_v6(hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    """Leading ``bits`` of 128 of (hi, lo)."""
    keep = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int")))
    return hi.bitwiseAND(keep(bits)), lo.bitwiseAND(keep(bits - 64))


def prefix_parts(cidr: Column) -> tuple[Column, Column]:
    parts = F.split(cidr, "/")
    return F.get(parts, 0), F.get(parts, 1).try_cast("int")


def hop_suffix(hop_id: Column) -> Column:
    """The address that ends a hop annotation's id, null without one."""
    pattern = r"_([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
    return F.when(hop_id.rlike(pattern), F.regexp_extract(hop_id, pattern, 1))


# Address blocks that count as private, and those of carrier-grade translation.
PRIVATE_V4 = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("100.64.0.0", 10)]
PRIVATE_V6 = [("fc00::", 10), ("fe80::", 10), ("::ffff:0:0", 96), ("2001:db8::", 64)]


def private_v4(n: Column) -> Column:
    hit = F.lit(False)
    for base, bits in PRIVATE_V4:
        hit = hit | (mask_v4(n, F.lit(bits)) == int(ipaddress.ip_address(base)))
    return hit


def private_v6(hi: Column, lo: Column) -> Column:
    hit, signed = F.lit(False), lambda v: v - (1 << 64) if v >> 63 else v
    for base, bits in PRIVATE_V6:
        n = int(ipaddress.ip_address(base))
        h, w = mask_v6(hi, lo, F.lit(bits))
        hit = hit | ((h == signed(n >> 64)) & (w == signed(n & (1 << 64) - 1)))
    return hit
