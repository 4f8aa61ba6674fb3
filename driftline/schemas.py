"""Schemas of the published tables; writers select in this order, and missing tables are made from it."""

from __future__ import annotations

from pyspark.sql import types as T

DAY = "partition_date"


def _t(text: str) -> T.StructType:
    """``name type, ...`` with plain types, without a session."""
    plain = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}
    out = T.StructType()
    for item in text.split(","):
        name, kind = item.split()
        out = out.add(name, plain[kind])
    return out


MERGED = _t(f"id string, day date, ip string, asn long, label string, site string, rtt double, loss double, throughput double, upload_rtt double, upload_throughput double, ip_version string, {DAY} date")
ANOMALIES = _t(
    "asn long, label string, site string, ip_version string, base_n long, day_n long, base_median double, day_median double, z double, p double, welch_p double, distance double, z_loss double, "
    "base_median_throughput double, day_median_throughput double, p_throughput double, base_median_upload_throughput double, day_median_upload_throughput double, p_upload_throughput double, "
    f"base_lossy_share double, day_lossy_share double, anomaly_rtt int, anomaly_throughput int, anomaly_upload_throughput int, anomaly_loss int, granularity string, {DAY} date"
)
PATHS = _t(f"id string, pair string, anomalous boolean, dayof boolean, ttl long, addr string, name string, rtt double, reach_dest boolean, {DAY} date")
MAPPED = _t(f"id string, pair string, anomalous boolean, dayof boolean, ttl long, addr string, rtt double, asn long, ixp string, lon double, lat double, metro string, hop_km double, path_km double, bound string, {DAY} date")
CULPRITS = _t(f"gran string, entity string, pairs long, purity double, step long, demoted_from string, support long, healthy long, p double, odds double, explained long, share double, {DAY} date")
ENTITIES = _t(f"gran string, entity string, a long, h long, p double, odds double, ratio double, culprit boolean, {DAY} date")
VERDICTS = _t(f"pair string, verdict string, direction string, div_f double, div_r double, changed_segment string, congested_segment string, agrees_with_culprit boolean, {DAY} date")
EVENTS = _t(f"pair string, site string, asn long, label string, location string, edge string, n_dayof long, n_baseline long, rtt_day double, rtt_base double, {DAY} date")
PLACE_METRO = _t("place string, canon string")
TABLES = {
    "merged": MERGED, "anomalies": ANOMALIES, "paths": PATHS, "mapped": MAPPED, "culprits": CULPRITS, "entities": ENTITIES, "verdicts": VERDICTS, "events": EVENTS,
    "place_metro": PLACE_METRO,
}


def create_all(store) -> list[str]:
    """Every table that does not exist yet, in order; running it twice changes nothing."""
    made = [name for name in TABLES if not store.exists(name)]
    for name in made:
        store.create_like(name, TABLES[name])
    return made
