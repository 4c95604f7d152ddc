"""Provider posture: the privacy ladder, capability ranking and evidence grading.

Catalog and ladder are tiny constant tables; they are applied as literal maps
inside projections (equivalent to a broadcast join, with no join at all).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import seeds
from .egress import is_local_url

CATALOG = {p[0]: dict(zip(["id", "label", "tier", "posture_aware", "attestable", "local", "base_url"], p))
           for p in seeds.PROVIDERS}
TIER = {t[0]: dict(zip(["tier", "label", "verifiability", "posture", "rank", "exposure"], t)) for t in seeds.TIERS}
GLYPH = dict(seeds.POSTURE_GLYPH)


def lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def tier_attr(tier: Column, attr: str) -> Column:
    return lit_map({k: v[attr] for k, v in TIER.items()})[tier]


def effective_tier(provider: Column, base_url: Column, zdr_enforced: Column, verified_tee: Column) -> Column:
    """Unknown provider -> standard; local flag or loopback URL -> local;
    openrouter by ZDR enforcement; the proxied TEE provider only with a verified
    signal; else the catalog tier."""
    known = provider.isin(*CATALOG)
    local_flag = lit_map({k: v["local"] for k, v in CATALOG.items()})[provider]
    cat_tier = lit_map({k: v["tier"] for k, v in CATALOG.items()})[provider]
    loop = F.coalesce(F.when(base_url.isNotNull(), is_local_url(base_url)), F.lit(False))
    return (F.when(~known | provider.isNull(), F.lit("standard"))
            .when(local_flag | loop, F.lit("local"))
            .when(provider == "openrouter", F.when(F.coalesce(zdr_enforced, F.lit(False)), "zdr-enforced").otherwise("zdr-policy"))
            .when(provider == "proxied-tee", F.when(F.coalesce(verified_tee, F.lit(False)), "tee-verified").otherwise("zdr-policy"))
            .otherwise(cat_tier))


def capability_tier(provider: Column, base_url: Column, zdr_enforced: Column, verified_tee: Column) -> Column:
    """Loopback first (even for providers the catalog does not know), then P1."""
    loop = F.coalesce(F.when(base_url.isNotNull(), is_local_url(base_url)), F.lit(False))
    return F.when(loop, F.lit("local")).otherwise(effective_tier(provider, base_url, zdr_enforced, verified_tee))


def attestable(provider: Column, verified_tee: Column) -> Column:
    cat = F.coalesce(lit_map({k: v["attestable"] for k, v in CATALOG.items()})[provider], F.lit(False))
    return F.when(provider == "proxied-tee", F.coalesce(verified_tee, F.lit(False))).otherwise(cat)


def capability_badge(tier: Column, is_attestable: Column) -> Column:
    """STRUCT<glyph, label> for the picker (never "Verified" for an unattested TEE)."""
    out = F.struct(F.lit("•").alias("glyph"), F.lit("Standard").alias("label"))
    for t, att, glyph, label in reversed(seeds.CAPABILITY_BADGE):
        cond = (tier == t) if att is None else ((tier == t) & (is_attestable == F.lit(att)))
        out = F.when(cond, F.struct(F.lit(glyph).alias("glyph"), F.lit(label).alias("label"))).otherwise(out)
    return out


def badge(tier: Column) -> Column:
    """Glyph by traffic-light posture plus the tier label; pending marker for unknown."""
    posture = tier_attr(tier, "posture")
    return F.when(tier.isNull(), F.lit(seeds.PENDING_BADGE)).otherwise(
        F.concat(lit_map(GLYPH)[posture], F.lit(" "), tier_attr(tier, "label")))


def tier_from_tee(posture: Column) -> Column:
    return F.when(posture == "green", "tee-verified").when(posture == "yellow", "tee-unverified").otherwise("standard")


ADDRESS_KEY = r'"(?i:signing_address|signingaddress|address)"\s*:\s*"\s*[^"\s]'


def report_grade(raw: Column, nonce: Column) -> Column:
    """P5: STRUCT<has_address, nvidia, intel_tdx, nonce_echoed, posture> of a report body.

    The signing-address search is a match on the serialized report for any key
    named signing_address / signingAddress / address (any case, any depth) holding
    a non-blank string; hardware evidence is a scan of the lower-cased report."""
    blob = F.lower(raw)
    has_addr = F.coalesce(raw.rlike(ADDRESS_KEY), F.lit(False))
    nvidia = blob.contains("nvidia") | blob.contains("gpu")
    intel = blob.contains("intel") | blob.contains("tdx")
    echoed = (F.length(nonce) >= seeds.MIN_NONCE_LEN) & blob.contains(F.lower(nonce))
    hw = F.coalesce(nvidia | intel, F.lit(False))
    echoed = F.coalesce(echoed, F.lit(False))
    posture = (F.when(~has_addr & ~hw, "red").when(has_addr & hw & echoed, "green").otherwise("yellow"))
    return F.struct(has_addr.alias("has_address"), F.coalesce(nvidia, F.lit(False)).alias("nvidia"),
                    F.coalesce(intel, F.lit(False)).alias("intel_tdx"), echoed.alias("nonce_echoed"),
                    posture.alias("posture"))


def _live_bytes(live_key: Column) -> Column:
    """The observed key's bytes. It must be 64 hex characters to count (a non-hex key
    would decode to nothing and match vacuously)."""
    return F.when(live_key.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(live_key))


def body_facts(report: Column, live_key: Column) -> Column:
    """What grading needs of a decoded body: STRUCT<head, size, holds>; NULL without one."""
    holds = F.coalesce(F.position(F.hex(_live_bytes(live_key)), F.hex(report)) % 2 == 1, F.lit(False))
    return F.when(report.isNotNull(), F.struct(F.substring(report, 1, seeds.SEV_REPORT_MIN_BYTES).alias("head"),
                                               F.length(report).cast("bigint").alias("size"), holds.alias("holds")))


def key_grade(fmt: Column, report: Column, live_key: Column) -> Column:
    """P6 of a decoded body (BINARY)."""
    return key_grade_of(fmt, body_facts(report, live_key), live_key)


def key_grade_of(fmt: Column, facts: Column, live_key: Column) -> Column:
    """STRUCT<hardware, attested_key, matched, posture> of a key-pin document."""
    f = F.lower(F.coalesce(fmt, F.lit("")))
    hw = F.filter(F.array(F.when(f.rlike("sev|snp"), F.lit("AMD SEV-SNP")), F.when(f.contains("tdx"), F.lit("Intel TDX")),
                          F.when(f.contains("nitro"), F.lit("AWS Nitro"))), lambda x: x.isNotNull())
    attested = F.when(f.contains("sev-snp-guest") & (facts["size"] >= seeds.SEV_REPORT_MIN_BYTES),
                      F.lower(F.hex(F.substring(facts["head"], seeds.SEV_KEY_OFFSET + 1, seeds.SEV_KEY_END - seeds.SEV_KEY_OFFSET))))
    same = F.coalesce(attested == F.lower(F.hex(_live_bytes(live_key))), F.lit(False))
    matched = same | F.coalesce(facts["holds"], F.lit(False))
    posture = (F.when((F.size(hw) == 0) & attested.isNull(), "red").when((F.size(hw) > 0) & matched, "green")
               .otherwise("yellow"))
    return F.struct(F.array_join(hw, ", ").alias("hardware"), attested.alias("attested_key"), matched.alias("matched"),
                    posture.alias("posture"))


def with_body_facts(df, body: str = "body", live_key: str = "live_key", out: str = "facts"):
    """Key-pin body (base64, gunzipped when the gzip magic leads) as the facts that
    grading needs; a gzipped body is read as a stream, whatever its length.

    Spark evaluates a Python UDF for every row of its input even inside a CASE,
    so gzipped rows are split off by a filter first; only they cross into the
    Arrow-batched UDF, and the two halves are unioned back (no join)."""
    from ..functions.gunzip import gunzip_facts_udf
    d = df.withColumn("_raw", F.unbase64(F.col(body)))
    key = F.col(live_key)
    is_gz = F.coalesce(F.hex(F.substring("_raw", 1, 2)) == "1F8B", F.lit(False))
    gz = d.where(is_gz).withColumn(out, gunzip_facts_udf()(F.col("_raw"), _live_bytes(key)))
    gz = gz.withColumn(out, F.when(F.col(out)["size"].isNotNull(), F.col(out)))
    plain = d.where(~is_gz).withColumn(out, body_facts(F.col("_raw"), key))
    return gz.unionByName(plain).drop("_raw")
