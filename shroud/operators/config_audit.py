"""Configuration audit over a fleet of settings.

Each row is one setting of one host from one source. Validation never coerces
a bad value into a default; an untrusted project file may only tighten; the
effective value layers env over file over default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.regex import JS_SPACE

ENUMS = {k: (vals, d) for k, vals, d in seeds.CONFIG_ENUMS}
SPLIT = f"[,{JS_SPACE}]+"


def trim(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def validate(cfg: DataFrame) -> DataFrame:
    """Adds valid (BOOLEAN), value (normalized text) and reason (one line per
    remark; NULL when valid without remark or silently ignored, as an empty
    environment value is)."""
    key, src = F.col("key"), F.col("source")
    var = F.try_parse_json(F.col("value_json"))
    jt = F.schema_of_variant(var)
    sval = F.when(jt == "STRING", F.try_variant_get(var, "$", "string"))
    is_env = src == "env"
    raw = sval
    js = F.col("value_json")
    elems = F.when(jt.startswith("ARRAY"), var.cast("array<variant>"))
    str_elems = F.transform(F.filter(elems, lambda e: F.schema_of_variant(e) == "STRING"),
                            lambda e: F.try_variant_get(e, "$", "string"))

    valid = F.lit(False)
    value = F.lit(None).cast("string")
    reason = F.lit(None).cast("string")

    def case(cond, ok, val, why):
        nonlocal valid, value, reason
        valid = F.when(cond, ok).otherwise(valid)
        value = F.when(cond, F.when(ok, val)).otherwise(value)
        reason = F.when(cond, why).otherwise(reason)

    for k, (allowed, _) in reversed(list(ENUMS.items())):
        lst = seeds.CONFIG_ENUM_SHOWN[k]
        env_v = F.lower(trim(raw))
        json_ok = F.coalesce(F.lower(sval).isin(*allowed), F.lit(False))
        env_ok = F.coalesce(env_v.isin(*allowed), F.lit(False))
        case((key == k) & ~is_env, json_ok, F.lower(sval),
             F.when(~json_ok, F.concat(F.lit(f"config.{k}="), js, F.lit(f" is not one of {lst} — ignoring."))))
        case((key == k) & is_env, env_ok, env_v,
             F.when(~env_ok, F.concat(F.lit(f'{k}="'), raw, F.lit(f'" is not one of {lst} — ignoring, using the default.'))))
    for k in reversed(seeds.CONFIG_BOOLS):
        env_v = F.lower(trim(raw))
        env_ok = env_v.isin(*seeds.BOOL_TRUE, *seeds.BOOL_FALSE)
        case((key == k) & ~is_env, jt == "BOOLEAN", F.lower(js),
             F.when(jt != "BOOLEAN", F.concat(F.lit(f"config.{k}="), js, F.lit(" is not a boolean — ignoring."))))
        case((key == k) & is_env, env_ok, F.when(env_v.isin(*seeds.BOOL_TRUE), "true").otherwise("false"),
             F.when(~env_ok, F.concat(F.lit(f'{k}="'), raw, F.lit('" is not a boolean (true/false) — ignoring, using the default.'))))
    # piiAllow
    kept = F.transform(F.filter(str_elems, lambda s: trim(s) != ""), lambda s: trim(s))
    env_list = F.filter(F.transform(F.split(raw, SPLIT, -1), lambda s: trim(s)), lambda s: s != "")
    case((key == "piiAllow") & ~is_env, F.coalesce(F.size(kept) > 0, F.lit(False)), F.array_join(kept, ","),
         F.when(elems.isNull(), F.lit("config.piiAllow is not an array of strings — ignoring."))
         .when(F.size(kept) != F.size(elems), F.lit("config.piiAllow has non-string/empty entries — dropping them.")))
    case((key == "piiAllow") & is_env, F.size(env_list) > 0, F.array_join(env_list, ","),
         F.when(F.size(env_list) == 0, F.concat(F.lit('piiAllow="'), raw, F.lit('" has no entries — ignoring it.'))))
    # badgeSinks
    sinks = F.filter(str_elems, lambda s: s.isin(*seeds.BADGE_SINKS))
    env_parts = F.filter(F.transform(F.split(raw, SPLIT, -1), lambda s: F.lower(trim(s))), lambda s: s != "")
    env_sinks = F.filter(env_parts, lambda s: s.isin(*seeds.BADGE_SINKS))
    sink_list = "|".join(seeds.BADGE_SINKS)
    case((key == "badgeSinks") & ~is_env, F.coalesce(F.size(sinks) > 0, F.lit(False)), F.array_join(sinks, ","),
         F.when(elems.isNull(), F.lit("config.badgeSinks is not an array — ignoring."))
         .when(F.size(sinks) == 0, F.lit(f"config.badgeSinks has no valid sinks ({sink_list}) — using the default chain.")))
    bad_sinks = F.transform(F.filter(env_parts, lambda s: ~s.isin(*seeds.BADGE_SINKS)),
                            lambda s: F.concat(F.lit('badgeSinks: "'), s, F.lit(f'" is not a badge sink ({sink_list}) — dropping it.')))
    no_sink = F.when(F.size(env_sinks) == 0, F.array(F.concat(F.lit('badgeSinks="'), raw, F.lit('" has no valid sinks — using the default chain.'))))
    remarks = F.array_join(F.concat(bad_sinks, F.coalesce(no_sink, F.array().cast("array<string>"))), "\n")
    case((key == "badgeSinks") & is_env, F.size(env_sinks) > 0, F.array_join(env_sinks, ","), F.when(remarks != "", remarks))
    for k in reversed(seeds.CONFIG_STRINGS):
        t = trim(sval)
        ok = F.coalesce(t != "", F.lit(False))
        case((key == k) & ~is_env, ok, t,
             F.when(~ok, F.concat(F.lit(f"config.{k}="), js, F.lit(" is not a non-empty string — ignoring."))))
        case((key == k) & is_env, ok, t, F.lit(None).cast("string"))
    for k in reversed(seeds.CODE_ONLY_OPTIONS):
        case((key == k) & ~is_env, F.lit(False), F.lit(None),
             F.lit(f"config.{k} is a code-only option and can't be set from JSON — it can only be passed in code."))
    case(is_env & (raw == ""), F.lit(False), F.lit(None), F.lit(None).cast("string"))
    return cfg.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("value", value).withColumn("reason", reason)


def floor(v: DataFrame) -> DataFrame:
    """On untrusted project rows, weakening settings are dropped and named."""
    key, val = F.col("key"), F.col("value")
    rank = F.lit(None).cast("int")
    floor_rank = F.lit(None).cast("int")
    for k, (allowed, d) in ENUMS.items():
        m = F.create_map(*[x for i, a in enumerate(allowed) for x in (F.lit(a), F.lit(i))])
        rank = F.when(key == k, F.coalesce(m[val], F.lit(0))).otherwise(rank)
        floor_rank = F.when(key == k, F.lit(allowed.index(d))).otherwise(floor_rank)
    default = F.create_map(*[x for k, (_, d) in ENUMS.items() for x in (F.lit(k), F.lit(d))])[key]
    weaker_enum = rank < floor_rank
    weaker_bool = key.isin(*seeds.PROTECTIVE_WHEN_TRUE) & (val == "false")
    why = F.create_map(*[x for k, w in seeds.PROJECT_MAY_NOT_SET for x in (F.lit(k), F.lit(w))])[key]
    json_val = F.when(key.isin(*ENUMS), F.concat(F.lit('"'), val, F.lit('"'))).otherwise(val)
    weak_msg = lambda fl: F.concat(F.lit("project-local config sets "), key, F.lit("="), json_val,
                                   F.lit(", which is WEAKER than the built-in default ("), fl,
                                   F.lit(") — ignoring it. A project you open must not be able to turn off your privacy guards."))
    violation = (F.when(F.coalesce(weaker_enum, F.lit(False)), weak_msg(F.concat(F.lit('"'), default, F.lit('"'))))
                 .when(weaker_bool, weak_msg(F.lit("true")))
                 .when(why.isNotNull(), F.concat(F.lit("project-local config sets "), key, F.lit(" — ignoring it, since "),
                                                 why, F.lit("."))))
    return v.withColumn("violation", violation).withColumn("kept", violation.isNull())


def effective(v: DataFrame) -> DataFrame:
    """Per (host, key): env over the file layer over the default. The file
    layer is the explicit file when a host has one, valid or not, else the
    project file (floored unless trust was resolved). Of several settings of
    one key the layer decides, then trusted before untrusted project file, then
    the least value."""
    fl = floor(v.where("valid"))
    hosts_with_file = v.where("source = 'file'").select("host").distinct().withColumn("has_file", F.lit(True))
    cand = (fl.join(hosts_with_file, "host", "left")
            .where((F.col("source") == "env") | (F.col("source") == "file") | (F.col("source") == "project_trusted")
                   | ((F.col("source") == "project") & F.col("kept")))
            .where(~((F.col("source").startswith("project")) & F.coalesce(F.col("has_file"), F.lit(False))))
            .withColumn("prio", F.when(F.col("source") == "env", 0).when(F.col("source") == "project", 2).otherwise(1)))
    w = Window.partitionBy("host", "key").orderBy("prio", "value", "value_json")
    chosen = cand.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("host", "key", "value", "source")
    keys = F.array(*[F.lit(k) for k, _ in seeds.CONFIG_DEFAULTS])
    hosts = v.select("host").distinct().select("host", F.explode(keys).alias("key"))
    dflt = F.create_map(*[x for k, d in seeds.CONFIG_DEFAULTS for x in (F.lit(k), F.lit(d))])
    return (hosts.join(chosen, ["host", "key"], "left")
            .select("host", "key", F.coalesce("value", dflt[F.col("key")]).alias("value"),
                    F.coalesce("source", F.lit("default")).alias("source")))
