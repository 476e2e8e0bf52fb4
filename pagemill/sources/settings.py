"""Stored settings as JSON of any version, brought to the present form when they are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The present version; settings of a lower one, or of none, are marked for writing again.
VERSION = 3
#: What settings are where they say nothing.
DEFAULTS = {"mode": "offline", "provider": "openrouter", "preset": "standard"}
SCHEMA = "mode string, settingsSchemaVersion double, user struct<id: string>, byok struct<provider: string, model: string>, processing struct<preset: string, slider: double>"


def migrate(raw: Column, fallback_id: Column, legacy: tuple[str, ...] = ("credits", "plan")) -> Column:
    """A struct of the settings in their present form, and `migrated`, whether they must be written again.

    Any mode but `ai` is `offline`; a version that is no number counts as 0; who has no id gets anon_ and the hash of the
    fallback; keys of old times are not carried over. Null, broken and empty JSON gives the defaults.
    """
    given = F.from_json(raw, SCHEMA)
    stored = F.trim(F.coalesce(raw, F.lit(""))).startswith("{") & given.isNotNull()
    old = lambda *names: F.coalesce(*(F.get_json_object(raw, f"$.{n}").isNotNull() for n in names))
    has_legacy = F.lit(False)
    for name in legacy:
        has_legacy = has_legacy | F.coalesce(old(name), F.lit(False))
    version = F.coalesce(F.when(~F.isnan(given["settingsSchemaVersion"]), given["settingsSchemaVersion"]).cast("int"), F.lit(0))
    mode = F.when(given["mode"] == "ai", "ai").otherwise(DEFAULTS["mode"])
    user = F.when(F.trim(given["user"]["id"]) != "", given["user"]["id"])
    slider = F.least(F.greatest(F.coalesce(given["processing"]["slider"], F.lit(55.0)), F.lit(0.0)), F.lit(100.0))
    changed = ~stored | (version < VERSION) | ~F.coalesce(given["mode"] == mode, F.lit(False)) | user.isNull() | has_legacy | F.coalesce(given["processing"]["slider"] != slider, F.lit(True))
    return F.struct(
        mode.alias("mode"),
        F.lit(VERSION).alias("version"),
        F.coalesce(user, F.concat(F.lit("anon_"), F.substring(F.sha2(fallback_id.cast("string"), 256), 1, 12))).alias("user_id"),
        F.lit(DEFAULTS["provider"]).alias("provider"),
        F.coalesce(given["processing"]["preset"], F.lit(DEFAULTS["preset"])).alias("preset"),
        slider.alias("slider"),
        F.coalesce(changed, F.lit(True)).alias("migrated"),
    )
