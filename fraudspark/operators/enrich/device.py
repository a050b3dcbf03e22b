"""Device fingerprints: hash, anomaly checks, links between devices and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions import bands
from fraudspark.functions.text import let

# Words that give away automated browsers and software renderers.
HEADLESS_AGENTS = ["headlesschrome", "phantomjs", "slimerjs", "puppeteer"]
SOFTWARE_RENDERERS = ["swiftshader", "llvmpipe", "mesa", "google swiftshader"]
MOBILE_WORDS = ["mobile", "android", "iphone"]


def device_hash() -> Column:
    """First 32 hex characters of the SHA-256 of seven stable signals."""
    screen = F.concat(F.col("screen_width").cast("string"), F.lit("x"), F.col("screen_height").cast("string"))
    joined = F.concat_ws("|", "canvas_hash", "webgl_hash", screen, "user_agent", "platform", "language", "timezone_name")
    return F.substring(F.sha2(joined, 256), 1, 32)


def typing_entropy(cadence: Column, bins: int = 10) -> Column:
    """Entropy in bits of the intervals over equal-width bins; 0 for fewer than five or all equal."""
    numbers = F.transform(cadence, lambda c: c.cast("double"))
    measured = F.struct(
        numbers.alias("values"), F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"), F.size(numbers).alias("n")
    )

    def place(m: Column) -> Column:
        spread = m["high"] - m["low"]
        return F.transform(m["values"], lambda c: F.least(F.floor((c - m["low"]) / spread * bins), F.lit(bins - 1)).cast("int"))

    def entropy(places: Column) -> Column:
        def term(b: Column) -> Column:
            share = F.size(F.filter(places, lambda p: p == b)) / F.size(places)
            return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda acc, b: acc + term(b))

    return let(
        measured,
        lambda m: F.when((m["n"] < 5) | (m["low"] == m["high"]), 0.0).otherwise(F.round(let(place(m), entropy), 3)),
    )


def device_risk(devices: DataFrame) -> DataFrame:
    """Adds device_hash, ``anomalies`` (array of type and weight), ``risk_score`` and ``risk_level``.

    ``typing_entropy`` may be given as a column (null where nothing was typed).
    """
    agent, renderer = F.lower("user_agent"), F.lower("webgl_renderer")
    any_of = lambda column, words: column.rlike("|".join(words))
    missing = sum(
        (F.when(F.col(c), 0).otherwise(1) for c in ("local_storage", "session_storage", "indexed_db", "cookies_enabled")), F.lit(0)
    )
    tor = F.contains(F.lower("connection_type"), F.lit("tor")) | F.contains(F.lower("ip_address"), F.lit("tor"))
    touch = F.col("touch_support") & (F.col("max_touch_points") > 0) & ~any_of(agent, MOBILE_WORDS)
    checks = [
        ("headless_browser", any_of(agent, HEADLESS_AGENTS), 35), ("headless_webgl", any_of(renderer, SOFTWARE_RENDERERS), 30),
        ("webdriver_detected", F.col("webdriver"), 40), ("low_device_memory", F.col("device_memory") <= 1, 15),
        ("single_core", F.col("hardware_concurrency") <= 1, 10), ("low_typing_entropy", F.col("typing_entropy") < 1.0, 20),
        ("no_mouse_activity", (F.col("mouse_movements") == 0) & (F.col("mouse_entropy") == 0.0), 15),
        ("missing_web_apis", missing >= 2, 10), ("no_plugins", (F.col("plugins_count") == 0) & ~F.col("pdf_viewer"), 8),
        ("missing_fingerprint_hashes", (F.col("canvas_hash") == "") & (F.col("webgl_hash") == ""), 20),
        ("tor_detected", tor, 25), ("touch_on_desktop", touch, 8),
    ]
    found = F.array_compact(
        F.array(*[
            F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("type"), F.lit(weight).alias("weight")))
            for name, ok, weight in checks
        ])
    )
    points = F.aggregate("anomalies", F.lit(0), lambda acc, a: acc + a["weight"])
    return (
        devices.withColumn("device_hash", device_hash()).withColumn("anomalies", found)
        .withColumn("risk_score", F.least(points, F.lit(100)).cast("double"))
        .withColumn("risk_level", bands.risk_level(F.col("risk_score")))
        .withColumn("is_headless", F.exists("anomalies", lambda a: a["type"].isin("headless_browser", "headless_webgl")))
        .withColumn("is_bot", F.exists("anomalies", lambda a: a["type"].isin("webdriver_detected", "low_typing_entropy")))
        .withColumn("is_emulator", F.exists("anomalies", lambda a: a["type"].isin("low_device_memory", "single_core")))
        .withColumn("is_tor", F.exists("anomalies", lambda a: a["type"] == "tor_detected"))
    )


def device_links(devices: DataFrame) -> DataFrame:
    """Users and sightings per device."""
    return devices.groupBy("device_hash").agg(F.countDistinct("user_id").alias("linked_users"), F.count("*").alias("seen_count"))


def device_switching(devices: DataFrame) -> DataFrame:
    """Devices per user and the risk of switching between them."""
    n = F.col("unique_devices")
    return devices.groupBy("user_id").agg(F.countDistinct("device_hash").alias("unique_devices")).withColumn(
        "switching_risk", F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")
    )


def multi_account(risks: DataFrame, links: DataFrame) -> DataFrame:
    """Raises the score of devices seen with several users: 15 per user, at most 100."""
    users = F.col("linked_users")
    raised = F.least(F.col("risk_score") + users * 15, F.lit(100.0))
    joined = risks.join(links, "device_hash").withColumn("several", users > 1)
    return (
        joined.withColumn("multi_account_weight", F.when(F.col("several"), F.least(users * 15, F.lit(40))).otherwise(0))
        .withColumn("risk_score", F.when(F.col("several"), raised).otherwise(F.col("risk_score")))
        .withColumn(
            "risk_level",
            F.when(F.col("several") & (F.col("risk_score") >= bands.CRITICAL), "CRITICAL")
            .when(F.col("several") & (F.col("risk_score") >= bands.HIGH), "HIGH").otherwise(F.col("risk_level")),
        )
        .drop("several")
    )
