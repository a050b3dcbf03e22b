"""E-mail signals, domain intelligence and breach data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.enrich.common import flagged, more, scored

# Shape of an address and the free providers.
EMAIL_SHAPE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
FREE_PROVIDERS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "protonmail.com",
    "zoho.com", "gmx.com", "yandex.com", "tutanota.com", "fastmail.com",
]

# Disposable domains known without any list.
DISPOSABLE_DOMAINS = [
    "tempmail.com", "throwaway.email", "guerrillamail.com", "mailinator.com", "10minutemail.com", "yopmail.com",
    "trashmail.com", "sharklasers.com", "guerrillamailblock.com", "grr.la", "dispostable.com", "mailnesia.com",
    "tempr.email", "fakeinbox.com", "emailondeck.com", "getnada.com", "temp-mail.org", "mohmal.com", "tempail.com",
    "burnermail.io", "maildrop.cc", "harakirimail.com", "tmail.ws", "tmpmail.net",
]


def email_signals(contacts: DataFrame, disposable: DataFrame) -> DataFrame:
    """Adds the parts of the address, flags, ``email_factors`` and ``email_score``.

    ``contacts`` needs email, known_breaches and registered_social_profiles (-1: unknown);
    ``disposable`` is the one-column domain list, added to the domains known anyway.
    """
    address = F.lower(F.trim("email"))
    valid = F.coalesce(address.rlike(EMAIL_SHAPE), F.lit(False))
    base = (
        contacts.withColumn("email", address).withColumn("valid_format", valid)
        .withColumn("email_domain", F.when(F.col("valid_format"), F.substring_index("email", "@", -1)).otherwise(""))
        .withColumn("email_local", F.when(F.col("valid_format"), F.regexp_replace("email", "@[^@]*$", "")).otherwise(""))
    )
    base = flagged(base, disposable, "email_domain", "listed")
    disposable_now = F.col("valid_format") & (F.col("listed") | F.col("email_domain").isin(DISPOSABLE_DOMAINS))
    base = (
        base.withColumn("is_disposable", disposable_now).drop("listed")
        .withColumn("is_free_provider", F.col("email_domain").isin(FREE_PROVIDERS))
        .withColumn("has_plus_alias", F.contains(F.col("email_local"), F.lit("+")))
        .withColumn("has_dots_trick", (F.col("email_domain") == "gmail.com") & F.contains(F.col("email_local"), F.lit(".")))
    )
    unknown = F.col("registered_social_profiles") == -1
    guessed = F.when(F.col("valid_format") & ~F.col("is_disposable"), F.when(F.col("is_free_provider"), 5).otherwise(3)).otherwise(0)
    base = base.withColumn("social_profiles_estimated", F.when(unknown, guessed).otherwise(F.col("registered_social_profiles")))
    digits = F.length(F.regexp_replace("email_local", r"[^0-9]", ""))
    return scored(
        base,
        [
            ("disposable_email", F.col("is_disposable"), 35),
            ("free_email_provider", F.col("is_free_provider"), 5),
            ("plus_alias_detected", F.col("has_plus_alias"), 10),
            ("BURNER_EMAIL_NO_SOCIAL", (F.col("registered_social_profiles") == 0) & F.col("is_free_provider"), 30),
            ("MASS_COMPROMISED_EMAIL_BREACHES", F.col("known_breaches") >= 10, 25),
            ("COMPROMISED_EMAIL_BREACH", F.col("known_breaches").between(1, 9), 5),
            ("very_short_local_part", F.length("email_local") <= 3, 8),
            ("numeric_heavy_email", digits > F.length("email_local") * 0.6, 10),
        ],
        "email",
        ("invalid_email_format", ~F.col("valid_format"), 40),
    )


def domain_age(domains: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``domain_age_days`` and its band."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = F.floor((micros(as_of) - micros(F.col("created"))) / F.lit(86_400_000_000))
    age = F.when(F.col("created").isNotNull(), F.greatest(days, F.lit(0)))
    aged = domains.withColumn("domain_age_days", age)
    a = F.col("domain_age_days")
    return aged.withColumn(
        "domain_age_risk",
        F.when(a.isNull(), "UNKNOWN").when(a < 30, "VERY_YOUNG").when(a < 180, "YOUNG").when(a < 365, "RECENT").otherwise("ESTABLISHED"),
    )


def domain_policy(records: DataFrame) -> DataFrame:
    """SPF and DMARC policy per domain. ``records``: domain, txt and dmarc_txt (arrays of TXT records)."""
    spf = F.filter(F.transform("txt", lambda r: F.lower(r)), lambda r: r.startswith("v=spf1"))
    dmarc = F.filter(F.transform("dmarc_txt", lambda r: F.lower(r)), lambda r: r.startswith("v=dmarc1"))
    tags = F.flatten(F.transform(dmarc, lambda r: F.transform(F.split(r, ";"), lambda t: F.trim(t))))
    policy = F.get(F.filter(tags, lambda t: t.startswith("p=") & (F.length(t) > 2)), F.lit(0))
    return (
        records.withColumn("spf_strict", F.exists(spf, lambda r: F.contains(r, F.lit("-all"))))
        .withColumn("dmarc_policy", F.substring(policy, 3, 100))
        .withColumn("dmarc_enforced", F.coalesce(F.col("dmarc_policy").isin("quarantine", "reject"), F.lit(False)))
    )


def breaches_by_domain(breaches: DataFrame, shown: int = 5) -> DataFrame:
    """Per domain: number of breaches, accounts exposed, and the first few names."""
    domain = F.lower(F.trim("domain"))
    clean = breaches.withColumn("domain", domain).filter(F.col("domain") != "")
    totals = clean.groupBy("domain").agg(
        F.count("*").alias("breach_count"), F.sum(F.coalesce("pwn_count", F.lit(0))).alias("total_accounts_exposed")
    )
    from fraudspark.operators.skew import first_n
    first = first_n(clean, ["domain"], [F.col("breach_date"), F.col("name")], shown)
    names = first.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("l")).select(
        "domain", F.transform("l", lambda x: x["name"]).alias("breaches")
    )
    return totals.join(names, "domain")


def email_follow_ups(signals: DataFrame, domains: DataFrame, footprints: DataFrame, breaches: DataFrame) -> DataFrame:
    """Second pass over e-mail signals with domain, footprint and breach tables.

    ``domains``: domain, domain_age_days, domain_age_risk, valid_mx. ``footprints``: entity_id,
    platforms_registered, platforms_checked, rate_limited. ``breaches``: as ``breaches_by_domain``.
    """
    joined = (
        signals.join(domains.withColumnRenamed("domain", "email_domain"), "email_domain", "left")
        .join(footprints, "entity_id", "left")
        .join(breaches.select(F.col("domain").alias("email_domain"), "breach_count", "total_accounts_exposed"), "email_domain", "left")
    )
    ok = F.col("valid_format")
    absent = (F.col("platforms_checked") - F.col("rate_limited") >= 7) & (F.col("platforms_registered") == 0)
    established = (F.col("domain_age_risk") == "ESTABLISHED") | (F.coalesce("domain_age_days", F.lit(0)) >= 3650)
    return more(
        joined,
        [
            ("very_young_domain", ok & (F.col("domain_age_risk") == "VERY_YOUNG"), 20),
            ("young_domain", ok & (F.col("domain_age_risk") == "YOUNG"), 10),
            ("no_mx_records", ok & (F.col("valid_mx") == F.lit(False)), 15),
            ("no_social_footprint", ok & absent & ~F.coalesce(established, F.lit(False)), 10),
            ("domain_in_known_breach", ok & (F.col("breach_count") >= 1), 0),
            ("domain_in_multiple_breaches", ok & (F.col("breach_count") >= 3), 5),
        ],
        "email",
    )


def password_breaches(passwords: DataFrame, hashes: DataFrame) -> DataFrame:
    """Exposure count per password by its SHA-1: bucket of five hex characters, then the rest.

    ``passwords``: id, password. ``hashes``: prefix, suffix, seen. The clear text does not leave this step.
    """
    digest = F.upper(F.sha1("password"))
    keyed = passwords.select("id", F.substring(digest, 1, 5).alias("prefix"), F.substring(digest, 6, 35).alias("suffix"))
    return keyed.join(hashes, ["prefix", "suffix"], "left").select(
        "id", "prefix", F.coalesce("seen", F.lit(0)).alias("exposures"), F.col("seen").isNotNull().alias("is_pwned")
    )
