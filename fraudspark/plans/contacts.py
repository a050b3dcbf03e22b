"""Enrichment of e-mail, IP, phone, card and device data."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.functions.net import PRIVATE_BLOCKS
from fraudspark.operators.enrich import card, combine, device, email, ip, phone
from fraudspark.plans.payments import AUDIT_SQL, audit_time
from fraudspark.plans.registry import query


def _factors(df, prefix):
    return F.coalesce(F.array_join(f"{prefix}_factors", ","), F.lit("")).alias("factors")


def _join_sql(parts):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in parts) + "], lambda x: x IS NOT NULL), ',')"


def _sum_sql(parts):
    return "least(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, c, p in parts) + ", 100)"


LISTS = "lists AS (SELECT DISTINCT kind, lower(trim(line)) AS value FROM {reflist_lines} WHERE trim(line) <> '' AND NOT starts_with(lower(trim(line)), '#'))"
FREE = ", ".join(f"'{d}'" for d in email.FREE_PROVIDERS)
KNOWN = ", ".join(f"'{d}'" for d in email.DISPOSABLE_DOMAINS)
E0 = """e0 AS (SELECT *, regexp_matches(address, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS ok FROM (SELECT *, lower(trim(email)) AS address FROM {contacts}) c)"""
E1 = f"""e1 AS (SELECT e0.*, CASE WHEN ok THEN split_part(address, '@', -1) ELSE '' END AS domain, CASE WHEN ok THEN regexp_replace(address, '@[^@]*$', '') ELSE '' END AS local FROM e0)"""
E2 = f"""e2 AS (SELECT *, ok AND (domain IN (SELECT value FROM lists WHERE kind = 'disposable') OR domain IN ({KNOWN})) AS is_disposable, domain IN ({FREE}) AS is_free,
   length(regexp_replace(local, '[^0-9]', '', 'g')) AS digits FROM e1)"""
EMAIL_PARTS = [
    ("disposable_email", "is_disposable", 35), ("free_email_provider", "is_free", 5), ("plus_alias_detected", "contains(local, '+')", 10),
    ("BURNER_EMAIL_NO_SOCIAL", "registered_social_profiles = 0 AND is_free", 30), ("MASS_COMPROMISED_EMAIL_BREACHES", "known_breaches >= 10", 25),
    ("COMPROMISED_EMAIL_BREACH", "known_breaches BETWEEN 1 AND 9", 5), ("very_short_local_part", "length(local) <= 3", 8), ("numeric_heavy_email", "digits > length(local) * 0.6", 10),
]
E3 = f"e3 AS (SELECT *, CASE WHEN ok THEN {_sum_sql(EMAIL_PARTS)} ELSE 40 END AS email_score, CASE WHEN ok THEN {_join_sql(EMAIL_PARTS)} ELSE 'invalid_email_format' END AS factors FROM e2)"
EMAIL = (LISTS, E0, E1, E2, E3)


def _lists(t):
    return ip.clean_list(t.reflist_lines)


def _emails(t):
    return email.email_signals(t.contacts, ip.clean_list(t.reflist_lines, "disposable"))


@query("src_reflist", "SELECT kind, value FROM lists", LISTS)
def _(t):
    return _lists(t)


@query("email_signals", """SELECT entity_id, address AS email, ok AS valid_format, domain AS email_domain, is_disposable, is_free AS is_free_provider,
   domain = 'gmail.com' AND contains(local, '.') AS has_dots_trick,
   CAST(CASE WHEN registered_social_profiles = -1 THEN CASE WHEN ok AND NOT is_disposable THEN CASE WHEN is_free THEN 5 ELSE 3 END ELSE 0 END ELSE registered_social_profiles END AS INTEGER) AS social_profiles_estimated,
   email_score, factors FROM e3""", *EMAIL)
def _(t):
    signals = _emails(t)
    return signals.select(
        "entity_id", "email", "valid_format", "email_domain", "is_disposable", "is_free_provider", "has_dots_trick", "social_profiles_estimated",
        "email_score", _factors(signals, "email"),
    )


AGE = f"""ages AS (SELECT *, CASE WHEN created IS NOT NULL THEN greatest(CAST(floor((epoch_us({AUDIT_SQL}) - epoch_us(created)) / 86400000000) AS BIGINT), 0) END AS age FROM {{domains}})"""
BAND = "CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age < 30 THEN 'VERY_YOUNG' WHEN age < 180 THEN 'YOUNG' WHEN age < 365 THEN 'RECENT' ELSE 'ESTABLISHED' END"


@query("domain_age", f"SELECT domain, coalesce(age, -1) AS domain_age_days, {BAND} AS domain_age_risk FROM ages", AGE)
def _(t):
    return email.domain_age(t.domains, audit_time()).select(
        "domain", F.coalesce("domain_age_days", F.lit(-1)).alias("domain_age_days"), "domain_age_risk"
    )


@query("domain_policy", """SELECT domain, lower(txt) LIKE 'v=spf1%' AND contains(lower(txt), '-all') AS spf_strict, p AS dmarc_policy, p IN ('quarantine', 'reject') AS dmarc_enforced
   FROM (SELECT *, CASE WHEN lower(dmarc_txt) LIKE 'v=dmarc1%' THEN coalesce(list_extract(list_filter(list_transform(string_split(lower(dmarc_txt), ';'), lambda x: trim(x)), lambda x: starts_with(x, 'p=')), 1)[3:], '') ELSE '' END AS p FROM {domains}) d""")
def _(t):
    records = t.domains.select("domain", F.array("txt").alias("txt"), F.array("dmarc_txt").alias("dmarc_txt"))
    return email.domain_policy(records).select("domain", "spf_strict", F.coalesce("dmarc_policy", F.lit("")).alias("dmarc_policy"), "dmarc_enforced")


BREACH = """br AS (SELECT d AS domain, count(*) AS breach_count, CAST(sum(pwn_count) AS BIGINT) AS total_accounts_exposed, string_agg(name, ',' ORDER BY breach_date, name) FILTER (WHERE rn <= 5) AS breaches
   FROM (SELECT *, lower(trim(domain)) AS d, row_number() OVER (PARTITION BY lower(trim(domain)) ORDER BY breach_date, name) AS rn FROM {breaches}) b GROUP BY d)"""


@query("breach_domain", "SELECT domain, breach_count, total_accounts_exposed, breaches FROM br", BREACH)
def _(t):
    return email.breaches_by_domain(t.breaches).withColumn("breaches", F.array_join("breaches", ","))


FOLLOW = [
    ("very_young_domain", "ok AND risk = 'VERY_YOUNG'", 20), ("young_domain", "ok AND risk = 'YOUNG'", 10), ("no_mx_records", "ok AND valid_mx = FALSE", 15),
    ("no_social_footprint", "ok AND platforms_checked - rate_limited >= 7 AND platforms_registered = 0 AND NOT coalesce(risk = 'ESTABLISHED', FALSE)", 10),
    ("domain_in_known_breach", "ok AND breach_count >= 1", 0), ("domain_in_multiple_breaches", "ok AND breach_count >= 3", 5),
]


@query("email_enrich", f"""SELECT entity_id, least(email_score + {_sum_sql(FOLLOW)}, 100) AS email_score, CASE WHEN {_join_sql(FOLLOW)} = '' THEN factors WHEN factors = '' THEN {_join_sql(FOLLOW)} ELSE factors || ',' || {_join_sql(FOLLOW)} END AS factors
   FROM e3 LEFT JOIN (SELECT domain, valid_mx, {BAND} AS risk FROM ages) a USING (domain) LEFT JOIN {{footprints}} f USING (entity_id) LEFT JOIN br USING (domain)""", *EMAIL, AGE, BREACH)
def _(t):
    domains = email.domain_age(t.domains, audit_time()).select("domain", "domain_age_days", "domain_age_risk", "valid_mx")
    done = email.email_follow_ups(_emails(t), domains, t.footprints, email.breaches_by_domain(t.breaches))
    return done.select("entity_id", "email_score", _factors(done, "email"))


# --- IP --------------------------------------------------------------------------------------

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NUMBER = "CASE WHEN regexp_matches({0}, '^" + OCTET + "(\\." + OCTET + "){{3}}$') THEN CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT) END"
IPS = "ips AS (SELECT DISTINCT ip_address, " + NUMBER.format("ip_address") + " AS number FROM {contacts})"
NETS = "nets AS (SELECT kind, value, CAST(split_part(value, '/', 2) AS INTEGER) AS bits, " + NUMBER.format("split_part(value, '/', 1)") + " AS base FROM lists WHERE kind IN ('vpn', 'datacentre'))"
IN_NET = "in_net AS (SELECT ip_address, kind, max(bits) AS prefix_length FROM ips JOIN nets ON number // CAST(pow(2, 32 - bits) AS BIGINT) = base // CAST(pow(2, 32 - bits) AS BIGINT) GROUP BY ALL)"
IP_FLAGS = """ip_flags AS (SELECT ip_address, number, ip_address IN (SELECT ip_address FROM in_net WHERE kind = 'vpn') AS is_vpn, ip_address IN (SELECT ip_address FROM in_net WHERE kind = 'datacentre') AS is_dc,
   ip_address IN (SELECT value FROM lists WHERE kind = 'tor') AS is_tor FROM ips)"""
NETWORK = (LISTS, IPS, NETS, IN_NET, IP_FLAGS)


@query("ip_cidr", "SELECT ip_address, kind, prefix_length FROM in_net", *NETWORK)
def _(t):
    return ip.longest_network(t.contacts.select("ip_address"), _lists(t).filter(F.col("kind").isin("vpn", "datacentre")))


@query("ip_lists", "SELECT ip_address, is_vpn, is_dc AS is_datacentre_network, is_tor AS is_tor_exit FROM ip_flags", *NETWORK)
def _(t):
    return ip.network_flags(t.contacts.select("ip_address"), _lists(t))


def _block_sql(cidr):
    base, bits = cidr.split("/")
    first = 0
    for part in base.split("."):
        first = first * 256 + int(part)
    return f"number BETWEEN {first} AND {first + 2 ** (32 - int(bits)) - 1}"


CLOUD = " OR ".join(f"starts_with(f.ip_address, '{p}')" for p in ip.DATACENTRE_PREFIXES)
IP_PARTS = [
    ("private_or_loopback_ip", "private", 15), ("datacenter_ip_detected", "cloud", 25), ("ipv6_address", "version = 6", 5),
    ("vpn_cidr_match", "is_vpn AND NOT cloud", 25), ("datacenter_cidr_match", "is_dc AND NOT cloud", 25), ("tor_exit_node", "is_tor", 40),
]
IP_SCORE = f"""ip_score AS (SELECT *, CAST(CASE WHEN version = 0 THEN 30 ELSE {_sum_sql(IP_PARTS)} END AS INTEGER) AS ip_score, CASE WHEN version = 0 THEN 'invalid_ip_address' ELSE {_join_sql(IP_PARTS)} END AS factors
  FROM (SELECT c.entity_id, f.*, CASE WHEN number IS NOT NULL THEN 4 WHEN contains(f.ip_address, ':') THEN 6 ELSE 0 END AS version, contains(f.ip_address, ':') OR {' OR '.join(_block_sql(b) for b in PRIVATE_BLOCKS)} AS private,
     {CLOUD} AS cloud FROM {{contacts}} c JOIN ip_flags f ON c.ip_address = f.ip_address) x)"""


@query("ip_signals", "SELECT entity_id, ip_address, version AS ip_version, ip_score, factors FROM ip_score", *NETWORK, IP_SCORE)
def _(t):
    signals = ip.ip_signals(t.contacts, _lists(t))
    return signals.select("entity_id", "ip_address", "ip_version", "ip_score", _factors(signals, "ip"))


# --- phone and card --------------------------------------------------------------------------

PHONE_PARTS = [
    ("voip_number_detected", "regexp_matches(cleaned, '^(1900|1800|1888|1877|1866)')", 20),
    ("premium_rate_number", "regexp_matches(cleaned, '^(190|0900)')", 15),
]
PHONES = f"phones AS (SELECT *, CASE WHEN length(cleaned) BETWEEN 7 AND 15 THEN {_sum_sql(PHONE_PARTS)} ELSE 25 END AS phone_score, CASE WHEN length(cleaned) BETWEEN 7 AND 15 THEN {_join_sql(PHONE_PARTS)} ELSE 'invalid_phone_length' END AS factors FROM (SELECT *, regexp_replace(phone, '[^0-9+]', '', 'g') AS cleaned FROM {{contacts}}) c)"


@query("phone_signals", "SELECT entity_id, cleaned AS phone_cleaned, phone_score, factors FROM phones", PHONES)
def _(t):
    signals = phone.phone_signals(t.contacts)
    return signals.select("entity_id", "phone_cleaned", "phone_score", _factors(signals, "phone"))


PREFIXES = "prefixes(prefix, scheme) AS (VALUES " + ", ".join(f"('{p}', '{s}')" for s, ps in card.SCHEME_PREFIXES.items() for p in ps) + ")"
BINS = "bins AS (SELECT *, CASE WHEN length(d) >= 6 THEN substr(d, 1, 6) END AS bin6 FROM (SELECT *, regexp_replace(card_bin, '[^0-9]', '', 'g') AS d FROM {contacts}) c)"
SCHEMES = "schemes AS (SELECT entity_id, arg_max(scheme, length(prefix)) AS scheme FROM bins JOIN prefixes ON starts_with(bin6, prefix) GROUP BY entity_id)"
CARD_PARTS = [("prepaid_card", "prepaid", 20), ("card_country_mismatch", "expected_country <> '' AND country_code <> '' AND upper(expected_country) <> upper(country_code)", 25)]
CARDS = f"""card_scores AS (SELECT b.entity_id, coalesce(b.bin6, '') AS bin6, coalesce(scheme, '') AS card_scheme, coalesce(country_code, '') AS country_code, CASE WHEN scheme IS NULL THEN 10 ELSE {_sum_sql(CARD_PARTS)} END AS card_score,
   CASE WHEN scheme IS NULL THEN 'unknown_bin_scheme' ELSE {_join_sql(CARD_PARTS)} END AS factors FROM bins b LEFT JOIN schemes s USING (entity_id) LEFT JOIN {{issuers}} i ON b.bin6 = i.bin6)"""


@query("bin_scheme", "SELECT entity_id, coalesce(bin6, '') AS bin6, coalesce(scheme, '') AS scheme FROM bins LEFT JOIN schemes USING (entity_id)", PREFIXES, BINS, SCHEMES)
def _(t):
    six = card.bin6(F.col("card_bin"))
    return t.contacts.select("entity_id", F.coalesce(six, F.lit("")).alias("bin6"), F.coalesce(card.scheme(six), F.lit("")).alias("scheme"))


@query("bin_risk", "SELECT entity_id, bin6, card_scheme, card_score, factors FROM card_scores", PREFIXES, BINS, SCHEMES, CARDS)
def _(t):
    signals = card.card_signals(t.contacts, t.issuers)
    none = F.lit("")
    return signals.select("entity_id", F.coalesce("bin6", none).alias("bin6"), F.coalesce("card_scheme", none).alias("card_scheme"), "card_score", _factors(signals, "card"))


@query("password_breach", """SELECT entity_id AS id, upper(substr(h, 1, 5)) AS prefix, coalesce(seen, 0) AS exposures, seen IS NOT NULL AS is_pwned FROM (SELECT *, upper(sha1(password)) AS h FROM {contacts}) c
   LEFT JOIN (SELECT upper(sha1('pw-' || s_suppkey)) AS hh, s_suppkey * 10 AS seen FROM {supplier}) p ON p.hh = c.h""")
def _(t):
    digest = F.upper(F.sha1(F.concat(F.lit("pw-"), F.col("s_suppkey").cast("string"))))
    hashes = t.supplier.select(F.substring(digest, 1, 5).alias("prefix"), F.substring(digest, 6, 35).alias("suffix"), (F.col("s_suppkey") * 10).alias("seen"))
    return email.password_breaches(t.contacts.select(F.col("entity_id").alias("id"), "password"), hashes)


# --- combination -----------------------------------------------------------------------------

GEO = """geo AS (SELECT *, CASE WHEN n >= 2 THEN 25 + 10 * (n - 2) + CASE WHEN absent THEN 10 ELSE 0 END ELSE 0 END AS geo_score, CASE WHEN n >= 2 THEN CASE WHEN absent THEN 'geo_mismatch,expected_country_absent' ELSE 'geo_mismatch' END ELSE '' END AS factors
  FROM (SELECT c.entity_id, len(list_distinct(list_filter([upper(ip_country), upper(phone_country), upper(country_code), upper(expected_country)], lambda x: x <> ''))) AS n,
     upper(expected_country) NOT IN (upper(ip_country), upper(phone_country), upper(country_code)) AS absent FROM {contacts} c JOIN {contact_countries} k USING (entity_id) JOIN card_scores s USING (entity_id)) x)"""
GEO_CTES = (PREFIXES, BINS, SCHEMES, CARDS, GEO)


def _geo(t, df):
    placed = df.join(t.contact_countries, "entity_id").withColumn("card_country", F.coalesce("country_code", F.lit("")))
    return combine.geo_check(placed)


@query("geo_mismatch", "SELECT entity_id, CAST(n AS INTEGER) AS n_countries, CAST(geo_score AS INTEGER) AS geo_score, factors FROM geo", *GEO_CTES)
def _(t):
    checked = _geo(t, card.card_signals(t.contacts, t.issuers))
    return checked.select("entity_id", F.size("geo_countries").alias("n_countries"), "geo_score", F.array_join("geo_factors", ",").alias("factors"))


@query("enrich_transaction", """SELECT entity_id, email_score, ip_score, phone_score, card_score, CAST(geo_score AS INTEGER) AS geo_score,
   round_even((email_score + ip_score + phone_score + card_score + geo_score) / (4 + (geo_score > 0)::INT), 1)::DOUBLE AS combined_risk_score
   FROM e3 JOIN ip_score USING (entity_id) JOIN phones USING (entity_id) JOIN card_scores USING (entity_id) JOIN geo USING (entity_id)""", *EMAIL, *NETWORK[1:], IP_SCORE, PHONES, *GEO_CTES)
def _(t):
    signals = card.card_signals(phone.phone_signals(ip.ip_signals(_emails(t), _lists(t))), t.issuers)
    combined = combine.combined_score(_geo(t, signals), ["email_score", "ip_score", "phone_score", "card_score"])
    return combined.select("entity_id", "email_score", "ip_score", "phone_score", "card_score", "geo_score", "combined_risk_score")


@query("latest_enrichment", "SELECT entity_id, enrichment_type, risk_score, created_at FROM {enrichments} QUALIFY row_number() OVER (PARTITION BY entity_id, enrichment_type ORDER BY created_at DESC, id DESC) = 1")
def _(t):
    return combine.latest_enrichments(t.enrichments).select("entity_id", "enrichment_type", "risk_score", "created_at")


@query("entity_enrichments", """SELECT entity_id, count(*) OVER (PARTITION BY entity_id) AS enrichment_count, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS place,
   enrichment_type, risk_score, created_at FROM {enrichments}""")
def _(t):
    found = combine.entity_enrichments(t.enrichments).select("entity_id", "enrichment_count", F.explode("enrichments").alias("e"))
    return found.select("entity_id", "enrichment_count", "e.place", "e.enrichment_type", "e.risk_score", "e.created_at")


# --- devices ---------------------------------------------------------------------------------

HASH = "substr(sha256(canvas_hash || '|' || webgl_hash || '|' || screen_width || 'x' || screen_height || '|' || user_agent || '|' || platform || '|' || language || '|' || timezone_name), 1, 32)"
DEVICE_PARTS = [
    ("headless_browser", "regexp_matches(lower(user_agent), 'headlesschrome|phantomjs|slimerjs|puppeteer')", 35),
    ("headless_webgl", "regexp_matches(lower(webgl_renderer), 'swiftshader|llvmpipe|mesa')", 30), ("webdriver_detected", "webdriver", 40),
    ("low_device_memory", "device_memory <= 1", 15), ("single_core", "hardware_concurrency <= 1", 10), ("low_typing_entropy", "FALSE", 20),
    ("no_mouse_activity", "mouse_movements = 0 AND mouse_entropy = 0", 15),
    ("missing_web_apis", "(NOT local_storage)::INT + (NOT session_storage)::INT + (NOT indexed_db)::INT + (NOT cookies_enabled)::INT >= 2", 10),
    ("no_plugins", "plugins_count = 0 AND NOT pdf_viewer", 8), ("missing_fingerprint_hashes", "canvas_hash = '' AND webgl_hash = ''", 20),
    ("tor_detected", "contains(lower(connection_type), 'tor') OR contains(lower(ip_address), 'tor')", 25),
    ("touch_on_desktop", "touch_support AND max_touch_points > 0 AND NOT regexp_matches(lower(user_agent), 'mobile|android|iphone')", 8),
]
DEVICES = f"dv AS (SELECT *, {HASH} AS device_hash, CAST({_sum_sql(DEVICE_PARTS)} AS DOUBLE) AS risk_score, {_join_sql(DEVICE_PARTS)} AS anomalies FROM {{device}})"
DEVICE_LEVEL = "CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
LINKS = "links AS (SELECT device_hash, count(DISTINCT user_id) AS linked_users, count(*) AS seen_count FROM dv GROUP BY device_hash)"


def _device_rows(t):
    return t.device.withColumn("typing_entropy", F.lit(None).cast("double"))


@query("device_hash", "SELECT event_id, device_hash FROM dv", DEVICES)
def _(t):
    return t.device.select("event_id", device.device_hash().alias("device_hash"))


@query("device_risk", f"SELECT event_id, device_hash, risk_score, {DEVICE_LEVEL} AS risk_level, anomalies FROM dv", DEVICES)
def _(t):
    names = F.array_join(F.transform("anomalies", lambda a: a["type"]), ",")
    return device.device_risk(_device_rows(t)).select("event_id", "device_hash", "risk_score", "risk_level", names.alias("anomalies"))


@query("device_links", "SELECT * FROM links", DEVICES, LINKS)
def _(t):
    return device.device_links(t.device.select("user_id", device.device_hash().alias("device_hash")))


@query("device_switching", "SELECT user_id, n AS unique_devices, CASE WHEN n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MEDIUM' ELSE 'LOW' END AS switching_risk FROM (SELECT user_id, count(DISTINCT device_hash) AS n FROM dv GROUP BY user_id) x", DEVICES)
def _(t):
    return device.device_switching(t.device.select("user_id", device.device_hash().alias("device_hash")))


@query("device_multi_account", f"""SELECT event_id, linked_users, CASE WHEN linked_users > 1 THEN least(linked_users * 15, 40) ELSE 0 END AS multi_account_weight, score AS risk_score,
   CASE WHEN linked_users > 1 AND score >= 75 THEN 'CRITICAL' WHEN linked_users > 1 AND score >= 50 THEN 'HIGH' ELSE {DEVICE_LEVEL} END AS risk_level
   FROM (SELECT *, CASE WHEN linked_users > 1 THEN least(risk_score + linked_users * 15, 100.0)::DOUBLE ELSE risk_score END AS score FROM dv JOIN links USING (device_hash)) x""", DEVICES, LINKS)
def _(t):
    risks = device.device_risk(_device_rows(t))
    return device.multi_account(risks, device.device_links(risks)).select("event_id", "linked_users", "multi_account_weight", "risk_score", "risk_level")


@query("typing_entropy", """SELECT vec_id, round(-sum(p * log2(p)), 3) + 0.0 AS entropy FROM (SELECT vec_id, b, count(*) / any_value(n) AS p FROM (
    SELECT vec_id, n, least(CAST(floor((c - lo) / (hi - lo) * 10) AS INTEGER), 9) AS b FROM (SELECT vec_id, len(typing_cadence_ms) AS n, list_min(typing_cadence_ms)::DOUBLE AS lo, list_max(typing_cadence_ms)::DOUBLE AS hi, unnest(typing_cadence_ms)::DOUBLE AS c FROM {cadences}) x) y
    GROUP BY vec_id, b) z GROUP BY vec_id""")
def _(t):
    return t.cadences.select("vec_id", device.typing_entropy(F.col("typing_cadence_ms")).alias("entropy"))
