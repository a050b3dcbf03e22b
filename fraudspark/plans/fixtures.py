"""Views that give the given tables the shape of payment data.

Each view is one SELECT in the SQL shared by Spark and DuckDB. ``{name}`` stands for a given table or
another view. ``EPOCH_US[x]`` is microseconds since the epoch, ``MAKE_TS[x]`` the way back.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fraudspark.session import use_utc

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

VIEWS: dict[str, str] = {
    # 30 days of events squeezed into one hour, so that short windows fill.
    "tx": """
        SELECT 'E' || CAST(event_id AS STRING) AS external_id,
               'U' || lpad(CAST(user_id AS STRING), 6, '0') AS sender_id,
               'M' || lpad(CAST(event_id * 7919 % 40 AS STRING), 6, '0') AS receiver_id,
               CAST(CAST(value AS DECIMAL(10,2)) * CAST(value AS DECIMAL(10,2)) AS DECIMAL(18,4)) AS amount,
               'GBP' AS currency,
               'GB' || lpad(CAST(user_id AS STRING), 20, '0') AS sender_iban,
               'GB' || lpad(CAST(event_id * 7919 % 40 AS STRING), 20, '0') AS receiver_iban,
               CASE event_type WHEN 'purchase' THEN 'SEND_MONEY' WHEN 'click' THEN 'TRANSFER'
                    WHEN 'view' THEN 'CARD_PAYMENT' WHEN 'signup' THEN 'ADD_MONEY'
                    ELSE 'WITHDRAWAL' END AS transaction_type,
               'pacs.008' AS iso20022_msg_type,
               CASE WHEN event_id % 97 = 0 THEN 'BLOCKED' WHEN event_id % 89 = 0 THEN 'SUSPENDED'
                    ELSE 'SUCCESS' END AS status,
               MAKE_TS[1704067200000000 + CAST(floor((EPOCH_US[ts] - 1704067200000000) / 720) AS BIGINT)] AS event_time
        FROM {events}""",
    # The same with amounts in whole thousands, so that equal amounts meet.
    "tx_round": """
        SELECT external_id, sender_id, receiver_id,
               CAST(CAST(floor(amount / 1000) AS BIGINT) * 1000 AS DECIMAL(18,4)) AS amount,
               currency, transaction_type, event_time
        FROM {tx}""",
    # The same with the columns a caller of the rolling scorer adds.
    "tx_rich": """
        SELECT t.*, 'acct-' || receiver_id AS receiver_account_id,
               CASE WHEN mod(length(sender_id) + CAST(substr(sender_id, 2) AS BIGINT), 29) = 0
                    THEN 'Suspicious Trading' ELSE 'Plain Person' END AS sender_name,
               'Shop ' || receiver_id AS receiver_name,
               CAST(1000 + CAST(substr(sender_id, 2) AS BIGINT) * 500 AS DOUBLE) AS sender_salary
        FROM {tx} t""",
    # The stream payload: JSON text, with some broken, array-shaped and incomplete records.
    "tx_payload": """
        SELECT CASE WHEN n % 50 = 0 THEN 'broken ' || external_id WHEN n % 53 = 0 THEN '[1, 2]'
                    ELSE chr(123) || '"external_id":"' || external_id || '"'
                         || CASE WHEN n % 59 = 0 THEN '' ELSE ',"sender_id":"' || sender_id || '"' END
                         || ',"receiver_id":"' || receiver_id || '","amount":"'
                         || CASE WHEN n % 61 = 0 THEN 'many' ELSE CAST(amount AS STRING) END
                         || '","currency":"' || currency || '","sender_iban":"' || sender_iban || '","receiver_iban":"' || receiver_iban
                         || '","transaction_type":"' || transaction_type || '","iso20022_msg_type":"' || iso20022_msg_type
                         || '","velocity_count":' || CAST(n % 12 AS STRING) || ',"hour_of_day":"' || CAST(n % 24 AS STRING)
                         || '","entity_risk":"none","ip_risk":' || CAST(n % 100 AS STRING) || '.5,"unknown":1' || chr(125) END AS payload,
               n AS kafka_offset, event_time
        FROM (SELECT *, CAST(substr(external_id, 2) AS BIGINT) AS n FROM {tx}) t""",
    # Unchecked input records with every kind of contract violation.
    "tx_raw": """
        SELECT CASE WHEN event_id % 101 = 0 THEN '' ELSE 'E' || CAST(event_id AS STRING) END AS external_id, event_id,
               CASE WHEN event_id % 103 = 0 THEN NULL ELSE 'U' || lpad(CAST(user_id AS STRING), 6, '0') END AS sender_id,
               CASE WHEN event_id % 107 = 0 THEN lpad('x', 300, 'x') ELSE 'M1' END AS receiver_id,
               CASE WHEN event_id % 19 = 0 THEN '-5' WHEN event_id % 23 = 0 THEN '1.23456' WHEN event_id % 29 = 0 THEN 'abc'
                    ELSE CAST(CAST(value AS DECIMAL(10,2)) AS STRING) END AS amount,
               CASE WHEN event_id % 31 = 0 THEN 'gbp' WHEN event_id % 37 = 0 THEN 'POUND' ELSE 'GBP' END AS currency,
               CASE WHEN event_id % 41 = 0 THEN 'BARTER' ELSE 'TRANSFER' END AS transaction_type,
               CASE WHEN event_id % 43 = 0 THEN lpad('9', 40, '9') ELSE 'GB01' END AS sender_iban,
               CASE WHEN event_id % 2 = 0 THEN chr(123) || '"channel":"app"' || chr(125) ELSE NULL END AS metadata, ts
        FROM {events}""",
    "verifications": """
        SELECT 'acct-M' || lpad(CAST(p_partkey % 40 AS STRING), 6, '0') AS account_id,
               CASE p_partkey % 40 % 13 WHEN 0 THEN 'AC01' WHEN 1 THEN 'ANNM' WHEN 2 THEN 'IVCR' WHEN 3 THEN 'ACNS'
                    WHEN 4 THEN 'MBAM' WHEN 5 THEN 'BAMM' WHEN 6 THEN 'PAMM' WHEN 7 THEN 'OPTO' WHEN 8 THEN 'BANM'
                    WHEN 9 THEN 'CASS' WHEN 10 THEN 'SCNS' WHEN 11 THEN 'ZZZZ' ELSE NULL END AS reason_code,
               p_partkey % 3 = 0 AS matched,
               p_name AS requested_name, p_brand AS returned_name,
               p_partkey AS seq
        FROM {part}""",
    # One profile per customer in each of the two roles a payment can name.
    "profiles": """
        SELECT role || lpad(CAST(c_custkey AS STRING), 6, '0') AS user_id,
               c_name AS full_name, lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@mail.example' AS email,
               CASE c_custkey % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'BASIC' WHEN 2 THEN 'STANDARD' ELSE 'ENHANCED' END AS kyc_level,
               CASE c_custkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'EXPIRED'
                    ELSE 'UNDER_REVIEW' END AS kyc_status,
               CASE c_nationkey % 5 WHEN 0 THEN 'GBR' WHEN 1 THEN 'IRN' WHEN 2 THEN 'FRA' WHEN 3 THEN 'SYR' ELSE 'DEU' END AS nationality,
               CASE c_custkey % 6 WHEN 0 THEN 'GBR' WHEN 1 THEN 'IRN' WHEN 2 THEN 'FRA' WHEN 3 THEN 'PRK' WHEN 4 THEN 'DEU'
                    ELSE 'USA' END AS country_of_residence,
               'City ' || CAST(c_nationkey AS STRING) AS city,
               c_custkey % 11 = 0 AS pep_status,
               CASE c_custkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'VERY_HIGH'
                    ELSE 'PROHIBITED' END AS risk_rating,
               c_mktsegment AS occupation,
               CASE c_custkey % 3 WHEN 0 THEN 'SALARY' WHEN 1 THEN 'BUSINESS' ELSE 'OTHER' END AS source_of_funds,
               CASE c_custkey % 7 WHEN 0 THEN 'FROZEN' ELSE 'ACTIVE' END AS account_status,
               c_custkey % 500 AS total_transaction_count, CAST(c_acctbal AS DECIMAL(18,4)) AS total_transaction_volume,
               c_custkey % 9 AS alert_count, c_custkey % 4 AS previous_sar_count, c_custkey % 300 AS login_count
        FROM (SELECT *, EXPLODE[split('U,M', ',')] AS role FROM {customer}) c""",
    "cards": """
        SELECT 'CARD' || CAST(c_custkey AS STRING) AS card_id, 'U' || lpad(CAST(c_custkey AS STRING), 6, '0') AS user_id,
               CASE c_custkey % 3 WHEN 0 THEN 'VIRTUAL' WHEN 1 THEN 'PREPAID' ELSE 'DEBIT' END AS card_type,
               CASE c_custkey % 4 WHEN 0 THEN 'VISA' WHEN 1 THEN 'MASTERCARD' WHEN 2 THEN 'AMEX' ELSE 'OTHER' END AS card_brand,
               CASE c_custkey % 6 WHEN 0 THEN 'FROZEN' WHEN 1 THEN 'BLOCKED' ELSE 'ACTIVE' END AS card_status,
               CASE c_nationkey % 3 WHEN 0 THEN 'GBR' WHEN 1 THEN 'FRA' ELSE 'USA' END AS issuing_country,
               CAST(1000 + c_custkey % 50 AS DECIMAL(18,4)) AS daily_limit, CAST(c_custkey % 900 AS DECIMAL(18,4)) AS daily_spent,
               CAST(c_custkey % 9000 AS DECIMAL(18,4)) AS monthly_spent, CAST(c_acctbal AS DECIMAL(18,4)) AS total_spent,
               c_custkey % 8 AS declined_count, CASE c_nationkey % 4 WHEN 0 THEN 'GBR' ELSE 'ESP' END AS last_used_country,
               CAST(5000 + c_custkey % 999 AS STRING) AS last_used_mcc, c_custkey % 2 = 0 AS contactless_enabled,
               c_custkey % 3 <> 0 AS international_enabled
        FROM {customer}""",
    # Stored fact tables of the case-management side, one row per order.
    "otx": """
        SELECT 'T' || CAST(o_orderkey AS STRING) AS id, 'X' || CAST(o_orderkey AS STRING) AS external_id,
               'C' || lpad(CAST(o_custkey AS STRING), 6, '0') AS sender_id,
               'S' || lpad(CAST(o_orderkey * 31 % 97 AS STRING), 6, '0') AS receiver_id,
               CAST(o_totalprice AS DECIMAL(18,4)) AS amount,
               CASE o_orderkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
               'GB' || lpad(CAST(o_custkey AS STRING), 20, '0') AS sender_iban,
               'DE' || lpad(CAST(o_orderkey * 31 % 97 AS STRING), 20, '0') AS receiver_iban,
               CASE o_orderkey % 4 WHEN 0 THEN 'SEND_MONEY' WHEN 1 THEN 'WIRE' WHEN 2 THEN 'TRANSFER' ELSE 'CARD_PAYMENT' END AS transaction_type,
               CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'BLOCKED' ELSE 'SUSPENDED' END END AS status,
               o_orderdate AS created_at
        FROM {orders}""",
    "scores": """
        SELECT 'R' || CAST(o_orderkey AS STRING) AS id, 'T' || CAST(o_orderkey AS STRING) AS transaction_id,
               'C' || lpad(CAST(o_custkey AS STRING), 6, '0') AS entity_id,
               CAST(o_orderkey * 37 % 10000 / 100.0 AS DECIMAL(5,2)) AS risk_score,
               CASE WHEN o_orderkey * 37 % 10000 >= 7500 THEN 'CRITICAL' WHEN o_orderkey * 37 % 10000 >= 5000 THEN 'HIGH'
                    WHEN o_orderkey * 37 % 10000 >= 2500 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
               CAST(o_orderkey % 5 * 10 AS DECIMAL(5,2)) AS velocity_score,
               CAST(CASE WHEN o_orderkey % 13 = 0 THEN 24 ELSE 0 END AS DECIMAL(5,2)) AS sanctions_score,
               CAST(CASE WHEN o_orderkey % 7 = 0 THEN 25 ELSE 0 END AS DECIMAL(5,2)) AS pattern_score,
               '["' || CASE WHEN o_orderkey % 5 > 0 THEN 'VELOCITY:' || CAST(o_orderkey % 5 * 3 AS STRING) || 'txns/2min(+' || CAST(o_orderkey % 5 * 10 AS STRING) || '.0)' ELSE 'DUPLICATE:same_amount_rapid(+15.0)' END
                    || CASE WHEN o_totalprice >= 50000 THEN '","AMOUNT:' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || '(+35.0)' ELSE '' END
                    || CASE WHEN o_orderkey % 7 = 0 THEN '","PATTERN:TESTING_THE_WATERS(+25.0)","PATTERN:VELOCITY_BURST' ELSE '' END
                    || CASE WHEN o_orderkey % 11 = 0 THEN '","COP:ANNM' ELSE '' END
                    || '"]' AS factors,
               o_orderdate AS scored_at
        FROM {orders}""",
    "alerts": """
        SELECT 'A' || CAST(o_orderkey AS STRING) AS id, 'T' || CAST(o_orderkey AS STRING) AS transaction_id,
               'R' || CAST(o_orderkey AS STRING) AS risk_score_id,
               CASE WHEN o_orderkey * 37 % 10000 >= 7500 THEN 'CRITICAL_RISK' WHEN o_orderkey * 37 % 10000 >= 5000 THEN 'HIGH_RISK'
                    ELSE 'VELOCITY_ANOMALY' END AS alert_type,
               CASE WHEN o_orderkey * 37 % 10000 >= 7500 THEN 'CRITICAL' WHEN o_orderkey * 37 % 10000 >= 5000 THEN 'HIGH'
                    WHEN o_orderkey * 37 % 10000 >= 2500 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               'Review of order ' || CAST(o_orderkey AS STRING) AS title,
               'Priority ' || o_orderpriority AS description,
               CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'RESOLVED'
                    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'INVESTIGATING' ELSE 'DISMISSED' END END AS status,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'analyst' || CAST(o_orderkey % 6 AS STRING) END AS resolved_by,
               o_orderdate AS created_at, o_orderdate + INTERVAL '3' DAY AS resolved_at
        FROM {orders}""",
    # Filings refer to every third alert; the others have none.
    "filings": """
        SELECT 'F' || CAST(o_orderkey AS STRING) AS id, 'A' || CAST(o_orderkey * 3 AS STRING) AS alert_id, 'SAR' AS filing_type,
               CASE o_orderkey % 4 WHEN 0 THEN 'FinCEN_BSA' WHEN 1 THEN 'FCA_UK' WHEN 2 THEN 'BaFin_DE' ELSE 'OTHER' END AS filing_format,
               CASE o_orderkey % 5 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'PENDING_REVIEW' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'FILED'
                    ELSE 'REJECTED' END AS status,
               'C' || lpad(CAST(o_custkey AS STRING), 6, '0') AS subject_name, 'Narrative ' || o_orderpriority AS narrative,
               CASE WHEN o_orderkey % 5 = 3 THEN o_orderdate ELSE NULL END AS filed_at, o_orderdate AS created_at
        FROM {orders}""",
    # Two model versions score each transaction, so a transaction has several rows.
    "model_scores": """
        SELECT 'T' || CAST(event_id AS STRING) AS transaction_id,
               CASE user_id % 2 WHEN 0 THEN 'vae' ELSE 'gnn' END AS model_name, version AS model_version,
               round(CASE WHEN version = 'v1' THEN value / 500 ELSE value / 700 END, 6) AS model_score,
               CASE event_id % 10 WHEN 0 THEN 'timeout' WHEN 5 THEN 'error' ELSE 'model' END AS source,
               CASE WHEN version = 'v1' THEN ts ELSE ts + INTERVAL '1' HOUR END AS created_at
        FROM (SELECT *, EXPLODE[split('v1,v2', ',')] AS version FROM {events}) e""",
    "calibration": """
        SELECT CASE label % 2 WHEN 0 THEN 'vae' ELSE 'gnn' END AS model_name, CAST(vec_id AS BIGINT) AS vec_id,
               round(abs(CAST(component AS DOUBLE)) * 2, 6) AS score
        FROM (SELECT label, vec_id, EXPLODE[embedding] AS component FROM {embeddings}) x""",
    "edges": """
        SELECT 'C' || lpad(CAST(o_custkey AS STRING), 6, '0') AS sender_id,
               'S' || lpad(CAST(l_suppkey AS STRING), 6, '0') AS receiver_id,
               CAST(l_extendedprice AS DECIMAL(18,4)) AS amount,
               CASE o_orderkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
               CAST(o_orderkey * 37 % 10000 / 100.0 AS DECIMAL(5,2)) AS risk_score, o_orderdate AS event_time
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Short chains inside blocks of sixteen orders: many small components and some self loops.
    "links": """
        SELECT 'N' || CAST(o_orderkey AS STRING) AS sender_id,
               'N' || CAST(greatest(o_orderkey - o_custkey % 3, o_orderkey - o_orderkey % 16) AS STRING) AS receiver_id,
               CAST(o_totalprice AS DECIMAL(18,4)) AS amount, 'GBP' AS currency, o_orderdate AS event_time
        FROM {orders}""",
    "contacts": """
        SELECT 'U' || lpad(CAST(c_custkey AS STRING), 6, '0') AS entity_id,
               CASE c_custkey % 12 WHEN 0 THEN 'not-an-email' WHEN 1 THEN 'ab@gmail.com' WHEN 2 THEN 'john.smith+x' || CAST(c_custkey AS STRING) || '@gmail.com'
                    WHEN 3 THEN '9' || CAST(c_custkey * 7919 AS STRING) || 'a@yahoo.com' WHEN 4 THEN 'shopper' || CAST(c_custkey AS STRING) || '@mailinator.com'
                    WHEN 5 THEN ' MiXed.Case' || CAST(c_custkey AS STRING) || '@Corp' || CAST(c_nationkey AS STRING) || '.example '
                    ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@corp' || CAST(c_nationkey AS STRING) || '.example' END AS email,
               CASE c_custkey % 7 WHEN 0 THEN '123' WHEN 1 THEN '+1 (900) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
                    WHEN 2 THEN '1800-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 3 THEN '1900555' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
                    ELSE '+44 7700 9' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') END AS phone,
               CASE c_custkey % 9 WHEN 0 THEN 'bad.ip' WHEN 1 THEN '10.0.' || CAST(c_custkey % 256 AS STRING) || '.7'
                    WHEN 2 THEN '34.' || CAST(c_custkey % 256 AS STRING) || '.1.9' WHEN 3 THEN '127.0.0.1'
                    WHEN 4 THEN '2001:db8:0:0:0:0:0:' || CAST(c_custkey % 10 AS STRING) WHEN 5 THEN '300.1.1.1'
                    WHEN 6 THEN '185.220.' || CAST(c_custkey % 8 AS STRING) || '.' || CAST(c_custkey % 251 AS STRING)
                    ELSE CAST(60 + c_custkey % 130 AS STRING) || '.' || CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_nationkey AS STRING) || '.' || CAST(c_custkey % 199 AS STRING) END AS ip_address,
               CASE c_custkey % 8 WHEN 0 THEN '4' || lpad(CAST(c_custkey AS STRING), 7, '0') WHEN 1 THEN '2720' || lpad(CAST(c_custkey AS STRING), 6, '0')
                    WHEN 2 THEN '37' || lpad(CAST(c_custkey AS STRING), 6, '0') WHEN 3 THEN '99' || lpad(CAST(c_custkey AS STRING), 6, '0')
                    WHEN 4 THEN '12' WHEN 5 THEN '6011-' || lpad(CAST(c_custkey AS STRING), 6, '0') WHEN 6 THEN '300' || lpad(CAST(c_custkey AS STRING), 5, '0')
                    ELSE '6304' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS card_bin,
               CASE c_custkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'us' ELSE 'FR' END AS expected_country,
               CASE c_custkey % 5 WHEN 0 THEN 12 WHEN 1 THEN 2 ELSE 0 END AS known_breaches,
               CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE -1 END AS registered_social_profiles,
               'pw-' || CAST(c_custkey % 200 AS STRING) AS password
        FROM {customer}""",
    # Countries each signal of a contact points to; empty where unknown.
    "contact_countries": """
        SELECT 'U' || lpad(CAST(c_custkey AS STRING), 6, '0') AS entity_id,
               CASE c_custkey % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'FR' WHEN 2 THEN 'US' ELSE '' END AS ip_country,
               CASE c_custkey % 3 WHEN 0 THEN 'GB' WHEN 1 THEN '' ELSE 'DE' END AS phone_country
        FROM {customer}""",
    "enrichments": """
        SELECT c_custkey AS id, 'C' || lpad(CAST(c_custkey * 7 % 60 AS STRING), 6, '0') AS entity_id,
               CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'ip' ELSE 'phone' END AS enrichment_type,
               CAST(c_custkey % 100 AS INT) AS risk_score, MAKE_TS[1700000000000000 + c_custkey * 1000000 % 7777777777] AS created_at
        FROM {customer}""",
    # Reference lists as they come from text files: comments, blanks and mixed case included.
    "reflist_lines": """
        SELECT 'tor' AS kind, CASE s_suppkey % 10 WHEN 0 THEN '# comment ' || s_name WHEN 1 THEN '   '
                    ELSE ' 185.220.' || CAST(s_suppkey % 8 AS STRING) || '.' || CAST(s_suppkey % 251 AS STRING) || ' ' END AS line FROM {supplier}
        UNION ALL SELECT 'disposable', CASE s_suppkey % 10 WHEN 0 THEN '#' || s_name ELSE ' Throw' || CAST(s_suppkey AS STRING) || '.Example' END FROM {supplier}
        UNION ALL SELECT 'disposable', 'corp' || CAST(n_nationkey AS STRING) || CASE WHEN n_nationkey % 9 = 0 THEN '.example' ELSE '.invalid' END FROM {nation}
        UNION ALL SELECT 'vpn', CAST(60 + s_suppkey % 130 AS STRING) || '.' || CAST(s_suppkey % 256 AS STRING) || '.0.0/16' FROM {supplier}
        UNION ALL SELECT 'vpn', CAST(60 + s_suppkey % 130 AS STRING) || '.' || CAST(s_suppkey % 256 AS STRING) || '.' || CAST(s_nationkey AS STRING) || '.0/24' FROM {supplier}
        UNION ALL SELECT 'datacentre', CAST(60 + n_nationkey * 4 AS STRING) || '.0.0.0/9' FROM {nation}""",
    "issuers": """
        SELECT substr(bin, 1, 6) AS bin6, max(bank) AS bank, max(country_code) AS country_code, max(card_type) AS card_type, bool_or(prepaid) AS prepaid
        FROM (SELECT '4' || lpad(CAST(c_custkey AS STRING), 7, '0') AS bin, 'Bank ' || CAST(c_nationkey AS STRING) AS bank,
                     CASE c_custkey % 3 WHEN 0 THEN 'GB' ELSE 'US' END AS country_code,
                     CASE c_custkey % 2 WHEN 0 THEN 'debit' ELSE 'credit' END AS card_type, c_custkey % 5 = 0 AS prepaid FROM {customer}
              UNION ALL
              SELECT '37' || lpad(CAST(c_custkey AS STRING), 6, '0'), 'Bank ' || CAST(c_nationkey AS STRING), 'FR', 'credit', c_custkey % 4 = 0 FROM {customer}) b
        GROUP BY substr(bin, 1, 6)""",
    "domains": """
        SELECT 'corp' || CAST(n_nationkey AS STRING) || '.example' AS domain,
               CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN MAKE_TS[1703000000000000] WHEN 2 THEN MAKE_TS[1695000000000000]
                    WHEN 3 THEN MAKE_TS[1685000000000000] ELSE MAKE_TS[1200000000000000] END AS created,
               CASE n_nationkey % 4 WHEN 0 THEN FALSE ELSE TRUE END AS valid_mx,
               CASE n_nationkey % 3 WHEN 0 THEN 'V=SPF1 include:x -ALL' WHEN 1 THEN 'v=spf1 ~all' ELSE 'google-site' END AS txt,
               CASE n_nationkey % 4 WHEN 0 THEN 'v=DMARC1; p=Reject; rua=x' WHEN 1 THEN 'v=dmarc1;sp=none; p=none'
                    WHEN 2 THEN 'v=DMARC1; p=quarantine' ELSE 'nothing' END AS dmarc_txt
        FROM {nation}""",
    "breaches": """
        SELECT ' Corp' || CAST(c_nationkey AS STRING) || '.Example' AS domain, 'Breach ' || CAST(c_custkey AS STRING) AS name,
               '2020-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS breach_date, c_custkey * 10 AS pwn_count
        FROM {customer}""",
    "footprints": """
        SELECT 'U' || lpad(CAST(c_custkey AS STRING), 6, '0') AS entity_id, c_custkey % 5 AS platforms_registered,
               6 + c_custkey % 4 AS platforms_checked, c_custkey % 2 AS rate_limited
        FROM {customer}""",
    "device": """
        SELECT event_id, 'U' || lpad(CAST(user_id AS STRING), 6, '0') AS user_id,
               CASE event_id % 17 WHEN 0 THEN 'Mozilla HeadlessChrome' WHEN 1 THEN 'PhantomJS' WHEN 2 THEN 'Mozilla Mobile Android'
                    ELSE 'Mozilla Desktop' END AS user_agent,
               CASE user_id % 3 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Win32' ELSE 'MacIntel' END AS platform,
               'en-GB' AS language, CASE user_id % 2 WHEN 0 THEN 'Europe/London' ELSE 'Europe/Paris' END AS timezone_name,
               CASE WHEN event_id % 23 = 0 THEN '' ELSE 'canvas' || CAST(user_id % 60 AS STRING) END AS canvas_hash,
               CASE WHEN event_id % 46 = 0 THEN '' ELSE 'gl' || CAST(user_id % 30 AS STRING) END AS webgl_hash,
               CASE event_id % 19 WHEN 0 THEN 'Google SwiftShader' WHEN 1 THEN 'Mesa X' ELSE 'ANGLE' END AS webgl_renderer,
               '81.2.69.' || CAST(event_id % 255 AS STRING) AS ip_address,
               CASE event_id % 31 WHEN 0 THEN 'Tor circuit' ELSE 'wifi' END AS connection_type,
               1024 + CAST(user_id % 3 AS INT) * 256 AS screen_width, 768 AS screen_height,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(1 + event_id % 8 AS INT) END AS hardware_concurrency,
               CAST(event_id % 3 AS INT) AS max_touch_points, CAST(event_id % 6 AS INT) AS mouse_movements,
               CAST(event_id % 3 AS INT) AS plugins_count,
               CASE WHEN event_id % 14 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS DOUBLE) END AS device_memory,
               CASE WHEN event_id % 6 = 0 THEN 0.0E0 ELSE CAST(value AS DOUBLE) END AS mouse_entropy,
               event_id % 29 = 0 AS webdriver, event_id % 5 <> 0 AS cookies_enabled, event_id % 7 <> 0 AS local_storage,
               event_id % 7 <> 0 AS session_storage, event_id % 3 <> 0 AS indexed_db, event_id % 2 = 0 AS pdf_viewer,
               event_id % 4 = 0 AS touch_support, ts AS created_at
        FROM {events}""",
    "cadences": """
        SELECT vec_id, embedding AS typing_cadence_ms FROM {embeddings}""",
    # Watch-list entities: companies named after parts, people named after payment senders.
    "entities": """
        SELECT 'W-P' || lpad(CAST(p_partkey AS STRING), 7, '0') AS id,
               CASE p_partkey % 4 WHEN 0 THEN 'Company' WHEN 1 THEN 'Person' WHEN 2 THEN 'LegalEntity' ELSE 'Vessel' END AS schema_type,
               p_name AS caption, CASE p_partkey % 2 WHEN 0 THEN 'us_ofac' ELSE 'eu_fsf' END AS dataset,
               ' ' || p_name || ' ' || p_brand AS name, p_type || ' ' || p_name AS alias,
               'P' || CAST(p_partkey AS STRING) AS passport, CASE p_partkey % 3 WHEN 0 THEN 'gb' WHEN 1 THEN 'ru' ELSE NULL END AS country,
               CAST(p_size AS STRING) || ' High Street' AS address, p_partkey AS version_key
        FROM {part}
        UNION ALL
        SELECT 'W-S' || lpad(CAST(s_suppkey AS STRING), 7, '0'), 'Organization', s_name,
               CASE s_suppkey % 2 WHEN 0 THEN 'us_ofac' ELSE 'gb_hmt' END, s_name,
               'U' || lpad(CAST(s_suppkey * 3 AS STRING), 6, '0') || ' Ltd', 'P9' || CAST(s_suppkey AS STRING), 'ir',
               CAST(s_nationkey AS STRING) || ' Dock Road', s_suppkey
        FROM {supplier}""",
    "entity_names": """
        SELECT id AS entity_id, name, lower(trim(name)) AS name_normalized, 'primary' AS name_type FROM {entities}
        UNION ALL SELECT id, alias, lower(trim(alias)), 'alias' FROM {entities}""",
    # Names to screen: the parts again, misspelt and turned around.
    "names": """
        SELECT 'Q' || CAST(p_partkey AS STRING) AS query_id,
               CASE p_partkey % 3 WHEN 0 THEN replace(p_name, 'e', 'a') || ' ' || p_brand WHEN 1 THEN upper(p_brand || ' ' || p_name)
                    ELSE p_name || ' und ' || p_type END AS name
        FROM {part}""",
    "rules": """
        SELECT * FROM (
            SELECT 'r1' AS rule_id, 'high_value_block' AS rule_name, 'amount' AS field, 'gt' AS operator, '50000' AS value, 'BLOCK' AS action, 50 AS risk_score_adjustment, 'CRITICAL' AS severity, TRUE AS active, 'system' AS created_by, 1 AS version
            UNION ALL SELECT 'r2', 'small_amount_flag', 'amount', 'lt', '10', 'FLAG', 5, 'LOW', TRUE, 'system', 1
            UNION ALL SELECT 'r3', 'currency_watch', 'currency', 'eq', 'EUR', 'FLAG', 5, 'LOW', TRUE, 'ai-agent', 1
            UNION ALL SELECT 'r4', 'sender_watch', 'sender_id', 'eq', 'U000007', 'SUSPEND', 40, 'HIGH', TRUE, 'ai-agent', 2
            UNION ALL SELECT 'r5', 'withdrawal_flag', 'transaction_type', 'eq', 'WITHDRAWAL', 'FLAG', 20, 'MEDIUM', TRUE, 'system', 1
            UNION ALL SELECT 'r6', 'sender_family', 'sender_id', 'contains', '00014', 'FLAG', 15, 'MEDIUM', TRUE, 'ai-agent', 1
            UNION ALL SELECT 'r7', 'receiver_family', 'receiver_id', 'contains', 'M00003', 'FLAG', 10, 'LOW', TRUE, 'system', 3
            UNION ALL SELECT 'r8', 'switched_off', 'amount', 'gt', '1', 'FLAG', 90, 'LOW', FALSE, 'system', 1
            UNION ALL SELECT 'r9', 'lower_case_type', 'transaction_type', 'contains', 'card', 'FLAG', 10, 'LOW', TRUE, 'system', 1
            UNION ALL SELECT 'r10', 'type_list', 'transaction_type', 'in', 'TRANSFER, WIRE', 'FLAG', 10, 'LOW', TRUE, 'system', 1
            UNION ALL SELECT 'r11', 'not_success', 'status', 'neq', 'SUCCESS', 'FLAG', 30, 'MEDIUM', TRUE, 'ai-agent', 1
            UNION ALL SELECT 'r12', 'bad_number', 'amount', 'gt', 'many', 'FLAG', 10, 'LOW', TRUE, 'system', 1
            UNION ALL SELECT 'r13', 'score_rule', 'current_score', 'gt', '60', 'FLAG', 25, 'MEDIUM', TRUE, 'system', 1
        ) r""",
    # A stored rule table, one rule per customer.
    "rule_table": """
        SELECT 'R' || CAST(c_custkey AS STRING) AS rule_id, 'watch_' || lower(c_mktsegment) || '_' || CAST(c_custkey AS STRING) AS rule_name,
               'Watch ' || c_name AS description,
               CASE c_custkey % 3 WHEN 0 THEN 'sender_id' WHEN 1 THEN 'amount' ELSE 'currency' END AS field,
               CASE c_custkey % 3 WHEN 1 THEN 'gt' ELSE 'eq' END AS operator,
               CASE c_custkey % 3 WHEN 0 THEN 'U' || lpad(CAST(c_custkey AS STRING), 6, '0') WHEN 1 THEN CAST(c_custkey * 10 AS STRING) ELSE 'GBP' END AS value,
               CASE c_custkey % 4 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'SUSPEND' ELSE 'FLAG' END AS action,
               CAST(c_custkey % 60 AS INT) AS risk_score_adjustment,
               CASE c_custkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               c_custkey % 5 <> 0 AS active, CASE c_custkey % 2 WHEN 0 THEN 'system' ELSE 'ai-agent' END AS created_by,
               CAST(1 + c_custkey % 3 AS INT) AS version
        FROM {customer}""",
    # A change set for it: some rules again with new values, some new ones.
    "rule_changes": """
        SELECT 'R' || CAST(s_suppkey * 7 AS STRING) AS rule_id, 'watch_supplier_' || CAST(s_suppkey AS STRING) AS rule_name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'Changed by ' || s_name ELSE NULL END AS description,
               CASE WHEN s_suppkey % 3 = 0 THEN 'SUSPEND' ELSE NULL END AS action,
               CASE WHEN s_suppkey % 5 = 0 THEN CAST(99 AS INT) ELSE NULL END AS risk_score_adjustment,
               CASE WHEN s_suppkey % 4 = 0 THEN FALSE ELSE NULL END AS active
        FROM {supplier}""",
    "features": """
        SELECT CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'us:er' ELSE 'merchant' END AS scope,
               'U' || CAST(user_id AS STRING) AS entity_id, CASE event_id % 2 WHEN 0 THEN '1h' ELSE '24h' END AS feature_window,
               value AS feature_value, ts AS put_at, CAST(3600 * (1 + event_id % 240) AS BIGINT) AS ttl_seconds, event_id
        FROM {events}""",
}


def referenced(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def _tokens(sql: str, epoch: str, make: str, explode: str) -> str:
    for token, template in (("EPOCH_US", epoch), ("MAKE_TS", make), ("EXPLODE", explode)):
        pattern = re.compile(token + r"\[([^\[\]]*)\]")
        while pattern.search(sql):
            sql = pattern.sub(lambda m: template.format(m.group(1)), sql)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    if name in TABLES:
        return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _tokens(
        VIEWS[name], "unix_micros(CAST({} AS TIMESTAMP))", "CAST(timestamp_micros({}) AS TIMESTAMP_NTZ)", "explode({})"
    )
    parts = {n: table(spark, sf_dir, n) for n in referenced(sql)}
    return spark.sql(sql, **parts)


def oracle(body: str, *more: str) -> str:
    """DuckDB statement: the views named in braces as CTEs, then ``more`` CTEs, then ``body``."""
    ctes: dict[str, str] = {}

    def add(sql: str) -> str:
        for name in referenced(sql):
            if name in VIEWS and name not in ctes:
                ctes[name] = add(VIEWS[name])
        sql = re.sub(r"\{([a-z]\w*)\}", r"\1", sql)
        return _tokens(sql, "epoch_us({})", "make_timestamp({})", "unnest({})")

    body = add(body)
    extra = [add(m) for m in more]
    steps = [f"{name} AS ({sql})" for name, sql in ctes.items()] + extra
    return ("WITH RECURSIVE " + ",\n".join(steps) + "\n" if steps else "") + body
