"""Schemas of the records and the enumerations they use."""

from __future__ import annotations

from pyspark.sql import types as T

# Members of the enumerations.
TRANSACTION_TYPES = [
    "SEND_MONEY", "ADD_MONEY", "DIRECT_DEBIT", "EXCHANGE", "CARD_PAYMENT", "WIRE", "TRANSFER", "WITHDRAWAL",
]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
RULE_ACTIONS = ["ALLOW", "FLAG", "SUSPEND", "BLOCK"]

MONEY = T.DecimalType(18, 4)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


text, whole, real, flag, stamp = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

PAYMENT_PAYLOAD = _struct(
    external_id=text, sender_id=text, receiver_id=text, amount=text, currency=text, sender_iban=text,
    receiver_iban=text, transaction_type=text, iso20022_msg_type=text,
)

RULE_MESSAGE = _struct(
    rule_id=text, rule_name=text, condition=_struct(field=text, operator=text, value=text), action=text,
    risk_score_adjustment=whole, severity=text, active=flag, created_by=text, created_at=text, version=whole,
)

WATCHLIST_ENTITY = _struct(
    id=text, schema=text, caption=text, datasets=T.ArrayType(text),
    properties=_struct(**{
        name: T.ArrayType(text)
        for name in ("name", "alias", "passportNumber", "idNumber", "taxNumber", "innCode", "country", "address")
    }),
    _corrupt_record=text,
)

CALIBRATION_FILE = _struct(
    model_name=text, baseline_scores=T.ArrayType(text), reconstruction_errors=T.ArrayType(text),
)

# The ten inputs of the model, in contract order.
MODEL_FEATURES = [
    "amount", "velocity_count", "hour_of_day", "is_weekend", "entity_risk", "ip_risk", "phone_risk", "email_risk",
    "cop_reason", "geo_mismatch",
]
