"""The operators on streams, and the fan-out of one stream to all sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.functions import bands
from fraudspark.operators import models, patterns, records, rules, scoring
from fraudspark.operators.skew import micros
from fraudspark.schemas import MODEL_FEATURES
from fraudspark.session import release_shuffles, ship_package
from fraudspark.sources import writers
from fraudspark.streaming.processors import MATCHED, ROLLED, InOrder, ReceiverPatterns, SenderPatterns, TrailingWindow

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where the session does not say otherwise: files of the last two batches are kept for recovery and not of a hundred, and a state store,
#: of which there are several per partition, does not set 4 MB of disk aside for a log of some hundred bytes.
STATE_DISK = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def use_rocksdb(spark: SparkSession) -> None:
    """Large keyed state lives in RocksDB, not on the heap, and takes no more disk than it must."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in STATE_DISK.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def with_window_count(payments: DataFrame, width: str = "2 minutes") -> DataFrame:
    """Each payment with the count of its tumbling window, when the window closes.

    Two stateful steps: counts of windows, which Spark adds up before the shuffle, and a join of the payments with the
    count of their window. A payment is a state row of its own until the watermark passes the window's end.
    """
    plain_time = F.timestamp_micros(F.unix_micros("event_time"))  # of each side, only the window carries the watermark
    rows = payments.withColumn("__window", F.window("event_time", width)).withColumn("event_time", plain_time)
    counts = payments.groupBy(F.col("sender_id").alias("__sender"), F.window("event_time", width).alias("__counted")).agg(F.count("*").alias("txn_count_2min"))
    met = rows.join(counts, (F.col("sender_id").eqNullSafe(F.col("__sender"))) & (F.col("__window") == F.col("__counted")))
    return met.select("event_time", *[c for c in payments.columns if c != "event_time"], "txn_count_2min")


def score_counted(counted: DataFrame) -> DataFrame:
    """The windowed score for payments that already carry their window count."""
    small = (F.col("amount") < bands.SMALL_AMOUNT) & (F.col("txn_count_2min") >= bands.SMALL_AMOUNT_MIN_COUNT)
    return (
        counted.withColumn("velocity_score", bands.velocity_score(F.col("txn_count_2min")))
        .withColumn("amount_score", bands.amount_score(F.col("amount")))
        .withColumn("pattern_score", F.when(small, bands.PATTERN_SCORE).otherwise(0.0))
        .withColumn("risk_score", F.least(F.col("velocity_score") + F.col("amount_score") + F.col("pattern_score"), F.lit(bands.MAX_SCORE)))
    )


KEY_BUCKETS = 512  # groups of keys that share a state; fixed for the life of a checkpoint


def _keyed(payments: DataFrame, key: str, processor: InOrder, output) -> DataFrame:
    """Each key's rows in order of time; keys are handled by bucket, as each group costs Python calls of its own."""
    use_rocksdb(payments.sparkSession)
    ship_package()
    party = "receiver_id" if key == "sender_id" else "sender_id"
    rows = payments.filter(F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).alias("bucket"), F.col(key).alias("key"), micros("event_time").alias("t"), "external_id", F.col(party).alias("party"),
        F.col("amount").cast("double").alias("amount"), "transaction_type", "currency", "event_time",
    )
    return rows.groupBy("bucket").transformWithStateInPandas(processor, output, "Append", "EventTime")


def rolling(payments: DataFrame, seconds: int = 120) -> DataFrame:
    """Trailing velocity, repeated amount and escalation per sender."""
    return _keyed(payments, "sender_id", TrailingWindow(seconds), ROLLED)


def sender_patterns(payments: DataFrame) -> DataFrame:
    return _keyed(payments, "sender_id", SenderPatterns(), MATCHED)


def receiver_patterns(payments: DataFrame) -> DataFrame:
    return _keyed(payments, "receiver_id", ReceiverPatterns(), MATCHED)


def model_scores(raw: DataFrame, model_version: str = "baseline", threshold: float = 0.5) -> DataFrame:
    """Scored messages of the model branch: every record is answered, a broken one with the safe default."""
    parsed = records.model_record(raw)
    kept = parsed.withColumn("ok", F.col("record").isNotNull())
    featured = kept.select("*", *[F.coalesce(F.col(f"record.{n}").try_cast("double"), F.lit(0.0)).alias(n) for n in MODEL_FEATURES])
    scored = models.vector_score(featured, MODEL_FEATURES, threshold)
    ok = F.col("ok")
    answered = scored.select(
        "record", F.when(ok, F.col("model_score")).otherwise(0.0).alias("model_score"), (ok & F.col("is_anomaly")).alias("is_anomaly"),
        F.array().cast("array<string>").alias("reason_codes"), F.when(ok, "model").otherwise("error").alias("source"),
        F.when(ok, model_version).otherwise("unknown").alias("model_version"), F.lit(0.0).alias("latency_ms"),
    )
    return records.model_messages(answered)


#: Runs over all that is there and stops. A continuous run takes {"processingTime": "60 seconds"}.
ONCE = {"availableNow": True}


def match_rules_per_batch(payments: DataFrame, read_rules: Callable[[], DataFrame], out: str, checkpoint: str, trigger: dict = ONCE, messages: str | None = None, as_of: bool = False):
    """Stream against changing rules: each batch is matched with the rules stored at that moment.

    With ``as_of``, ``read_rules`` gives all rule messages so far (a table that ``store_rules`` fills), and a payment is
    matched with the version of each rule that held at its own time; a message that arrives after the payment's batch
    does not change it any more. Matches carry their payment's time. They are appended to the table ``out``, and sent to the topic folder
    ``messages`` where one is named.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        release_shuffles(batch.sparkSession)
        if as_of:
            hits = rules.stream_matches_as_of(batch, rules.rule_history(read_rules()), F.col("event_time"))
        else:
            hits = rules.stream_matches(batch, rules.latest_versions(read_rules()), F.col("event_time"))
        stored = writers.append_batch(hits, out, batch_id)
        if messages:
            writers.write_messages(stored, messages, batch_id)

    return payments.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def store_rules(messages: DataFrame, out: str, checkpoint: str, trigger: dict = ONCE):
    """The stream of rule messages as a table of all versions."""
    return run_to_table(messages, out, checkpoint, trigger=trigger)


def pattern_rows(found: DataFrame) -> DataFrame:
    """Alert rows (alert and audit text) of matches found on the stream."""
    kind = lambda name: found.filter(F.col("pattern_type") == name).withColumn("detected_at", F.timestamp_micros("detected_us"))
    money = lambda c: F.col(c).cast("decimal(18,4)")
    return patterns.pattern_alerts(
        kind("SMALL_TO_LARGE").select(
            F.col("key").alias("matched_sender"), F.col("n").alias("small_count"), (money("total") / F.col("n")).alias("avg_small_amount"),
            F.col("last_id").alias("large_txn"), money("last_amount").alias("large_amount"), "currency", "detected_at",
        ),
        kind("RAPID_ROUND_TRIP").select(
            F.col("key").alias("matched_sender"), F.col("first_id").alias("outbound_txn"), money("first_amount").alias("out_amount"),
            F.col("last_id").alias("inbound_txn"), money("last_amount").alias("in_amount"), F.col("party").alias("intermediary"), "currency", "detected_at",
        ),
        kind("VELOCITY_BURST").select(F.col("key").alias("matched_sender"), F.col("n").alias("burst_count"), money("total").alias("burst_total"), "currency", "detected_at"),
        kind("DUPLICATE_INBOUND_AMOUNTS").select(F.col("key").alias("matched_receiver"), money("last_amount").alias("duplicate_amount"), "currency", "detected_at"),
    )


def store(rows: DataFrame, table: str, keys: list[str], order: list[str], version: int) -> None:
    """Into a keyed table, of which the last two states are kept."""
    if writers.upsert_table(rows, table, keys, order, version):
        writers.vacuum(rows.sparkSession, table)


def run_patterns(by_sender: DataFrame, by_receiver: DataFrame, base: str, checkpoint: str, trigger: dict = ONCE) -> list:
    """All four patterns to the alert topic and to the keyed pattern table; one query for senders, one for receivers."""
    def sink(side: str):
        def handle(batch: DataFrame, batch_id: int) -> None:
            release_shuffles(batch.sparkSession)
            rows = pattern_rows(batch.persist())
            try:
                writers.write_messages(rows.drop("audit"), f"{base}/pattern_alerts/{side}", batch_id)
                table = rows.drop("details").withColumnRenamed("audit", "details")
                store(table, f"{base}/patterns/{side}", ["pattern_type", "sender_id", "detected_at"], ["details"], batch_id + 1)
            finally:
                batch.unpersist()

        return handle

    sides = (("senders", sender_patterns(by_sender)), ("receivers", receiver_patterns(by_receiver)))
    return [found.writeStream.foreachBatch(sink(side)).option("checkpointLocation", f"{checkpoint}/{side}").trigger(**trigger).start() for side, found in sides]


def write_all_sinks(scored_batch: DataFrame, batch_id: int, base: str, stamp: Column) -> None:
    """One scored batch to the five sinks of scores. Computed once; each write may be repeated without effect."""
    release_shuffles(scored_batch.sparkSession)
    scored_batch = scored_batch.persist()
    try:
        version = batch_id + 1
        store(scoring.transactions_out(scored_batch, stamp), f"{base}/transactions", ["id"], ["created_at"], version)
        store(scoring.risk_scores(scored_batch, stamp), f"{base}/risk_scores", ["transaction_id"], ["scored_at"], version)
        store(scoring.alerts(scored_batch, stamp), f"{base}/alerts", ["transaction_id", "alert_type"], ["created_at"], version)
        writers.write_messages(scoring.scored_events(scored_batch, stamp), f"{base}/scored_events", batch_id)
        writers.write_messages(scoring.interdictions(scored_batch, stamp), f"{base}/interdictions", batch_id)
    finally:
        scored_batch.unpersist()


def run_pipeline(raw: DataFrame, base: str, checkpoint: str, stamp: Callable[[], Column] = F.current_timestamp, trigger: dict = ONCE):
    """Payload stream to parse, window count, score and the sinks of scores, with recoverable progress."""
    use_rocksdb(raw.sparkSession)
    payments = records.parse_transactions(raw).drop("raw_payload")  # no sink has the text, and the state need not hold it
    scored = score_counted(with_window_count(payments))
    return (
        scored.writeStream.outputMode("append")
        .foreachBatch(lambda batch, batch_id: write_all_sinks(batch, batch_id, base, stamp()))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def run_all(
    open_stream: Callable[[], DataFrame], read_rules: Callable[[], DataFrame], base: str, checkpoint: str,
    stamp: Callable[[], Column] = F.current_timestamp, trigger: dict = ONCE,
) -> list:
    """Every insert of the pipeline: scores (5), rule matches (1), and four patterns as alerts and as table rows (8).

    ``open_stream`` gives the payload stream anew for each query, since each keeps its own progress below ``checkpoint``.
    """
    parsed = lambda: records.parse_transactions(open_stream())
    return [
        run_pipeline(open_stream(), base, f"{checkpoint}/scores", stamp, trigger),
        match_rules_per_batch(parsed(), read_rules, f"{base}/rule_matches_table", f"{checkpoint}/rules", trigger, f"{base}/rule_matches"),
        *run_patterns(parsed(), parsed(), base, f"{checkpoint}/patterns", trigger),
    ]


def run_to_table(stream: DataFrame, out: str, checkpoint: str, output_mode: str = "append", trigger: dict = ONCE):
    """Runs a stream into Parquet files."""
    return (
        stream.writeStream.outputMode(output_mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
