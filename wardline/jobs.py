"""Long-running jobs over topics, for ``spark-submit``.

    spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2 \\
        -m wardline.jobs detect --mode fraud --broker host:9093 --checkpoint /shared/chk --out /shared/tables

``ingest`` writes the event tables under ``--out``, where ``analyse`` finds the features and ``train`` its payments; ``compact`` gathers the small files of one of these tables;
``train`` saves the model that ``score`` loads. The broker's password comes from the environment only, since command
lines show in process lists. A setting is taken from the command line, else from the environment, else from its default; an empty
environment variable counts as not set.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.decode import broken_values, decode_events, with_event_time
from wardline.operators.scoring import decide, evaluate, load, save, score, split, train, training_set
from wardline.operators.sequence import SequenceRule, rule_for_mode, to_alerts
from wardline.plans.medallion import CLUSTERED_BY, Tables, start_alert_streams, start_event_streams
from wardline.session import configure
from wardline.sources.topics import read_topics, source_options, topic_options, write_alerts
from wardline.streaming.runs import SCORING_INTERVAL, write_stream
from wardline.streaming.sequence import match_sequence_stream

# Topic names and checkpoint interval.
TOPICS = {"fraud": "auth_txn", "insider": "insider_events"}
ALERTS_TOPIC = "alerts"
GROUP = "wardline"
CHECKPOINT_INTERVAL = "5 seconds"
# The matcher holds what a batch brings until the watermark passes it; starting from the earliest
# offset must not bring the whole topic at once.
MESSAGES_PER_BATCH = 10_000_000


@dataclass(frozen=True)
class Settings:
    mode: str
    broker: str
    topic: str
    group: str
    alerts_topic: str
    password: str

    @classmethod
    def of(cls, args: Mapping[str, str | None], env: Mapping[str, str] = os.environ) -> Settings:
        def pick(arg: str | None, variable: str, default: str) -> str:
            given = args.get(arg) if arg else None
            return given if given is not None else env.get(variable) or default

        mode = pick("mode", "MODE", "fraud")
        kind = "fraud" if mode == "fraud" else "insider"
        return cls(
            mode=mode,
            broker=pick("broker", "EH_BROKER", ""),
            topic=pick("topic", f"TOPIC_{kind.upper()}", TOPICS[kind]),
            group=pick("group", "GROUP_ID", GROUP),
            alerts_topic=pick(None, "TOPIC_ALERTS", ALERTS_TOPIC),
            password=pick(None, "EH_LISTEN", ""),
        )


def detect_alerts(messages: DataFrame, rule: SequenceRule, delay: str) -> DataFrame:
    """Topic messages (``value, timestamp, seq``) to alerts. A missing ``ts`` becomes the time the
    message reached the topic, so that a replay gives the same alerts."""
    arrived = messages.selectExpr("value", "seq", "unix_millis(timestamp) AS arrived_ms")
    events = with_event_time(decode_events(arrived, default_ts=arrived["arrived_ms"]))
    return to_alerts(match_sequence_stream(events, rule, delay))


def quarantine(messages: DataFrame, checkpoint: str, out: str, every: str | None = CHECKPOINT_INTERVAL) -> StreamingQuery:
    """The messages that strict decoding leaves out, unchanged, as a table."""
    return write_stream(broken_values(messages), f"{out}/quarantine", f"{checkpoint}/quarantine", every, name="quarantine")


def detect(
    messages: DataFrame, settings: Settings, checkpoint: str, out: str, delay: str
) -> list[StreamingQuery]:
    """Alerts to their topic, broken messages to the quarantine."""
    alerts = detect_alerts(messages, rule_for_mode(settings.mode), delay)
    sent = write_alerts(
        alerts, topic_options(settings.broker, settings.password), settings.alerts_topic,
        f"{checkpoint}/detect-{settings.mode}", CHECKPOINT_INTERVAL)
    return [sent, quarantine(messages, f"{checkpoint}/detect-{settings.mode}", out)]


def ingest(messages: DataFrame, checkpoint: str, out: str, every: str | None = CHECKPOINT_INTERVAL) -> list[StreamingQuery]:
    """The event tables."""
    return start_event_streams(messages, Tables(out), f"{checkpoint}/ingest", every)


def analyse(
    messages: DataFrame, checkpoint: str, out: str, database: str = "fraud", every: str | None = CHECKPOINT_INTERVAL
) -> list[StreamingQuery]:
    """The alert tables, with the features that ``ingest`` writes, or else the tables of ``database`` as they stand."""
    tables, spark = Tables(out), messages.sparkSession
    fraud, insider = (
        tables.stream_or_static(spark, name, f"{database}.{name}") for name in ("features_fraud", "features_insider"))
    return start_alert_streams(messages, fraud, insider, tables, f"{checkpoint}/analyse", every)


def train_model(spark: SparkSession, out: str, path: str) -> DataFrame:
    """Train on the payments that ``ingest`` has written, save the model, and return its figures on held-out rows."""
    train_rows, test_rows = split(training_set(Tables(out).read(spark, "features_fraud")))
    model = train(train_rows)
    save(model, path)
    return evaluate(test_rows, model)


def score_payments(
    messages: DataFrame, checkpoint: str, out: str, model: str, every: str | None = SCORING_INTERVAL
) -> StreamingQuery:
    payments = with_event_time(decode_events(messages.select("value"), "lenient"))
    return write_stream(
        decide(score(payments, load(model))), f"{out}/realtime_scored", f"{checkpoint}/score", every, name="score")


def await_all(spark: SparkSession, queries: Sequence[StreamingQuery]) -> None:
    """Wait until every query has ended; the first that fails raises its error, which names it."""
    while any(query.isActive for query in queries):
        spark.streams.awaitAnyTermination()
        spark.streams.resetTerminated()


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wardline")
    parser.add_argument("job", choices=["detect", "ingest", "analyse", "train", "score", "compact"])
    for name in ("mode", "broker", "topic", "group", "model", "table"):
        parser.add_argument(f"--{name}")
    for name, what in (("checkpoint", "progress and state"), ("out", "the tables")):
        parser.add_argument(f"--{name}", required=True, help=f"folder of {what}, shared by all executors")
    parser.add_argument("--delay", default="10 minutes", help="how late an event may come")
    parser.add_argument("--messages-per-batch", type=int, default=MESSAGES_PER_BATCH, help="for detect")
    args = vars(parser.parse_args(argv))
    if args["job"] in ("train", "score") and not args["model"]:
        parser.error(f"{args['job']} needs --model")
    if args["job"] == "compact" and args["table"] not in CLUSTERED_BY:
        parser.error(f"compact needs --table, one of {', '.join(CLUSTERED_BY)}")
    spark = configure(SparkSession.builder.appName(f"wardline-{args['job']}").getOrCreate())
    settings, checkpoint, out = Settings.of(args), args["checkpoint"], args["out"]

    def topics(*names: str, **options) -> DataFrame:
        return read_topics(spark, source_options(settings.broker, *names, password=settings.password, **options))

    if args["job"] == "train":
        train_model(spark, out, args["model"]).show()
        return
    if args["job"] == "compact":
        Tables(out).compact(spark, args["table"])
        return
    if args["job"] == "detect":
        messages = topics(settings.topic, group=settings.group, max_per_trigger=args["messages_per_batch"])
        queries = detect(messages, settings, checkpoint, out, args["delay"])
    elif args["job"] == "ingest":
        queries = ingest(topics(*TOPICS.values(), starting="latest"), checkpoint, out)
    elif args["job"] == "analyse":
        queries = analyse(topics(settings.alerts_topic, starting="latest"), checkpoint, out)
    else:
        queries = [score_payments(topics(TOPICS["fraud"], starting="latest"), checkpoint, out, args["model"])]
    await_all(spark, queries)


if __name__ == "__main__":
    main()
