"""The tables from raw topic values to gold, written one after the other.

Each table is written once and read by the next, so nothing is computed twice and a lost executor
costs at most the tasks of one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardline.plans import alerts as alert_plans
from wardline.plans import events as event_plans
from wardline.plans import gold
from wardline.sources import compaction
from wardline.sources.tables import write_table
from wardline.streaming.combined import stream_combined_threat_analytics
from wardline.streaming.runs import write_stream

# The column each table is clustered by.
CLUSTERED_BY = {
    "bronze_alerts": "ts",
    "silver_alerts": "event_time",
    "gold_alert_dashboard": "window_start",
    "gold_daily_alert_summary": "date",
    "gold_alert_patterns": "pattern_date",
    "gold_alert_pattern_entities": "window_start",
    "gold_combined_threat_analytics": "date",
    "gold_executive_dashboard": "date",
    "bronze": "ts",
    "silver": "event_time",
    "features_fraud": "event_time",
    "features_insider": "event_time",
}
_TIES = {
    "bronze_alerts": ("id",), "silver_alerts": ("id",), "bronze": ("cardId", "actor"),
    "silver": ("cardId", "actor"), "features_fraud": ("cardId",), "features_insider": ("actor",),
    "gold_alert_pattern_entities": ("rule", "entity"),
}


@dataclass(frozen=True)
class Tables:
    """Where the tables live: ``{root}/{name}``."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        return write_table(rows, self.path(name), CLUSTERED_BY[name], *_TIES.get(name, ()))

    def stream(self, name: str, like: DataFrame) -> DataFrame:
        """The rows that another running stream appends to ``name``; the table may not exist yet."""
        spark = like.sparkSession
        spark.createDataFrame([], like.schema).write.mode("ignore").parquet(self.path(name))
        return spark.readStream.schema(like.schema).parquet(self.path(name))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))

    def stream_or_static(self, spark: SparkSession, name: str, fallback: str) -> DataFrame:
        """The stream of what is appended to ``name``, or the catalog table ``fallback`` as it stands now if no job
        has written ``name`` here. A folder that is there but can't be read is an error."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.table(fallback)
        return spark.readStream.schema(self.read(spark, name).schema).parquet(self.path(name))

    def _store(self, name: str) -> str:
        return f"{self.root}/compacted/{name}"

    def compact(
        self, spark: SparkSession, name: str, schema: StructType | None = None, target: int = compaction.TARGET
    ) -> int:
        """Gather the small files of ``name``, which a stream may be writing, and return the version of the result."""
        columns = [CLUSTERED_BY[name], *_TIES.get(name, ())[:1]]
        schema = schema or self.read(spark, name).schema
        return compaction.compact(spark, self.path(name), self._store(name), schema, columns, target)

    def read_compacted(self, spark: SparkSession, name: str, schema: StructType | None = None) -> DataFrame:
        """All rows of ``name``, from compacted files as far as there are any."""
        return compaction.read(spark, self.path(name), self._store(name), schema or self.read(spark, name).schema)

    def lay_out(self, spark: SparkSession, name: str) -> DataFrame:
        """A copy of ``name`` under ``laid_out`` with rows of neighbouring values side by side: streams append many
        small files in order of arrival, which scans can't skip."""
        return write_table(self.read(spark, name), f"{self.root}/laid_out/{name}", CLUSTERED_BY[name], *_TIES.get(name, ()))


def build_event_tables(raw: DataFrame, tables: Tables, mode: str = "lenient", observe=None) -> dict[str, DataFrame]:
    """bronze, silver, features_fraud, features_insider."""
    bronze = tables.write("bronze", event_plans.bronze_events(raw.select("value"), mode, observe=observe))
    silver = tables.write("silver", event_plans.silver_events(bronze))
    return {
        "bronze": bronze,
        "silver": silver,
        "features_fraud": tables.write("features_fraud", event_plans.features_fraud(silver)),
        "features_insider": tables.write("features_insider", event_plans.features_insider(silver)),
    }


def build_alert_tables(
    raw: DataFrame,
    fraud: DataFrame,
    insider: DataFrame,
    tables: Tables,
    ingestion_ts: Column | None = None,
    observe=None,
) -> dict[str, DataFrame]:
    """bronze_alerts, silver_alerts and the gold tables."""
    built = {}

    def add(name: str, rows: DataFrame) -> DataFrame:
        built[name] = tables.write(name, rows)
        return built[name]

    bronze = add("bronze_alerts", alert_plans.bronze_alerts(raw, ingestion_ts, observe))
    silver = add("silver_alerts", alert_plans.silver_alerts(bronze))
    for name, build in _GOLD.items():
        add(name, build(silver))
    add("gold_combined_threat_analytics", gold.combined_threat_analytics(silver, fraud, insider))
    return built


_GOLD = {
    "gold_alert_dashboard": gold.alert_dashboard,
    "gold_daily_alert_summary": gold.daily_alert_summary,
    "gold_alert_patterns": gold.alert_patterns,
    "gold_alert_pattern_entities": gold.pattern_entities,
    "gold_executive_dashboard": gold.executive_dashboard,
}


def start_event_streams(
    raw: DataFrame, tables: Tables, checkpoints: str, every: str | None
) -> list[StreamingQuery]:
    """bronze, silver, features_fraud and features_insider as running streams, each over the table before."""
    bronze = event_plans.bronze_events(raw.select("value"), observe="events")
    silver = event_plans.silver_events(tables.stream("bronze", bronze))
    grown = tables.stream("silver", silver)
    return _start({
        "bronze": bronze,
        "silver": silver,
        "features_fraud": event_plans.features_fraud(grown),
        "features_insider": event_plans.features_insider(grown),
    }, tables, checkpoints, every)


def start_alert_streams(
    raw: DataFrame, fraud: DataFrame, insider: DataFrame, tables: Tables, checkpoints: str,
    every: str | None,
) -> list[StreamingQuery]:
    """bronze_alerts with the provenance ``raw`` brings, silver_alerts and the gold tables as running streams,
    each over the table before. The features may be streams or tables."""
    bronze = alert_plans.bronze_alerts(raw, observe="alerts")
    silver = alert_plans.silver_alerts(tables.stream("bronze_alerts", bronze))
    grown = tables.stream("silver_alerts", silver)
    streams = {"bronze_alerts": bronze, "silver_alerts": silver} | {name: build(grown) for name, build in _GOLD.items()}
    streams["gold_combined_threat_analytics"] = stream_combined_threat_analytics(grown, fraud, insider)
    return _start(streams, tables, checkpoints, every)


def _start(
    streams: dict[str, DataFrame], tables: Tables, checkpoints: str, every: str | None
) -> list[StreamingQuery]:
    """One query per table, in order. With ``every=None`` each runs over what is there now before the
    next one starts."""
    queries = []
    for name, rows in streams.items():
        queries.append(write_stream(rows, tables.path(name), f"{checkpoints}/{name}", every, name=name))
        if every is None:
            queries[-1].awaitTermination()
    return queries
