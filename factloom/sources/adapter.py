"""An event table as a source-event log, and delivery sequences over it for the ingest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import context_fingerprint, instant, sha256


def numbered(df: DataFrame, group: list[str], order: list[str], bucket) -> DataFrame:
    """source_sequence: place in ``order`` inside a group, from 1, without a group ever meeting in one task.

    bucket: an expression that never falls along ``order``. Rows are numbered inside (group, bucket); the buckets' counts,
    a few for each group, give each bucket what stands before it.
    """
    staged = df.withColumn("_b", bucket)
    counts = staged.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))
    return staged.withColumn("_r", place).join(bases, [*group, "_b"]).withColumn("source_sequence", F.col("_r") + F.col("_base")).drop("_b", "_r", "_base")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as source events: three tenants, three engagements of ten days, one stream for each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("occurred_at"), "user_id", F.col("event_type").alias("et"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    number = F.when(F.col("occurred_at") < F.lit("2024-01-11").cast("timestamp"), 1).when(F.col("occurred_at") < F.lit("2024-01-21").cast("timestamp"), 2).otherwise(3)
    tenant = (F.col("user_id") % 3).cast("string")
    e = e.withColumn("n", number).select(
        "*",
        F.concat(F.lit("tenant-"), tenant).alias("tenant_id"),
        F.concat(F.lit("eng-"), F.col("n")).alias("engagement_id"),
        F.concat(F.lit("stream-"), tenant, F.lit("-"), F.col("n")).alias("source_stream_id"),
        F.concat(F.lit("evt-"), F.col("event_id")).alias("source_event_id"),
        F.when(F.col("et") == "signup", "asset_observation").when(F.col("et") == "error", "finding_observation").otherwise("test_attempt").alias("event_type"),
        F.concat(F.lit("deploy-"), F.col("user_id")).alias("resource_uid"),
        F.concat(F.lit("check-"), F.col("k") % 4).alias("verification_key"),
        F.concat(F.lit("vuln-"), F.col("k") % 4).alias("vuln_class"),
        F.concat(F.lit("loc-"), F.col("k") % 4).alias("location"),
        F.when((F.col("et") != "error") & (F.col("k") % 10 == 0), "2.0.0").otherwise("1.0.0").alias("check_version"),
        F.concat(F.lit("cluster-"), (F.col("user_id") % 2).cast("string")).alias("cluster_id"),
        F.lit("Deployment").alias("resource_kind"),
        F.when((F.col("et") != "error") & (F.col("k") % 10 == 1), 8443).otherwise(443).alias("port"),
        F.when((F.col("et") != "error") & (F.col("k") % 25 == 3), 2).otherwise(1).alias("compatibility_policy_version"),
        F.when(F.col("et") == "view", "partial").when(F.col("et").isin("click", "purchase"), "completed").alias("execution_status"),
        F.when(F.col("et") == "click", "not_detected").when(F.col("et") == "purchase", "detected").alias("result"),
    )
    fingerprint = context_fingerprint(F.lit("https"), F.col("port"), F.concat(F.lit("/"), F.col("location")), None, F.lit(False), F.lit(None).cast("string"))
    e = e.withColumn("relevant_context_hash", fingerprint)
    return numbered(e, ["tenant_id", "engagement_id", "source_stream_id"], ["occurred_at", "event_id"], F.date_trunc("hour", "occurred_at")).drop("et", "n", "user_id").withColumn("source_sequence", F.col("source_sequence").cast("long"))


def deliveries(log: DataFrame) -> DataFrame:
    """The log as it arrives, then redeliveries, changed duplicates, taken positions and a stream of another tenant.

    arrival: place in the order of arrival. content: what the canonical hash would cover.
    """
    base = log.select("tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", F.col("event_id").alias("arrival"), F.concat_ws("|", "event_type", "resource_uid", "k").alias("content"), "event_id")
    late = F.lit(1_000_000_000).cast("long")
    again = base.where("event_id % 20 = 0").withColumn("arrival", F.col("event_id") + late)
    changed = base.where("event_id % 50 = 1").withColumn("arrival", F.col("event_id") + late).withColumn("content", F.concat("content", F.lit("|changed")))
    taken = base.where("event_id % 70 = 2").withColumn("arrival", F.col("event_id") + late).withColumn("source_event_id", F.concat(F.lit("dup-"), F.col("event_id")))
    foreign = base.where("event_id % 90 = 3 and tenant_id = 'tenant-0'").withColumn("arrival", F.col("event_id") + 2 * late).withColumn("tenant_id", F.lit("tenant-x")).withColumn("engagement_id", F.lit("eng-x"))
    return base.unionByName(again).unionByName(changed).unionByName(taken).unionByName(foreign).drop("event_id")


def with_markers(log: DataFrame, positions: DataFrame) -> DataFrame:
    """The log as it arrives stream by stream, with a completion marker after each limit and a few events later than that.

    positions: the limit of each stream. last_data_sequence is null for data. A marker stands at the limit plus one.
    """
    content = F.concat_ws("|", "event_type", "resource_uid", "k")
    late = F.when(F.col("event_id") % 40 == 7, 1_000_000_000).otherwise(0)
    data = log.select("tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", (2 * F.col("source_sequence") + late).cast("long").alias("arrival"), content.alias("content"), F.lit(None).cast("long").alias("last_data_sequence"))
    again = data.where("source_sequence % 30 = 4").withColumn("arrival", F.col("arrival") + 2_000_000_000)
    limit = F.col("last_data_sequence")
    owners = log.select("tenant_id", "engagement_id", "source_stream_id").distinct().join(positions, ["tenant_id", "source_stream_id"])
    marks = owners.select("tenant_id", "engagement_id", "source_stream_id", (limit + 1).alias("source_sequence"), F.concat(F.lit("mark-"), "source_stream_id").alias("source_event_id"), (2 * limit + 1).alias("arrival"), F.lit("marker").alias("content"), limit.alias("last_data_sequence"))
    return data.unionByName(again).unionByName(marks)


def journal_deliveries(log: DataFrame, limits: DataFrame) -> DataFrame:
    """The log up to the limit of each stream, with a marker behind it, as :func:`factloom.operators.journal.deliveries` gives them."""
    keys = ["tenant_id", "engagement_id", "source_stream_id"]
    inside = log.join(limits, keys).where(F.col("source_sequence") <= F.col("last_data_sequence")).drop("last_data_sequence")
    data = inside.withColumns({"arrival": F.col("event_id"), "canonical_source_hash": event_hash(), "last_data_sequence": F.lit(None).cast("long")})
    marks = limits.select(*keys, (F.col("last_data_sequence") + 1).alias("source_sequence"), F.concat(F.lit("mark-"), "source_stream_id").alias("source_event_id"), F.lit("engagement_completed").alias("event_type"), F.lit(10**12).alias("arrival"), "last_data_sequence")
    marks = marks.withColumn("canonical_source_hash", sha256(F.concat_ws("|", "source_event_id", "last_data_sequence")))
    both = data.unionByName(marks, allowMissingColumns=True)
    return both.withColumns({"content": F.col("canonical_source_hash"), "dns": F.lit(None).cast("string"), "labels": F.lit(None).cast("map<string,string>")})


def raw_attempts(log: DataFrame) -> DataFrame:
    """``(event_id, json)``: the attempts as JSON texts, some of them broken in one of the ways a codec must survive."""
    context = F.struct(F.lit("https").alias("protocol"), F.col("port"), F.concat(F.lit("/"), F.col("location")).alias("normalized_route"), F.lit(False).alias("is_address_bound"))
    payload = F.struct("verification_key", "resource_uid", "cluster_id", "resource_kind", "check_version", context.alias("relevant_context"), "execution_status", "result", "compatibility_policy_version")
    event = F.struct("source_event_id", "event_type", "source_stream_id", "source_sequence", F.lit(1).alias("schema_version"), instant(F.col("occurred_at")).alias("occurred_at"), payload.alias("payload"))
    text = F.to_json(event)
    kind = F.col("event_id") % 20
    broken = (
        F.when(kind == 0, F.regexp_replace(text, r'"source_sequence":\d+', '"source_sequence":1180591620717411303424'))
        .when(kind == 1, F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"z":1}')))
        .when(kind == 2, F.expr("left(j, length(j) - 1)"))
        .when(kind == 3, F.regexp_replace(text, r'"source_event_id":"[^"]*"', r'"source_event_id":"\\ud800"'))
        .when(kind == 4, F.concat(F.repeat(F.lit("["), 700), F.repeat(F.lit("]"), 700)))
        .otherwise(text)
    )
    attempts = log.where("event_type = 'test_attempt'").withColumn("j", text)
    return attempts.select("event_id", broken.alias("json"))


def event_hash() -> Column:
    """A digest of an event's own content, for the digest of a plan's inputs."""
    return sha256(F.concat_ws("|", "source_event_id", "event_type", "resource_uid", "verification_key"))
