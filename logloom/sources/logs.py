"""Log lines from tables: event rendering, synthetic load, files; and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Templates of the synthetic load (i and j count from 1, spt is a port, sec a second).
TEMPLATES = {
    "cef": (
        "CEF:0|PaloAltoNetworks|PAN-OS|10.1.0|TRAFFIC|traffic|1|src=192.168.1.{i} dst=10.0.0.{j} spt={spt} dpt=443 proto=tcp act=allow cn1=4520 cs1=corp-web",
        "CEF:0|CheckPoint|VPN-1|R81|Accept|1|src=10.10.1.{i} dst=172.16.0.{j} spt={spt} dpt=80 proto=tcp act=allow msg=connection_accepted",
        "CEF:0|CrowdStrike|Falcon|6.30|Alert|5|src=192.168.100.{i} dst=1.1.1.1 spt={spt} dpt=53 proto=udp act=block msg=DNS_Tunneling_Detected",
        "CEF:0|Fortinet|FortiGate|7.0|deny|2|src=172.20.1.{i} dst=192.168.2.{j} spt={spt} dpt=22 proto=tcp act=deny msg=SSH_BruteForce",
    ),
    "syslog": (
        "<134>1 2026-09-19T00:00:{sec}Z perimeter-gw-01 sshd 12401 ID47 [auth user=admin src_ip=192.168.1.{i} port={spt}] Accepted publickey for admin",
        "<14>1 2026-09-19T00:00:{sec}Z core-switch-02 kernel - - [net src=10.1.1.{i} dst=10.2.2.{j} proto=UDP len=64] Packet dropped by ACL",
        "<86>1 2026-09-19T00:00:{sec}Z waf-node-03 nginx 8421 - [http status=403 method=GET path=/api/v1/auth client=192.168.50.{i}] WAF signature match 941100",
    ),
    "key_value": (
        "timestamp=2026-09-19T00:00:{sec}Z vendor=Fortinet devname=FGT-HQ action=deny srcip=10.0.1.{i} dstip=192.168.1.{j} srcport={spt} dstport=443 proto=6 service=HTTPS duration=12 sentbyte=1400 rcvdbyte=0",
        "timestamp=2026-09-19T00:00:{sec}Z vendor=PaloAlto type=THREAT subtype=vulnerability src=192.168.10.{i} dst=10.10.0.{j} sport={spt} dport=8080 proto=tcp action=reset-both threat=SQLi",
        "timestamp=2026-09-19T00:00:{sec}Z vendor=CiscoASA tag=ASA-6-302013 built inbound TCP connection src=172.16.1.{i}:{spt} dst=10.0.0.{j}:443 action=permit",
    ),
    "json": (
        '{"timestamp":"2026-09-19T00:00:{sec}Z","source":"aws.cloudtrail","event_name":"ConsoleLogin","user_identity":{"type":"IAMUser","user_name":"secops-{i}"},"source_ip_address":"198.51.100.{i}","response_elements":{"ConsoleLogin":"Success"},"status":"ALLOW"}',
        '{"timestamp":"2026-09-19T00:00:{sec}Z","source":"okta","action":"user.authentication.auth_via_mfa","actor":{"alternate_id":"user{i}@corp.local"},"client":{"ip":"203.0.113.{i}"},"outcome":{"result":"SUCCESS"}}',
    ),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with the fields of a connection log, derived from its columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ip = lambda head, *parts: F.concat_ws(".", F.lit(head), *(p.cast("string") for p in parts))
    user, event = F.col("user_id"), F.col("event_id")
    octet = lambda c, n: F.floor(c / n) % 256
    action = F.when(F.col("event_type").isin("click", "view"), "allow").when(F.col("event_type").isin("purchase", "signup"), "login").otherwise("deny")
    return e.select(
        "event_id", "ts", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        ip("10", octet(user, 65536), octet(user, 256), user % 256).alias("src"), ip("172.16", octet(event, 256), event % 256).alias("dst"),
        F.element_at(F.array(*map(F.lit, (22, 80, 443, 445, 3389))), (event % 5).cast("int") + 1).alias("dpt"), action.alias("act"),
        F.when(event % 2 == 0, "tcp").otherwise("udp").alias("proto"), (F.round(F.col("value") * 100).cast("long") * 1000).alias("bytes"), F.when(action == "login", F.concat(F.lit("user "), user.cast("string"))).alias("usr"),
    )


def as_kv() -> Column:
    c = F.col
    return F.concat(F.lit("ts="), c("iso"), F.lit(" src="), c("src"), F.lit(" dst="), c("dst"), F.lit(" dpt="), c("dpt").cast("string"), F.lit(" action="), c("act"), F.lit(" proto="), c("proto"), F.lit(" bytes="), c("bytes").cast("string"), F.coalesce(F.concat(F.lit(' user="'), c("usr"), F.lit('"')), F.lit("")), F.lit(" sid=s"), c("event_id").cast("string"))


def _pairs(sep: str) -> Column:
    c = F.col
    return F.concat_ws(sep, F.concat(F.lit("src="), c("src")), F.concat(F.lit("dst="), c("dst")), F.concat(F.lit("dpt="), c("dpt").cast("string")), F.concat(F.lit("act="), c("act")), F.concat(F.lit("usr="), F.coalesce("usr", F.lit("none"))))


def as_cef() -> Column:
    return F.concat(F.lit("CEF:0|Acme|Wall\\|One|1.0|"), F.col("event_id").cast("string"), F.lit("|"), F.col("event_type"), F.lit("|5|"), _pairs(" "))


def as_leef(version: int = 2) -> Column:
    return F.concat(F.lit("LEEF:2.0|Acme|Gate|1.0|"), F.col("event_id").cast("string"), F.lit("|^|"), _pairs("^")) if version == 2 else F.concat(F.lit("LEEF:1.0|Acme|Gate|1.0|"), F.col("event_id").cast("string"), F.lit("|"), _pairs("\t"))


def as_syslog(version: int = 5424) -> Column:
    pri = (F.col("event_id") % 192).cast("string")
    if version == 5424:
        return F.concat(F.lit("<"), pri, F.lit(">1 "), F.col("iso"), F.lit(" fw-01 gate "), F.col("event_id").cast("string"), F.lit(' ID47 [meta seq="'), F.col("event_id").cast("string"), F.lit('"] '), _pairs(" "))
    return F.concat(F.lit("<"), pri, F.lit(">"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" fw-01 gate["), F.col("event_id").cast("string"), F.lit("]: "), _pairs(" "))


def as_json() -> Column:
    return F.to_json(F.struct(F.struct(F.struct(F.col("src").alias("ip")).alias("src"), F.struct(F.col("dst").alias("ip"), F.col("dpt").alias("port")).alias("dst")).alias("net"), F.col("act").alias("action"), F.array("proto", "event_type").alias("tags")))


def as_csv() -> Column:
    return F.concat_ws(",", "iso", "src", "dst", F.col("dpt").cast("string"), F.concat(F.lit('"'), "act", F.lit(', ""'), "proto", F.lit('"""')))


def rendered(index: Column, kind: str) -> Column:
    """The synthetic line of an index."""
    line = F.element_at(F.array(*map(F.lit, TEMPLATES[kind])), (index % len(TEMPLATES[kind])).cast("int") + 1)
    for name, value in (("{i}", index % 250 + 1), ("{j}", F.floor(index / 250) % 250 + 1), ("{spt}", 1024 + index % 60000), ("{sec}", F.lpad((index % 60).cast("string"), 2, "0"))):
        line = F.replace(line, F.lit(name), value.cast("string"))
    return line


def load(spark: SparkSession, n: int, kind: str = "key_value") -> DataFrame:
    """n synthetic lines by index; the same for the same index."""
    return spark.range(n).select(F.col("id").alias("line"), rendered(F.col("id"), kind).alias("raw"))


def paced(spark: SparkSession, per_second: int, kind: str = "key_value", corpus: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """A stream of synthetic lines, or of a corpus in turn, at so many a second; Spark makes up for late batches."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    if corpus is None:
        return ticks.select(F.col("value").alias("line"), "timestamp", rendered(F.col("value"), kind).alias("raw"))
    numbered, size = placed(corpus, order), corpus.count()
    return ticks.withColumn("place", F.col("value") % max(size, 1)).join(numbered, "place").drop("place")


def placed(rows: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """Rows with their place from 0 in the order of a number or time; ties count in any order.

    Rows are ranked within ranges of the order, and each range starts after the
    rows of all before it, so no task gets all rows.
    """
    at = F.col(order).cast("double")
    bounds = rows.select(F.percentile_approx(at, F.lit([k / parts for k in range(1, parts)]), F.lit(10_000))).first()[0] or []
    ranges = rows.withColumn("_range", F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<double>"), lambda b: b < at)))
    # one row for each range
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranges.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_rank") - 1).drop("_range", "_rank", "_before")


def replay(corpus: DataFrame, n: int, order: str) -> DataFrame:
    """n lines of a corpus in turn, by an equi-join on the place in the corpus."""
    size = corpus.count()
    return corpus.sparkSession.range(n).withColumn("place", F.col("id") % max(size, 1)).join(placed(corpus, order), "place").drop("place")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (raw); blank lines dropped."""
    return spark.read.text(path).select(F.col("value").alias("raw")).where(F.trim("raw") != "")


def text_line() -> Column:
    """Structured text of a canonical, sealed event; ports that aren't there are left out."""
    c = F.col
    end = lambda side: F.concat(F.coalesce(f"{side}_ip", F.lit("")), F.coalesce(F.concat(F.lit(":"), c(f"{side}_port").cast("string")), F.lit("")))
    return F.format_string("[%s] ID=%s ACTION=%s SRC=%s DST=%s PROTO=%s SHA256=%s... DPS=1.00", c("event_time"), c("envelope_id"), F.upper("action"), end("src"), end("dst"), c("protocol"), F.substring("raw_sha256", 1, 16))


#: Columns of the CSV sink and where they come from.
CSV_COLUMNS = {
    "timestamp": "event_time", "event_id": "envelope_id", "event_class": "event_class", "event_action": "action", "outcome": "outcome", "source_vendor": "vendor", "source_product": "product",
    "src_ip": "src_ip", "src_port": "src_port", "dst_ip": "dst_ip", "dst_port": "dst_port", "protocol": "protocol", "parser_id": "parser_id", "raw_sha256": "raw_sha256", "mapping_score": "mapping_score",
}


def csv_rows(events: DataFrame) -> DataFrame:
    """The CSV sink's columns of canonical events; one that isn't there is null."""
    return events.select(*((F.col(c) if c in events.columns else F.lit(None).cast("string")).alias(n) for n, c in CSV_COLUMNS.items()))


def json_lines(events: DataFrame) -> DataFrame:
    """One JSON document (value) for each event."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def sink(events: DataFrame, kind: str, path: str, limit: int | None = None, event_class: str | None = None, mode: str = "append") -> None:
    """Write canonical events as ndjson, csv or text, at most so many and of one class if asked for."""
    if event_class is not None:
        events = events.where(F.col("event_class") == event_class)
    if limit is not None:
        events = events.limit(limit)
    if kind == "csv":
        csv_rows(events).write.mode(mode).option("header", True).csv(path)
    elif kind in ("ndjson", "text"):
        (json_lines(events) if kind == "ndjson" else events.select(text_line().alias("value"))).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown sink {kind}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_once(new: DataFrame, path: str, key: str) -> None:
    """Append rows whose id the store doesn't hold, partitioned by day and source."""
    from ..operators.firewall import unseen

    spark = new.sparkSession
    new = unseen(new, spark.read.parquet(path), key) if exists(spark, path) else new.dropDuplicates([key])
    new.write.mode("append").partitionBy("day", "source_id").parquet(path)


def stored(spark: SparkSession, path: str, refs: DataFrame, key: str = "raw_ref") -> DataFrame:
    """Raw events of a write-once store by their references."""
    return spark.read.parquet(path).join(refs.select(key).distinct(), key, "left_semi")


def recent(events: DataFrame, order: str, n: int = 5000) -> DataFrame:
    """The latest n events, as the ring buffer holds them."""
    return events.orderBy(F.desc(order)).limit(n)


def snapshot(events: DataFrame, order: str, path: str, n: int = 5000) -> None:
    """The ring's events as JSON lines, oldest first."""
    json_lines(recent(events, order, n).orderBy(order)).write.mode("overwrite").text(path)


def ring_stats(events: DataFrame, size: str, status: str, seconds: float, capacity: int = 5000) -> DataFrame:
    """One row: events, bytes, quarantined events, events the ring holds, its capacity, and events a second."""
    n = F.count("*")
    return events.agg(
        n.alias("events_received"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes_ingested"), F.count_if(F.col(status) == "QUARANTINED").alias("quarantined"),
        F.least(n, F.lit(capacity)).alias("ring_buffer_count"), F.lit(capacity).alias("ring_buffer_capacity"), F.round(n / max(1.0, seconds), 2).alias("eps_rate"), F.lit(1.0).alias("dps_ratio"),
    )
