"""Telemetry records in OTLP/JSON to rows, and rows in line-wise JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_value = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string>"
_attrs = f"array<struct<key:string,value:{_value}>>"
_resource = f"resource:struct<attributes:{_attrs}>"
TRACES = f"resourceSpans array<struct<{_resource},scopeSpans:array<struct<scope:struct<name:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_attrs},status:struct<code:string,message:string>,links:array<struct<traceId:string,spanId:string,traceState:string>>>>>>>>"
_point = f"struct<attributes:{_attrs},timeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,exemplars:array<struct<timeUnixNano:string,asDouble:double,asInt:string,traceId:string,spanId:string,filteredAttributes:{_attrs}>>>"
METRICS = f"resourceMetrics array<struct<{_resource},scopeMetrics:array<struct<metrics:array<struct<name:string,description:string,unit:string,gauge:struct<dataPoints:array<{_point}>>,sum:struct<dataPoints:array<{_point}>,isMonotonic:boolean>,histogram:struct<dataPoints:array<{_point}>>>>>>>>"
LOGS = f"resourceLogs array<struct<{_resource},scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,severityNumber:int,severityText:string,body:{_value},attributes:{_attrs},traceId:string,spanId:string>>>>>>"
ZERO_PARENT = "0" * 16
#: Camel-case records of line-wise files by signal.
RECORDS = {
    "logs": "timestampNanos long, severityNumber int, severityText string, body string, attributes map<string,string>, traceId string, spanId string, serviceName string, scopeName string, receivedAtMs long",
    "traces": "traceId string, spanId string, parentSpanId string, name string, kind int, startTimeNanos long, endTimeNanos long, attributes map<string,string>, statusCode int, statusMessage string, serviceName string, scopeName string, receivedAtMs long",
    "metrics": "name string, description string, unit string, type string, serviceName string, dataPoints array<struct<attributes:map<string,string>,timestampNanos:bigint,value:double,count:bigint,sum:double,bucketCounts:array<bigint>,explicitBounds:array<double>>>, receivedAtMs long",
}


def _text(v: Column) -> Column:
    """Any value as text: whole doubles as they are, missing ones ''."""
    return F.coalesce(v.stringValue, v.intValue, v.doubleValue.cast("string"), v.boolValue.cast("string"), v.bytesValue, F.lit(""))


def _bag(attributes: Column) -> Column:
    some = F.coalesce(attributes, F.array().cast(_attrs))
    last = F.filter(some, lambda x, i: ~F.exists(F.slice(some, i + 2, F.size(some)), lambda y: y.key == x.key))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x.key, _text(x.value))))


def _service(resource: Column) -> Column:
    own = F.filter(F.coalesce(resource.attributes, F.array().cast(_attrs)), lambda x: x.key == "service.name")
    return F.coalesce(F.get(own, F.size(own) - 1).value.stringValue, F.lit(""))


def _lower(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def _long(x: Column) -> Column:
    return F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))


def _number(x: Column, names: dict[str, int]) -> Column:
    """An enumeration given as number or name."""
    out = x.try_cast("int")
    for name, n in names.items():
        out = F.when(x == name, n).otherwise(out)
    return F.coalesce(out, F.lit(0))


def otlp_traces(df: DataFrame, column: str = "value", received_at_ms: Column | None = None) -> DataFrame:
    """A row for each span; malformed records give none.  Ids are lower-case hex, an all-zero parent is ''."""
    r = df.select(F.explode(F.from_json(column, TRACES).resourceSpans).alias("r"))
    s = r.select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeSpans").alias("c")).select("service_name", F.coalesce("c.scope.name", F.lit("")).alias("scope_name"), F.explode("c.spans").alias("s"))
    parent = _lower(F.col("s.parentSpanId"))
    kinds = {f"SPAN_KIND_{k}": n for n, k in enumerate(("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"))}
    codes = {f"STATUS_CODE_{k}": n for n, k in enumerate(("UNSET", "OK", "ERROR"))}
    return s.select(
        _lower(F.col("s.traceId")).alias("trace_id"), _lower(F.col("s.spanId")).alias("span_id"), F.when(parent == ZERO_PARENT, "").otherwise(parent).alias("parent_span_id"), F.coalesce("s.traceState", F.lit("")).alias("trace_state"),
        F.col("s.name").alias("name"), _number(F.col("s.kind"), kinds).alias("kind"), _long(F.col("s.startTimeUnixNano")).alias("start_time_nano"), _long(F.col("s.endTimeUnixNano")).alias("end_time_nano"),
        (_long(F.col("s.endTimeUnixNano")) - _long(F.col("s.startTimeUnixNano"))).alias("duration_nano"), _bag(F.col("s.attributes")).alias("attributes"), _number(F.col("s.status.code"), codes).alias("status_code"),
        F.coalesce("s.status.message", F.lit("")).alias("status_message"), "service_name", "scope_name", F.coalesce(F.to_json("s.links"), F.lit("[]")).alias("span_links"), _received(received_at_ms),
    )


def _received(given: Column | None) -> Column:
    return (F.unix_millis(F.current_timestamp()) if given is None else given).alias("received_at_ms")


def otlp_metrics(df: DataFrame, column: str = "value", received_at_ms: Column | None = None) -> DataFrame:
    """A row for each metric with its points; kinds other than gauge, sum and histogram have none."""
    r = df.select(F.explode(F.from_json(column, METRICS).resourceMetrics).alias("r"))
    m = r.select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeMetrics").alias("c")).select("service_name", F.explode("c.metrics").alias("m"))
    kind = F.when(F.col("m.gauge").isNotNull(), "GAUGE").when(F.col("m.sum").isNotNull(), "SUM").when(F.col("m.histogram").isNotNull(), "HISTOGRAM").otherwise("UNSPECIFIED")
    points = F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints", "m.histogram.dataPoints", F.array().cast(f"array<{_point}>"))

    def point(p: Column) -> Column:
        exemplar = lambda e: F.struct(_long(e.timeUnixNano).alias("timestamp_nano"), F.coalesce(e.asDouble, e.asInt.try_cast("double"), F.lit(0.0)).alias("value"), _lower(e.traceId).alias("trace_id"), _lower(e.spanId).alias("span_id"), _bag(e.filteredAttributes).alias("attributes"))
        return F.struct(
            _bag(p.attributes).alias("attributes"), _long(p.timeUnixNano).alias("timestamp_nano"), F.coalesce(p.asDouble, p.asInt.try_cast("double"), F.lit(0.0)).alias("value"), _long(p["count"]).alias("count"), F.coalesce(p["sum"], F.lit(0.0)).alias("sum"),
            F.transform(F.coalesce(p.bucketCounts, F.array().cast("array<string>")), _long).alias("bucket_counts"), F.coalesce(p.explicitBounds, F.array().cast("array<double>")).alias("bounds"), F.transform(F.coalesce(p.exemplars, F.array().cast(f"{_exemplars}")), exemplar).alias("exemplars"),
        )

    return m.select(F.col("m.name").alias("name"), F.coalesce("m.description", F.lit("")).alias("description"), F.coalesce("m.unit", F.lit("")).alias("unit"), kind.alias("type"), F.transform(points, point).alias("data_points"), "service_name", _received(received_at_ms))


_exemplars = f"array<struct<timeUnixNano:string,asDouble:double,asInt:string,traceId:string,spanId:string,filteredAttributes:{_attrs}>>"


def otlp_logs(df: DataFrame, column: str = "value", received_at_ms: Column | None = None) -> DataFrame:
    """A row for each log record; the body as text."""
    r = df.select(F.explode(F.from_json(column, LOGS).resourceLogs).alias("r"))
    s = r.select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeLogs").alias("c")).select("service_name", F.coalesce("c.scope.name", F.lit("")).alias("scope_name"), F.explode("c.logRecords").alias("l"))
    return s.select(_long(F.col("l.timeUnixNano")).alias("timestamp_nano"), F.coalesce("l.severityNumber", F.lit(0)).alias("severity_number"), F.coalesce("l.severityText", F.lit("")).alias("severity_text"), F.coalesce(_text(F.col("l.body")), F.lit("")).alias("body"),
                    _bag(F.col("l.attributes")).alias("attributes"), _lower(F.col("l.traceId")).alias("trace_id"), _lower(F.col("l.spanId")).alias("span_id"), "service_name", "scope_name", _received(received_at_ms))


#: Bytes of the longest line that is read (fixed value).
MOST_BYTES = 4 << 20


def read_signal_jsonl(spark: SparkSession, path: str, signal: str, stream: bool = False) -> DataFrame:
    """Records of line-wise JSON files of a signal; lines that don't parse, or are longer than MOST_BYTES, are left out."""
    reader = spark.readStream if stream else spark.read
    return _records(reader.text(path), RECORDS[signal]).select("r.*")


def _records(lines: DataFrame, schema: str, name: str = "r") -> DataFrame:
    """lines with the record of each ``value`` that has one."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.filter(F.octet_length("value") <= MOST_BYTES).withColumn(name, parsed).filter(F.col(name).isNotNull() & F.col(name)["_bad"].isNull())
    return rows.withColumn(name, F.col(name).dropFields("_bad"))


def write_signal_jsonl(df: DataFrame, path: str, received: str = "receivedAtMs") -> None:
    """Records appended as line-wise JSON, by date of receipt (UTC)."""
    df.withColumn("dt", F.to_date(F.timestamp_millis(F.coalesce(F.col(received), F.lit(0))))).write.partitionBy("dt").mode("append").json(path)


def write_dlq(df: DataFrame, path: str, reason: str, day: str, signal: str) -> None:
    """Rows of a failed batch as lines with the reason and a batch of one row: nothing is gathered, so any batch can be written."""
    line = F.to_json(F.struct(F.lit(reason).alias("error_reason"), F.array(F.struct(*df.columns)).alias("batch")))
    df.select(line.alias("value")).write.mode("append").text(f"{path}/{signal}-{day}")


def read_dlq(spark: SparkSession, path: str, signal: str, today: str) -> DataFrame:
    """Rows of failed batches of days before today, from lines with a batch and from lines with one row."""
    day = F.regexp_extract(F.input_file_name(), rf"/{signal}-(\d{{4}}-\d{{2}}-\d{{2}})[^/]*(?:/|$)", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("day", day)
    return dlq_rows(lines.filter((F.col("day") != "") & (F.col("day") != today)), signal)


def dlq_rows(lines: DataFrame, signal: str) -> DataFrame:
    """The rows of dead-letter lines (``value``)."""
    schema = RECORDS[signal]
    struct = "struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in _columns(schema)) + ">"
    both = _records(_records(lines, f"error_reason string, batch array<{struct}>", "b"), schema)
    batch = both.filter("b.batch is not null").select(F.explode("b.batch").alias("r")).select("r.*")
    bare = both.filter("b.batch is null and b.error_reason is null").select("r.*").dropna("all")
    return batch.unionByName(bare)


def _columns(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]
