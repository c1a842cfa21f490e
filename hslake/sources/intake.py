"""Intake of report files: closed contracts judged row by row, refused files kept with their reasons and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_US = 253402300799999999
#: The fields of a raw report and of its sockets; the schema's name ends so, whoever publishes it.
RAW_FIELDS = ["schema", "provider", "pid", "process_started_us", "operation_started_us", "timestamp_us", "local", "remote", "role", "transport", "success", "algorithm", "mode", "key_bits"]
SOCKET_FIELDS = ["address", "port"]
RAW_SCHEMA = r"^[a-z]+\.raw/1$"
RAW_BYTES, RECORDING_BYTES, RECORDING_EVENTS = 2 << 20, 16 << 20, 50_000
#: The kinds of a recording's events that are kept, and what each reports.
RECORDED = {"jdk.TLSHandshake": "Endpoint reported TLS handshake", "jdk.X509Validation": "JDK validation-chain event", "jdk.X509Certificate": "JDK parsed certificate"}


def report_files(spark: SparkSession, folder: str, *, stream: bool = False) -> DataFrame:
    """(path, size, body) of the JSON files of a folder, one report a file; as a stream, files that are new or have changed."""
    reader = spark.readStream.schema("value string") if stream else spark.read
    files = reader.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("body"))


def _members(doc: Column) -> Column:
    """The members of an object as variants, an empty map for anything else; a repeated member makes the document unreadable."""
    return F.from_json(doc, "map<string,variant>")


def _integer(v: Column, low: int, high: int) -> Column:
    value = F.try_variant_get(v, "$", "bigint")
    return F.when((F.schema_of_variant(v) == "BIGINT") & value.between(low, high), value)


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _printable(c: Column, most: int) -> Column:
    return c.isNotNull() & F.rlike(c, F.lit(rf"^[\x20-\x7E]{{1,{most}}}$"))


def concrete_address(c: Column) -> Column:
    """IPv4 in four decimal parts, or IPv6 by its form; all-zero addresses name no socket."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = F.rlike(c, F.lit(rf"^{part}(\.{part}){{3}}$")) & (c != "0.0.0.0")
    groups = F.size(F.filter(F.split(c, ":"), lambda g: g != ""))
    twice = F.size(F.regexp_extract_all(c, F.lit("::"), F.lit(0)))
    six = F.rlike(c, F.lit("^[0-9a-fA-F:]{2,45}$")) & F.rlike(c, F.lit("[1-9a-fA-F]")) & ~F.rlike(c, F.lit("[0-9a-fA-F]{5}|:::")) & ~F.rlike(c, F.lit("(^:[^:])|([^:]:$)")) & F.when(twice == 1, groups <= 7).otherwise((twice == 0) & (groups == 8))
    return F.coalesce(four | six, F.lit(False))


def raw_reports(files: DataFrame) -> DataFrame:
    """Each file of (path, size, body) with its report's fields and the reasons why it is refused; an empty list accepts it.

    The contract is closed: every field must be there, of its type and within its bounds, and no other, in the sockets too. Addresses are of one family. Files over
    2 MiB are refused by their size. Null bodies and what isn't a JSON object are refused as unreadable.
    """
    keys = F.when(F.col("size") <= RAW_BYTES, F.json_object_keys("body"))
    readable = keys.isNotNull() & (F.size(keys) == F.size(F.array_distinct(keys)))
    df = files.withColumn("_keys", F.when(readable, keys)).withColumn("_m", F.when(F.col("_keys").isNotNull(), _members(F.col("body"))))
    m = lambda k: F.col("_m")[k]
    for side in ("local", "remote"):
        df = df.withColumn(f"_{side}", F.when(F.startswith(F.schema_of_variant(m(side)), F.lit("OBJECT")), F.to_json(m(side))))
    ends = {}
    for side in ("local", "remote"):
        own = _members(F.col(f"_{side}"))
        ends |= {f"{side}_address": _text(own["address"]), f"{side}_port": _integer(own["port"], 1, 65535)}
    numbers = {"pid": (1, 4294967295), "process_started_us": (1, LAST_US), "operation_started_us": (1, LAST_US), "timestamp_us": (1, LAST_US), "key_bits": (1, 65536)}
    texts = ["schema", "provider", "role", "transport", "algorithm", "mode"]
    df = df.withColumns({**{n: _text(m(n)) for n in texts}, **{n: _integer(m(n), *b) for n, b in numbers.items()}, "success": F.when(F.schema_of_variant(m("success")) == "BOOLEAN", F.try_variant_get(m("success"), "$", "boolean")), **ends})
    here, known = F.col("_m").isNotNull(), F.array(*[F.lit(f) for f in RAW_FIELDS])
    extra = [F.size(F.array_except(F.json_object_keys(f"_{s}"), F.array(*[F.lit(f) for f in SOCKET_FIELDS]))) > 0 for s in ("local", "remote")]
    six = lambda s: F.contains(f"{s}_address", F.lit(":"))
    rules = [
        (F.col("size") > RAW_BYTES, "report exceeds 2 MiB"),
        ((F.col("size") <= RAW_BYTES) & ~here, "not a JSON object with distinct fields"),
        (here & (F.size(F.array_except("_keys", known)) > 0), "unknown field"),
        (here & (F.size(F.array_except(known, F.coalesce("_keys", F.array().cast("array<string>")))) > 0), "missing field"),
        (here & ~F.coalesce(F.rlike("schema", F.lit(RAW_SCHEMA)), F.lit(False)), "unsupported schema"),
        (here & ~F.coalesce(F.length("provider").between(1, 128), F.lit(False)), "provider"),
        *[(here & F.col(n).isNull(), n) for n in numbers],
        *[(here & ~(concrete_address(F.col(f"{s}_address")) & F.col(f"{s}_port").isNotNull() & ~F.coalesce(e, F.lit(False))), s) for s, e in zip(("local", "remote"), extra)],
        (here & F.coalesce(six("local") != six("remote"), F.lit(False)), "address families differ"),
        (here & ~F.coalesce(F.col("role").isin("client", "server"), F.lit(False)), "role"),
        (here & ~F.coalesce(F.col("transport").isin("TCP", "UDP"), F.lit(False)), "transport"),
        (here & F.col("success").isNull(), "success"),
        (here & ~_printable(F.col("algorithm"), 128), "algorithm"),
        (here & ~_printable(F.col("mode"), 64), "mode"),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for t, r in rules]), lambda r: r.isNotNull())
    fields = [c for c in RAW_FIELDS if c not in ("local", "remote")] + [*ends]
    return df.select("path", "size", F.sha2("body", 256).alias("report_id"), *fields, reasons.alias("reasons"))


def quarantined(judged: DataFrame) -> DataFrame:
    """How many files each reason refused; a file counts for each of its reasons."""
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def iso_micros(c: Column) -> Column:
    """Microseconds of an ISO time with an explicit offset; digits beyond the sixth are cut off. Null for any other form."""
    form = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})$"
    part = lambda k: F.regexp_extract(c, form, k)
    whole = F.unix_micros(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" +00:00")), F.lit("yyyy-MM-dd HH:mm:ss xxx")))
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0").cast("long")
    zone = part(4)
    minutes = F.substring(zone, 2, 2).cast("long") * 60 + F.substring(zone, 5, 2).cast("long")
    offset = F.when(zone == "Z", 0).when(F.startswith(zone, F.lit("+")), -minutes).otherwise(minutes)
    return F.when(F.rlike(c, F.lit(form)), whole + fraction + offset * 60_000_000)


RECORDING = "pid variant, process_started_us variant, process_name string, process_path string, recording struct<events: array<struct<type: string, values: variant>>>"


def recordings(files: DataFrame) -> DataFrame:
    """Each file of (path, size, body) parsed as a recording, with the reason why it is refused, or null."""
    doc = F.from_json("body", RECORDING)
    df = files.withColumn("d", F.when((F.col("size") <= RECORDING_BYTES) & F.json_object_keys("body").isNotNull(), doc))
    lifetime = _integer(F.coalesce(F.col("d.process_started_us"), F.parse_json(F.lit("0"))), 0, LAST_US)
    pid = F.when(F.col("d.pid").isNull(), F.lit(0).cast("long")).otherwise(_integer(F.col("d.pid"), 0, 4294967295))
    events = F.col("d.recording.events")
    reason = (
        F.when(F.col("size") > RECORDING_BYTES, "recording exceeds 16 MiB").when(F.col("d").isNull(), "not a JSON object").when(events.isNull(), "no events").when(F.size(events) > RECORDING_EVENTS, "too many events")
        .when(lifetime.isNull(), "invalid process lifetime").when(pid.isNull(), "invalid process id")
        .when((F.octet_length(F.coalesce("d.process_name", F.lit(""))) > 256) | (F.octet_length(F.coalesce("d.process_path", F.lit(""))) > 4096), "process identity exceeds the field limits")
        .when(F.exists(events, lambda e: e["type"].isin(*RECORDED) & iso_micros(F.try_variant_get(e["values"], "$.startTime", "string")).isNull()), "invalid event time")
    )
    return df.select("path", pid.alias("pid"), lifetime.alias("process_started_us"), F.coalesce("d.process_name", F.lit("")).alias("process_name"), F.coalesce("d.process_path", F.lit("")).alias("process_path"), events.alias("events"), reason.alias("reason"))


def recorded_events(parsed: DataFrame) -> DataFrame:
    """The kept events of the recordings that aren't refused, each once by its id: SHA-256 of kind, process and the values' text."""
    rows = parsed.where("reason is null").select("path", "pid", "process_started_us", "process_name", F.explode("events").alias("e")).where(F.col("e.type").isin(*RECORDED))
    get = lambda name: F.try_variant_get(F.col("e.values"), f"$.{name}", "string")
    text = F.to_json("e.values")
    port = F.greatest(F.lit(0), F.least(F.lit(65535), F.coalesce(F.try_variant_get(F.col("e.values"), "$.peerPort", "int"), F.lit(0))))
    result = F.create_map(*[F.lit(x) for pair in RECORDED.items() for x in pair])[F.col("e.type")]
    empty = lambda c: F.coalesce(c, F.lit(""))
    columns = {"kind": F.col("e.type"), "timestamp_us": iso_micros(get("startTime")), "peer": empty(get("peerHost")), "port": port, "protocol": empty(get("protocolVersion")), "cipher": empty(get("cipherSuite")), "certificate_id": empty(get("certificateId")), "result": result}
    ident = F.sha2(F.concat(F.col("e.type"), F.lit(":"), F.col("pid").cast("string"), F.lit(":"), text), 256)
    return rows.select(ident.alias("id"), "pid", "process_started_us", *[v.alias(k) for k, v in columns.items()]).dropDuplicates(["id"])
