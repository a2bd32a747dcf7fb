"""Canonical ``event.v1`` records (JSON text) and their conversion to and from flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewrank.functions import registry as R
from reviewrank.session import small_table

_FIELD = "STRUCT<name: STRING, kind: STRING, slot: STRING, lo: DOUBLE, hi: DOUBLE, lo_text: STRING, hi_text: STRING, allowed: ARRAY<STRING>, listed: STRING>"


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def field_table(spark: SparkSession) -> DataFrame:
    """Event types with their payload fields in order (25 rows, fixed size)."""
    rows = []
    for name, t in R.TYPES.items():
        fields = [
            {
                "name": f["name"], "kind": f["kind"], "slot": f["slot"],
                "lo": None if f["lo"] is None else float(f["lo"]), "hi": None if f["hi"] is None else float(f["hi"]),
                "lo_text": None if f["lo"] is None else str(f["lo"]), "hi_text": None if f["hi"] is None else str(f["hi"]), "allowed": f["allowed"],
                "listed": f["allowed"] and _listed(f["allowed"]),
            }
            for f in t["fields"]
        ]
        rows.append({"_type": name, "_home": t["channel"], "_fields": fields})
    return small_table(spark, rows, f"_type STRING, _home STRING, _fields ARRAY<{_FIELD}>")


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """JSON type of a variant: BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, STRING, OBJECT<..>, ARRAY<..>, VOID or NULL."""
    return F.schema_of_variant(v)


def _number(kind: Column) -> Column:
    return F.coalesce((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))


def _when(bad: Column, text: Column | str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(text) if isinstance(text, str) else text)


def parse(records: DataFrame, column: str = "event") -> DataFrame:
    """Add the parsed record and its typed parts; text that is not a JSON object gets NULL parts."""
    v = F.try_parse_json(F.col(column)) if dict(records.dtypes)[column] == "string" else F.col(column)
    df = records.withColumn("_v", v)
    root = F.col("_v")
    parts = {k: _at(root, f"$.{k}", "variant") for k in
             ("schema", "session_id", "ts_ms", "channel", "detector", "detector_version", "event_type", "confidence", "payload", "quality")}
    df = df.select("*", *[c.alias(f"_v_{k}") for k, c in parts.items()])
    types = [_kind(F.col(f"_v_{k}")).alias(f"_k_{k}") for k in parts]
    text = {k: F.when(F.col(f"_k_{k}") == "STRING", _at(F.col(f"_v_{k}"), "$", "string"))
            for k in ("schema", "session_id", "channel", "detector", "detector_version", "event_type")}
    df = df.select("*", *types).select("*", *[c.alias(f"_t_{k}") for k, c in text.items()])
    is_object = F.col("_k_payload").startswith("OBJECT")
    payload = F.when(is_object, _at(F.col("_v_payload"), "$", "map<string,variant>"))
    df = df.withColumn("_payload", payload)
    return df.join(F.broadcast(field_table(df.sparkSession)), F.col("_t_event_type") == F.col("_type"), "left")


def _field_error(f: Column) -> Column:
    v = F.try_element_at(F.col("_payload"), f["name"])
    kind = _kind(v)
    num = _at(v, "$", "double")
    said = lambda text: F.concat(F.lit("payload."), f["name"], F.lit(text))
    missing = v.isNull() | F.coalesce(kind == "VOID", F.lit(False))
    label_bad = (kind != "STRING") | ~F.array_contains(f["allowed"], _at(v, "$", "string"))
    return (
        F.when(missing, said(" missing"))
        .when((f["kind"] == "bool"), F.when(kind != "BOOLEAN", said(" must be boolean")))
        .when(f["kind"] == "label", F.when(F.coalesce(label_bad, F.lit(True)), F.concat(said(" must be one of "), f["listed"])))
        .when(~_number(kind), said(" must be numeric"))
        .when((f["kind"] == "int") & (num != F.floor(num)), said(" must be an integer"))
        .when(F.coalesce(num < f["lo"], F.lit(False)), F.concat(said(" below "), f["lo_text"]))
        .when(F.coalesce(num > f["hi"], F.lit(False)), F.concat(said(" above "), f["hi_text"]))
    )


def record_errors(parsed: DataFrame) -> Column:
    """Array of every broken rule of a parsed record, in contract order."""
    c = F.col
    known_channel = F.coalesce(c("_t_channel").isin(R.CHANNELS), F.lit(False))
    known_type = c("_type").isNotNull()
    conf = _at(c("_v_confidence"), "$", "double")
    ts = _at(c("_v_ts_ms"), "$", "bigint")
    has_payload = c("_payload").isNotNull()
    quality = c("_v_quality")
    has_quality = quality.isNotNull() & (c("_k_quality") != "VOID")
    quality_map = F.when(c("_k_quality").startswith("OBJECT"), _at(quality, "$", "map<string,variant>"))
    extra = F.array_sort(F.array_except(F.map_keys(c("_payload")), F.transform(c("_fields"), lambda f: f["name"])))
    quoted = F.concat(F.lit("['"), F.array_join(extra, "', '"), F.lit("']"))

    def out_of(key: str, lo: float, hi: float) -> Column:
        v = F.try_element_at(quality_map, F.lit(key))
        given = v.isNotNull() & (_kind(v) != "VOID")
        x = _at(v, "$", "double")
        return F.coalesce(given & (~_number(_kind(v)) | ~x.between(lo, hi)), F.lit(False))

    usable = F.try_element_at(quality_map, F.lit("usable"))
    before = [
        _when(c("_t_schema") != R.EVENT_SCHEMA, f"schema must be '{R.EVENT_SCHEMA}'"),
        _when(~c("_t_session_id").rlike(R.SESSION_ID_PATTERN), "session_id must match ^[A-Za-z0-9_-]{3,64}$"),
        _when((c("_k_ts_ms") != "BIGINT") | (ts < 0), "ts_ms must be a non-negative integer"),
        _when(ts > R.MAX_TS_MS, "ts_ms is beyond the longest session"),
        F.when(~known_channel, F.lit(f"channel must be one of {_listed(R.CHANNELS)}")),
        _when(c("_t_detector") == "", "detector must be a non-empty string"),
        _when(c("_t_detector_version") == "", "detector_version must be a non-empty string"),
        _when(~_number(c("_k_confidence")) | (conf < 0) | (conf > 1), "confidence must be a number in [0, 1]"),
        F.when(~known_type, F.lit("event_type is not registered in event.v1")),
        F.when(
            known_type & known_channel & (c("_home") != c("_t_channel")),
            F.concat(F.lit("event_type "), c("_type"), F.lit(" belongs to channel '"), c("_home"), F.lit("', not '"), c("_t_channel"), F.lit("'")),
        ),
        F.when(known_type & ~has_payload, F.lit("payload must be an object")),
    ]
    fields = F.when(known_type & has_payload, F.transform(c("_fields"), _field_error))
    after = [
        F.when(known_type & has_payload & (F.size(extra) > 0), F.concat(F.lit("payload has unexpected fields "), quoted)),
        F.when(has_quality & quality_map.isNull(), F.lit("quality must be an object")),
        F.when(usable.isNotNull() & F.coalesce(_kind(usable) != "BOOLEAN", F.lit(True)), F.lit("quality.usable must be boolean")),
        F.when(out_of("frame_blur", 0, 1), F.lit("quality.frame_blur must be in [0, 1]")),
        F.when(out_of("frame_luma", 0, 255), F.lit("quality.frame_luma must be in [0, 255]")),
    ]
    every = F.concat(F.array(*before), F.coalesce(fields, F.array().cast("array<string>")), F.array(*after))
    not_object = ~F.coalesce(_kind(c("_v")).startswith("OBJECT"), F.lit(False))
    return F.when(not_object, F.array(F.lit("event must be a JSON object"))).otherwise(F.array_compact(every))


def validate_records(records: DataFrame, column: str = "event", more: list[Column] = ()) -> DataFrame:
    """Parsed records plus ``reason`` (NULL when valid); ``more`` are further NULL-or-text rules."""
    parsed = parse(records, column)
    errors = F.concat(record_errors(parsed), F.array_compact(F.array(*more))) if more else record_errors(parsed)
    return parsed.withColumn("reason", F.nullif(F.array_join(errors, "; "), F.lit("")))


def flat_columns() -> list[Column]:
    """The 15 flat columns of a parsed valid record."""
    def slot(name: str) -> Column:
        f = F.filter(F.col("_fields"), lambda x: x["slot"] == name)
        v = F.try_element_at(F.col("_payload"), F.try_element_at(f, F.lit(1))["name"])
        if name == "label":
            return _at(v, "$", "string").alias(name)
        truth = _at(v, "$", "boolean").cast("double")
        return F.when(_kind(v) == "BOOLEAN", truth).otherwise(_at(v, "$", "double")).alias(name)

    q = F.col("_v_quality")
    return [
        F.col("_t_session_id").alias("session_id"),
        _at(F.col("_v_ts_ms"), "$", "bigint").alias("ts_ms"),
        *[F.col(f"_t_{c}").alias(c) for c in ("channel", "detector", "detector_version", "event_type")],
        _at(F.col("_v_confidence"), "$", "double").alias("confidence"),
        *[slot(s) for s in ("p0", "p1", "p2", "p3", "label")],
        F.coalesce(_at(q, "$.usable", "boolean"), F.lit(True)).alias("usable"),
        _at(q, "$.frame_blur", "double").alias("frame_blur"),
        _at(q, "$.frame_luma", "double").alias("frame_luma"),
    ]


def payload_json() -> Column:
    """Typed payload of a flat row as JSON text."""
    out = None
    for name, t in R.TYPES.items():
        parts = []
        for f in t["fields"]:
            raw = F.col(f["slot"])
            typed = {"bool": raw.cast("boolean"), "int": raw.cast("bigint")}.get(f["kind"], raw)
            parts.append(typed.alias(f["name"]))
        text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
        hit = F.col("event_type") == name
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def canonical_json() -> Column:
    """A flat row as one ``event.v1`` JSON text."""
    head = F.to_json(F.struct(
        F.lit(R.EVENT_SCHEMA).alias("schema"), "session_id", "ts_ms", "channel", "detector", "detector_version", "event_type"))
    quality = F.to_json(F.struct("usable", "frame_blur", "frame_luma"))
    return F.concat(
        F.rtrim(head, F.lit("}")), F.lit(',"payload":'), payload_json(),
        F.lit(',"confidence":'), F.col("confidence").cast("string"), F.lit(',"quality":'), quality, F.lit("}"))
