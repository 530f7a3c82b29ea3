"""Metric points from JSON payloads, as ``array<struct>`` column expressions.

A payload is a VARIANT column, so every path is read from one parse of the line. A normaliser
maps (payload, config struct, receive time in nanoseconds) to the points of that payload. The
config struct is prepared once per data source by :func:`config_struct`, not once per line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from logweave.functions.text import let

POINT_TYPE = (
    "struct<name:string,type:string,value:double,unit:string,time_unix_nano:bigint,"
    "resource:map<string,string>,attributes:map<string,string>>"
)

# Fixed value: texts that read as a floating point number.
_DIGITS = r"\d+(_\d+)*"
FLOAT_TEXT = (
    rf"(?iU)^\s*[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)\s*$"
)

Normalizer = Callable[[Column, Column, Column], Column]
NORMALIZERS: dict[str, Normalizer] = {}


def register_normalizer(kind: str) -> Callable[[Normalizer], Normalizer]:
    """Add a normaliser for a source kind."""

    def add(fn: Normalizer) -> Normalizer:
        NORMALIZERS[kind] = fn
        return fn

    return add


def text_float(text: Column) -> Column:
    """Number in a text, null if it is none; blanks around it are allowed."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$|(?<=\d)_(?=\d)", "")
    return F.when(text.rlike(FLOAT_TEXT), body).try_cast("double")


def get(payload: Column, path: str | Column, kind: str = "variant") -> Column:
    """Value at a path, null if missing or of another kind."""
    path = F.lit(path) if isinstance(path, str) else path
    return F.call_function("try_variant_get", payload, path, F.lit(kind))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("OBJECT"), F.lit(False))


def variant_float(value: Column) -> Column:
    """Number held by a JSON value: numbers, booleans and numeric texts count."""
    return let(
        value,
        lambda v: F.when(_kind(v) == "STRING", text_float(get(v, "$", "string"))).otherwise(get(v, "$", "double")),
    )


def truthy(value: Column) -> Column:
    """Whether a JSON value is non-zero and non-empty; null is not."""

    def by_kind(v: Column, kind: Column) -> Column:
        return (
            F.when(kind == "VOID", False)
            .when(kind == "STRING", get(v, "$", "string") != "")
            .when(kind == "BOOLEAN", get(v, "$", "boolean"))
            .when(kind.startswith("OBJECT"), kind != "OBJECT<>")
            .when(kind.startswith("ARRAY"), F.size(get(v, "$", "array<variant>")) > 0)
            .otherwise(get(v, "$", "double") != 0)
        )

    return let(value, lambda v: let(_kind(v), lambda kind: by_kind(v, kind)))


def text_or_empty(payload: Column, path: str) -> Column:
    return F.coalesce(get(payload, path, "string"), F.lit(""))


def string_map(*pairs: tuple[str | Column, Column]) -> Column:
    flat: list[Column] = []
    for key, value in pairs:
        flat += [F.lit(key) if isinstance(key, str) else key, value]
    return F.create_map(*flat) if flat else F.expr("CAST(map() AS map<string,string>)")


def point(
    name: Column,
    value: Column,
    time_nano: Column,
    resource: Column,
    attributes: Column | None = None,
    unit: Column | None = None,
    type_: Column | None = None,
) -> Column:
    """Array of one point, empty when there is no number."""

    def made(number: Column) -> Column:
        return F.struct(
            name.alias("name"),
            (type_ if type_ is not None else F.lit("gauge")).alias("type"),
            number.alias("value"),
            (unit if unit is not None else F.lit(None).cast("string")).alias("unit"),
            time_nano.alias("time_unix_nano"),
            resource.alias("resource"),
            (attributes if attributes is not None else string_map()).alias("attributes"),
        ).cast(POINT_TYPE)

    return F.transform(F.array_compact(F.array(value)), made)


def no_points() -> Column:
    return F.expr(f"CAST(array() AS array<{POINT_TYPE}>)")


@register_normalizer("telegraf")
def telegraf(payload: Column, config: Column, now_nano: Column) -> Column:
    """Points of one agent metric, by its name; unknown names use their ``value`` field."""

    def stamped(name: Column, stamp: Column) -> Column:
        numeric = _kind(stamp).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        time_nano = F.when(numeric, (get(stamp, "$", "double") * F.lit(1e9)).cast("bigint")).otherwise(now_nano)
        resource = string_map(("host", text_or_empty(payload, "$.tags.host")), ("vendor", F.lit("telegraf")))
        device = string_map(("device", text_or_empty(payload, "$.tags.device")))
        path = string_map(("path", text_or_empty(payload, "$.tags.path")))

        def field(key: str) -> Column:
            return get(payload, f"$.fields.{key}")

        def number(key: str) -> Column:
            return variant_float(field(key))

        def one(name: Column, value: Column, attributes: Column | None = None, unit: str | None = None) -> Column:
            return point(name, value, time_nano, resource, attributes, F.lit(unit).cast("string"))

        health = truthy(field("health_ok")).cast("double")
        return (
            F.when(name == "cpu_temperature", one(F.lit("system.cpu.temperature"), number("value"), unit="C"))
            .when(
                name == "smart_device",
                F.concat(
                    one(F.lit("smart.health_ok"), health, device),
                    one(F.lit("smart.power_on_hours"), number("power_on_hours"), device, "h"),
                ),
            )
            .when(name == "disk", one(F.lit("fs.used_percent"), number("used_percent"), path, "%"))
            .otherwise(one(F.concat(F.lit("telegraf."), name), number("value")))
        )

    name = F.lower(text_or_empty(payload, "$.name"))
    return let(name, lambda n: let(get(payload, "$.timestamp"), lambda stamp: stamped(n, stamp)))


@register_normalizer("snmp")
def snmp(payload: Column, config: Column, now_nano: Column) -> Column:
    """The point of a reading whose oid is mapped in the source's config."""

    def mapped(oid: Column, rule: Column) -> Column:
        number = variant_float(get(payload, "$.value"))
        value = F.when(rule["scaled"], number * rule["scale"]).otherwise(number)
        made = point(
            F.coalesce(F.nullif(rule["name"], F.lit("")), oid),
            value,
            now_nano,
            string_map(("host", text_or_empty(payload, "$.host")), ("vendor", F.lit("snmp"))),
            string_map(("oid", oid)),
            rule["unit"],
            F.coalesce(F.nullif(rule["type"], F.lit("")), F.lit("gauge")),
        )
        return F.when(rule.isNotNull(), made).otherwise(no_points())

    return let(
        text_or_empty(payload, "$.oid"),
        lambda oid: let(F.try_element_at(config["oids"], oid), lambda rule: mapped(oid, rule)),
    )


def _extracted(body: Column, extractors: Column, now_nano: Column) -> Column:
    def key(name: Column) -> Column:
        return F.concat(F.lit("$['"), name, F.lit("']"))

    def per_item(ex: Column, item: Column) -> Column:
        def with_attr(attr: Column) -> Column:
            return F.when(attr.isNotNull(), F.create_map(ex["attr_key"], attr)).otherwise(string_map())

        return point(
            ex["name"],
            variant_float(get(item, key(ex["field"]))),
            now_nano,
            string_map(("vendor", F.lit("dcim_http"))),
            let(get(item, key(ex["attr_key"]), "string"), with_attr),
            ex["unit"],
            ex["type"],
        )

    def per_extractor(ex: Column) -> Column:
        items = F.coalesce(get(body, ex["path"], "array<variant>"), F.expr("CAST(array() AS array<variant>)"))
        return F.flatten(F.transform(items, lambda item: per_item(ex, item)))

    return F.flatten(F.transform(extractors, per_extractor))


# The built-in extraction for Redfish thermal sensors.
REDFISH_EXTRACTOR = {
    "name": "redfish.temperature.celsius",
    "type": "gauge",
    "unit": "C",
    "path": "$['Thermal']['Temperatures']",
    "field": "ReadingCelsius",
    "attr_key": "Name",
}


def redfish_extractors() -> Column:
    return F.array(F.struct(*[F.lit(v).alias(k) for k, v in REDFISH_EXTRACTOR.items()]))


def dcim_http(payload: Column, config: Column, now_nano: Column, redfish: bool = True) -> Column:
    """Numbers that the extractors of the source find in a sensor response.

    A source with the Redfish schema uses the built-in extractor, unless ``redfish`` is off: then
    it gives no points.
    """
    configured = F.coalesce(config["extract"], F.slice(redfish_extractors(), 1, 0))
    preset = redfish_extractors() if redfish else F.slice(redfish_extractors(), 1, 0)
    extractors = F.when(F.coalesce(config["schema"], F.lit("")) == "redfish", preset).otherwise(configured)
    return let(
        get(payload, "$.body"),
        lambda body: F.when(is_object(body), _extracted(body, extractors, now_nano)).otherwise(no_points()),
    )


register_normalizer("dcim_http")(dcim_http)


def config_struct(config: Column) -> Column:
    """Typed settings of one data source, from its JSON config (VARIANT)."""

    def item(m: Column, key: str, kind: str = "string") -> Column:
        return get(m, f"$.{key}", kind)

    mappings = F.filter(
        F.coalesce(get(config, "$.mappings", "array<variant>"), F.expr("CAST(array() AS array<variant>)")),
        lambda m: F.coalesce(item(m, "oid") != "", F.lit(False)),
    )
    oids = F.transform(mappings, lambda m: item(m, "oid"))
    # one entry per oid, the last mapping of an oid wins
    latest = F.transform(
        F.array_distinct(oids),
        lambda oid: F.struct(
            oid.alias("key"),
            F.element_at(F.filter(mappings, lambda m: item(m, "oid") == oid), -1).alias("m"),
        ),
    )
    oid_map = F.map_from_entries(
        F.transform(
            latest,
            lambda e: F.struct(
                e["key"].alias("key"),
                F.struct(
                    item(e["m"], "name").alias("name"),
                    item(e["m"], "type").alias("type"),
                    item(e["m"], "unit").alias("unit"),
                    item(e["m"], "scale", "variant").isNotNull().alias("scaled"),
                    variant_float(item(e["m"], "scale", "variant")).alias("scale"),
                ).alias("value"),
            ),
        )
    )
    extract = F.transform(
        F.filter(
            get(config, "$.extract", "array<variant>"),
            lambda e: F.coalesce(item(e, "field") != "", F.lit(False)),
        ),
        lambda e: F.struct(
            F.coalesce(item(e, "name"), F.lit("dcim.metric")).alias("name"),
            F.coalesce(item(e, "type"), F.lit("gauge")).alias("type"),
            item(e, "unit").alias("unit"),
            F.concat(
                F.lit("$"),
                F.array_join(
                    F.transform(
                        F.coalesce(item(e, "path", "array<string>"), F.array().cast("array<string>")),
                        lambda k: F.concat(F.lit("['"), k, F.lit("']")),
                    ),
                    "",
                ),
            ).alias("path"),
            item(e, "field").alias("field"),
            item(e, "attr_key").alias("attr_key"),
        ),
    )
    return F.struct(
        oid_map.alias("oids"), extract.alias("extract"), get(config, "$.schema", "string").alias("schema")
    )
