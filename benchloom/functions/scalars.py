"""Column helpers for names, configuration values and benchmark units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalogue words standing for true and for missing.
TRUE_WORDS = ("Yes",)
MISSING_WORDS = ("unavailable", "unknown", "No", "N/A")


def normalize_name(name: Column) -> Column:
    """Feature and row names: dots, colons and spaces become underscores."""
    return F.translate(name, ".: ", "___")


def normalize_key(name: Column) -> Column:
    """Catalogue attribute names: spaces become underscores."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def normalize_value(cell: Column) -> Column:
    """Catalogue cell as text: flags to 1/0, else the first word without leading ``$``."""
    word = F.split(F.trim(cell), r"\s+")[0]
    bare = F.regexp_replace(word, r"^\$+", "")
    return (
        F.when(cell.isin(*TRUE_WORDS), "1")
        .when(cell.isin(*MISSING_WORDS), "0")
        .otherwise(F.nullif(bare, F.lit("")))
    )


def normalize_number(cell: Column) -> Column:
    """Numeric reading of :func:`normalize_value`, null when it is not a plain number."""
    text = normalize_value(cell)
    plain = text.rlike(r"^[+-]?([0-9]+|[0-9]*\.[0-9]+|[0-9]+\.[0-9]*)([eE][+-]?[0-9]+)?$")
    dotted_or_int = text.rlike(r"^[+-]?[0-9]+$") | F.contains(text, F.lit("."))
    return F.when(plain & dotted_or_int, text.try_cast("double"))


def container_id(pod: Column, container: Column) -> Column:
    """``driver_<container>`` or ``<last two pod parts>_<container>``; empty without container."""
    parts = F.split(pod, "-")
    tail = F.array_join(F.slice(parts, -2, 2), "_")
    owner = F.when(F.contains(pod, F.lit("driver")), "driver").when(
        F.size(parts) >= 2, tail
    ).otherwise(pod)
    return F.when(container == "", "").otherwise(F.concat_ws("_", owner, container))


def executor_of(feature: Column) -> Column:
    """Executor id: third underscore part of a container feature name."""
    return F.get(F.split(feature, "_"), 2)


def executor_feature(feature: Column) -> Column:
    """Feature part of a container feature name: everything after the executor id."""
    parts = F.split(feature, "_")
    return F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "_")


def parse_duration_ms(text: Column) -> Column:
    """Durations such as ``900.00us``, ``1.20ms``, ``1.50s`` in milliseconds."""
    def number(unit):
        return F.replace(text, F.lit(unit), F.lit("")).try_cast("double")

    return (
        F.when(F.contains(text, F.lit("us")), number("us") / 1000)
        .when(F.contains(text, F.lit("ms")), number("ms"))
        .when(F.contains(text, F.lit("s")), number("s") * 1000)
        .otherwise(text.try_cast("double"))
    )


def parse_rate_mb(text: Column) -> Column:
    """Transfer rates such as ``512.00KB`` in binary megabytes; null for other units."""
    def number(unit):
        return F.replace(text, F.lit(unit), F.lit("")).try_cast("double")

    return (
        F.when(F.contains(text, F.lit("MB")), number("MB"))
        .when(F.contains(text, F.lit("KB")), number("KB") / 1024)
        .when(F.contains(text, F.lit("GB")), number("GB") * 1024)
    )


def config_text(names: Sequence[str]) -> Column:
    """Canonical ``k=v`` text of the named columns in name order; nulls read ``None``."""
    pairs = [
        F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("None")))
        for n in sorted(names)
    ]
    return F.concat_ws(";", *pairs)


def config_digest(names: Sequence[str]) -> Column:
    """Digest that is equal exactly when the named configuration columns are equal."""
    return F.md5(config_text(names))


def run_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def bits_to_mbit(report: Column) -> Column:
    """Received throughput of a JSON report, bits per second over 1024 squared."""
    bits = F.get_json_object(report, "$.end.sum_received.bits_per_second")
    return bits.try_cast("double") / F.lit(1024.0 * 1024.0)


def ping_latency_us(line: Column) -> Column:
    """Smallest round trip of a ``min/avg`` line (milliseconds) in microseconds."""
    number = F.regexp_extract(line, r"^\S+\s+\S+\s+\S+\s+([0-9.]+)/", 1)
    return F.when(
        F.contains(line, F.lit("min/avg")), F.nullif(number, F.lit("")).try_cast("double") * 1000
    )


def order_key(seed: str, *parts: Column) -> Column:
    """Pseudo-random but reproducible sort key: md5 of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
