"""Time parts and their labels. Hours of the labels and their texts are fixed values."""

from pyspark.sql import functions as F, types as T

from tunetrail.schema import DAY_LABELS


def time_of_day(hour):
    return (F.when((hour >= 5) & (hour < 12), "Morning")
            .when((hour >= 12) & (hour < 17), "Afternoon")
            .when((hour >= 17) & (hour < 22), "Evening")
            .when(hour.isNotNull(), "Night"))


def with_time_features(df, ts="ts", tz=None):
    """Add hour, day_of_week (Monday 0), month, is_weekend and time_of_day.

    Clock hours are those of the stored time; `tz` shifts them from UTC first.
    """
    t = F.col(ts) if tz is None else F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts).cast("timestamp_ntz"))
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "month": F.month(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "time_of_day": time_of_day(F.hour(t)),
    })


def day_label(day):
    return F.element_at(F.array(*[F.lit(d) for d in DAY_LABELS]), day + 1)


def clock_label(hour):
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    return F.concat(twelve, F.when(hour < 12, ":00 AM").otherwise(":00 PM"))


def context_label(hour):
    return (F.when(hour.between(6, 9), "Morning Commute")
            .when(hour.between(10, 11), "Late Morning")
            .when(hour.between(12, 13), "Lunch")
            .when(hour.between(14, 17), "Afternoon")
            .when(hour.between(18, 21), "Evening")
            .when(hour.between(22, 23), "Night")
            .otherwise("Late Night"))


def micros(df, ts):
    """Microseconds since 1970 of a timestamp column, free of the session time zone."""
    zero = "timestamp_ntz'1970-01-01 00:00:00'"
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        zero = "timestamp'1970-01-01 00:00:00Z'"
    return F.expr(f"timestampdiff(MICROSECOND, {zero}, `{ts}`)")
