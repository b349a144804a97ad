"""Column expressions with the exact rounding, null and tie rules of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
THRESHOLDS = (5, 10, 15, 30)
#: Month-day of the fixed national holidays (fixed values).
HOLIDAYS = ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "12-25")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def commercial_stop(stop: Column | str, stopping: Column | str, strict: bool = True) -> Column:
    """Both flags true; leniently, a missing stopping flag passes."""
    stopping = col(stopping)
    return F.coalesce(col(stop), F.lit(False)) & F.coalesce(stopping, F.lit(not strict))


def delay_minutes(reported: Column | str, scheduled: Column | str, actual: Column | str, estimate: Column | str | None = None) -> Column:
    """Reported minutes, else the rounded (half-even) difference of the times; estimates count where given."""
    arrived = col(actual) if estimate is None else F.coalesce(col(actual), col(estimate))
    return F.coalesce(col(reported), F.bround((F.unix_timestamp(arrived) - F.unix_timestamp(col(scheduled))) / 60, 0).cast("int"))


def unless(flag: Column | str, value: Column | str) -> Column:
    """value where flag is false or missing, else null."""
    return F.when(~F.coalesce(col(flag), F.lit(False)), col(value))


def canonical_pair(a: Column | str, b: Column | str) -> Column:
    """One key for both directions; equal ends are a ring."""
    a, b = col(a), col(b)
    return F.when(a == b, F.concat(a, F.lit(" ring service"))).otherwise(F.concat_ws(" - ", F.least(a, b), F.greatest(a, b)))


def clean_label(name: Column | str) -> Column:
    return F.regexp_replace(col(name), "(?i) asema$", "")


def on_time_flags(delay: Column | str, done: Column | str, thresholds=THRESHOLDS) -> dict[str, Column]:
    return {f"on_time_{t}": F.coalesce(col(done) & (col(delay) <= t), F.lit(False)) for t in thresholds}


def safe_rate(n: Column | str, d: Column | str, places: int = 6) -> Column:
    """Null for an empty denominator."""
    return F.round(F.try_divide(col(n).cast("double"), col(d).cast("double")), places)


def exact_sum(value: Column | str, scale: int = 2) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(col(value).cast(f"decimal(18,{scale})")).cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def smoothed_rate(late: Column | str, n: Column | str, prior: Column | float = 0.05, strength: float = 20.0) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (col(late) + F.lit(strength) * prior) / (col(n) + F.lit(strength))


def workload_ratio(n30: Column | str, n: Column | str, experience_days: Column | str) -> Column:
    """Recent daily orders against the lifetime's, clipped to 20, as log1p."""
    recent = col(n30) / 30 + 0.01
    always = col(n) / F.greatest(col(experience_days), F.lit(30)) + 0.01
    return F.log1p(F.least(F.greatest(recent / always, F.lit(0.0)), F.lit(20.0)))


def season(month: Column | str) -> Column:
    """Southern hemisphere."""
    m = col(month)
    return F.when(m.isin(12, 1, 2), "summer").when(m.isin(3, 4, 5), "autumn").when(m.isin(6, 7, 8), "winter").otherwise("spring")


def business_days(start: Column | str, end: Column | str) -> Column:
    """Monday to Friday in the inclusive interval: whole weeks count five, the rest is looked at day by day."""
    s, e = col(start), col(end)
    n = F.datediff(e, s) + 1
    rest = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: (k < n % 7) & (F.pmod(F.weekday(s) + k, F.lit(7)) < 5))
    return F.when(n > 0, F.floor(n / 7) * 5 + F.size(rest)).otherwise(0).cast("int")


def holidays_between(start: Column | str, end: Column | str, weekdays: bool = False) -> Column:
    """Holidays in the inclusive interval; with `weekdays`, those from Monday to Friday."""
    years = F.sequence(F.year(col(start)), F.year(col(end)))
    days = F.flatten(F.transform(years, lambda y: F.array(*[F.to_date(F.concat(y.cast("string"), F.lit("-" + d))) for d in HOLIDAYS])))
    return F.size(F.filter(days, lambda d: (d >= col(start)) & (d <= col(end)) & (F.weekday(d) < 5 if weekdays else F.lit(True))))


def bucket(value: Column | str, edges: list[float], labels: list[str], missing: str = "__missing__") -> Column:
    """Right-closed buckets; one label more than edges."""
    v = col(value)
    out = F.when(v.isNull(), missing)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(v <= edge, label)
    return out.otherwise(labels[-1])


def zip_region(prefix: Column | str) -> Column:
    return F.coalesce(F.floor(col(prefix).try_cast("int") / 1000).cast("string"), F.lit("__missing__"))


def clipped_ratio(a: Column | str, b: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.try_divide(col(a), col(b)), F.lit(low)), F.lit(high))


def parse_money(text: Column | str) -> Column:
    """Spaces go, a comma is the decimal point, anything else is null."""
    return F.regexp_replace(F.regexp_replace(col(text), r"[\s ]", ""), ",", ".").try_cast("double")


def localized(values: Column | str, languages=("eng", "fin", "fra", "deu", "swe")) -> Column:
    """The first language with texts, else all texts, of map<string, array<string>>."""
    m = col(values)
    picks = [F.when(F.size(m[x]) > 0, m[x]) for x in languages]
    return F.coalesce(*picks, F.flatten(F.map_values(m)))


def tokens(text: Column | str, stop: list[str] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(r"[a-z0-9+#.]{2,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else F.array_distinct(found)


def numbers(text: Column | str) -> Column:
    """Distinct numbers, decimal commas as points; digits right after a letter are part of a word."""
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?<![a-z])\d+(?:[.,]\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def fingerprint(*columns: str) -> Column:
    """Content hash over named columns in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for vectors of different size, empty ones and zero norms."""
    a, b = col(a), col(b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def interpolate(x: Column | str, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), constant outside: isotonic calibration and quantile scores."""
    v = col(x)
    out = F.when(v <= xs[0], F.lit(float(ys[0])))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
        out = out.when(v <= x1, F.lit(float(y0)) + (v - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(float(y1)))
    return out.otherwise(F.lit(float(ys[-1])))


def local_time(ts: Column | str, zone: str = "Europe/Helsinki") -> Column:
    return F.from_utc_timestamp(col(ts).cast("timestamp"), zone)
