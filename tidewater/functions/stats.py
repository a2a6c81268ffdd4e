"""Statistics as Column expressions: roundings, normal distribution, correlation from sums, p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column, places: int = 0) -> Column:
    """Half up, toward plus infinity: -2.5 gives -2."""
    k = 10.0**places
    return F.floor(c * k + 0.5) / k


def normal_cdf(z: Column) -> Column:
    """Polynomial approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def t_of(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide(n - 2, F.greatest(F.lit(1e-12), 1 - r * r)))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided: normal tail of t for n > 30, else min(1, 2 exp(-0.717 |t| - 0.416 t^2))."""
    t = F.abs(t_of(r, n))
    return F.when(n > 30, 2 * (1 - normal_cdf(t))).otherwise(F.least(F.lit(1.0), 2 * F.exp(-0.717 * t - 0.416 * t * t)))


def exact_sum(c: Column) -> Column:
    """Aggregate: the sum of doubles by their decimal digits, so the order of rows can't move it off or over a limit; the plain sum where a value or the sum needs more than 23 digits before or 15 behind the point."""
    d = c.try_cast("decimal(38,15)")
    whole = F.count(F.when(d.cast("double") == c, 1)) == F.count(c)
    return F.when(whole, F.coalesce(F.try_sum(d).cast("double"), F.sum(c))).otherwise(F.sum(c))


def exact_avg(c: Column) -> Column:
    """Aggregate: the mean by exact_sum."""
    return F.try_divide(exact_sum(c), F.count(c))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r from sums; 0 where a series is constant."""
    n = F.count(F.lit(1))
    cov = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    var = (n * F.sum(x * x) - F.sum(x) * F.sum(x)) * (n * F.sum(y * y) - F.sum(y) * F.sum(y))
    return F.when(var > 1e-12, cov / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(0.0)


def ols(y: Column, x: Column) -> tuple[Column, Column, Column]:
    """Aggregates: slope, intercept, R2; slope and R2 are 0 for a constant series."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    sxx, sxy, syy = n * F.sum(x * x) - sx * sx, n * F.sum(x * y) - sx * sy, n * F.sum(y * y) - sy * sy
    slope = F.when(sxx > 1e-12, sxy / F.greatest(sxx, F.lit(1e-300))).otherwise(0.0)
    r2 = F.when((sxx > 1e-12) & (syy > 1e-9), sxy * sxy / F.greatest(sxx * syy, F.lit(1e-300))).otherwise(0.0)
    return slope, (sy - slope * sx) / n, r2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def daylight_hours(day_of_year: Column, latitude: Column) -> Column:
    """From the sun's declination and the hour angle."""
    decl = F.radians(23.45 * F.sin(F.radians(360 / 365 * (day_of_year + 284))))
    cos_h = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(latitude)) * F.tan(decl)))
    return 2 * F.degrees(F.acos(cos_h)) / 15


def iso_week(d: Column) -> Column:
    """YYYY-Www."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def iso_week_monday(key: Column) -> Column:
    """The Monday of YYYY-Www."""
    jan4 = F.make_date(key.substr(1, 4).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(jan4, F.weekday(jan4)), (key.substr(7, 2).cast("int") - 1) * 7)


def half_even(c: Column) -> Column:
    """A floating number to an integer, halves to the even one."""
    return F.rint(c).cast("long")


def half_away(c: Column) -> Column:
    """A decimal number to an integer, halves away from zero."""
    return F.round(c).cast("long")
