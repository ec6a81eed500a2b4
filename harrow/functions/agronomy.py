"""Agronomic formulas as Column builders; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the features of the site distance, and the distance of a site of the same class without features.
DISTANCE_WEIGHTS = {"aridity": 2.0, "rainfall": 1.0, "frost": 1.0, "elevation": 0.5}
FALLBACK_DISTANCE = 2.0
#: Ordinal scales of soil texture and drainage (fixed values).
TEXTURE_ORDER = {
    "sand": 0, "loamy sand": 1, "sandy loam": 2, "loam": 3, "silt loam": 3, "silt": 3, "sandy clay loam": 4, "clay loam": 4,
    "silty clay loam": 4, "sandy clay": 5, "silty clay": 5, "clay": 6,
}
DRAINAGE_ORDER = {"well_drained": 0, "moderate": 1, "poor": 2}


def lit_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def features(rainfall: str, et0: str, frost: str, elevation: str) -> dict[str, Column]:
    """The four features of a site; all null unless every input is there and et0 is not zero."""
    whole = F.col(rainfall).isNotNull() & F.col(frost).isNotNull() & F.col(elevation).isNotNull() & (F.coalesce(F.col(et0), F.lit(0)) != 0)
    raw = {"aridity": F.col(rainfall) / F.nullif(F.col(et0), F.lit(0)), "rainfall": F.col(rainfall), "frost": F.col(frost), "elevation": F.col(elevation)}
    return {name: F.when(whole, value.cast("double")) for name, value in raw.items()}


def weighted_distance(left: dict[str, Column], right: dict[str, Column], span: dict[str, Column]) -> Column:
    """sqrt(sum of w * (difference / span)^2 / sum of w); a feature without span counts as equal."""
    terms = [
        F.lit(w) * F.pow(F.when(span[f] > 0, (left[f] - right[f]) / F.nullif(span[f], F.lit(0.0))).otherwise(0.0), F.lit(2.0))
        for f, w in DISTANCE_WEIGHTS.items()
    ]
    return F.sqrt(reduce(lambda a, b: a + b, terms) / sum(DISTANCE_WEIGHTS.values()))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks and what is left of them without, by Unicode's decomposition."""
    marked = [c for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(base := unicodedata.normalize("NFD", c)) > 1 and base[0].isascii()]
    return "".join(marked) + "".join(STROKED), "".join(unicodedata.normalize("NFD", c)[0] for c in marked) + "".join(STROKED.values())


#: Letters that Unicode doesn't take apart (fixed values).
STROKED = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}
PLAIN_LETTERS = _plain_letters()


def site_key(name: Column) -> Column:
    """Identity of a site by name: accents folded, one trailing parenthesis off, spaces collapsed, lower case."""
    folded = F.translate(F.lower(F.coalesce(name, F.lit(""))), *PLAIN_LETTERS)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"\s*\([^)]*\)\s*$", ""), r"\s+", " "))


def variety_name(name: Column) -> Column:
    upper = F.upper(F.trim(name))
    bare = F.trim(F.regexp_replace(upper, r"\s*\([^)]*\)\s*$", ""))
    return F.when(name == "", None).when(bare == "", upper).otherwise(bare)


def eppo_code(code: Column) -> Column:
    """Five upper-case letters without prefix, else null; the two codes of maize are one."""
    bare = F.upper(F.trim(F.regexp_replace(code, "(?:eppo|EPPO):", "")))
    return F.when(F.length(bare) == 5, F.when(bare == "ZEAMA", "ZEAMX").otherwise(bare))


def yield_provenance(derived: Column, trials: Column) -> Column:
    return F.when(derived == 0, "measured").when(derived >= trials, "derived").otherwise("partial")


def evidence(numeric: Column) -> Column:
    return F.when(F.coalesce(numeric, F.lit(0)) == 0, "none").when(numeric < 5, "sparse").otherwise("direct")


def _worse(verdicts: list[Column]) -> Column:
    rank = [F.when(v == "suitable", 0).when(v == "marginal", 1).when(v == "unsuitable", 2) for v in verdicts]
    worst = F.array_max(F.array(*rank))
    return F.when(worst == 0, "suitable").when(worst == 1, "marginal").when(worst == 2, "unsuitable").otherwise("unknown")


def ordinal_gap(value: Column, wanted: Column, order: dict[str, int]) -> Column:
    """Smallest distance on an ordinal scale between a value and an array of wanted values; null if unknown."""
    scale = lit_map(order)
    own = F.try_element_at(scale, value)
    return F.array_min(F.transform(wanted, lambda w: F.abs(F.try_element_at(scale, w) - own)))


def texture_name(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "[_-]", " ")


def soil_verdict(ph: Column, ph_min: Column, ph_max: Column, texture: Column, textures: Column, drainage: Column, drainages: Column) -> dict[str, Column]:
    """Verdict per dimension, the worst of them, and the confidence by how many could be assessed."""
    ph_gap = F.greatest(ph_min - ph, ph - ph_max)
    by_ph = F.when(ph_gap <= 0, "suitable").when(ph_gap <= 0.5, "marginal").when(ph_gap > 0.5, "unsuitable")
    gap = ordinal_gap(texture_name(texture), F.transform(textures, texture_name), TEXTURE_ORDER)
    by_texture = F.when(gap <= 1, "suitable").when(gap <= 3, "marginal").when(gap > 3, "unsuitable")
    wet = ordinal_gap(drainage, drainages, DRAINAGE_ORDER)
    by_drainage = F.when(wet == 0, "suitable").when(wet == 1, "marginal").when(wet > 1, "unsuitable")
    known = sum((v.isNotNull().cast("int") for v in (by_texture, by_drainage)), by_ph.isNotNull().cast("int"))
    return {
        "ph_verdict": by_ph, "texture_verdict": by_texture, "drainage_verdict": by_drainage,
        "verdict": _worse([by_ph, by_texture, by_drainage]), "confidence": F.when(known >= 2, "medium").otherwise("low"),
    }


def drainage_class(group: Column, ksat: Column) -> Column:
    scs = F.coalesce(F.upper(F.trim(group)), F.when(ksat > 36, "A").when(ksat > 3.6, "B").when(ksat > 0.36, "C").when(ksat.isNotNull(), "D"))
    return F.when(scs.isin("A", "B"), "well_drained").when(scs == "C", "moderate").when(scs == "D", "poor")


def koppen(temp: Column, rain: Column, coldest: Column, warmest: Column, driest: Column, wettest: Column) -> Column:
    """Main climate groups from annual and seasonal figures; nulls mean that a figure is not known.

    The classes are tried in this order; a condition on a figure that is not known doesn't hold.
    """
    dry, hot, winter = 20 * (temp + 7), temp >= 18, wettest == "winter"
    desert, steppe = (rain < dry) & (rain < dry / 2), rain < dry
    tropical, temperate, continental = coldest >= 18, coldest >= -3, coldest < -3
    classes = [
        ("Unknown", temp.isNull() | rain.isNull()),
        ("ET", (warmest < 10) & (coldest > 0)), ("EF", warmest < 10),
        ("BWh", desert & hot), ("BWk", desert), ("BSh", steppe & hot), ("BSk", steppe),
        ("Af", tropical & (driest >= 60)), ("Am", tropical & (rain >= 25 * (100 - driest))), ("Aw", tropical),
        ("Csa", temperate & (warmest >= 22) & winter), ("Cwa", temperate & (warmest >= 22) & (driest < 30)), ("Cfa", temperate & (warmest >= 22)),
        ("Csb", temperate & winter), ("Cfb", temperate),
        ("Dwa", continental & (warmest >= 22) & winter), ("Dfa", continental & (warmest >= 22)),
        ("Dwb", continental & (warmest >= 10) & winter), ("Dfb", continental & (warmest >= 10)),
        ("Dfc", continental & warmest.isNotNull()), ("Dfb", continental),
    ]
    return F.coalesce(*(F.when(condition, name) for name, condition in classes), F.lit("Unknown"))


def photoperiod_hours(latitude: Column, day: int = 172) -> Column:
    """Day length by Spencer's declination; 24 in the polar day and 0 in the polar night."""
    b = F.lit(2 * 3.141592653589793 / 365 * (day - 1))
    decl = (
        F.lit(0.006918) - F.lit(0.399912) * F.cos(b) + F.lit(0.070257) * F.sin(b) - F.lit(0.006758) * F.cos(b * 2)
        + F.lit(0.000907) * F.sin(b * 2) - F.lit(0.002697) * F.cos(b * 3) + F.lit(0.00148) * F.sin(b * 3)
    )
    x = -F.tan(F.radians(latitude)) * F.tan(decl)
    return F.when(x >= 1, 0.0).when(x <= -1, 24.0).otherwise(F.round(F.lit(24.0) * F.acos(x) / F.pi(), 2))


def saxton_rawls(sand_pct: Column, clay_pct: Column, om_pct: Column) -> dict[str, Column]:
    """Soil water by the Saxton-Rawls regressions: wilting point, field capacity, saturation, conductivity, capacity."""
    clamp = lambda c, top: F.greatest(F.lit(0.1), F.least(F.lit(top), c)) / 100
    s, c, o = clamp(sand_pct, 99.9), clamp(clay_pct, 99.9), clamp(om_pct, 10.0)
    poly = lambda a, b, d, so, co, sc, k: a * s + b * c + d * o + so * s * o + co * c * o + sc * s * c + k
    wp = poly(-0.024, 0.487, 0.006, 0.005, -0.013, 0.068, 0.031)
    wp = wp + (0.14 * wp - 0.02)
    fc = poly(-0.251, 0.195, 0.011, 0.006, -0.027, 0.452, 0.299)
    fc = fc + (1.283 * fc * fc - 0.374 * fc - 0.015)
    extra = poly(0.278, 0.034, 0.022, -0.018, -0.027, -0.584, 0.078)
    extra = extra + (0.636 * extra - 0.107)
    sat = fc + extra - 0.097 * s + 0.043
    slope = (F.log(fc) - F.log(wp)) / (F.log(F.lit(1500.0)) - F.log(F.lit(33.0)))
    ksat = F.when(sat > fc, F.lit(1930.0 * 24) * F.pow(sat - fc, F.lit(3.0) - slope))
    return {"theta_wp": wp, "theta_fc": fc, "theta_sat": sat, "k_sat_mm_d": ksat, "awc_mm_m": F.greatest(F.lit(0.01), fc - wp) * 1000}


def nodata(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null for the sentinels of soil grids and for values out of range."""
    bad = value.isin(-9999.0, -3276.8) | (value < -3.0e38)
    if low is not None and high is not None:
        bad = bad | (value < low) | (value > high)
    return F.when(~bad, value)


def water_budget(kc: Column, awc: Column, moisture_pct: Column, et0: Column, rain: Column) -> dict[str, Column]:
    """Weekly irrigation need of a parcel, with the usual defaults for what is not known."""
    kc, awc = F.coalesce(kc, F.lit(0.85)), F.coalesce(awc, F.lit(120.0))
    et0, rain = F.coalesce(et0, F.lit(35.0)), F.coalesce(rain, F.lit(5.0))
    moisture = awc * F.coalesce(F.nullif(moisture_pct, F.lit(0.0)), F.lit(70.0)) / 100
    etc = F.round(kc * et0, 2)
    deficit = F.greatest(F.lit(0.0), F.round(etc - rain - F.greatest(F.lit(0.0), moisture - awc * 0.5), 2))
    band = F.when(deficit <= 0, "none").when(deficit < 15, "light").when(deficit < 30, "apply").otherwise("urgent")
    return {"etc_mm": etc, "deficit_mm": deficit, "recommendation": band}


def water_risk(rain: Column, et0: Column, awc: Column) -> dict[str, Column]:
    """Seasonal water balance of a cover crop, with a band of 20 mm either way."""
    etc = F.coalesce(F.nullif(et0, F.lit(0.0)), rain * 0.8) * 0.4 * 0.8
    deficit = etc - (rain * 0.6 * 0.8 + F.coalesce(F.nullif(awc, F.lit(0.0)), F.lit(120.0)) * 0.5)
    risk = F.when(rain.isNull(), "unknown").when(deficit < -20, "low").when(deficit < 20, "medium").otherwise("high")
    return {"deficit_mm": F.round(deficit, 1), "risk": risk}


def carbon(biomass_t_ha: Column, soc: Column, target: Column) -> dict[str, Column]:
    """Soil organic carbon gain, sequestered CO2 equivalent and years to a target."""
    c = biomass_t_ha * 0.45
    gain = F.round(c * 0.15 / 10, 2)
    years = F.when((soc < target) & (gain > 0), F.greatest(F.lit(1.0), F.bround((target - soc) / F.nullif(gain, F.lit(0.0)))))
    return {"soc_delta_pct": gain, "co2e_t_ha": F.round(c * 3.67, 1), "years_to_target": years.cast("int")}
