"""Column functions: indices, recoding, radar and report arithmetic. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def reflectance(dn: Column, baseline: Column) -> Column:
    """Surface reflectance of a raw number, never below 1e-4; offset 1000 from processing baseline 04.00 on."""
    off = F.when(baseline >= "04.00", 1000.0).otherwise(0.0)
    return F.greatest((dn.cast("double") - off) / 10000.0, F.lit(1e-4))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.try_divide(a - b, a + b)


#: Index name -> (bands, formula over a dict of band columns).
INDICES: dict[str, tuple[tuple[str, ...], Callable[[dict[str, Column]], Column]]] = {}


def register_index(name: str, bands: tuple[str, ...], formula: Callable[[dict[str, Column]], Column]) -> None:
    """Add an index; its formula stays inside the optimiser."""
    INDICES[name.upper()] = (bands, formula)


register_index("NDVI", ("B08", "B04"), lambda b: normalised_difference(b["B08"], b["B04"]))
register_index("NDWI", ("B03", "B08"), lambda b: normalised_difference(b["B03"], b["B08"]))
register_index("NDMI", ("B8A", "B11"), lambda b: normalised_difference(b["B8A"], b["B11"]))
register_index("NDRE", ("B8A", "B05"), lambda b: normalised_difference(b["B8A"], b["B05"]))
register_index("EVI", ("B08", "B04", "B02"), lambda b: F.try_divide(2.5 * (b["B08"] - b["B04"]), b["B08"] + 6.0 * b["B04"] - 7.5 * b["B02"] + 1.0))


def index(name: str, bands: dict[str, Column]) -> Column:
    needed, formula = INDICES[name.upper()]
    return formula({b: bands[b] for b in needed})


def bands_for(names: list[str]) -> list[str]:
    """The bands that the indices need, sorted: what a scan has to read."""
    return sorted({b for n in names for b in INDICES[n.upper()][0]})


CLEAR_CLASSES, CLOUD_CLASSES = (4, 5, 6), (3, 8, 9, 10)


def clear(scl: Column, grown_cloud: Column, bands: list[Column]) -> Column:
    """A pixel to use: clear class, away from cloud, every band measured."""
    out = scl.isin(*CLEAR_CLASSES) & ~grown_cloud
    for b in bands:
        out = out & (b > 0)
    return out


def decibel(x: Column) -> Column:
    """10 log10 x; null for x <= 0."""
    return F.when(x > 0, 10.0 * F.log10(x))


def radar_ratios(vv: Column, vh: Column) -> tuple[Column, Column]:
    """(ratio in dB, radar vegetation index) of linear means."""
    return decibel(F.try_divide(vh, vv)), F.try_divide(4.0 * vh, vv + vh)


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normal_word(x: Column) -> Column:
    """Trimmed, lower case, blanks as underscores, null as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), " ", "_")


def recode(x: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def half_up_percent(share: Column) -> Column:
    return F.floor(100.0 * share + 0.5 + 1e-9).cast("int")


def margin95(p: Column, n: Column) -> Column:
    """Half-width of the 95 % interval of a share."""
    return 1.96 * F.sqrt(F.try_divide(p * (1.0 - p), n.cast("double")))


def season_of(day: Column) -> Column:
    """rabi_Y from 1 Nov Y-1 to 30 Apr Y, kharif_Y from 1 May to 31 Oct."""
    m, y = F.month(day), F.year(day)
    return F.when(m >= 11, F.concat(F.lit("rabi_"), (y + 1).cast("string"))).when(m <= 4, F.concat(F.lit("rabi_"), y.cast("string"))).otherwise(F.concat(F.lit("kharif_"), y.cast("string")))


def map_code(p: list[Column], codes: list[int], n_clear: Column, least: float = 0.6, fewest: int = 8, unsure: int = 4) -> Column:
    """0 with too few clear dates; else the likeliest class's code, or `unsure` below `least`."""
    top = F.greatest(*p)
    out = F.lit(unsure)
    for c, x in reversed(list(zip(codes, p, strict=True))):
        out = F.when(x == top, F.lit(c)).otherwise(out)
    return F.when(n_clear < fewest, 0).when(top < least, unsure).otherwise(out)
