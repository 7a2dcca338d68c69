"""Package and pour sizes from numbers and names (SZ1-SZ5, PK1-PK6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brimful.functions.binding import let
from brimful.functions.vocabulary import CATEGORIES, METRIC_SIZES, ML_PER_OZ, PACKAGES_ML, PACKAGES_OZ, POURS_OZ

BOTTLES_ML = [50, 187, 200, 375, 500, 750, 1000, 1500, 1750]
PACKAGES = [(label, oz, oz * ML_PER_OZ) for label, oz in PACKAGES_OZ] + [(label, ml / ML_PER_OZ, ml) for label, ml in PACKAGES_ML]
POURS = [(label, oz, oz * ML_PER_OZ) for label, oz in POURS_OZ]


def _size(label: Column, oz: Column) -> Column:
    return F.struct(label.alias("label"), oz.cast("double").alias("oz"))


def _preset(wanted: str) -> Column:
    label, oz, _ = next(p for p in [*PACKAGES, *POURS] if p[0] == wanted)
    return _size(F.lit(label), F.lit(oz))


def _nearest(target: Column, presets: list[tuple[str, float, float]], at: int) -> Column:
    """struct(gap, order, label, oz) of the nearest preset, the first on ties."""
    gap = lambda p: F.abs(F.lit(p[at]) - target)
    return F.array_min(F.array(*(F.struct(gap(p).alias("gap"), F.lit(i).alias("order"), F.lit(p[0]).alias("label"), F.lit(p[1]).alias("oz")) for i, p in enumerate(presets))))


def nearest_ml(ml: Column) -> Column:
    """struct(label, oz): the package within 1 % of a volume, else the volume's own label; 12 oz unless positive."""
    litres = ml / 1000
    litre_text = F.when(F.abs(litres - F.round(litres)) < 0.01, F.round(litres).cast("int").cast("string")).otherwise(litres.cast("string"))
    own = F.when(ml >= 1000, F.concat(litre_text, F.lit(" L"))).otherwise(F.concat(F.round(ml).cast("int").cast("string"), F.lit(" mL")))
    near = let(_nearest(ml, PACKAGES, 2), lambda best: F.when(best.gap <= ml * 0.01, _size(best.label, best.oz)))
    return F.when(~(ml > 0), _preset("12 oz")).otherwise(F.coalesce(near, _size(own, ml / ML_PER_OZ)))


def nearest_oz(oz: Column, presets: list[tuple[str, float, float]] = PACKAGES) -> Column:
    """struct(label, oz): the preset within 2 %, else the ounces themselves."""
    text = F.when(F.abs(oz - F.round(oz)) < 0.05, F.round(oz).cast("int").cast("string")).otherwise(oz.cast("string"))
    near = let(_nearest(oz, presets, 1), lambda best: F.when(best.gap <= oz * 0.02, _size(best.label, best.oz)))
    return F.when(~(oz > 0), _preset("12 oz")).otherwise(F.coalesce(near, _size(F.concat(text, F.lit(" oz")), oz)))


def size_tokens(name: Column) -> Column:
    """Words of a lower-case name with units glued to their numbers in short form."""
    text = F.lower(name)
    for unit, spelled in (("ml", "milliliters|milliliter|mls|ml"), ("l", "liters|liter|litres|litre|ltr|lt|l"), ("oz", "ounces|ounce|oz|fl")):
        text = F.regexp_replace(text, rf"(?<=\p{{N}}) (?:{spelled})(?!\p{{L}})", unit)
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}.]+"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, r"\.+$", ""))


def _number(token: Column, unit: str) -> Column:
    value = F.when(token.rlike(rf"^[0-9.]+{unit}$"), F.regexp_replace(token, f"{unit}$", "").try_cast("double"))
    return F.when(value > 0, value)


def _first(tokens: Column, test) -> Column:  # noqa: ANN001
    return F.get(F.filter(tokens, test), F.lit(0))


def _volume(token: Column, units: tuple[str, ...]) -> Column:
    """struct(oz, ml) of a token like 12oz: one of the two is stated; NULL for other tokens."""
    oz, ml = _number(token, "oz"), F.coalesce(_number(token, "ml"), *([_number(token, "l") * 1000] if "l" in units else []))
    return F.when(oz.isNotNull() | ml.isNotNull(), F.struct(oz.alias("oz"), ml.alias("ml")))


def _first_volume(tokens: Column, units: tuple[str, ...] = ("oz", "ml", "l")) -> Column:
    return F.get(F.filter(F.transform(tokens, lambda t: _volume(t, units)), lambda v: v.isNotNull()), F.lit(0))


def container_from_name(name: Column, category: Column) -> Column:
    """struct(label, oz) of the container a product name states; NULL where it states none."""
    lowered = F.lower(name)
    spirit = category.isin(*(c for c, row in CATEGORIES.items() if row[6]))

    def choose(tokens: Column) -> Column:
        has = lambda w: F.array_contains(tokens, w)
        sized = let(_first_volume(tokens), lambda v: F.when(v.oz.isNotNull(), let(v.oz, nearest_oz)).when(v.ml.isNotNull(), let(v.ml, nearest_ml)))
        bare = let(_first(tokens, lambda t: t.isin(*map(str, BOTTLES_ML))), lambda t: F.when(t.isNotNull(), let(t.try_cast("double"), nearest_ml)))
        named = (
            F.when(has("handle") | F.contains(lowered, F.lit("half gallon")), _preset("1.75 L (handle)"))
            .when(has("magnum"), _preset("1.5 L (magnum)"))
            .when(has("stovepipe"), _preset("19.2 oz"))
            .when(has("tallboy") | lowered.rlike("tall boy|pounder"), _preset("16 oz"))
            .when(has("fifth"), _preset("750 mL"))
            .when(has("nip") | has("mini"), _preset("50 mL (nip)"))
        )
        pints = F.when(spirit & F.contains(lowered, F.lit("half pint")), _preset("200 mL")).when(spirit & has("pint"), _preset("375 mL (half)"))
        return F.coalesce(named, sized, bare, pints)

    return let(size_tokens(name), choose)


def count_from_name(name: Column) -> Column:
    """How many a name says a package holds, 2 to 48."""
    lowered = F.lower(name)
    found = F.transform(F.regexp_extract_all(lowered, F.lit(r"(?<!\p{N})(\p{N}+)[ -]?(?:pk|pack|ct|count)"), F.lit(1)), lambda d: d.try_cast("int"))
    first = F.get(F.filter(found, lambda n: n.between(2, 48)), F.lit(0))
    return F.when(lowered.rlike("30 rack|30rack|30-rack"), 30).otherwise(F.coalesce(first, F.when(F.contains(lowered, F.lit(" case")) | F.contains(lowered, F.lit("case of 24")), 24)))


def _by_category(category: Column, value) -> Column:  # noqa: ANN001
    """value(row) of the category's fixed row; that of unknown for other names."""
    out = value(CATEGORIES["unknown"])
    for name, row in CATEGORIES.items():
        out = F.when(category == name, value(row)).otherwise(out)
    return out


def default_abv(category: Column) -> Column:
    return _by_category(category, lambda r: F.lit(r[1]))


def default_pour_oz(category: Column) -> Column:
    return _by_category(category, lambda r: F.lit(r[2]))


def abv_ceiling(category: Column) -> Column:
    """NULL means that every strength is plausible."""
    return _by_category(category, lambda r: F.lit(r[3]).cast("double"))


def suggest_package(name: Column, category: Column, ml: Column, units: Column) -> Column:
    """struct(label, oz, count): what is stated, else what the name says, else the category's default."""
    stated = F.when(ml > 0, let(ml, nearest_ml))

    def counted(container: Column) -> Column:
        default_count = F.when(container.oz * ML_PER_OZ >= 500, 1).otherwise(_by_category(category, lambda r: F.lit(r[5])))
        count = F.greatest(F.lit(1), F.coalesce(units, count_from_name(name), default_count)).cast("int")
        return F.struct(container.label.alias("label"), container.oz.alias("oz"), count.alias("count"))

    return let(F.coalesce(stated, container_from_name(name, category), _by_category(category, lambda r: _preset(r[4]))), counted)


def pour_from_name(name: Column, category: Column) -> Column:
    """struct(label, oz) of the pour a drink name states; vessels that are drinks by themselves come before sizes."""
    wine, draft = category.isin("wineGlass", "sangria"), category == "draftBeer"
    pours = lambda oz: nearest_oz(oz, POURS)

    def choose(tokens: Column) -> Column:
        has = lambda *ws: F.arrays_overlap(tokens, F.array(*map(F.lit, ws)))
        named = F.when(has("pitcher", "pitchor"), _preset("60 oz pitcher")).when(has("double"), _preset("3 oz double")).when(has("shot", "shooter"), _preset("1.5 oz shot")).when(has("pint"), _preset("16 oz"))
        sized = let(_first_volume(tokens, ("oz", "ml")), lambda v: F.when(v.isNotNull(), let(F.coalesce(v.oz, v.ml / ML_PER_OZ), pours)))
        vessel = F.when(wine & has("bottle"), _size(F.lit("25.4 oz"), F.lit(25.4))).when(wine & has("glass"), _preset("5 oz wine pour")).when(draft & has("bottle", "can"), _preset("12 oz")).when(draft & has("draft", "draught"), _preset("16 oz"))
        return F.coalesce(named, sized, vessel)

    return let(size_tokens(name), choose)


def suggest_pour(name: Column, category: Column, typical_oz: Column) -> Column:
    """struct(label, oz)."""
    return F.coalesce(pour_from_name(name, category), F.when(typical_oz > 0, let(typical_oz, lambda oz: nearest_oz(oz, POURS))), _preset("12 oz"))


def ounces_text(oz: Column) -> Column:
    whole = F.abs(oz - F.round(oz)) < 0.05
    return F.when(whole, F.format_string("%d oz", F.round(oz).cast("long"))).otherwise(F.format_string("%.1f oz", oz))


def metric_text(ml: Column) -> Column:
    litres = ml / 1000
    whole = F.abs(litres - F.round(litres)) < 0.01
    some = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", litres), "0+$", ""), r"\.$", "")
    return F.when(ml < 1000, F.format_string("%d mL", F.round(ml).cast("long"))).when(whole, F.format_string("%d L", F.round(litres).cast("long"))).otherwise(F.concat(some, F.lit(" L")))


def _trade_size(oz: Column) -> Column:
    """The metric trade size within 1.5 %, unless the volume is whole ounces."""
    ml = oz * ML_PER_OZ
    near = F.get(F.filter(F.array(*(F.lit(float(m)) for m in METRIC_SIZES)), lambda m: F.abs(ml - m) <= m * 0.015), F.lit(0))
    return F.when(F.abs(oz - F.round(oz)) >= 0.05, near)


def volume_text(oz: Column) -> Column:
    size = _trade_size(oz)
    return F.when(size.isNotNull(), metric_text(size)).otherwise(ounces_text(oz))


def package_text(count: Column, unit_oz: Column) -> Column:
    return F.when(count > 1, F.concat(count.cast("string"), F.lit(" × "), volume_text(unit_oz))).otherwise(volume_text(unit_oz))


def total_text(count: Column, unit_oz: Column) -> Column:
    total = unit_oz * F.greatest(F.lit(1), count)
    return F.when(_trade_size(unit_oz).isNotNull(), metric_text(total * ML_PER_OZ)).otherwise(ounces_text(total))
