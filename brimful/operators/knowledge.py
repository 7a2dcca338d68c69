"""What a name tells: brand, misread brand, style, catalog and category (JN6-JN8, JN12, EN1-EN8, OCR4, OCR5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brimful.functions.binding import let
from brimful.functions.sizes import abv_ceiling, default_abv, default_pour_oz, suggest_package, suggest_pour
from brimful.functions.text import glyph_tokens
from brimful.functions.vocabulary import BRANDS, CATEGORIES, STYLES
from brimful.operators.search import specific_match, substring_join


def brand_table(spark: SparkSession) -> DataFrame:
    """The seed of brands; longer keys come first, then earlier rows."""
    rows = sorted(enumerate(BRANDS), key=lambda r: (-len(r[1][0]), r[0]))
    return spark.createDataFrame([(*r, i) for i, (_, r) in enumerate(rows)], "key string, label string, category string, abv double, priority int")


def style_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(STYLES)], "priority int, keywords array<string>, label string, natural_category string, abv double, size_oz double")


def category_table(spark: SparkSession) -> DataFrame:
    rows = [(c, *r[:4], r[6]) for c, r in CATEGORIES.items()]
    return spark.createDataFrame(rows, "category string, alcoholic boolean, default_abv double, default_oz double, abv_ceiling double, spirituous boolean")


def _contained(names: DataFrame, table: DataFrame, values: Column) -> DataFrame:
    """(name, r): for each name the row of `table` (key, priority, ...) whose key its lower-case form contains, first by priority."""
    pairs = substring_join(names.withColumn("lowered", F.lower("name")), "lowered", table, "key")
    return pairs.groupBy("name").agg(F.min_by(values, "priority").alias("r"))


def brand_match(names: DataFrame, brands: DataFrame) -> DataFrame:
    """(name, label, category, abv) of the first brand whose key is in the name."""
    return _contained(names.select("name").distinct(), brands, F.struct("label", "category", "abv")).select("name", "r.*")


def style_match(names: DataFrame, styles: DataFrame) -> DataFrame:
    """(name, label, natural_category, abv, size_oz) of the first style with a keyword in the name."""
    keyed = styles.withColumn("key", F.explode("keywords")).drop("keywords")
    return _contained(names.select("name").distinct(), keyed, F.struct("label", "natural_category", "abv", "size_oz")).select("name", "r.*")


#: Letters that a misread word may have wrong, by the longer of two words; a brand's letters in all, likewise.
WORD_EDITS, NAME_EDITS = ((5, 0), (9, 1)), ((12, 1), (20, 2))
MOST_EDITS_OF_A_WORD, MOST_EDITS_OF_A_NAME = 2, 3
LEAST_LETTERS = 5


def _stepped(length: Column, steps: tuple[tuple[int, int], ...], beyond: int) -> Column:
    out = F.lit(beyond)
    for below, value in reversed(steps):
        out = F.when(length < below, value).otherwise(out)
    return out


def _word_cost(read: Column, own: Column, may_be_cut: Column) -> Column:
    """struct(edits, exact, beyond) of a word as read and a brand's own; a word cut short at the end of a name costs nothing."""
    cut = may_be_cut & (F.length(read) >= 3) & (F.length(own) > F.length(read)) & F.startswith(own, read)
    edits = F.when(cut, 0).otherwise(F.levenshtein(read, own))
    over = edits > _stepped(F.greatest(F.length(read), F.length(own)), WORD_EDITS, MOST_EDITS_OF_A_WORD)
    return F.struct(edits.alias("edits"), (read == own).alias("exact"), over.alias("beyond"))


def _letters(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def glyph_cost(menu: Column, brand: Column) -> Column:
    """Least struct(edits, tier, size) of the ways to read a brand's words out of a name's; null where none is near enough.

    Tier 0: the brand stands in the name; 1: the name is a part, by letters at least half, of the brand; 2: one word is the
    whole brand run together. The shorter of the two slides along the other; a word with too many edits only counts
    beside one that is exact.
    """
    both, letters = F.least(F.size(menu), F.size(brand)), _letters(brand)
    stands = F.size(brand) <= F.size(menu)

    def window(shift: Column) -> Column:
        read = F.slice(menu, F.when(stands, shift).otherwise(0) + 1, both)
        own = F.slice(brand, F.when(stands, 0).otherwise(shift) + 1, both)
        last = lambda i: (i == both - 1) & (both > 1)
        costs = F.transform(F.sequence(F.lit(0), both - 1), lambda i: _word_cost(F.get(read, i), F.get(own, i), last(i)))
        lone = let(costs, lambda c: F.when(~F.exists(c, lambda x: x.beyond) | F.exists(c, lambda x: x.exact), F.aggregate(c, F.lit(0), lambda total, x: total + x.edits)))
        enough = stands | ((F.size(menu) >= 2) & (_letters(own) * 2 >= letters))
        return F.struct(F.when(enough, lone).alias("edits"), F.when(stands, 0).otherwise(1).alias("tier"), F.when(stands, -letters).otherwise(letters).alias("size"))

    def run_together(word: Column) -> Column:
        edits = F.levenshtein(word, F.array_join(brand, ""), 2)
        return F.struct(F.when(edits >= 0, edits).alias("edits"), F.lit(2).alias("tier"), (-letters).alias("size"))

    ways = F.concat(F.transform(F.sequence(F.lit(0), F.abs(F.size(menu) - F.size(brand))), window), F.transform(menu, run_together))
    near = F.filter(ways, lambda w: w.edits <= _stepped(letters, NAME_EDITS, MOST_EDITS_OF_A_NAME))
    return F.when((F.size(menu) > 0) & (F.size(brand) > 0), F.array_min(near))


def _resembling(words: DataFrame, brands: DataFrame) -> DataFrame:
    """(word, priority): brands with a word, or all words in one, that a menu word could stand for.

    A unit of a brand is split into one part more than edits are allowed, so that a part is left whole in the word, moved
    by that many places at most, and the word is longer or shorter by as many letters. Words and units meet where part,
    place and length are equal. A word cut short meets the units that begin as it does.
    """
    length, edits = F.length("unit"), F.col("edits")
    single = F.explode(F.transform("tokens", lambda t: F.struct(t.alias("unit"), F.when(F.length(t) >= 7, 2).when(F.length(t) >= 4, 1).otherwise(0).alias("edits"))))
    joined = brands.select("priority", F.array_join("tokens", "").alias("unit"), F.lit(2).alias("edits"))
    units = brands.select("priority", single.alias("u")).select("priority", "u.*").unionByName(joined).where(length > edits)
    begins = F.transform(F.sequence(F.lit(0), edits), lambda k: F.floor(k * length / (edits + 1)).cast("int"))
    ends = lambda k: F.floor((k + 1) * length / (edits + 1)).cast("int")
    part = F.explode(F.transform(begins, lambda at, k: F.struct((at + 1).alias("at"), F.substring("unit", at + 1, F.least(F.lit(3), ends(k) - at)).alias("piece"))))
    around = lambda x: F.explode(F.sequence(F.greatest(F.lit(1), x - edits), x + edits))
    keyed = units.select("priority", "unit", "edits", part.alias("p")).select("priority", "unit", "edits", "p.piece", around(F.col("p.at")).alias("place"))
    keyed = keyed.withColumn("size", around(length)).distinct()
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.array(*(F.struct(i.alias("place"), F.substring("word", i, F.lit(n)).alias("piece")) for n in (1, 2, 3))))))
    held = words.where("word <> ''").select("word", F.length("word").alias("size"), places.alias("p")).select("word", "size", "p.*").distinct()
    near = held.join(keyed, ["piece", "place", "size"]).where(F.levenshtein("word", "unit") <= edits).select("word", "priority")
    begun = brands.select("priority", F.explode("tokens").alias("unit")).select("priority", "unit", F.substring("unit", 1, 3).alias("piece"))
    cut = words.where("length(word) >= 3").select("word", F.substring("word", 1, 3).alias("piece")).join(begun, "piece").where(F.startswith("unit", "word"))
    return near.unionByName(cut.select("word", "priority")).distinct()


def glyph_match(names: DataFrame, brands: DataFrame) -> DataFrame:
    """(name, label, category, abv) of brands whose glyphs a misread name resembles.

    Names and brands meet where a word of one could be a misread word of the other; of a name's brands the one that
    takes the least edits is chosen, then by the order of glyph_cost(), then the first. Priorities of brands are distinct.
    """
    menus = names.select("name").distinct().select("name", glyph_tokens(F.lower("name")).alias("menu"))
    table = brands.select("priority", "label", "category", "abv", glyph_tokens(F.col("key")).alias("tokens")).where(_letters(F.col("tokens")) >= LEAST_LETTERS)
    owned = menus.select("name", F.explode(F.array_distinct("menu")).alias("word"))
    met = owned.join(_resembling(owned.select("word").distinct(), table), "word").select("name", "priority").distinct()
    rated = met.join(table, "priority").join(menus, "name").withColumn("cost", glyph_cost(F.col("menu"), F.col("tokens"))).where("cost is not null")
    best = rated.groupBy("name").agg(F.min_by(F.struct("label", "category", "abv"), F.struct("cost", "priority")).alias("r"))
    return best.select("name", "r.*")


def estimate_note(kind: Column, matched: Column, abv: Column, category: Column) -> Column:
    number = abv.cast("string")
    by_kind = F.when(kind == "brandMatch", F.concat(F.lit("matched "), matched, F.lit(" (brand, ~"), number, F.lit("% ABV)"))).when(kind == "styleChart", F.concat(F.lit("matched "), matched, F.lit(" (style, ~"), number, F.lit("% ABV)")))
    return by_kind.when(kind == "categoryFallback", F.concat(F.lit("typical "), category, F.lit(" (~"), number, F.lit("% ABV)"))).otherwise(F.concat(F.lit("unclassified (~"), number, F.lit("% ABV)")))


def profile(names: DataFrame, brands: DataFrame, styles: DataFrame, glyphs: bool = True) -> DataFrame:
    """(name, section, category, typical_abv, typical_oz, kind, matched, note) for each distinct (name, section).

    The tiers in turn: a non-alcoholic section, a brand in the name, a misread brand, a style, the section,
    nothing. A known section replaces the category of brand and style.
    """
    asked = names.select("name", F.coalesce("section", F.lit("unknown")).alias("section")).distinct()
    exact = brand_match(asked, brands)
    if glyphs:
        rest = asked.select("name").distinct().join(exact.select("name"), "name", "left_anti")
        exact = exact.unionByName(glyph_match(rest, brands))
    brand = exact.select("name", F.struct("label", "category", "abv").alias("brand"))
    style = style_match(asked, styles).select("name", F.struct("label", "natural_category", "abv", "size_oz").alias("style"))
    rows = asked.join(brand, "name", "left").join(style, "name", "left")
    dry, known = F.col("section") == "nonAlcoholic", F.col("section") != "unknown"
    by_brand, by_style = F.col("brand").isNotNull(), F.col("style").isNotNull()
    sober = dry | (by_brand & (F.col("brand.category") == "nonAlcoholic"))
    category = F.when(sober, "nonAlcoholic").when(known, F.col("section")).when(by_brand, F.col("brand.category")).when(by_style, F.col("style.natural_category")).otherwise("unknown")
    kind = F.when(dry, "categoryFallback").when(by_brand, "brandMatch").when(by_style, "styleChart").when(known, "categoryFallback").otherwise("unclassifiedFallback")
    rows = rows.withColumn("category", category).withColumn("kind", kind)
    abv = F.when(sober, 0.0).when(by_brand, F.col("brand.abv")).when(by_style, F.col("style.abv")).otherwise(default_abv(F.col("category")))
    size = F.when(~sober & ~by_brand & by_style, F.col("style.size_oz"))
    matched = F.when(kind == "brandMatch", F.col("brand.label")).when(kind == "styleChart", F.col("style.label"))
    rows = rows.withColumn("typical_abv", abv).withColumn("typical_oz", F.coalesce(size, default_pour_oz(F.col("category")))).withColumn("matched", matched)
    return rows.select("name", "section", "category", "typical_abv", "typical_oz", "kind", "matched", estimate_note(F.col("kind"), F.col("matched"), F.col("typical_abv"), F.col("category")).alias("note"))


def profile_with_catalog(names: DataFrame, brands: DataFrame, styles: DataFrame, catalog: DataFrame, glyphs: bool = True) -> DataFrame:
    """profile() with a tier for catalog products after brands; a product never gives the size of a pour."""
    base = profile(names, brands, styles, glyphs)
    asked = base.where("kind <> 'brandMatch'").select(F.col("name").alias("query_id"), F.col("name").alias("query")).distinct()
    match = specific_match(asked, catalog).select(F.col("query_id").alias("name"), F.struct(F.col("name"), "category", "abv").alias("product"))
    rows = base.join(match, "name", "left")
    sober = F.col("product.category") == "nonAlcoholic"
    use = (F.col("kind") != "brandMatch") & F.col("product").isNotNull() & (sober | (F.col("product.abv") > 0))
    pick = lambda new, old: F.when(use, new).otherwise(F.col(old)).alias(old)
    category = F.when(sober, "nonAlcoholic").when(F.col("category") == "unknown", F.col("product.category")).otherwise(F.col("category"))
    out = rows.select("name", "section", pick(category, "category"), pick(F.when(sober, 0.0).otherwise(F.col("product.abv")), "typical_abv"), "typical_oz", pick(F.lit("brandMatch"), "kind"), pick(F.col("product.name"), "matched"))
    return out.withColumn("note", estimate_note(F.col("kind"), F.col("matched"), F.col("typical_abv"), F.col("category")))


def abv_with_provenance(read_abv: Column, category: Column, typical: Column, note: Column) -> Column:
    """struct(value, is_estimated, note): the printed strength if plausible for the item's category, else the typical one."""
    ceiling = abv_ceiling(category)
    read = F.coalesce((read_abv > 0) & (ceiling.isNull() | (read_abv <= ceiling)), F.lit(False))
    return F.struct(F.when(read, read_abv).otherwise(typical).alias("value"), (~read).alias("is_estimated"), F.when(~read, note).alias("note"))


def size_with_provenance(read_oz: Column, category: Column, typical: Column) -> Column:
    note = F.concat(F.lit("assumed "), typical.cast("string"), F.lit(" oz for "), category)
    return F.struct(F.coalesce(read_oz, typical).alias("value"), read_oz.isNull().alias("is_estimated"), F.when(read_oz.isNull(), note).alias("note"))


def resolve(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """items with status (ranked, needs_price, excluded), category, abv, size_oz and their provenance.

    `profiles` comes from profile(); names are resolved once however many lists hold them.
    """
    known = profiles.select("name", F.col("section").alias("__section"), F.struct("category", "typical_abv", "typical_oz", "note").alias("p"))
    rows = items.withColumn("__section", F.coalesce("category", F.lit("unknown"))).join(known, ["name", "__section"], "left").drop("__section")
    excluded = (F.col("category") == "nonAlcoholic") | (F.col("p.category") == "nonAlcoholic")
    status = F.when(excluded, "excluded").when(F.col("price_cents") > 0, "ranked").otherwise("needs_price")
    abv = abv_with_provenance(F.col("read_abv"), F.col("category"), F.col("p.typical_abv"), F.col("p.note"))
    size = size_with_provenance(F.col("read_size_oz"), F.col("p.category"), F.col("p.typical_oz"))
    rows = rows.withColumn("status", status).withColumn("a", abv).withColumn("s", size)
    return rows.select("list_id", "item_no", "name", "price_cents", F.col("p.category").alias("category"), "status", F.col("a.value").alias("abv"), F.col("a.is_estimated").alias("abv_estimated"), F.col("a.note").alias("abv_note"), F.col("s.value").alias("size_oz"), F.col("s.is_estimated").alias("size_estimated"), F.col("s.note").alias("size_note"))


def prefilled_packages(products: DataFrame, profiles: DataFrame) -> DataFrame:
    """(product_id, name, abv, abv_estimated, note, label, oz, count): a form for each product (product_id, name, category, abv, ml, units).

    Its own strength or else the typical one of its profile(), always an estimate, and the package.
    """
    known = profiles.select("name", F.col("section").alias("__section"), "typical_abv", "note")
    rows = products.withColumn("__section", F.coalesce("category", F.lit("unknown"))).join(known, ["name", "__section"], "left")
    package = suggest_package(F.col("name"), F.col("__section"), F.col("ml"), F.col("units"))
    own = F.concat("name", F.lit(" at its typical label strength, not read off this package"))
    rows = rows.select("product_id", "name", F.coalesce("abv", "typical_abv").alias("abv"), F.lit(True).alias("abv_estimated"), F.when(F.col("abv").isNotNull(), own).otherwise(F.col("note")).alias("note"), package.alias("p"))
    return rows.select("product_id", "name", "abv", "abv_estimated", "note", "p.label", "p.oz", "p.count")


def prefilled_drinks(drinks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(name, abv, abv_estimated, note, label, oz): a form for each drink (name, category, abv) with a pour.

    A name that was typed has null category and abv: its profile() gives the strength and the category of the pour.
    """
    known = profiles.select("name", F.col("section").alias("__section"), F.col("category").alias("__category"), "typical_abv", "typical_oz", "note")
    rows = drinks.withColumn("__section", F.coalesce("category", F.lit("unknown"))).join(known, ["name", "__section"], "left")
    pour = suggest_pour(F.col("name"), F.coalesce("category", "__category"), F.col("typical_oz"))
    own = F.concat("name", F.lit(" at its typical strength, not read off the menu"))
    rows = rows.select("name", F.coalesce("abv", "typical_abv").alias("abv"), F.lit(True).alias("abv_estimated"), F.when(F.col("abv").isNotNull(), own).otherwise(F.col("note")).alias("note"), pour.alias("p"))
    return rows.select("name", "abv", "abv_estimated", "note", "p.label", "p.oz")
