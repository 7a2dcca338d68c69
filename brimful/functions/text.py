"""Name cleaning and folding columns (CAT1-CAT9, CAT11, SR1-SR3, OCR1-OCR3, OCR6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brimful.functions.vocabulary import ACCENTS, KEEP_UPPER, LIGATURES, LOOK_ALIKES, ML_PER_OZ, PAIRS

UNIT = r"(ml|mls|l|lt|ltr|liter|litre|oz|ounce)\b"
SIZE = rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*{UNIT}"
TRAILING = rf"(?i)[\s,/-]*\b(?:([0-9]+)\s*[/xX*]\s*)?([0-9]+(?:\.[0-9]+)?)\s*{UNIT}\.?\s*$"
#: Code points that are deleted, as ranges, and typographic marks by their plain form.
DELETED = [(0xFE00, 0xFE0F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0xFEFF, 0xFEFF), (0xAD, 0xAD)]
PLAIN_MARKS = {"'": (0x2019, 0x2018), '"': (0x201C, 0x201D), "-": (0x2013, 0x2014), " ": (0xA0,)}
INVISIBLE = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in DELETED) + "]"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def build_upc(raw: Column) -> Column:
    """A barcode as the catalog build keys it: digits, padded to 12; NULL without a digit other than 0."""
    only = digits(raw)
    return F.when(~only.rlike("^0*$"), F.when(F.length(only) < 12, F.lpad(only, 12, "0")).otherwise(only))


def lookup_upc(raw: Column) -> Column:
    """A barcode as lookups key it: digits without the leading zeros beyond 12."""
    return F.regexp_replace(digits(raw), "^0+(?=[0-9]{12,}$)", "")


def _ml(value: Column, unit: Column) -> Column:
    scale = F.when(unit.startswith("ml"), 1.0).when(unit.startswith("l"), 1000.0).otherwise(ML_PER_OZ)
    return F.when(value > 0, value * scale)


def ml_from_size(text: Column) -> Column:
    """Millilitres of the first size in a text."""
    return _ml(F.regexp_extract(text, SIZE, 1).try_cast("double"), F.lower(F.regexp_extract(text, SIZE, 2)))


def size_from_description(name: Column) -> Column:
    """struct(ml, units, name): a trailing size like 4/187ML, its multiplier from 2 to 48, and the name before it."""
    ml = F.round(_ml(F.regexp_extract(name, TRAILING, 2).try_cast("double"), F.lower(F.regexp_extract(name, TRAILING, 3))), 1)
    many = F.regexp_extract(name, TRAILING, 1).try_cast("int")
    before = F.regexp_replace(F.regexp_replace(name, TRAILING, ""), r"^[ ,/-]+|[ ,/-]+$", "")
    return F.struct(ml.alias("ml"), F.when(ml.isNotNull() & many.between(2, 48), many).alias("units"), F.when(ml.isNotNull() & (before != ""), before).otherwise(name).alias("name"))


def sanitize(name: Column) -> Column:
    """Without invisible and control characters, with plain quotes and dashes and single spaces."""
    text = F.regexp_replace(F.regexp_replace(name, INVISIBLE, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.translate(text, "".join(chr(c) for cs in PLAIN_MARKS.values() for c in cs), "".join(k * len(cs) for k, cs in PLAIN_MARKS.items()))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _title(word: Column) -> Column:
    """Upper-case after everything that is not a letter; a single letter after an apostrophe stays small."""
    parts = F.regexp_extract_all(F.lower(word), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    titled = F.array_join(F.transform(parts, F.initcap), "")
    single = r"(?<=['’])([\p{L}])(?![\p{L}\p{N}_])"
    marked = F.split(F.regexp_replace(titled, single, "\u0001$1\u0001"), "\u0001")
    return F.when(titled.rlike(single), F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, F.lower(x)).otherwise(x)), "")).otherwise(titled)


def prettify(name: Column) -> Column:
    """A shouted name in title case; acronyms stay upper-case and mixed-case words as they are."""

    def word(w: Column) -> Column:
        shouted = w.rlike(r"\p{L}") & ((w == F.upper(w)) | (w == F.lower(w)))
        return F.when(F.upper(F.regexp_replace(w, "[^A-Za-z0-9]", "")).isin(*KEEP_UPPER), F.upper(w)).when(shouted, _title(w)).otherwise(w)

    return F.array_join(F.transform(F.split(sanitize(name), " "), word), " ")


def clean_float(raw: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """The number in a text if low < number <= high."""
    value = F.regexp_replace(raw, r"[^0-9.]", "").try_cast("double")
    return F.when((value > low) & (value <= high), value)


def abv_from_proof(abv: Column, proof: Column) -> Column:
    return F.coalesce(abv, F.round(clean_float(proof, 0, 200) / 2, 2))


def bc_category(category: Column, subcategory: Column, item_class: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(subcategory, F.lit("")), F.coalesce(item_class, F.lit(""))))
    has = lambda *words: blob.rlike("|".join(words))
    spirits = F.when(has("liqueur", "ready to serve", "cocktail"), "cocktail").otherwise("shot")
    return F.when(has("de-alcoholized", "alcohol free"), "nonAlcoholic").when(category == "Beer", "bottledBeer").when(has("cider"), "cider").when(has("cooler", "seltzer"), "seltzer").when(category == "Wine", "wineGlass").when(category == "Spirits", spirits).when(has("refreshment"), "seltzer").otherwise("unknown")


def tag_category(tags: Column) -> Column:
    """Category of an array of tags; NULL for what is no drink."""
    blob = F.lower(F.array_join(tags, " "))
    has = lambda *words: blob.rlike("|".join(words))
    return F.when(has("beer", "ale"), "bottledBeer").when(has("cider"), "cider").when(has("seltzer"), "seltzer").when(has("wine", "champagne", "sparkling"), "wineGlass").when(has("spirit", "whisky", "whiskey", "vodka"), "shot").when(has("alcoholic"), "unknown")


def fold(text: Column) -> Column:
    """Search form of a name: lower-case ASCII words with single spaces."""
    plain = F.translate(F.lower(text), "".join(ACCENTS.values()), "".join(k * len(v) for k, v in ACCENTS.items()))
    for pair, letters in PAIRS.items():
        plain = F.replace(plain, F.lit(pair), F.lit(letters))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "['’.]", ""), "[^a-z0-9]+", " "))


def words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


def match_tier(name: Column, query: Column) -> Column:
    """0 equal, 1 prefix, 2 prefix of a word, 3 substring, 4 every word a substring; NULL for no match. Both folded."""
    several = F.size(words(query)) > 1
    every = F.forall(words(query), lambda w: F.contains(name, w))
    return F.when(query == "", None).when(name == query, 0).when(F.startswith(name, query), 1).when(F.contains(name, F.concat(F.lit(" "), query)), 2).when(F.contains(name, query), 3).when(several & every, 4)


def glyph_fold(word: Column) -> Column:
    """A word by the shape of its glyphs, as misread print has it."""
    shape = F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")
    for pair, letter in LIGATURES:
        shape = F.replace(shape, F.lit(pair), F.lit(letter))
    return F.translate(shape, *LOOK_ALIKES)


def glyph_tokens(name: Column) -> Column:
    return F.filter(F.transform(F.split(name, r"[ \-/\t\n]"), glyph_fold), lambda w: (w != "") & (w != "and"))
