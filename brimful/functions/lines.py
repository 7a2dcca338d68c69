"""What one line of a price list says (LN1-LN16, LN18, LN19); everything here is a column over the line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimful.functions import vocabulary as V
from brimful.functions.binding import let
from brimful.functions.money import price_cents

EDGES = r"^[.,|:;\-–—()/]+|[.,|:;\-–—()/]+$"
TRAILING = r"[ \-–—|:,•·.]+$"
#: Where a token ends, in a pattern over a whole line; `$` of a pattern over a token also stands before a last line end.
ENDS = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?(?![^ ])"
TOKEN_EDGES = rf"(?=[.,|:;\-–—()/])(?:(?<![^ ])[.,|:;\-–—()/]+|[.,|:;\-–—()/]+(?={ENDS}))"
#: Tokens that are no part of a name: strengths, sizes and dashes.
MEASURES = rf"(?<![^ ])(?:[aA][bB][vV](?![^ ])|(?:[<>]*[\p{{N}}.]+%\.*|[\p{{N}}.]+[oO][zZ]\.*|[-–—]+){ENDS})"


def is_in(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def without_blank_ends(text: Column) -> Column:
    """text without spaces, tabs and line ends around it; the pattern is only tried where spaces are not all there is."""
    odd = lambda t: is_in(F.substring(t, 1, 1), list("\t\n\r")) | is_in(F.substring(t, -1, 1), list("\t\n\r\u0085\u2028\u2029"))
    return let(F.trim(text), lambda t: F.when(odd(t), F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).otherwise(t))


def without_trailing(text: Column) -> Column:
    """text without marks and spaces at its end."""
    return let(text, lambda t: F.when(is_in(F.substring(t, -1, 1), list(" -–—|:,•·.\n\r\u0085\u2028\u2029")), F.regexp_replace(t, TRAILING, "")).otherwise(t))


def has_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def has_anchored_price(line: Column) -> Column:
    return line.rlike(r"[$£€][$£€ ]*\p{N}")


def detect_abv(line: Column) -> Column:
    """The first percentage over 0 and up to 100."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"([\p{N}.]*)%"), F.lit(1)), lambda d: d.try_cast("double"))
    return F.when(F.contains(line, F.lit("%")), F.get(F.filter(found, lambda v: (v > 0) & (v <= 100)), F.lit(0)))


def detect_size(line: Column) -> Column:
    """Ounces stated before the first "oz"; a pint is 16."""
    lowered = F.lower(line)
    stated = F.regexp_extract(F.substring_index(lowered, "oz", 1), r"([\p{N}.]*) *$", 1).try_cast("double")
    return F.when(F.contains(lowered, F.lit("oz")) & (stated > 0), stated).when(F.contains(lowered, F.lit("pint")), 16.0)


def without_separators(line: Column) -> Column:
    return F.regexp_replace(line, "[•·…|/_]", " ")


def without_dot_runs(line: Column) -> Column:
    return F.regexp_replace(line, r"\.{2,}", " ")


def spaced(line: Column) -> Column:
    """The line with spaces for separators and runs of dots, in one pass."""
    return F.regexp_replace(line, r"[•·…|/_]|\.{2,}", " ")


def has_dot_leader(line: Column) -> Column:
    return F.contains(line, F.lit(".."))


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def strip_edges(token: Column) -> Column:
    return F.regexp_replace(token, EDGES, "")


def _plain(token: Column) -> Column:
    return F.lower(strip_edges(token))


def pure_number(token: Column) -> Column:
    return F.when(token.rlike(r"^[$sS]?[\p{N}.]+$"), F.regexp_replace(token, "^[$sS]", "").try_cast("double"))


def normalized_dollars(number: Column) -> Column:
    """Dollars of a digit run; four digits or more without a point end in cents."""
    n = F.length(number)
    cents = F.substring(number, F.lit(1), n - 2).try_cast("double") + F.substring(number, n - 1, F.lit(2)).try_cast("double") / 100
    return F.when(F.contains(number, F.lit(".")) | (n < 4), number.try_cast("double")).otherwise(cents)


def repaired_digits(text: Column) -> Column:
    return F.translate(text, "sSoO", "5500")


def dollar_value(token: Column) -> Column:
    number = F.regexp_extract(repaired_digits(F.substring(token, F.lit(2), F.length(token))), r"^[\p{N}.]+", 0)
    return F.when(token.rlike("^[$sS]"), let(number, lambda n: F.when(n != "", normalized_dollars(n))))


def is_measure(word: Column) -> Column:
    """A measurement, price or separator; `word` is lower-case without edge marks."""
    measure = is_in(word, ["|", "-", "/", "&", "$", "abv"]) | word.startswith("+") | pure_number(word).isNotNull() | word.rlike(r"(oz\.?|%|ml)$")
    return word.rlike(r"^(?:[|\-/&$+\p{N}.]|[sS][\p{N}.]|abv)|(?:oz\.?|%|ml)$") & measure  # most words end at the first pattern


def is_percent(token: Column) -> Column:
    return token.rlike(r"^[<>]*[\p{N}.]+%\.*$")


def is_size(token: Column) -> Column:
    return F.lower(token).rlike(r"^[\p{N}.]+oz\.*$")


def clean_name(name: Column) -> Column:
    """A name without list number, strength, size and dashes."""

    def numbered(ts: Column) -> Column:
        first, second = F.get(ts, F.lit(0)), F.get(ts, F.lit(1))
        bare = F.regexp_replace(first, "^#", "")
        core = strip_edges(bare)
        number = (F.size(ts) >= 2) & core.rlike(r"^\p{N}{1,3}$")
        marked = first.startswith("#") | (bare != core)
        spaced = second.rlike("^[-–—]+$") | is_in(second, [".", ":"])
        return F.when(number & marked, F.slice(ts, F.lit(2), F.size(ts))).when(number & spaced, F.slice(ts, F.lit(3), F.size(ts))).otherwise(ts)

    def kept(listed: Column) -> Column:
        bare = F.when(listed.rlike(r"%|[-–—]|[oO][zZ]|[aA][bB][vV]"), F.regexp_replace(listed, MEASURES, "")).otherwise(listed)
        return let(bare, lambda x: F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)))

    listed = lambda n: F.when(n.rlike(r"^ *#?[.,|:;\-–—()/]*\p{N}"), F.array_join(let(tokens(n), numbered), " ")).otherwise(n)
    return without_trailing(let(let(name, listed), kept))


def parse_item(line: Column, flat: Column | None = None) -> Column:
    """struct(dollars, name): from the first $, else a bare run of four digits or more, else a last pure number.

    `flat`, if known, is spaced(line), here and below.
    """

    def without_price(text: Column, ts: Column) -> Column:
        bare = F.array_position(F.transform(ts, lambda t: strip_edges(t).rlike(r"^\p{N}{4,}$")), F.lit(True)).cast("int")
        up_to = lambda n: F.array_join(F.slice(ts, F.lit(1), n), " ")

        def without_dollar(at: Column, last: Column) -> Column:
            """struct(dollars, part) of a line without $; `at` is the place of the bare run."""
            long = F.struct(normalized_dollars(strip_edges(F.get(ts, at - 1))).alias("dollars"), up_to(at - 1).alias("part"))
            return F.when(at > 0, long).otherwise(F.struct(last.alias("dollars"), F.when(last.isNotNull(), up_to(F.size(ts) - 1)).otherwise(text).alias("part")))

        return let(bare, lambda at: let(pure_number(F.try_element_at(ts, F.lit(-1))), lambda last: without_dollar(at, last)))

    def priced(text: Column) -> Column:
        number = let(repaired_digits(F.regexp_extract(text, r"^[^$]*\$([\p{N}.sSoO]*)", 1)), lambda after: F.when(after != "", normalized_dollars(after)))
        with_dollar = F.struct(number.alias("dollars"), F.substring_index(text, "$", 1).alias("part"))
        return F.when(F.contains(text, F.lit("$")), with_dollar).otherwise(let(tokens(text), lambda ts: without_price(text, ts)))

    named = lambda x: F.struct(x.dollars.alias("dollars"), clean_name(without_trailing(without_blank_ends(x.part))).alias("name"))
    return let(let(spaced(line) if flat is None else flat, priced), named)


def outside_brackets(line: Column) -> Column:
    """The characters outside all brackets; unbalanced ones do not count."""

    def step(s: Column, part: Column) -> Column:
        opens, closes = F.rlike(part, F.lit(r"^[(\[]")), F.rlike(part, F.lit(r"^[)\]]"))
        depth = F.when(opens, s.depth + 1).when(closes, F.greatest(F.lit(0), s.depth - 1)).otherwise(s.depth)
        rest = F.regexp_replace(part, r"^[()\[\]]", "")
        return F.struct(depth.alias("depth"), F.when(depth > 0, s.out).otherwise(F.concat(s.out, F.array(rest))).alias("out"))

    # Cut before each bracket: a part is left out as a whole or kept without its bracket.
    parts = F.split(line, r"(?=[()\[\]])")
    cut = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out")), step, lambda s: F.array_join(s.out, ""))
    return F.when(line.rlike(r"[()\[\]]"), cut).otherwise(line)


def is_attribute_line(line: Column) -> Column:
    """States attributes of the drink above and names none of its own."""

    def measured(t: Column) -> Column:
        return let(_plain(t), lambda w: ~w.rlike(r"[\p{L}\p{N}]") | is_measure(w) | is_percent(w) | is_size(w) | (w == "abv") | w.rlike(r"^[\p{N}.]*[% ]*abv$"))

    def states(outside: Column) -> Column:
        only = F.forall(tokens(without_separators(outside)), measured)
        stated = detect_abv(line).isNotNull() | detect_size(line).isNotNull()
        return only & F.when(outside != line, line.rlike(r"\p{L}")).otherwise(stated)

    return ~F.contains(line, F.lit("$")) & let(outside_brackets(line), states)


def _plain_tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.regexp_replace(line, TOKEN_EDGES, "")), " "), "")


def plain_words(line: Column) -> Column:
    """Lower-case words without edge marks, separators taken as spaces."""
    return _plain_tokens(without_separators(line))


def is_pure_label(ws: Column) -> Column:
    """Of plain words: nothing but section words, vessels, prices and filler, with a section word."""
    section = lambda w: ~is_measure(w) & ~is_in(w, V.LABEL_FILLER) & is_in(w, V.SECTION_WORDS)
    passes = lambda w: is_in(w, [*V.LABEL_FILLER, *V.SECTION_WORDS, *V.VESSEL_WORDS]) | is_measure(w)
    return F.forall(ws, passes) & F.exists(ws, section)


def label_category(ws: Column) -> Column:
    return F.coalesce(*(F.when(F.arrays_overlap(ws, F.array(*map(F.lit, words))), category) for category, words in V.LABEL_WORDS))


def _header_keyword(line: Column) -> Column:
    """struct(category, keyword) of the first keyword in order that the line contains."""
    first = lambda lowered: F.coalesce(*(F.when(F.contains(lowered, F.lit(k)), F.struct(F.lit(category).alias("category"), F.lit(k).alias("keyword"))) for category, keywords in V.HEADER_KEYWORDS for k in keywords))
    return let(F.lower(line), first)


def is_plausible_header(line: Column, ws: Column, keyword: Column, most: int = 2) -> Column:
    """No list or sentence, no strength, and at most two words besides the keyword."""
    parts = F.split(keyword, " ")

    def modifier(w: Column) -> Column:
        known = is_in(w, V.LABEL_FILLER) | is_measure(w) | is_in(w, V.SECTION_WORDS) | F.array_contains(parts, w) | F.exists(parts, lambda p: (F.length(p) >= 4) & F.contains(w, p))
        return w.rlike(r"\p{L}") & ~known

    return ~line.rlike("[,•·]") & detect_abv(line).isNull() & (F.size(F.filter(ws, modifier)) <= most)


def section_category(line: Column, ws: Column, dollars: Column) -> Column:
    """The category a section header opens; NULL for lines that are none. `dollars` is the line's parsed price."""
    priced = price_cents(dollars).isNotNull() & ~F.contains(line, F.lit("|")) & ~has_dot_leader(line)

    def by_keyword(pure: Column) -> Column:
        return F.when(~(priced & ~pure), let(_header_keyword(line), lambda hit: F.when(hit.isNotNull() & is_plausible_header(line, ws, hit.keyword), hit.category)))

    return let(is_pure_label(ws), lambda pure: F.coalesce(F.when(pure, label_category(ws)), by_keyword(pure)))


def is_wine_sub_label(ws: Column) -> Column:
    return (F.size(ws) > 0) & F.forall(ws, lambda w: is_in(w, V.WINE_SUB_LABELS))


def is_food_header(line: Column, words: Column | None = None) -> Column:
    """`words`, if known, are the line's lower-case words without edge marks, here and below; separators are no spaces to them."""
    ws, filler = _plain_tokens(line) if words is None else words, ["&", *V.LABEL_FILLER, *V.FOOD_SECTION_FILLER]
    return F.forall(ws, lambda w: is_in(w, [*filler, *V.FOOD_SECTION_WORDS])) & F.exists(ws, lambda w: ~is_in(w, filler))


def is_food(line: Column, words: Column | None = None) -> Column:
    return F.exists(_plain_tokens(line) if words is None else words, lambda w: is_in(w, V.FOOD_WORDS))


def is_url(line: Column) -> Column:
    return has_any(F.lower(line), V.URL_MARKERS)


def is_non_alcoholic(line: Column) -> Column:
    return has_any(F.lower(line), V.NON_ALCOHOLIC_MARKERS)


def is_description(line: Column) -> Column:
    return F.contains(line, F.lit("•")) | F.contains(line, F.lit("·")) | (F.contains(line, F.lit(",")) & line.rlike(",.*,")) | (F.size(tokens(line)) > 6)


def title_words(name: Column) -> Column:
    """The words of a name that can make it a title."""
    real = lambda w: (F.length(w) >= 2) & ~is_in(w, V.LABEL_FILLER) & w.rlike(r"\p{L}") & ~is_measure(w)
    return F.filter(_plain_tokens(name), real)


def is_rankable(name: Column) -> Column:
    """Looks like the title of a drink."""

    def titled(ws: Column) -> Column:
        all_in = lambda words: F.forall(ws, lambda w: is_in(w, words))
        return (F.size(ws) > 0) & ~all_in(V.SECTION_WORDS) & ~all_in(V.VESSEL_WORDS) & ~is_in(F.get(ws, F.lit(0)), V.PROMO_LEADS) & (F.size(F.filter(ws, lambda w: is_in(w, V.RECIPE_WORDS))) < 2)

    return let(title_words(name), titled)


def marks(line: Column, flat: Column | None = None) -> Column:
    """array<struct<token, price, size, label>>: what each token is to a line of several prices."""

    def sized(t: Column, lowered: Column) -> Column:
        """struct(size, label) of a token that is no price."""
        ounces = F.when(lowered.endswith("oz") & (F.length(lowered) > 2), F.regexp_replace(lowered, "oz$", "").try_cast("double"))
        word = F.coalesce(*(F.when(lowered == w, oz) for w, oz in V.SIZE_WORDS.items()))

        def of_ounces(oz: Column) -> Column:
            label = F.concat(F.when(oz == F.round(oz), F.round(oz).cast("long").cast("string")).otherwise(oz.cast("string")), F.lit(" oz"))
            return F.when(oz > 0, F.struct(oz.alias("size"), label.alias("label"))).otherwise(let(word, lambda w: F.struct(w.alias("size"), F.when(w.isNotNull(), lowered).alias("label"))))

        return let(ounces, of_ounces)

    def mark(t: Column) -> Column:
        known = lambda price: F.struct(t.alias("token"), price.alias("price"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("string").alias("label"))
        other = let(let(_plain(t), lambda lowered: sized(t, lowered)), lambda x: F.struct(t.alias("token"), F.lit(None).cast("double").alias("price"), x["size"].alias("size"), x.label.alias("label")))
        return let(dollar_value(t), lambda price: F.when(F.coalesce(price > 0, F.lit(False)), known(price)).otherwise(other))

    return F.transform(tokens(spaced(line) if flat is None else flat), mark)


def may_have_marks(flat: Column) -> Column:
    """False only for lines that are neither a grid nor hold two prices: the first token is none of a grid, and no two tokens begin as prices."""
    sizes = "|".join(V.SIZE_WORDS)
    grid = rf"""^ *(?:[$s][\p{{N}}.so]|[.,|:;\-–—()/"*°'•·\p{{N}}+&$]|abv|{sizes}|[^ ]*(?:oz|ml|%))"""
    return F.lower(flat).rlike(grid + r"|(?s)[$s](?<![^ ].)[\p{N}.so].* [$s][\p{N}.so]")


def grid_price(marked: Column) -> Column:
    """The smallest price of a nameless grid of sizes and prices."""
    plain = lambda m: m.price.isNotNull() | m["size"].isNotNull() | m.token.rlike(r"""^[.,|:;\-–—()/"*°'•·]+$""") | is_measure(_plain(m.token))
    prices = F.transform(F.filter(marked, lambda m: m.price.isNotNull()), lambda m: m.price)
    grid = (F.size(marked) >= 2) & F.forall(marked, plain) & ((F.size(prices) >= 2) | F.exists(marked, lambda m: m["size"].isNotNull()))
    return F.when(grid, F.array_min(prices))


#: A line that ends in its only price, a token of dollars and cents above zero.
PLAIN_PRICE = r"^([^$]* )\$((?=[0.]*[1-9])[0-9]{1,6}\.[0-9]{2})\z"


def line_kind(text: Column) -> Column:
    """A line with all the features of `text` but its price, text and non-alcoholic marks: the same line at one fixed price, if it ends in its only price and is no grid."""
    plain = text.rlike(PLAIN_PRICE) & ~may_have_marks(spaced(text))
    return F.when(plain, F.concat(F.substring_index(text, "$", 1), F.lit("$1.11"))).otherwise(text)


def priced_kind(text: Column, kind: Column, cents: Column) -> Column:
    """The price of `text` where `cents` is that of its kind."""
    return F.when(kind == text, cents).otherwise(price_cents(F.substring_index(text, "$", -1).try_cast("double")))


def line_features(lines: DataFrame) -> DataFrame:
    """lines with one column for each thing the list reader asks of a line."""
    text, flat = F.col("text"), F.col("flat")
    out = lines.withColumn("text", without_blank_ends(F.coalesce("line", F.lit("")))).withColumn("flat", spaced(text))
    ws = F.when(has_dot_leader(text), plain_words(text)).otherwise(_plain_tokens(flat))
    out = out.withColumns({"item": parse_item(text, flat), "marks": F.when(may_have_marks(flat), marks(text, flat)), "ws": ws})
    out = out.withColumn("words", F.when(flat == text, F.col("ws")).otherwise(_plain_tokens(text)))
    return out.select(
        *lines.columns,
        "text",
        (text == "").alias("is_blank"),
        is_food_header(text, F.col("words")).alias("is_food_header"),
        is_attribute_line(text).alias("is_attribute"),
        section_category(text, F.col("ws"), F.col("item.dollars")).alias("section"),
        is_wine_sub_label(F.col("ws")).alias("is_sub_label"),
        is_food(text, F.col("words")).alias("is_food"),
        is_url(text).alias("is_url"),
        is_non_alcoholic(F.coalesce("line", F.lit(""))).alias("is_non_alcoholic"),
        price_cents(grid_price(F.col("marks"))).alias("grid_cents"),
        F.when(F.size(F.filter("marks", lambda m: m.price.isNotNull())) >= 2, F.col("marks")).alias("marks"),
        is_description(text).alias("is_description"),
        F.col("item.name").alias("name"),
        price_cents(F.col("item.dollars")).alias("price_cents"),
        is_rankable(F.col("item.name")).alias("is_rankable"),
        detect_abv(text).alias("read_abv"),
        detect_size(text).alias("read_size_oz"),
        has_anchored_price(text).alias("has_anchored_price"),
    )
