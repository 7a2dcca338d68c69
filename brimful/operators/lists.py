"""Reading lists: ordered state over the lines of a list, as running values of windows (LN17, ST1-ST5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brimful.functions.lines import TRAILING, is_in, is_non_alcoholic, line_features, line_kind, priced_kind, title_words, without_blank_ends
from brimful.functions.vocabulary import PROMO_LEADS, RECIPE_WORDS, SECTION_WORDS, SIZE_WORDS, VESSEL_WORDS
from brimful.operators.dealing import dealt
from brimful.sources.sinks import materialized

#: Names and ounces of two prices without a size: the lower, then the higher.
GLASS, BOTTLE = (5.0, "glass"), (25.36, "bottle")


def _names_a_drink(words: Column, label: Column) -> Column:
    """Whether title words and a size label in brackets make the title of a drink."""
    ws = F.when(is_in(label, list(SIZE_WORDS)), F.concat(words, F.array(label))).otherwise(words)
    only = lambda known: F.forall(ws, lambda w: is_in(w, known))
    recipe = F.size(F.filter(ws, lambda w: is_in(w, RECIPE_WORDS)))
    return (F.size(ws) > 0) & ~only(SECTION_WORDS) & ~only(VESSEL_WORDS) & ~is_in(F.get(ws, F.lit(0)), PROMO_LEADS) & (recipe < 2)


def with_sizes(features: DataFrame) -> DataFrame:
    """features with `sizes`, array<struct<name, cents, size, rankable>>: the items of a line with several prices; empty for others.

    Each price takes a size mark of its own: the last one left between the price before and itself, or else the first one
    behind it. Two prices without any are a glass and a bottle. The words before the first mark are the name.
    """
    marks, nth = F.col("marks"), lambda xs, k: F.get(F.col(xs), k)
    places = F.sequence(F.lit(0), F.size(marks) - 1)
    first = F.get(F.filter(places, lambda i: F.get(marks, i).price.isNotNull() | F.get(marks, i)["size"].isNotNull()), F.lit(0))
    base = F.regexp_replace(F.trim(F.array_join(F.transform(F.slice(marks, F.lit(1), first), lambda m: m.token), " ")), TRAILING, "")
    rows = features.withColumns({"__priced": F.filter(places, lambda i: F.get(marks, i).price.isNotNull()), "__base": F.when(marks.isNotNull(), base)})
    rows = rows.withColumn("__ends", F.concat(F.array(F.lit(-1)), "__priced", F.array(F.size(marks))))
    between = lambda k: F.filter(places, lambda i: F.get(marks, i)["size"].isNotNull() & (i > nth("__ends", k)) & (i < nth("__ends", k + 1)))
    rows = rows.withColumn("__gaps", F.transform(F.sequence(F.lit(0), F.size("__priced")), between))

    def take(state: Column, k: Column) -> Column:
        """`used` tells whether the price before took the first size of this gap."""
        left, behind = nth("__gaps", k), nth("__gaps", k + 1)
        own = F.size(left) > state.used
        taken = F.when(own, F.try_element_at(left, F.lit(-1))).otherwise(F.get(behind, F.lit(0)))
        return F.struct((~own & (F.size(behind) > 0)).cast("int").alias("used"), F.concat(state.taken, F.array(taken)).alias("taken"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))
    rows = rows.withColumn("__taken", F.aggregate(F.sequence(F.lit(0), F.size("__priced") - 1), start, take, lambda state: state.taken))
    price = lambda k: F.get(marks, nth("__priced", k)).price
    bare = (F.size("__priced") == 2) & F.forall("__taken", lambda t: t.isNull())
    lower = lambda k: F.when(price(F.lit(0)) <= price(F.lit(1)), k == 0).otherwise(k == 1)
    pair = lambda k, at: F.when(lower(k), GLASS[at]).otherwise(BOTTLE[at])

    def entry(at: Column, k: Column) -> Column:
        mark = F.get(marks, nth("__taken", k))
        label = F.when(bare, pair(k, 1)).otherwise(mark.label)
        name = F.when(F.coalesce(label, F.lit("")) != "", F.concat("__base", F.lit(" ("), label, F.lit(")"))).otherwise(F.col("__base"))
        return F.struct(name.alias("name"), F.floor(F.get(marks, at).price * 100 + 0.5).cast("int").alias("cents"), F.when(bare, pair(k, 0)).otherwise(mark["size"]).alias("size"))

    def titled(e: Column) -> Column:
        label = F.when(F.endswith(e["name"], F.lit(")")), F.regexp_replace(F.substring_index(e["name"], " (", -1), r"\)$", "")).otherwise(F.lit(""))
        return F.struct(e["name"].alias("name"), e.cents.alias("cents"), e["size"].alias("size"), _names_a_drink(F.col("__words"), label).alias("rankable"))

    rows = rows.withColumn("__words", F.when(marks.isNotNull(), title_words(F.col("__base"))))
    rows = rows.withColumn("__entries", F.filter(F.transform("__priced", entry), lambda e: e.cents > 0))
    good = F.coalesce((F.size("__priced") >= 2) & (F.col("__base") != "") & (F.size("__entries") >= 2), F.lit(False))
    none = F.array().cast("array<struct<name:string,cents:int,size:double,rankable:boolean>>")
    rows = rows.withColumn("sizes", F.when(good, F.transform("__entries", titled)).otherwise(none))
    return rows.drop("__priced", "__base", "__ends", "__gaps", "__taken", "__words", "__entries")


#: Kinds of lines up to which their features are sent to every task; where there are more, each line's are computed where it stands.
MOST_KINDS = 100_000


def features(lines: DataFrame, deal: bool = False) -> DataFrame:
    """line_features() with `sizes`, computed once for all lines that differ in their price alone, however many lists hold them.

    With `deal`, lists are dealt to tasks before their lines meet the features. Reads the lines twice.
    """
    text = without_blank_ends(F.coalesce("line", F.lit("")))
    kinds = materialized(lines.select(line_kind(text).alias("line")).distinct(), "kinds")
    own = dealt(lines, "list_id") if deal else lines
    if kinds.count() > MOST_KINDS:
        return with_sizes(line_features(own))
    known = with_sizes(line_features(kinds))
    rows = own.withColumn("text", text).withColumn("kind", line_kind(F.col("text"))).join(F.broadcast(known.withColumnRenamed("line", "kind").drop("text")), "kind")
    rows = rows.withColumn("price_cents", priced_kind(F.col("text"), F.col("kind"), F.col("price_cents"))).withColumn("is_non_alcoholic", is_non_alcoholic(F.coalesce("line", F.lit(""))))
    return rows.select(*lines.columns, "text", *(c for c in known.columns if c not in ("line", "text")))


def gated(lines: DataFrame) -> DataFrame:
    """Features of each line with `at` (its place), `gate`, the running `category` and `header_cents`, its `items` and how many came before.

    What a line is depends on state that earlier lines set; all of it is last values over the lines before, in one order
    and one shuffle by list_id:
    1. A food header begins a food region and any section ends it, so the region needs no other state.
    2. The first line that can be an item before any attribute is adopted is the first item; from then on, outside of
       food, lines of attributes belong to the item above them.
    3. The other section lines give the category, and a price or none for their items; labels within a wine section keep it.
    4. A grid of prices fills the item above that waits for one, else it prices the items below. Items only wait where no
       price is inherited: until the first grid of a section that finds no item waiting.
    """
    flag = lambda condition: F.coalesce(condition, F.lit(False))
    last = lambda value, when, over: F.last(F.when(when, value), ignorenulls=True).over(over)
    c = F.col
    in_list = Window.partitionBy("list_id").orderBy("line_no", "line")
    before, up_to = in_list.rowsBetween(Window.unboundedPreceding, -1), in_list.rowsBetween(Window.unboundedPreceding, 0)
    f = features(lines.select("list_id", "line_no", "line"), deal=True).withColumn("at", F.row_number().over(in_list))
    filled, food, section = ~c("is_blank"), ~c("is_blank") & c("is_food_header"), c("section").isNotNull()
    f = f.withColumn("in_food", flag(last(food, filled & (food | section), before)))
    no_drink = c("in_food") | c("is_food") | c("is_url")
    starts = filled & ~food & ~section & ~no_drink & c("grid_cents").isNull() & ((F.size("sizes") > 0) | (c("name") != ""))
    f = f.withColumn("has_items", flag(F.max(flag(starts)).over(before)))
    f = f.withColumn("adopts", filled & ~food & c("has_items") & ~c("in_food") & c("is_attribute"))
    f = f.withColumn("opens", filled & ~food & ~c("adopts") & section)
    f = f.withColumn("category", F.coalesce(last(c("section"), c("opens"), before), F.lit("unknown")))
    keeps = (c("section") == "wineGlass") & (c("category") == "wineGlass") & c("price_cents").isNull() & c("is_sub_label")
    f = f.withColumn("prices", c("opens") & ~flag(keeps))
    plain = filled & ~food & ~c("adopts") & ~c("opens") & ~no_drink
    f = f.withColumn("is_grid", plain & c("grid_cents").isNotNull())
    f = f.withColumn("is_sizes", plain & ~c("is_grid") & (F.size("sizes") > 0))
    f = f.withColumn("rest", plain & ~c("is_grid") & ~c("is_sizes"))
    f = f.withColumn("may_describe", c("rest") & c("price_cents").isNull() & c("is_description") & c("has_items"))
    since = F.struct("at", "price_cents")
    f = f.withColumn("since", last(since, c("prices"), up_to)).withColumns({"epoch": F.coalesce("since.at", F.lit(0)), "epoch_cents": c("since.price_cents")})
    titled = c("rest") & (c("name") != "") & ~c("may_describe")
    waits = titled & c("price_cents").isNull() & c("is_rankable")
    f = f.withColumn("item_waits", flag(last(waits, food | c("opens") | c("is_grid") | c("is_sizes") | titled, before)))
    f = f.withColumn("inherits", c("epoch_cents").isNotNull() | flag(last(c("epoch"), c("is_grid") & ~c("item_waits"), before) == c("epoch")))
    f = f.withColumn("fills", c("is_grid") & ~c("inherits") & c("item_waits"))
    f = f.withColumn("grid", last(F.struct("epoch", "grid_cents"), c("is_grid") & ~c("fills"), before))
    f = f.withColumn("header_cents", F.when(c("grid.epoch") == c("epoch"), c("grid.grid_cents")).otherwise(c("epoch_cents")))
    f = f.withColumn("describes", c("may_describe") & c("header_cents").isNull())
    f = f.withColumn("is_item", c("rest") & ~c("describes") & (c("name") != ""))
    gate = (
        F.when(c("is_blank"), "blank").when(food, "food_header").when(c("adopts"), "attribute").when(c("opens"), "section")
        .when(c("in_food"), "in_food").when(c("is_food"), "food").when(c("is_url"), "url")
        .when(c("fills"), "grid_back").when(c("is_grid"), "grid").when(c("is_sizes"), "sizes")
        .when(c("describes"), "description").when(c("is_item"), "item").otherwise("no_name")
    )
    one = F.struct(c("name"), F.when(c("is_rankable"), F.coalesce("price_cents", "header_cents")).alias("cents"), c("read_size_oz").alias("size"))
    several = F.transform("sizes", lambda s: F.struct(s["name"].alias("name"), F.when(s.rankable, s.cents).alias("cents"), s["size"].alias("size")))
    f = f.withColumn("gate", gate).withColumn("items", F.when(c("is_sizes"), several).when(c("is_item"), F.array(one)).otherwise(F.slice(several, 1, 0)))
    return f.withColumn("items_before", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)).cast("int"))


def parse_lists(lines: DataFrame) -> DataFrame:
    """Items of every list from lines (list_id string, line_no int, line string).

    (list_id, item_no, name, price_cents, read_abv, read_size_oz, category, description, line_no). A line gives its items,
    or adds to the item above it: attributes, a description, or the price of a grid.
    """
    c, nothing = F.col, lambda kind: F.lit(None).cast(kind)
    category = F.when(c("is_non_alcoholic"), "nonAlcoholic").otherwise(c("category"))
    own = F.transform("items", lambda x, k: F.struct((c("items_before") + k).alias("item_no"), F.struct(x["name"].alias("name"), category.alias("category"), c("line_no").alias("line_no")).alias("title"), x.cents.alias("cents"), c("read_abv").alias("abv"), x["size"].alias("size"), nothing("string").alias("note")))
    adopts, describes = c("gate") == "attribute", c("gate") == "description"
    title = nothing("struct<name:string,category:string,line_no:int>")
    added = F.struct((c("items_before") - 1).alias("item_no"), title.alias("title"), F.when(c("gate") == "grid_back", c("grid_cents")).alias("cents"), F.when(adopts | describes, c("read_abv")).alias("abv"), F.when(adopts, c("read_size_oz")).alias("size"), F.when(adopts | describes, c("text")).alias("note"))
    parts = F.when(adopts | describes | (c("gate") == "grid_back"), F.array(added)).otherwise(own)
    rows = gated(lines).select("list_id", "at", F.explode(parts).alias("p")).select("list_id", "at", "p.*")
    first = lambda value: F.min_by(value, F.when(c(value).isNotNull(), c("at")))
    notes = F.array_sort(F.collect_list(F.when(c("note").isNotNull(), F.struct("at", "note"))))
    items = rows.groupBy("list_id", "item_no").agg(F.max("title").alias("title"), F.max("cents").alias("price_cents"), first("abv").alias("read_abv"), first("size").alias("read_size_oz"), F.nullif(F.array_join(F.transform(notes, lambda n: n.note), " "), F.lit("")).alias("description"))
    return items.select("list_id", "item_no", "title.name", "price_cents", "read_abv", "read_size_oz", "title.category", "description", "title.line_no")


def trace_lists(lines: DataFrame) -> DataFrame:
    """(list_id, line_no, gate): what the reader took every line for."""
    return gated(lines).select("list_id", "line_no", "gate")


def section_state(lines: DataFrame) -> DataFrame:
    """lines with the running `category`, `in_food` and the `header_cents` of the section, by windows alone.

    The part of parse_lists() that needs no items: attribute lines and price grids play no role.
    """
    f = features(lines, deal=True)
    upto = Window.partitionBy("list_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("list_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    is_header = F.col("section").isNotNull() & ~F.col("is_food_header")
    f = f.withColumn("is_header", is_header).withColumn("previous", F.last(F.when(is_header, F.col("section")), ignorenulls=True).over(before))
    sub = (F.col("section") == "wineGlass") & (F.col("previous") == "wineGlass") & F.col("price_cents").isNull() & F.col("is_sub_label")
    price = F.when(F.col("is_header") & ~F.coalesce(sub, F.lit(False)), F.struct("price_cents"))
    food = F.when(F.col("is_food_header"), True).when(F.col("is_header"), False)
    return f.select(
        "list_id", "line_no", "line",
        F.coalesce(F.last(F.when(F.col("is_header"), F.col("section")), ignorenulls=True).over(upto), F.lit("unknown")).alias("category"),
        F.coalesce(F.last(food, ignorenulls=True).over(upto), F.lit(False)).alias("in_food"),
        F.last(price, ignorenulls=True).over(upto).price_cents.alias("header_cents"),
    )


def adopt_attributes(lines: DataFrame) -> DataFrame:
    """Items with the strength, size and description of the attribute lines below them, by windows alone.

    `lines` has list_id, line_no, is_item, is_attribute, name, read_abv, read_size_oz and text.
    """
    upto = Window.partitionBy("list_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where("is_item or is_attribute").withColumn("item_no", F.sum(F.col("is_item").cast("int")).over(upto) - 1).where("item_no >= 0")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    notes = F.array_sort(F.collect_list(F.when(F.col("is_attribute"), F.struct("line_no", "text"))))
    return rows.groupBy("list_id", "item_no").agg(F.min_by("name", "line_no").alias("name"), first("read_abv"), first("read_size_oz"), F.nullif(F.array_join(F.transform(notes, lambda n: n.text), " "), F.lit("")).alias("description"))


def price_line_counts(lines: DataFrame) -> DataFrame:
    """(list_id, lines, priced_rows, complete_rows): lines with $ and a letter, and those with a strength too."""
    priced = F.col("line").rlike(r"\$") & F.col("line").rlike(r"\p{L}")
    return lines.groupBy("list_id").agg(F.count("*").alias("lines"), F.count_if(priced).alias("priced_rows"), F.count_if(priced & F.contains(F.upper("line"), F.lit("ABV"))).alias("complete_rows"))
