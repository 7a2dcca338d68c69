"""The word lists, tables and limits that decide results. Order matters where a comment says so."""

from __future__ import annotations

# category: (alcoholic, default ABV %, default pour oz, printed-ABV ceiling % or None, default package oz or mL, default count, spirituous)
CATEGORIES = {
    "draftBeer": (True, 5.0, 16.0, 30.0, "12 oz", 6, False),
    "bottledBeer": (True, 5.0, 12.0, 30.0, "12 oz", 6, False),
    "cider": (True, 5.0, 12.0, 20.0, "12 oz", 6, False),
    "seltzer": (True, 5.0, 12.0, 20.0, "12 oz", 12, False),
    "wineGlass": (True, 12.0, 5.0, 30.0, "750 mL", 1, False),
    "sangria": (True, 10.0, 6.0, 30.0, "750 mL", 1, False),
    "cocktail": (True, 12.0, 5.0, 45.0, "750 mL", 1, True),
    "frozenCocktail": (True, 10.0, 8.0, 40.0, "750 mL", 1, True),
    "martini": (True, 25.0, 3.5, 50.0, "750 mL", 1, True),
    "shot": (True, 40.0, 1.5, 96.0, "750 mL", 1, True),
    "nonAlcoholic": (False, 0.0, 12.0, 1.0, "12 oz", 1, False),
    "unknown": (True, 12.0, 6.0, None, "12 oz", 1, False),
}

ML_PER_OZ = 29.5735
OZ_PER_STANDARD_DRINK = 0.6
ETHANOL_GRAMS_PER_ML = 0.789
CALORIES_PER_GRAM = 7.1

# label: size in oz; the first of equally near ones wins.
PACKAGES_OZ = [("12 oz", 12.0), ("16 oz", 16.0), ("19.2 oz", 19.2), ("24 oz", 24.0), ("25 oz", 25.0)]
PACKAGES_ML = [("50 mL (nip)", 50.0), ("187 mL (split)", 187.0), ("200 mL", 200.0), ("375 mL (half)", 375.0), ("500 mL", 500.0), ("750 mL", 750.0), ("1 L", 1000.0), ("1.5 L (magnum)", 1500.0), ("1.75 L (handle)", 1750.0)]
POURS_OZ = [("1.5 oz shot", 1.5), ("3 oz double", 3.0), ("5 oz wine pour", 5.0), ("8 oz", 8.0), ("12 oz", 12.0), ("16 oz", 16.0), ("20 oz", 20.0), ("22 oz", 22.0), ("24 oz", 24.0), ("60 oz pitcher", 60.0)]
METRIC_SIZES = [50, 100, 187, 200, 250, 330, 375, 500, 700, 720, 750, 1000, 1500, 1750, 3000, 5000]

# Section keywords in the order they are tried; the first one contained in a line decides.
HEADER_KEYWORDS = [
    ("nonAlcoholic", ["non-alcoholic", "non alcoholic", "mocktails", "booze free", "zero proof"]),
    ("frozenCocktail", ["frozen cocktails", "frozen margaritas", "frozen"]),
    ("draftBeer", ["on tap", "on draught", "draught", "draft beers", "draft selections", "draft beer", "on draft", "drafts", "draft"]),
    ("bottledBeer", ["tall boy", "bottled beer", "bottles/cans", "bottles", "imports", "import", "domestic beer", "domestics", "domestic"]),
    ("seltzer", ["hard seltzer", "canned cocktails", "seltzers", "seltzer", "cans"]),
    ("cider", ["ciders", "cider"]),
    ("shot", ["shots"]),
    ("martini", ["martinis", "old-fashioneds", "old fashioneds"]),
    ("sangria", ["sangria"]),
    ("wineGlass", ["by the glass", "sparkling", "reds", "whites", "rosé", "rosados", "wine"]),
    ("cocktail", ["specialty cocktails", "original cocktails", "signature cocktails", "cocktails", "elixirs", "back to basics", "hand-crafted", "hand crafted", "specialty", "signature"]),
]
# Words of a pure label, in the order they are tried.
LABEL_WORDS = [
    ("nonAlcoholic", ["non-alcoholic", "mocktails"]),
    ("frozenCocktail", ["frozen"]),
    ("draftBeer", ["draught", "drafts", "draft"]),
    ("bottledBeer", ["bottles", "imports", "import", "domestics", "domestic"]),
    ("seltzer", ["seltzers", "seltzer", "cans"]),
    ("cider", ["ciders", "cider"]),
    ("shot", ["shots"]),
    ("martini", ["martinis"]),
    ("sangria", ["sangria"]),
    ("wineGlass", ["sparkling", "bubbles", "reds", "red", "whites", "white", "rosé", "rose", "rosados", "wines", "wine"]),
    ("cocktail", ["cocktails", "cocktail", "elixirs", "specialty", "signature"]),
]
SECTION_WORDS = "beer beers wine wines drinks drink menu shots shot cocktail cocktails food drafts draft bottles bottle cans can cider ciders seltzer seltzers domestic domestics import imports specialty signature sangria martinis elixirs reds whites sparkling mocktails spirits beverages selections bubbles rosé rose rosados red white".split()
LABEL_FILLER = "each ea per and the our list of".split()
WINE_SUB_LABELS = "whites white reds red rosé rose bubbles sparkling".split()
FOOD_SECTION_WORDS = "food foods kitchen eats snacks snack apps appetizer appetizers starter starters sides mains entree entrees plates plate bites shareable shareables munchies nibbles".split()
FOOD_SECTION_FILLER = "small large bar hot cold warm shared".split()
FOOD_WORDS = "fries cheeseburger hamburger burger burgers slider sliders quesadilla quesadillas nachos nacho mozzarella calamari dumplings hummus guacamole queso burrito burritos flatbread wings tenders tots pretzel pretzels wontons empanada empanadas panini meatball meatballs nuggets parmesan chicken bites poppers".split()
PROMO_LEADS = "make add ask get for with sub choice choose upgrade any all includes served half free your".split()
VESSEL_WORDS = "glass gloss bottle pitcher pitchor carafe flight pint mug can draft double single neat rocks shot".split()
RECIPE_WORDS = "juice syrup simple fresh squeezed fresh-squeezed puree nectar soda water bitters muddled topped dash splash garnish rim twist infused saline distilled agave cranberry curacao vermouth tonic peel zest foam germain chinola colombian caramelized sec sugar".split()
NON_ALCOHOLIC_MARKERS = ["non-alcoholic", "non alcoholic", "n/a", "n/ a", "zero proof", "alcohol free", "alcohol-free"]
URL_MARKERS = ["www.", ".com", ".net", "://", ".org"]
SIZE_WORDS = {"glass": 5.0, "gls": 5.0, "gloss": 5.0, "bottle": 25.36, "btl": 25.36, "bot": 25.36, "pint": 16.0, "draft": 16.0, "draught": 16.0, "pour": 5.0, "pitcher": 60.0, "pitchor": 60.0, "carafe": 17.0, "half": 8.0, "can": 12.0, "magnum": 50.72}
SERVING_WORDS = "glass glasses pitcher pitchers bottle bottles can cans oz ozs ounce ounces pint pints split splits carafe half quart liter litre mug stein growler flight shot shots double single draft drafts draught each ea per cup cups goblet magnum taster sample pour pours".split()
UNIT_WORDS = "abv alc vol oz ozs ml cl proof".split()

# Style chart, most specific first: keywords, label, category, ABV, pour oz or None.
STYLES = [
    (["double ipa", "dipa", "imperial ipa"], "double IPA", "draftBeer", 8.5, None),
    (["session ipa"], "session IPA", "draftBeer", 4.5, None),
    (["ipa"], "IPA", "draftBeer", 6.5, None),
    (["imperial stout", "russian imperial"], "imperial stout", "draftBeer", 9.0, None),
    (["milk stout", "sweet stout", "oatmeal stout"], "sweet stout", "draftBeer", 5.5, None),
    (["dry stout", "irish stout", "guinness"], "Irish stout", "draftBeer", 4.2, None),
    (["stout"], "stout", "draftBeer", 6.0, None),
    (["baltic porter"], "Baltic porter", "draftBeer", 8.0, None),
    (["porter"], "porter", "draftBeer", 5.5, None),
    (["hefeweizen", "hefe", "weizen", "weiss", "witbier", "white ale", "wheat"], "wheat/witbier", "draftBeer", 5.4, None),
    (["pale ale", "apa"], "pale ale", "draftBeer", 5.5, None),
    (["pilsner", "pils", "pilsener"], "pilsner", "draftBeer", 4.7, None),
    (["vienna", "marzen", "märzen", "oktoberfest", "amber"], "amber/Vienna", "draftBeer", 5.2, None),
    (["blonde", "golden ale", "kolsch", "kölsch", "cream ale"], "blonde/golden ale", "draftBeer", 4.8, None),
    (["mexican lager", "modelo", "corona", "pacifico", "dos equis", "tecate"], "Mexican lager", "bottledBeer", 4.5, None),
    (["light lager", "light"], "light lager", "bottledBeer", 4.2, None),
    (["barleywine", "doppelbock", "tripel", "quadrupel", "quad", "eisbock"], "strong ale", "draftBeer", 9.5, None),
    (["bock"], "bock", "draftBeer", 6.5, None),
    (["lager"], "lager", "draftBeer", 5.0, None),
    (["cider"], "cider", "cider", 5.0, None),
    (["sour", "gose"], "sour", "draftBeer", 5.0, None),
    (["ale"], "ale", "draftBeer", 5.5, None),
    (["seltzer", "white claw", "high noon", "truly", "nutrl", "surfside", "carbliss", "vizzy"], "hard seltzer", "seltzer", 5.0, None),
    (["moscato", "muscat"], "Moscato", "wineGlass", 6.0, None),
    (["riesling"], "Riesling", "wineGlass", 10.0, None),
    (["prosecco"], "Prosecco", "wineGlass", 11.0, None),
    (["champagne", "cava", "sparkling", "brut", "blanc de blanc"], "sparkling", "wineGlass", 12.0, None),
    (["pinot grigio", "pinot gris"], "Pinot Grigio", "wineGlass", 12.0, None),
    (["sauvignon blanc", "sauv blanc", "sancerre"], "Sauvignon Blanc", "wineGlass", 13.0, None),
    (["rose", "rosé", "rosado"], "rosé", "wineGlass", 12.5, None),
    (["chardonnay", "chard"], "Chardonnay", "wineGlass", 13.5, None),
    (["pinot noir"], "Pinot Noir", "wineGlass", 13.5, None),
    (["merlot"], "Merlot", "wineGlass", 13.5, None),
    (["cabernet", "cab sauv"], "Cabernet", "wineGlass", 14.0, None),
    (["malbec"], "Malbec", "wineGlass", 14.0, None),
    (["syrah", "shiraz"], "Syrah/Shiraz", "wineGlass", 14.5, None),
    (["zinfandel", "zin"], "Zinfandel", "wineGlass", 15.0, None),
    (["port", "sherry", "madeira", "marsala"], "fortified wine", "wineGlass", 18.0, 3.5),
    (["vermouth"], "vermouth", "wineGlass", 18.0, 3.5),
    (["red blend", "red wine"], "red wine", "wineGlass", 13.5, None),
    (["white wine"], "white wine", "wineGlass", 12.5, None),
    (["sangria"], "sangria", "sangria", 10.0, None),
]
# A seed of brands for tests and examples: key, label, category, ABV. Real tables come as a DataFrame.
BRANDS = [
    ("bud light", "Bud Light", "bottledBeer", 4.2),
    ("busch light", "Busch Light", "bottledBeer", 4.1),
    ("coors light", "Coors Light", "bottledBeer", 4.2),
    ("corona light", "Corona Light", "bottledBeer", 4.0),
    ("corona", "Corona Extra", "bottledBeer", 4.6),
    ("modelo", "Modelo Especial", "bottledBeer", 4.4),
    ("dogfish head 60 minute", "Dogfish Head 60 Minute", "draftBeer", 6.0),
    ("athletic", "Athletic", "nonAlcoholic", 0.4),
    ("heineken 0.0", "Heineken 0.0", "nonAlcoholic", 0.0),
    ("heineken", "Heineken", "bottledBeer", 5.0),
    ("guinness", "Guinness Draught", "draftBeer", 4.2),
]
GENERIC_WORDS = "beer ale lager ipa ipas pale hazy stout porter pilsner pils wheat hefeweizen witbier amber blonde golden kolsch bock double imperial session light lite dark draft draught cider wine red white rose rosado blush blend reserve riserva cabernet sauvignon merlot pinot noir grigio gris blanc chardonnay riesling moscato muscat malbec shiraz syrah zinfandel sangiovese tempranillo prosecco champagne cava brut sparkling port sherry vermouth sangria house vodka gin rum tequila mezcal whiskey whisky bourbon scotch rye brandy cognac liqueur cocktail martini margarita seltzer shot well premium classic original spiced silver gold anejo reposado blanco single malt bottle bottles can cans glass pint pitcher pack oz ml".split()
KEEP_UPPER = "VSOP VS XO IPA IPAS NV GSM BC USA XXX DOCG DOC IGT AOC LBV RD XA PET SRP GG 1ER NA RTD II III IV V VI VII VIII IX X XI XII XIII".split()
# Letters with accents by the plain letter they fold to, and three pairs.
ACCENTS = {"a": "àáâãäåāăą", "c": "çćĉč", "e": "èéêëēĕėęě", "i": "ìíîïīĭį", "n": "ñńň", "o": "òóôõöøōŏő", "u": "ùúûüūŭűų", "y": "ýÿ", "s": "šśş", "z": "žźż", "g": "ğĝ", "r": "řŕ", "t": "ťţ", "l": "ľĺł", "d": "ďċ"}
PAIRS = {"æ": "ae", "œ": "oe", "ß": "ss"}
# Ligatures in the order they are folded, then single look-alikes.
LIGATURES = [("li", "u"), ("fi", "r"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u")]
LOOK_ALIKES = ("0q1l|!5$862", "ooiiiissbgz")
WHOLESALE_COLUMNS = {
    "name": ["product description", "description", "brand name", "item description", "product name"],
    "size": ["retail size", "size description", "bottle size", "size", "unit of measure", "volume", "liter", "litre", "capacity", "container", "ml"],
    "upc": ["upc"],
    "proof": ["proof"],
    "abv": ["alcohol", "abv"],
}
