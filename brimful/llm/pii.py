"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from four patterns. Further candidates (credentials, local phone numbers, spelled-out
e-mail addresses) get votes of 1, 0 or -1 from five labelers: shape (regex), gazetteer, context, character
mix and length. Expectation-maximisation over the counts of vote patterns (3 ** 5 a kind at most, however
large the corpus) estimates each labeler's reliability; the posteriors of the patterns train the final
span classifier, naive Bayes over span features, and spans above even odds are added. Base spans stay;
an added span never overlaps one.

Defined cases: a null or empty text has no spans; equal rows give equal rows; without candidates nothing
is added; a null doc_id and rows with one doc_id are rows like any other; further columns are ignored by find()
and kept by redact(), whatever their names. Positions count code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimful.functions.binding import let
from brimful.llm.common import written

# A match can only begin where a run of its characters begins, or where the last match ended; saying so
# keeps the search linear on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE_KINDS = ("email", "ip", "card", "phone")

SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
LOCAL = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{](?:at|AT)[)\]}] ?[A-Za-z0-9-]++(?: ?[(\[{](?:dot|DOT)[)\]}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
ADDED = {"email_spelled": SPELLED, "phone_local": LOCAL, "secret": SECRET}
# Gazetteers and context words of each kind.
GAZETTEER = {"email_spelled": r"(?i)(com|org|net|edu|gov|info|de|fr|es|uk|io)$", "phone_local": r"^\(?[2-9][0-9]{2}", "secret": r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk[_-]|pk_|xox[abp]-|eyJ|AIza)"}
CONTEXT = {"email_spelled": r"(?i)(mail|contact|write|reach|kontakt|correo|courriel)", "phone_local": r"(?i)(tel|phone|call|mobile|cell|fax|dial|telefon)", "secret": r"(?i)(token|secret|passw|api|key|bearer|credential|auth)"}
SHAPE = {"email_spelled": r"(?i)(\.|[(\[{]dot[)\]}])", "phone_local": r"^(\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}$", "secret": r"^([0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_-]{20,})$"}
LENGTHS = {"email_spelled": (8, 120), "phone_local": (12, 14), "secret": (20, 128)}
LABELERS = ("shape", "gazetteer", "context", "mix", "length")
CONTEXT_CHARS = 32
BLOCK = 256


def _running(items: Column) -> Column:
    """Structs (s, e, f) from structs (n, f): e is the running sum of n, s = e - length(f). In blocks, to stay near linear."""

    def in_block(block: Column, base: Column) -> Column:
        end = lambda x, i: base + x.n + F.aggregate(F.slice(block, F.lit(1), i), F.lit(0), lambda a, y: a + y.n)
        return F.transform(block, lambda x, i: let(end(x, i), lambda e: F.struct((e - F.length(x.f)).alias("s"), e.alias("e"), x.f.alias("f"))))

    def all_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, y: a + y.n))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, k: let(F.aggregate(F.slice(t, F.lit(1), k), F.lit(0), lambda a, y: a + y), lambda base: in_block(b, base)))))

    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1)), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    return let(items, lambda x: let(blocks(x), all_blocks))


def spans(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, f), counted in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.filter(F.zip_with(gaps, found, lambda g, f: F.struct((F.length(g) + F.length(f)).alias("n"), f.alias("f"))), lambda x: x.f.isNotNull())
    nothing = F.array().cast("array<struct<s:int,e:int,f:string>>")
    hit = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(hit, _running(both)).otherwise(nothing)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        doubled = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    digits = lambda x: F.regexp_replace(x.f, "[^0-9]", "")
    right = lambda x: let(digits(x), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP), lambda x: x.f.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": F.filter(spans(text, CARD), right),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(digits(x)).between(9, 15)),
    }


def _votes(kind: str, x: Column, before: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate (s, e, f)."""
    low, high = LENGTHS[kind]
    n_digits, n_letters = F.length(F.regexp_replace(x.f, "[^0-9]", "")), F.length(F.regexp_replace(x.f, "[^A-Za-z]", ""))
    mixed = {"secret": (n_digits >= 4) & (n_letters >= 4), "phone_local": n_digits == 10, "email_spelled": n_letters >= 5}[kind]
    sign = lambda good, bad: F.when(good, 1).otherwise(bad)
    return {"shape": sign(x.f.rlike(SHAPE[kind]), -1), "gazetteer": sign(x.f.rlike(GAZETTEER[kind]), 0), "context": sign(before.rlike(CONTEXT[kind]), 0), "mix": sign(mixed, -1), "length": sign(F.length(x.f).between(low, high), -1)}


def _apart(found: Column, base: Column) -> Column:
    """Those of structs (s, e, f), in order and apart from each other, that overlap none of the base spans.

    Both are cut at the ends of BLOCK found ones, so that each is compared with the base spans of its own stretch.
    """

    def clear(x: Column, near: Column) -> Column:
        return ~F.exists(near, lambda b: (b.s < x.e) & (x.s < b.e))

    def of_block(block: Column) -> Column:
        near = F.filter(base, lambda b: (b.s < F.element_at(block, -1).e) & (F.get(block, F.lit(0)).s < b.e))
        return let(near, lambda n: F.filter(block, lambda x: clear(x, n)))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / BLOCK).cast("int") - 1), lambda k: F.slice(found, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(F.flatten(F.transform(blocks, of_block)))


def _candidates(kind: str, text: Column, base: Column) -> Column:
    """Candidates of a kind that overlap no base span, with votes and features."""

    def described(x: Column, parts: Column) -> Column:
        before = _between(parts, F.greatest(F.lit(0), x.s - CONTEXT_CHARS), x.s)
        share = F.floor(4 * F.length(F.regexp_replace(x.f, "[^0-9]", "")) / (F.length(x.f) + 1)).cast("int")
        marks = F.when(before.rlike(r"[=:\"']\s*$"), 1).otherwise(0)
        size = F.least(F.lit(6), F.floor(F.log2(F.length(x.f))).cast("int"))
        votes = [v.cast("int").alias(k) for k, v in _votes(kind, x, before).items()]
        return F.struct(F.lit(kind).alias("kind"), x.s.alias("s"), x.e.alias("e"), *votes, share.alias("digit_share"), marks.alias("quoted"), size.alias("size"))

    needs = {"secret": text.rlike("[0-9]"), "phone_local": text.rlike("[0-9]{4}"), "email_spelled": text.rlike(r"[(\[{](?:at|AT)[)\]}]")}[kind]
    found = F.filter(spans(text, ADDED[kind], needs), lambda x: x.f.rlike("[A-Za-z]") if kind == "secret" else F.lit(True))
    return let(_apart(found, base), lambda free: F.when(F.size(free) > 0, let(_slices(text), lambda parts: F.transform(free, lambda x: described(x, parts)))).otherwise(F.slice(F.transform(free, lambda x: described(x, F.array(text))), 1, 0)))


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_base` (array of kind, s, e in listed order) and `pii_candidates`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.s.alias("s"), x.e.alias("e"))
    named = [F.transform(c, of_kind(k)) for k, c in base_spans(text).items()]
    docs = docs.withColumn("pii_base", F.concat(*named))
    return docs.withColumn("pii_candidates", F.concat(*(_candidates(k, text, F.col("pii_base")) for k in ADDED)))


FEATURES = ("digit_share", "quoted", "size", *LABELERS)


def learn(candidates: DataFrame, rounds: int = 12) -> dict[str, dict[tuple[str, int], float]]:
    """Weights of the span classifier by kind: log odds of each (feature, value), and of ("prior", 0).

    `candidates` has one row for each candidate. It is reduced to counts of (votes, features) once; each
    EM round aggregates those counts, and only sums by kind, labeler and vote reach the driver.
    """
    counts = written(candidates.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")), "pii-patterns").coalesce(1)
    kinds = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    posterior = 1 / (1 + F.exp(-sum((F.col(k) for k in LABELERS), F.lit(0.0)).cast("double")))
    weights: dict[str, dict[tuple[str, int], float]] = {}

    def log_odds(p: Column, features: tuple[str, ...]) -> dict[str, dict[tuple[str, int], float]]:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in features))).alias("x")
        summed = counts.withColumn("p", p * F.col("n")).select("kind", "n", "p", pairs).groupBy("kind", "x.feature", "x.value").agg(F.sum("p").alias("yes"), F.sum("n").alias("n")).collect()
        out: dict[str, dict[tuple[str, int], float]] = {}
        for kind in kinds:
            rows = [r for r in summed if r["kind"] == kind]
            yes = sum(r["yes"] for r in rows if r["feature"] == features[0])
            no = kinds[kind] - yes
            out[kind] = {("prior", 0): math.log((yes + 1) / (no + 1))}
            for r in rows:
                out[kind][r["feature"], r["value"]] = math.log((r["yes"] + 1) / (yes + 3)) - math.log((r["n"] - r["yes"] + 1) / (no + 3))
        return out

    for _ in range(rounds if kinds else 0):
        weights = log_odds(posterior, LABELERS)
        posterior = 1 / (1 + F.exp(-_score(weights, LABELERS, F.col)))
    return log_odds(posterior, FEATURES) if kinds else {}


def _score(weights: dict, features: tuple[str, ...], of: Callable[[str], Column]) -> Column:
    """Log odds of a candidate whose fields `of` gives."""
    by_kind = F.lit(-1.0)
    for kind, table in weights.items():
        total = F.lit(table["prior", 0])
        for f in features:
            own = [(value, w) for (name, value), w in table.items() if name == f]
            total = total + reduce(lambda c, vw, f=f: F.when(of(f) == vw[0], vw[1]).otherwise(c), own, F.lit(0.0))
        by_kind = F.when(of("kind") == kind, total).otherwise(by_kind)
    return by_kind


def _accepted(weights: dict) -> Column:
    """All spans as (kind, s, e): base ones as they are, then accepted candidates."""
    good = F.filter("pii_candidates", lambda x: _score(weights, FEATURES, lambda f: x[f]) > 0) if weights else F.slice("pii_candidates", 1, 0)
    return F.concat("pii_base", F.transform(good, lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"))))


def _written_as(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added) for every row of docs."""
    found = written(annotate(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).drop("text"), "pii-candidates")
    weights = learn(found.select(F.inline("pii_candidates")))
    is_kind = lambda k: lambda x: x.kind == k
    numbers = [F.size(F.filter("pii_base", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    spans_now = _accepted(weights)
    return found.select("doc_id", *numbers, _written_as(F.col("pii_base")).alias("base"), _written_as(spans_now).alias("spans"), (F.size(spans_now) - F.size("pii_base")).cast("long").alias("n_added"))


def _slices(text: Column) -> Column:
    """The text in parts of BLOCK code points, so that a place is found without walking from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in _slices(): at most two parts are cut, those between go whole."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    piece = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    head = F.substring(piece(first), start - first * BLOCK + 1, F.when(first == last, end - start).otherwise(F.lit(BLOCK)))
    whole = F.array_join(F.slice(parts, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    tail = F.when(first == last, "").otherwise(F.substring(piece(last), F.lit(1), end - last * BLOCK))
    return F.when(end > start, F.concat(head, whole, tail)).otherwise(F.lit(""))


def _furthest(items: Column) -> Column:
    """For each of structs (s, e, ...) the greatest e of those before it, 0 for the first. In blocks, to stay near linear."""
    ends = lambda xs: F.array_max(F.transform(xs, lambda x: x.e))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.size(items) / BLOCK).cast("int"))

    def in_block(block: Column, sofar: Column) -> Column:
        return F.transform(block, lambda x, i: F.greatest(sofar, F.coalesce(ends(F.slice(block, F.lit(1), i)), F.lit(0))))

    def all_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, ends), lambda t: F.flatten(F.transform(blocks, lambda b, k: let(F.coalesce(F.array_max(F.slice(t, F.lit(1), k)), F.lit(0)), lambda sofar: in_block(b, sofar)))))

    return let(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK))), all_blocks)


def replaced(text: Column, all_spans: Column) -> Column:
    """The text with every span (kind, s, e) as its kind in brackets; one that begins inside an earlier one goes with it."""
    ordered = F.array_sort(F.transform(all_spans, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"))))

    def joined(xs: Column, parts: Column) -> Column:
        def written(x: Column, done: Column) -> Column:
            return F.when(x.s < done, "").otherwise(F.concat(_between(parts, done, x.s), F.lit("["), F.upper(x.kind), F.lit("]")))

        return let(_furthest(xs), lambda done: F.array_join(F.zip_with(xs, done, written), ""))

    def rest(xs: Column, parts: Column) -> Column:
        end = F.coalesce(F.array_max(F.transform(xs, lambda x: x.e)), F.lit(0))
        return let(end, lambda at: _between(parts, at, F.length(text)))

    return let(ordered, lambda xs: let(_slices(text), lambda parts: F.concat(joined(xs, parts), rest(xs, parts))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; the time grows with the text, whatever it holds."""
    weights = learn(annotate(docs.select("text")).select(F.inline("pii_candidates")))
    text = F.coalesce(F.col("text"), F.lit(""))
    new = F.when(F.size("pii_base") + F.size("pii_candidates") > 0, replaced(text, _accepted(weights))).otherwise(F.col("text"))
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return annotate(boxed).withColumn("text", new).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
