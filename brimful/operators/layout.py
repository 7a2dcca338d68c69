"""From positioned boxes to lines (LY1-LY14, EV6-EV8). A page is small; pages are folded many to a batch."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brimful.functions.lines import has_anchored_price
from brimful.functions.vocabulary import SERVING_WORDS, UNIT_WORDS
from brimful.operators.dealing import dealt

NAME_TRIM = r"""^[$.,%|•·()/\-–—_"'*°:; ]+|[$.,%|•·()/\-–—_"'*°:; ]+$"""
SERVING_TRIM = r"^[$.,%|•()/\-]+|[$.,%|•()/\-]+$"


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the page cut, as fractions of the page."""

    row_tolerance: float = 0.5
    min_section_gap: float = 0.03
    section_gap_multiple: float = 2.2
    min_column_span: float = 0.18
    min_side: int = 3
    min_group: int = 6
    header_width: float = 0.45
    min_gutter: float = 0.045
    gutter_cluster: float = 0.04
    min_votes: int = 3
    min_names: float = 0.2
    price_gap_multiple: float = 4.0
    bins: int = 100
    gutter_veto: bool = True
    chaining: bool = True
    isolate: bool = False
    #: For the cut by text heights only.
    section_heights: float = 0.9
    corridor_bins: int = 400
    most_depth: int = 3


def is_name_bearing(text: Column) -> Column:
    word = F.lower(F.regexp_replace(text, NAME_TRIM, ""))
    rest = F.regexp_replace(word, r"^[\p{N}.]+", "")
    return (F.length(F.regexp_replace(word, r"[^\p{L}]", "")) >= 2) & ~word.isin(*UNIT_WORDS) & ~((rest != word) & rest.isin(*UNIT_WORDS))


def is_serving_word(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, SERVING_TRIM, "")).isin(*SERVING_WORDS)


def is_price_like(text: Column) -> Column:
    """A number with two marks at most around it."""
    core = F.regexp_replace(text, r"^[^\p{N}]{0,2}|[^\p{N}]{0,2}$", "")
    return core.rlike(r"^\p{N}+([.,]\p{N}+)?$")


def tokens_of(boxes: DataFrame) -> DataFrame:
    """boxes that hold text, with the token tests the layout asks."""
    text = F.trim("text")
    return boxes.where(text != "").withColumn("text", text).withColumn("is_name", is_name_bearing(F.col("text"))).withColumn("is_serving", is_serving_word(F.col("text"))).withColumn("is_price", is_price_like(F.col("text"))).withColumn("has_letter", F.col("text").rlike(r"\p{L}"))


def _stretches(said: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(verdicts, index of the first) of the rows between those that run across."""
    bounds = np.concatenate([[-1], np.flatnonzero(said < 0), [len(said)]])
    return [(said[a + 1 : b], a + 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _median(values: list[float]) -> float:
    """As NumPy's, without the cost of a call on the few values of a row; NaN where there are none or one is NaN."""
    total, n = sum(values), len(values)
    if not n or total != total:
        return float(np.median(values)) if n else float("nan")
    ordered = sorted(values)
    return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


class Page:
    """Boxes of one page as arrays, and the recursive cut."""

    def __init__(self, rows: Mapping[str, np.ndarray] | pd.DataFrame, t: Thresholds) -> None:
        """`rows` gives each column of TOKEN. Rows of a page hold a few boxes, which lists handle faster than arrays."""
        self.t = t
        low, high = (np.asarray(rows[c], float) for c in ("min_y", "max_y"))
        self.left, self.right = (np.asarray(rows[c], float) for c in ("min_x", "max_x"))
        self.mid_x, self.mid_y, self.height = (self.left + self.right) / 2, (low + high) / 2, high - low
        self.name, self.serving, self.price, self.letter = (np.asarray(rows[c], bool) for c in ("is_name", "is_serving", "is_price", "has_letter"))
        self.text = list(rows["text"])
        self.lefts, self.rights, self.ys, self.heights = (x.tolist() for x in (self.left, self.right, self.mid_y, self.height))
        self.from_left = [x if x == x else float("inf") for x in self.lefts]
        #: Rows of parts, which depend on no threshold, and what HeightPage made of sections under all thresholds but their heights.
        self.known: dict[bytes, tuple[list[np.ndarray], list[list[int]]]] = {}
        self.done: dict[tuple[bytes, Thresholds], list[list[int]]] = {}

    def by_left(self, row: np.ndarray) -> list[int]:
        return sorted(row.tolist(), key=self.from_left.__getitem__)

    def banded(self, own: np.ndarray) -> tuple[list[np.ndarray], list[list[int]]]:
        """Rows from top to bottom, and the same from left to right; one begins where a box is too far from the row's first."""
        key = own.tobytes()
        if key not in self.known:  # a part is cut into rows once for all the rules that ask
            boxes = own[np.argsort(-self.mid_y[own], kind="stable")]
            ys = self.mid_y[boxes].tolist()
            tolerance, cuts, anchor = _median(self.height[own].tolist()) * 0.5, [], ys[0]
            for i, y in enumerate(ys):
                if abs(y - anchor) > tolerance:
                    cuts.append(i)
                    anchor = y
            bands = [boxes[a:b] for a, b in zip([0, *cuts], [*cuts, len(ys)], strict=True)]
            self.known[key] = bands, [self.by_left(b) for b in bands]
        return self.known[key]

    def bands(self, own: np.ndarray) -> list[np.ndarray]:
        return self.banded(own)[0]

    def horizontal(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        bands = self.bands(own)
        if len(bands) < 4:
            return None
        gaps = -np.diff([_median(self.mid_y[b].tolist()) for b in bands])
        cut = int(np.argmax(gaps)) + 1
        if gaps[cut - 1] < max(self.t.min_section_gap, _median(gaps.tolist()) * self.t.section_gap_multiple) or not 2 <= cut <= len(bands) - 2:
            return None
        parts = np.concatenate(bands[:cut]), np.concatenate(bands[cut:])
        return parts if min(map(len, parts)) >= self.t.min_side else None

    def guarded(self, own: np.ndarray, x: float) -> tuple[np.ndarray, np.ndarray] | None:
        parts = own[self.mid_x[own] < x], own[self.mid_x[own] >= x]
        for part in parts:
            if len(part) < self.t.min_side or self.right[part].max() - self.left[part].min() < self.t.min_column_span - 1e-9 or self.name[part].mean() < self.t.min_names:
                return None
        return parts

    def coverage(self, own: np.ndarray) -> np.ndarray:
        n = self.t.bins
        lo, hi = np.maximum(0, (self.left[own] * n).astype(int)), np.minimum(n - 1, (self.right[own] * n).astype(int))
        on = lo <= hi
        return np.cumsum(np.bincount(lo[on], minlength=n + 1) - np.bincount(hi[on] + 1, minlength=n + 1))[:n]

    def corridor(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The guarded split at the widest empty run of bins, nearest the centre on ties."""
        narrow = own[self.right[own] - self.left[own] <= self.t.header_width]
        full = np.flatnonzero(self.coverage(narrow if len(narrow) >= 2 * self.t.min_side else own)).tolist()
        best = None
        for a, b in zip(full[:-1], full[1:], strict=True):
            run = b - a - 1
            x = (a + 1 + run // 2 + 0.5) / self.t.bins
            key = (run, -abs(x - 0.5))
            if run > 0 and (best is None or key > best[0]) and (parts := self.guarded(own, x)):
                best = key, parts
        return best and best[1]

    def central(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        cover = self.coverage(own)
        band = np.arange(int(0.33 * self.t.bins), int(0.67 * self.t.bins))
        least, peak = cover[band].min(), cover.max()
        if peak < 2 or least > max(1, peak // 3):
            return None
        centers = (band[cover[band] == least] + 0.5) / self.t.bins
        return self.guarded(own, float(centers[np.argmin(np.abs(centers - 0.5))]))

    def gutters(self, own: np.ndarray) -> list[float]:
        """Places where rows vote for a gap, most votes first, then the widest."""
        votes, right, left = [], self.rights, self.lefts
        for row in self.banded(own)[1]:
            votes += [((right[a] + left[b]) / 2, left[b] - right[a]) for a, b in zip(row[:-1], row[1:], strict=True) if left[b] - right[a] >= self.t.min_gutter]
        clusters, used = [], np.zeros(len(votes), bool)
        at, width = np.array(votes).reshape(-1, 2).T
        for seed in np.argsort(-width, kind="stable").tolist():
            if not used[seed]:
                members = ~used & (np.abs(at - at[seed]) <= self.t.gutter_cluster)
                used |= members
                if members.sum() >= self.t.min_votes:
                    clusters.append((-int(members.sum()), -width[members].mean(), at[members].mean()))
        return [c[2] for c in sorted(clusters)]

    def verdicts(self, rows: list[list[int]], x: float) -> np.ndarray:
        """For each row, from left to right, 1 if it leaves a gutter free, -1 if it runs across, 0 if it lies on one side."""
        least, out = self.t.min_gutter, np.zeros(len(rows), int)
        for k, row in enumerate(rows):
            left, right = [self.lefts[i] for i in row], [self.rights[i] for i in row]
            if any(a <= x <= b and b - a >= least for a, b in zip(right[:-1], left[1:], strict=True)):
                out[k] = 1
            elif any(a < x < b for a, b in zip(left, right, strict=True)) or (any(b <= x for b in right) and any(a >= x for a in left)):
                out[k] = -1
        return out

    def vetoed(self, own: np.ndarray, x: float) -> bool:
        """More rows run across a gutter than leave it free."""
        return self.verdicts(self.banded(own)[1], x).sum() < 0

    def isolated(self, own: np.ndarray) -> list[np.ndarray]:
        """The rows above, in and below the longest run of rows that agree on a gutter which others run across; empty if there is none.

        Rows on one side of the gutter do not end a run, rows across do; a run begins and ends with rows that leave it free.
        """
        bands, rows = self.banded(own)
        for x in self.gutters(own):
            said = self.verdicts(rows, x)
            stretches = [np.flatnonzero(part == 1) + at for part, at in _stretches(said)]
            runs = [(free[0], free[-1] + 1) for free in stretches if len(free)]
            if not runs or said.min() >= 0:  # where nobody runs across, a plain cut does
                continue
            start, end = max(runs, key=lambda r: r[1] - r[0])
            middle = np.concatenate(bands[start:end])
            if end - start >= self.t.min_votes and self.guarded(middle, x):
                return [np.concatenate(part) for part in (bands[:start], bands[start:end], bands[end:]) if part]
        return []

    def vertical(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        found = self.corridor(own) or self.central(own)
        for x in [] if found else self.gutters(own):
            if not (self.t.gutter_veto and self.vetoed(own, x)) and (found := self.guarded(own, x)):
                break
        return found

    def leaves(self, own: np.ndarray) -> list[np.ndarray]:
        parts = None if len(own) < self.t.min_group else self.horizontal(own) or (self.isolated(own) if self.t.isolate else None) or self.vertical(own)
        return [own] if parts is None else [leaf for part in parts for leaf in self.leaves(part)]

    def chained(self, own: np.ndarray) -> list[list[int]]:
        """Rows of a leaf: each box, from the left, joins the row whose nearest member in height is closest."""
        if not self.t.chaining:
            return [list(row) for row in self.banded(own)[1]]
        tolerance, rows = _median(self.height[own].tolist()) * self.t.row_tolerance, []
        boxes = self.by_left(own)
        if not tolerance >= 0:  # no height is known
            rows = [[box] for box in boxes]
            return sorted(rows, key=lambda row: -self.mid_y[row].max())
        heights: list[float] = []  # of the boxes so far, each once; row_at has the first row at each
        row_at: dict[float, int] = {}
        for box in boxes:
            y = self.ys[box]
            at = bisect_left(heights, y)
            least = min(abs(heights[at] - y) if at < len(heights) else float("inf"), abs(heights[at - 1] - y) if at else float("inf"))
            if least <= tolerance:
                near, i = [], at
                while i < len(heights) and abs(heights[i] - y) == least:
                    near.append(row_at[heights[i]])
                    i += 1
                i = at - 1
                while i >= 0 and abs(heights[i] - y) == least:
                    near.append(row_at[heights[i]])
                    i -= 1
                row = min(near)
                rows[row].append(box)
            else:
                row = len(rows)
                rows.append([box])
            if y in row_at:
                row_at[y] = min(row_at[y], row)
            else:
                row_at[y] = row
                insort(heights, y)
        return sorted(rows, key=lambda row: -max(map(self.ys.__getitem__, row)))

    def segments(self, row: list[int]) -> list[list[int]]:
        """A row cut where a price is followed, after a wide gap, by another name."""
        ends = [i for i in range(len(row) - 1) if self.price[row[i]] and self.letter[row[i + 1]] and not self.serving[row[i + 1]]]
        if not ends:
            return [row]
        gaps = [self.lefts[b] - self.rights[a] for a, b in zip(row[:-1], row[1:], strict=True)]
        positive = [g for g in gaps if g > 0]
        wide = self.t.price_gap_multiple * max(_median(positive) if positive else 0.0, 0.0005)
        cuts = [i + 1 for i in ends if gaps[i] >= wide and any(self.letter[k] for k in row[: i + 1])]
        return [row[a:b] for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True)]

    def lines(self) -> list[str]:
        every = np.arange(len(self.text))
        rows = [row for leaf in self.leaves(every) for row in self.chained(leaf)] if len(every) else []
        return [" ".join(self.text[i] for i in part) for row in rows for part in self.segments(row)]


class HeightPage(Page):
    """A page cut by text heights: sections first, then columns within each section.

    White space between rows grows with the type, so a section ends where it reaches `section_heights` median heights
    of a box; columns do not, so corridors and gutters stay fractions of the page.
    """

    def sections(self, own: np.ndarray) -> list[np.ndarray]:
        bands = self.bands(own)
        low, high = self.mid_y - self.height / 2, self.mid_y + self.height / 2
        bottom = np.array([low[b].min() for b in bands])
        top = np.array([high[b].max() for b in bands])
        ends = np.flatnonzero(bottom[:-1] - top[1:] >= _median(self.height[own].tolist()) * self.t.section_heights) + 1
        return [np.concatenate(bands[a:b]) for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(bands)], strict=True)]

    def wide_enough(self, own: np.ndarray, x: float) -> tuple[np.ndarray, np.ndarray] | None:
        parts = own[self.mid_x[own] < x], own[self.mid_x[own] >= x]
        return parts if all(len(p) and self.right[p].max() - self.left[p].min() >= self.t.min_column_span for p in parts) else None

    def empty_corridor(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The cut in the most central empty run of bins between the narrow boxes, if it is as wide as a gutter."""
        narrow = own[self.right[own] - self.left[own] <= self.t.header_width]
        if not len(narrow):
            return None
        lo, n = self.left[narrow].min(), self.t.corridor_bins
        width = self.right[narrow].max() - lo
        if width <= 0:
            return None
        at = lambda x: np.clip(((x - lo) / width * n).astype(int), 0, n - 1)
        full = np.flatnonzero(np.cumsum(np.bincount(at(self.left[narrow]), minlength=n + 1) - np.bincount(at(self.right[narrow]) + 1, minlength=n + 1))[:n])
        begin, end = full[:-1] + 1, full[1:]
        wide = (end - begin) / n * width >= self.t.min_gutter
        middles = (lo + (begin + end) / 2 / n * width)[wide & (end > begin)]
        return self.wide_enough(own, middles[np.argmin(np.abs(middles - 0.5))]) if len(middles) else None

    def columns(self, own: np.ndarray, depth: int = 0) -> list[np.ndarray]:
        if depth >= self.t.most_depth or len(own) < 4:
            return [own]
        parts = self.empty_corridor(own)
        for x in [] if parts else self.gutters(own):
            if parts := self.wide_enough(own, x):
                break
        return [own] if parts is None else [leaf for part in parts for leaf in self.columns(part, depth + 1)]

    def rows(self) -> list[list[int]]:
        every = np.arange(len(self.text))
        return [row for section in self.sections(every) for row in self.rows_of(section)] if len(every) else []

    def rows_of(self, section: np.ndarray) -> list[list[int]]:
        key = section.tobytes(), replace(self.t, section_heights=0.0)
        if key not in self.done:
            self.done[key] = [row for leaf in self.columns(section) for row in self.banded(leaf)[1]]
        return self.done[key]

    def lines(self) -> list[str]:
        return [" ".join(self.text[i] for i in row) for row in self.rows()]

    def score(self) -> tuple[float, float, int]:
        """Shares of lines with two words or fewer and no digit, and with a gap as wide as a gutter inside; and how many lines."""
        rows = self.rows()
        texts = [" ".join(self.text[i] for i in row) for row in rows]
        orphans = sum(len(t.split()) <= 2 and not any(c.isdigit() for c in t) for t in texts)
        fused = sum(any(self.lefts[b] - self.rights[a] >= self.t.min_gutter for a, b in zip(row[:-1], row[1:], strict=True)) for row in rows)
        return (orphans / len(rows), fused / len(rows), len(rows)) if rows else (0.0, 0.0, 0)


TOKEN = ("text", "min_x", "max_x", "min_y", "max_y", "is_name", "is_serving", "is_price", "has_letter")


def with_params(boxes: DataFrame, params: DataFrame) -> DataFrame:
    """(page_id, the columns of TOKEN as arrays, param): one row for each page and parameter row, those of a page one after the other.

    The parameters, a table of choices to try, come as one array to every page; each page meets each of them. Boxes are
    shuffled once, whatever the number of parameters.
    """
    token = F.struct("box_id", *TOKEN)
    pages = dealt(tokens_of(boxes), "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list(token)).alias("b"))
    choices = params.agg(F.collect_list(F.struct(*params.columns)).alias("p")).scalar()
    arrays = [F.col(f"b.{c}").alias(c) for c in TOKEN]
    return pages.select("page_id", *arrays).withColumn("param", F.explode(choices))


def each_page(tried: DataFrame, kind: type[Page], read: Callable[[Page], list[tuple]], columns: str) -> DataFrame:
    """(page_id, param_id, columns): what `read` makes of every page of with_params(); its parameters share the cuts that they agree on."""
    names, known = ["page_id", "param_id", *(c.split()[0] for c in columns.split(", "))], {f.name for f in fields(Thresholds)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, page_id = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                chosen = row.param if isinstance(row.param, dict) else row.param.asDict()
                thresholds = Thresholds(**{k: v for k, v in chosen.items() if k in known and v is not None})
                if page is None or row.page_id != page_id:
                    page, page_id = kind({c: getattr(row, c) for c in TOKEN}, thresholds), row.page_id
                page.t = thresholds
                out += [(row.page_id, chosen["param_id"], *values) for values in read(page)]
            yield pd.DataFrame(out, columns=names)

    return tried.mapInPandas(run, f"page_id string, param_id string, {columns}")


def assemble(boxes: DataFrame, params: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """(page_id, line_no, line) of boxes (page_id, box_id, text, min_x, min_y, max_x, max_y), y upwards.

    `placed` tells that the boxes of a page already stand together in one partition, by box_id; they are not shuffled then.
    `params`, rows with param_id and columns named like Thresholds (null: as usual), has every page assembled under each
    of them in turn; param_id comes out too.
    """
    if params is not None:
        return each_page(with_params(boxes, params), Page, lambda page: list(enumerate(page.lines())), "line_no int, line string")

    def read(pages: list[tuple[str, list[dict[str, np.ndarray]]]]) -> pd.DataFrame:
        out = []
        for page_id, parts in pages:
            page = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in TOKEN}
            out += [(page_id, i, line) for i, line in enumerate(Page(page, Thresholds()).lines())]
        return pd.DataFrame(out, columns=["page_id", "line_no", "line"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list[tuple[str, list[dict[str, np.ndarray]]]] = []  # the page that the next batch may go on with
        for batch in batches:
            ids, columns = batch["page_id"].to_numpy(), {c: batch[c].to_numpy() for c in TOKEN}
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(batch)]
            pages = last
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = {c: x[a:b] for c, x in columns.items()}
                if pages and a < b and pages[-1][0] == ids[a]:
                    pages[-1][1].append(part)
                elif a < b:
                    pages.append((ids[a], [part]))
            yield read(pages[:-1])
            last = pages[-1:]
        yield read(last)

    tokens = tokens_of(boxes)
    ordered = tokens if placed else dealt(tokens, "page_id").sortWithinPartitions("page_id", "box_id")
    return ordered.select("page_id", *TOKEN).mapInPandas(run, "page_id string, line_no int, line string")


#: The variants of the bench: rules against gutters that rows run across and against columns of prices, and chaining of rows.
VARIANTS = {"base": (False, False, 0.0, False), "veto": (True, False, 0.0, False), "isolate": (True, True, 0.0, False), "price_gutter": (False, False, 0.2, False), "chaining": (False, False, 0.0, True), "both": (False, False, 0.2, True), "usual": (True, False, 0.2, True)}


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in VARIANTS.items()], "param_id string, gutter_veto boolean, isolate boolean, min_names double, chaining boolean")


def variant_bench(boxes: DataFrame, params: DataFrame) -> DataFrame:
    """(page_id, param_id, lines, priced, complete): lines with a price and a letter, and those of them that name a strength."""
    lines = assemble(boxes, params)
    priced = F.contains("line", F.lit("$")) & F.col("line").rlike(r"\p{L}")
    return lines.groupBy("page_id", "param_id").agg(F.count("*").alias("lines"), F.count_if(priced).alias("priced"), F.count_if(priced & F.contains(F.upper("line"), F.lit("ABV"))).alias("complete"))


def height_sweep(spark: SparkSession, heights: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0)) -> DataFrame:
    return spark.createDataFrame([(f"heights={k}", k) for k in heights], "param_id string, section_heights double")


def sweep_scores(boxes: DataFrame, params: DataFrame) -> DataFrame:
    """(page_id, param_id, orphans, fused, lines) of pages cut by text heights under each row of params."""
    return each_page(with_params(boxes, params), HeightPage, lambda page: [page.score()], "orphans double, fused double, lines int")


def sweep_summary(scores: DataFrame) -> DataFrame:
    """(param_id, orphans, fused, bad, pages): means over pages, to nine decimals."""
    mean = lambda c: F.round(F.avg(c), 9)
    return scores.groupBy("param_id").agg(mean("orphans").alias("orphans"), mean("fused").alias("fused"), mean(F.col("orphans") + F.col("fused")).alias("bad"), F.count("*").alias("pages"))


def coverage_histogram(boxes: DataFrame, bins: int = 100) -> DataFrame:
    """(page_id, bin, boxes): how many boxes cover each of `bins` columns of a page."""
    low, high = F.greatest(F.lit(0), (F.col("min_x") * bins).cast("int")), F.least(F.lit(bins - 1), (F.col("max_x") * bins).cast("int"))
    return boxes.where(low <= high).select("page_id", F.explode(F.sequence(low, high)).alias("bin")).groupBy("page_id", "bin").agg(F.count("*").alias("boxes"))


def gutter_votes(rows: DataFrame, min_gutter: float = 0.045) -> DataFrame:
    """(page_id, row_no, x, width): gaps between neighbours of a row that are wide enough, from boxes with row_no."""
    after = F.lead("min_x").over(Window.partitionBy("page_id", "row_no").orderBy("min_x", "box_id"))
    gap = rows.withColumn("after", after).withColumn("width", F.col("after") - F.col("max_x"))
    return gap.where(F.col("width") >= min_gutter).select("page_id", "row_no", ((F.col("max_x") + F.col("after")) / 2).alias("x"), "width")


def gutter_support(rows: DataFrame, gutters: DataFrame, min_gutter: float = 0.045) -> DataFrame:
    """(page_id, x, voters, crossers): rows that leave each candidate gutter (page_id, x) free, and rows that run across it."""
    after = F.lead("min_x").over(Window.partitionBy("page_id", "row_no").orderBy("min_x", "box_id"))
    x = F.col("x")
    # The next box is the same for every gutter. Gutters are few for the boxes of a page: hashed, they spare boxes a sort.
    boxes = rows.select("page_id", "row_no", "box_id", "min_x", "max_x").withColumn("after", after).join(gutters.hint("shuffle_hash"), "page_id")
    votes = (F.col("max_x") <= x) & (x <= F.col("after")) & (F.col("after") - F.col("max_x") >= min_gutter)
    each = boxes.groupBy("page_id", "x", "row_no").agg(F.coalesce(F.bool_or(votes), F.lit(False)).alias("votes"), F.bool_or((F.col("min_x") < x) & (x < F.col("max_x"))).alias("spans"), (F.bool_or(F.col("max_x") <= x) & F.bool_or(F.col("min_x") >= x)).alias("both"))
    return each.groupBy("page_id", "x").agg(F.count_if("votes").alias("voters"), F.count_if(~F.col("votes") & (F.col("spans") | F.col("both"))).alias("crossers"))


def column_sides(boxes: DataFrame, gutters: DataFrame) -> DataFrame:
    """(page_id, x, side, boxes, span, names): what the guard of a split looks at, on both sides of each gutter."""
    sided = tokens_of(boxes).join(gutters.hint("shuffle_hash"), "page_id").withColumn("side", F.when((F.col("min_x") + F.col("max_x")) / 2 < F.col("x"), "left").otherwise("right"))
    return sided.groupBy("page_id", "x", "side").agg(F.count("*").alias("boxes"), (F.max("max_x") - F.min("min_x")).alias("span"), F.avg(F.col("is_name").cast("int")).alias("names"))


def text_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line) of structured page text: white space collapsed, blank lines dropped."""
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select("page_id", F.posexplode(lines).alias("line_no", "line"))


def table_lines(rows: DataFrame) -> DataFrame:
    """rows (page_id, row_no, cells array) as lines of their cells that are not empty."""
    return rows.select("page_id", "row_no", F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""), " ").alias("line")).where("line <> ''")


def promote_candidate(readings: DataFrame, most: int = 3) -> DataFrame:
    """(page_id, line_no, line): of the first `most` readings of a line the first with an anchored price, else the first."""
    plain = ~has_anchored_price(F.col("line"))
    few = dealt(readings.where(F.col("candidate_no") < most), "page_id", "line_no", times=8)  # the aggregate sorts what a task holds
    return few.groupBy("page_id", "line_no").agg(F.min_by("line", F.struct(plain.alias("plain"), "candidate_no")).alias("line"))


def select_reading(scores: DataFrame) -> DataFrame:
    """(photo_id, candidate_no): most anchored lines, then most priced items, then fewest items, then the earliest."""
    key = F.struct((-F.col("anchored")).alias("a"), (-F.col("priced")).alias("p"), "items", "candidate_no")
    return scores.groupBy("photo_id").agg(F.min_by("candidate_no", key).alias("candidate_no"))
