"""Page layout from text boxes (page, ord, left, top, right, bottom, text, font_size) and classing of single values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, small_batches


def cluster_1d(values: DataFrame, tolerance: float, *by: str) -> DataFrame:
    """Rows (by, id, x) with a group number: a gap of more than the tolerance opens a new one."""
    w = Window.partitionBy(*by).orderBy("x", "id")
    gap = F.when(F.col("x") - F.lag("x").over(w) > tolerance, 1).otherwise(0)
    return values.withColumn("__gap", gap).withColumn("g", F.sum("__gap").over(w)).drop("__gap")


def centroids(clustered: DataFrame, *by: str) -> DataFrame:
    return clustered.groupBy(*by, "g").agg(F.avg("x").alias("centroid"), F.count(F.lit(1)).alias("size"))


def otsu(values: DataFrame, *by: str) -> DataFrame:
    """Threshold between two neighbouring distinct values that maximises the variance between the classes; the lowest of equals."""
    one = values.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("x")
    upto, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    s = one.select(*by, "x", F.lead("x").over(w).alias("next"), F.sum("n").over(upto).alias("n0"), F.sum(F.col("x") * F.col("n")).over(upto).alias("s0"), F.sum("n").over(every).alias("N"), F.sum(F.col("x") * F.col("n")).over(every).alias("S")).where("next IS NOT NULL")
    n1, m0 = F.col("N") - F.col("n0"), F.col("s0") / F.col("n0")
    m1 = (F.col("S") - F.col("s0")) / n1
    var = F.col("n0") * n1 / (F.col("N") * F.col("N")) * (m0 - m1) * (m0 - m1)
    s = s.select(*by, ((F.col("x") + F.col("next")) / 2).alias("threshold"), F.round(var, 9).alias("variance"), F.col("n0").alias("below"), n1.alias("above"), m0.alias("below_mean"), m1.alias("above_mean"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("variance"), "threshold"))
    return s.withColumn("__r", best).where("__r = 1").drop("__r")


def modes(values: DataFrame, width: float, *by: str, least: int = 1) -> DataFrame:
    """Centres of bins that hold at least as many values as both neighbours."""
    low = values.groupBy(*by).agg(F.min("x").alias("lo"))
    v = values.join(low, list(by)) if by else values.crossJoin(low)
    bins = v.groupBy(*by, "lo", F.floor((F.col("x") - F.col("lo")) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("b")
    near = lambda f, d: F.when(f("b").over(w) == F.col("b") + d, f("n").over(w)).otherwise(0)
    got = bins.withColumn("l", near(F.lag, -1)).withColumn("r", near(F.lead, 1))
    return got.where((F.col("n") >= least) & (F.col("n") >= F.col("l")) & (F.col("n") >= F.col("r"))).select(*by, (F.col("lo") + (F.col("b") + 0.5) * width).alias("mode"), "n")


def jenks(x: np.ndarray, k: int) -> list[float]:
    """Upper bounds of k classes with the least squared deviation, by dynamic programming over prefix sums."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    k = min(k, n)
    if not k:
        return []
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    i = np.arange(n)
    best = q[1:] - s[1:] ** 2 / (i + 1)
    cuts = []
    for _ in range(1, k):
        new, at = np.full(n, np.inf), np.zeros(n, int)
        for e in range(n):
            b = np.arange(1, e + 1)
            if len(b):
                cost = best[b - 1] + (q[e + 1] - q[b]) - (s[e + 1] - s[b]) ** 2 / (e + 1 - b)
                at[e] = b[np.argmin(cost)]
                new[e] = cost.min()
        cuts.append(at)
        best = new
    out, e = [], n - 1
    for at in [*reversed(cuts), None]:
        out.append(float(x[e]))
        e = at[e] - 1 if at is not None else e
    return out[::-1]


def jenks_breaks(values: DataFrame, k: int, by: str) -> DataFrame:
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        b = jenks(df["x"].to_numpy(), k)
        return pd.DataFrame({"g": [key[0]] * len(b), "class": range(len(b)), "upper": b})

    return values.groupBy(by).applyInPandas(run, "g long, class int, upper double")


def _ends(axis: str) -> tuple[Column, Column]:
    return (F.col("left"), F.col("right")) if axis == "x" else (F.col("top"), F.col("bottom"))


def projection_profile(boxes: DataFrame, axis: str, resolution: float = 1.0, weight: str = "count") -> DataFrame:
    """page, bin, weight over all bins between the outermost edges; empty bins are 0."""
    a, b = _ends(axis)
    w = {"count": F.lit(1.0), "area": (F.col("bottom") - F.col("top")) if axis == "x" else (F.col("right") - F.col("left")), "length": F.length("text").cast("double")}[weight]
    edge = boxes.groupBy("page").agg(F.min(a).alias("lo"), F.max(b).alias("hi"))
    bins = edge.withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / resolution)))
    cover = boxes.join(bins, "page").select("page", "bins", w.alias("w"), F.greatest(F.lit(0), F.floor((a - F.col("lo")) / resolution)).alias("s"), F.least("bins", F.ceil((b - F.col("lo")) / resolution)).alias("e")).where("e > s")
    hit = cover.select("page", "w", F.explode(F.sequence("s", F.col("e") - 1)).alias("bin")).groupBy("page", "bin").agg(F.sum("w").alias("weight"))
    every = bins.select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every.join(hit, ["page", "bin"], "left").na.fill(0.0, ["weight"])


def find_valleys(profile: DataFrame, threshold: float = 0.0, least: int = 1) -> DataFrame:
    """Runs of bins at or below the threshold (islands), widest first by `rank`."""
    w = Window.partitionBy("page").orderBy("bin")
    low = profile.where(F.col("weight") <= threshold).withColumn("k", F.col("bin") - F.row_number().over(w))
    v = low.groupBy("page", "k").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end")).withColumn("width", F.col("end") - F.col("start")).where(F.col("width") >= least)
    return v.select("page", "start", "end", "width", F.floor((F.col("start") + F.col("end")) / 2).alias("center"), F.row_number().over(Window.partitionBy("page").orderBy(F.desc("width"), "start")).alias("rank"))


_EDGES = ("left", "top", "right", "bottom")


def group_into_lines(boxes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """page, line, position, ord and edges: boxes in order of their middle join the line whose running mean is near enough."""

    def run(p: np.ndarray, box: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        y, left, ords = (box["top"] + box["bottom"]) / 2, box["left"], box["ord"]
        order = np.lexsort((ords, left, y, p))
        p, y = p[order], y[order]
        page = np.append(True, p[1:] != p[:-1])
        opens = page | np.append(True, y[1:] - y[:-1] > tolerance)
        # middles within the tolerance of each other are one line; only wider runs need the mean as it moves
        at = np.flatnonzero(opens)
        end = np.append(at[1:], len(y))
        for a, b in zip(at[wide := ~(y[end - 1] - y[at] < tolerance)].tolist(), end[wide].tolist(), strict=True):
            total, n = 0.0, 0
            for i in range(a, b):
                if n and abs(y[i] - total / n) > tolerance:
                    opens[i], total, n = True, 0.0, 0
                total, n = total + y[i], n + 1
        line = np.cumsum(opens)
        inner = np.lexsort((ords[order], left[order], line))
        order, p, line = order[inner], p[inner], line[inner]
        head = np.append(True, line[1:] != line[:-1])
        place = np.arange(len(line))
        position = place - np.maximum.accumulate(np.where(head, place, 0))
        base = np.maximum.accumulate(np.where(np.append(True, p[1:] != p[:-1]), line, 0))
        return {"of": order, "line": (line - base).astype(np.int32), "position": position.astype(np.int32)}

    out = {"line": "int", "position": "int"}
    return _by_page(boxes, ("ord", *_EDGES), run, ("line", "position", "ord", *_EDGES), out)


def _by_page(boxes: DataFrame, names: tuple[str, ...], run: Callable, wanted: tuple[str, ...], made: dict[str, str]) -> DataFrame:
    """page and the wanted columns: `run` gets the boxes of many whole pages (page numbers in a batch, columns by name) and returns which
    row each of its rows is `of`, with the columns it made."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n = batch.column(1).value_lengths().to_numpy()
            held = batch.column(1).flatten()
            cols = {c: held.field(c) for c in names}
            got = run(np.repeat(np.arange(len(n)), n), {c: v.to_numpy(zero_copy_only=False) for c, v in cols.items()})
            of = pa.array(got["of"])
            page = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)[got["of"]]))
            yield pa.RecordBatch.from_arrays([page, *[pa.array(got[c]) if c in got else cols[c].take(of) for c in wanted]], names=["page", *wanted])

    small_batches(boxes.sparkSession)
    kinds = {c: "long" if c == "ord" else "double" for c in names}
    rows = boxes.groupBy(F.col("page").cast("long").alias("page")).agg(F.collect_list(F.struct(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])).alias("boxes"))
    return rows.mapInArrow(batches, ", ".join(["page long", *[f"{c} {made.get(c) or kinds[c]}" for c in wanted]]))


def xy_cut(boxes: DataFrame, min_gap_x: float = 10.0, min_gap_y: float = 5.0) -> DataFrame:
    """page, ord, region: recursive cut at the widest gap, rows first, then columns, in reading order.

    The regions of all pages of a batch are cut at once. Gaps between rows stay whatever else is cut, so all of them are cut in one
    step; of columns only the widest gap of a region is, as its parts may have rows apart again.
    """

    def cut(region: np.ndarray, a: np.ndarray, rank: np.ndarray, ends: np.ndarray, least: float, widest: bool) -> tuple[np.ndarray, bool]:
        order = np.lexsort((a, region))
        r, n = region[order], np.int64(len(ends))
        same = r[1:] == r[:-1]
        top = ends[np.maximum.accumulate(rank[order] + r * n) - r * n][:-1]
        width = a[order][1:] - top
        at = np.flatnonzero(same & (width >= least))
        if widest and len(at):
            best = np.lexsort((at, -width[at], r[at]))
            at = at[best][np.append(True, r[at][1:] != r[at][:-1])]
        opens = np.append(True, ~same)
        opens[at + 1] = True
        out = np.empty_like(region)
        out[order] = np.cumsum(opens) - 1
        return out, bool(len(at))

    def run(p: np.ndarray, box: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        region, more = p.astype(np.int64), len(p) > 0
        (bottoms, b), (rights, r) = (np.unique(box[c], return_inverse=True) for c in ("bottom", "right"))
        while more:
            region, _ = cut(region, box["top"], b, bottoms, min_gap_y, widest=False)
            region, more = cut(region, box["left"], r, rights, min_gap_x, widest=True)
        first = np.full(int(p.max()) + 1 if len(p) else 0, np.iinfo(np.int64).max)
        np.minimum.at(first, p, region)
        return {"of": np.arange(len(p)), "region": (region - first[p]).astype(np.int32)}

    return _by_page(boxes, ("ord", *_EDGES), run, ("ord", "region"), {"region": "int"})


def headers_footers(boxes: DataFrame, share: float = 0.5, margin: float = 0.1) -> DataFrame:
    """page, ord, zone of the boxes whose text, folded, stands in the top or bottom zone of at least max(2, share of the pages) pages."""
    edge = boxes.groupBy("page").agg(F.min("top").alias("lo"), F.max("bottom").alias("hi"))
    n = edge.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * share)).alias("least"))
    span, y = F.col("hi") - F.col("lo"), (F.col("top") + F.col("bottom")) / 2
    zone = F.when(span <= 0, None).when(y < F.col("lo") + span * margin, "header").when(y > F.col("hi") - span * margin, "footer")
    got = boxes.join(edge, "page").select("page", "ord", zone.alias("zone"), F.lower(F.trim("text")).alias("key")).where("zone IS NOT NULL AND key <> ''")
    often = got.groupBy("zone", "key").agg(F.count_distinct("page").alias("pages")).crossJoin(n).where(F.col("pages") >= F.col("least")).select("zone", "key")
    return got.join(often, ["zone", "key"]).select("page", "ord", "zone")


def detect_columns(boxes: DataFrame, least: float = 10.0, resolution: float = 1.0, ratio: float = 0.1) -> DataFrame:
    """page, n, left, right of the columns between gutters: strips of at least `least` units under `ratio` of the page's peak."""
    profile = projection_profile(boxes, "x", resolution)
    low = profile.join(profile.groupBy("page").agg((F.max("weight") * ratio).alias("most")), "page").where(F.col("weight") <= F.col("most"))
    k = F.col("bin") - F.row_number().over(Window.partitionBy("page").orderBy("bin"))
    gutters = low.withColumn("k", k).groupBy("page", "k").agg(F.min("bin").alias("s"), (F.max("bin") + 1).alias("e")).where(F.col("e") - F.col("s") >= max(1, int(least / resolution)))
    edge = boxes.groupBy("page").agg(F.min("left").alias("lo"), F.max("right").alias("hi"))
    cuts = gutters.join(edge, "page").select("page", (F.col("lo") + F.col("s") * resolution).alias("until"), (F.col("lo") + F.col("e") * resolution).alias("since"))
    ends = cuts.select("page", F.col("until").alias("x"), F.col("since").alias("next")).unionByName(edge.select("page", F.col("hi").alias("x"), F.lit(None).cast("double").alias("next")))
    w = Window.partitionBy("page").orderBy(F.col("next").asc_nulls_last())
    spans = ends.join(edge.select("page", "lo"), "page").select("page", F.coalesce(F.lag("next").over(w), F.col("lo")).alias("left"), F.col("x").alias("right")).where(F.col("right") > F.col("left"))
    return spans.select("page", F.row_number().over(Window.partitionBy("page").orderBy("left")).alias("n"), "left", "right")


def natural_breaks(x: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Class of each of the sorted distinct values (held so many times): k classes of least squared deviation."""
    m, k = len(x), min(k, len(x))
    n, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (times, times * x, times * x * x))
    cost = np.full((m + 1, m + 1), np.inf)
    for b in range(m):
        e = np.arange(b + 1, m + 1)
        cost[b, e] = q[e] - q[b] - (s[e] - s[b]) ** 2 / (n[e] - n[b])
    best, cuts = cost[0], []
    for _ in range(1, k):
        both = best[:, None] + cost
        cuts.append(both.argmin(axis=0))
        best = both.min(axis=0)
    out, e = np.zeros(m, int), m
    for c in range(k - 1, 0, -1):
        b = int(cuts[c - 1][e])
        out[b:e] = c
        e = b
    return out


_CLASSES = {1: ("body",), 2: ("body", "heading"), 3: ("footnote", "body", "heading"), 4: ("footnote", "body", "subheading", "heading")}


def classify_font_sizes(boxes: DataFrame, *by: str, k: int = 0, tolerance: float = 0.5) -> DataFrame:
    """by, size, blocks, role of every font size: k natural breaks (0: as many as sizes are apart by more than the tolerance, 4 at most).

    Two classes are split where Otsu's threshold is, which is the same bound; sizes that aren't positive are body.
    """
    size = boxes.groupBy(*by, F.col("font_size").cast("double").alias("size")).agg(F.count(F.lit(1)).alias("blocks"))
    names = [*by, "size", "blocks", "role"]

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("size")
        known = df[df["size"] > 0]
        x = known["size"].to_numpy()
        apart = 1 + int((np.diff(x) > tolerance).sum()) if len(x) else 0
        classes = (k or min(apart, 4)) if apart >= 2 else 1
        label = natural_breaks(x, known["blocks"].to_numpy().astype(float), classes) if len(x) else np.zeros(0, int)
        roles = _CLASSES.get(classes) or tuple(f"class_{i}" for i in range(classes))
        out = df.assign(role="body")
        out.loc[known.index, "role"] = [roles[i] for i in label]
        return out[names]

    kinds = {f.name: f.dataType.simpleString() for f in size.schema.fields}
    return size.groupBy(*by).applyInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in (*by, "size", "blocks")]) + ", role string")


def paragraph_breaks(lines: DataFrame, method: str = "otsu", relative: float = 1.5) -> DataFrame:
    """page, line, breaks for lines (page, line, top, bottom): whether a line opens a paragraph, by the gap before it.

    otsu: the gap reaches the page's threshold, unless over 0.8 of the gaps do; relative: it reaches so many medians; jenks: it
    is in the upper of two natural classes. No page has breaks whose largest gap isn't positive or under 1.3 medians.
    """
    if method not in ("otsu", "relative", "jenks"):
        raise ValueError(f"unknown method {method}")
    w = Window.partitionBy("page").orderBy("top", "line")
    g = lines.withColumn("gap", (F.col("top") - F.lag("bottom").over(w)).cast("double"))
    g = materialize(g.select("page", "line", "gap"), "gaps")  # read three times
    known = g.where("gap IS NOT NULL")
    cut = otsu(known.select("page", F.col("gap").alias("x")), "page").select("page", "threshold", "above")
    ordered = F.array_sort(F.collect_list("gap"))
    mid = known.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("widest"), F.element_at(ordered, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median"))
    differ = (F.col("widest") > 0) & ~((F.col("median") > 0) & (F.col("widest") / F.col("median") < 1.3))
    over = {
        "otsu": (F.col("gap") >= F.col("threshold")) & (F.col("above") <= 0.8 * F.col("n")),
        "relative": F.col("gap") >= F.col("median") * relative,
        "jenks": F.col("gap") > F.col("threshold"),
    }[method]
    return g.join(mid, "page", "left").join(cut, "page", "left").select("page", "line", F.coalesce(differ & over, F.lit(False)).alias("breaks"))


def table_regions(placed: DataFrame, least_cols: int = 2, least_rows: int = 2, tolerance: float = 3.0) -> DataFrame:
    """page, left, top, right, bottom of runs of lines whose boxes stand at enough common left edges.

    placed: boxes with their line. Left edges of a page are clustered; a column is a cluster that so many lines have, and a box
    belongs to it within the tolerance of the cluster's mean.
    """
    placed = materialize(placed.select("page", "line", "ord", *_EDGES), "placed")  # read twice
    got = cluster_1d(placed.select("page", "line", F.col("ord").alias("id"), F.col("left").cast("double").alias("x")), tolerance, "page")
    columns = got.groupBy("page", "g").agg(F.avg("x").alias("at"), F.count_distinct("line").alias("rows")).where(F.col("rows") >= least_rows)
    held = got.join(columns, ["page", "g"]).where(F.abs(F.col("x") - F.col("at")) <= tolerance).groupBy("page", "line").agg(F.count_distinct("g").alias("columns"))
    wide = held.where(F.col("columns") >= least_cols).withColumn("k", F.col("line") - F.row_number().over(Window.partitionBy("page").orderBy("line")))
    box = placed.groupBy("page", "line").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    runs = wide.join(box, ["page", "line"]).groupBy("page", "k").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("rows"))
    return runs.where(F.col("rows") >= least_rows).select("page", "left", "top", "right", "bottom")
