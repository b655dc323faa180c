"""Alignment: plateau fits, track-based minimisation (one detector at a time, or all at once), and detectors under test.

Tracks stay distributed: one row a track with its points, stored once. A detector's geometry enters as a few
constants: where a local point lies, and how that place moves with each degree of freedom. Per pass, one aggregation brings sums to the driver whose number follows from the
geometry alone: a matrix of (6 x detectors)^2 numbers, or a histogram of fixed bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamloom.functions import coords, hist
from beamloom.operators import track
from beamloom.sources import geometry, store
from beamloom.sources.geometry import Detector

DOFS = ("x", "y", "z", "rx", "ry", "rz")


# ---- limits of chi2


def _chi2_cdf(x: float, ndof: int) -> float:
    """The regularised lower incomplete gamma function P(ndof / 2, x / 2), by its series."""
    a, h = ndof / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1.0 / a
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= h / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


@lru_cache(256)
def chi2_limit(deviations: int, ndof: int) -> float:
    """chi2 / ndof that a track exceeds as rarely as a normal variable so many (1 to 3) standard deviations; 0 without degrees of
    freedom. Up to 30 the exact quantile to four digits, beyond it Fisher's approximation."""
    if ndof < 1:
        return 0.0
    level = math.erf(max(1, min(deviations, 3)) / math.sqrt(2))
    if ndof > 30:
        return (NormalDist().inv_cdf(level) + math.sqrt(2 * ndof - 3)) ** 2 / (2 * ndof - 2)
    low, high = 0.0, 100.0 + 10 * ndof
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, ndof) < level else (low, middle)
    return round(high / ndof, 4)


# ---- plateau


@dataclass
class Plateau:
    centre: float
    width: float
    warning: str = ""


#: Fixed values of the fit: bins either side that a level is the mean of, entries it needs, where the background is taken and how far edges are
#: looked for (in known widths, plus bins), the share of the known width below which a channel counts as missing, and
#: what shows on which side: the share of the height, the bins (at least, and in pitches) of a run.
LEVEL_BINS, LEAST_ENTRIES, BACKGROUND_AT, EDGES_WITHIN, MORE_BINS, MISSING_BELOW, WEAK, LEAST_RUN, RUN_IN_PITCHES = 2, 100, 1.6, 1.3, 2, 0.7, 0.15, 3, 0.3


def plateaus(profiles: DataFrame, by: tuple[str, ...], bins: int, low: float, high: float, tolerance: float = 0.15) -> DataFrame:
    """by, centre, found_width, warning of box profiles over a background, for all profiles at once; those of few entries have none.

    profiles: by, width (0 if unknown), pitch, bin, content; bins without entries may be left out. The edges are where the
    profile passes the middle between the fullest bin's level and the background's. A profile much narrower than the
    known width misses a channel: its centre moves half a pitch to the side with the larger run of weak bins. Everything is an
    aggregation or a window over the bins of a profile.
    """
    step, peak, bin_, content = (high - low) / bins, F.col("peak"), F.col("bin"), F.col("content")
    reach = lambda widths: F.round(widths * F.col("width") / step) + MORE_BINS
    fullest = F.min_by("bin", F.struct(-content, bin_)).alias("peak")
    shapes = profiles.groupBy(*by).agg(F.sum("content").alias("entries"), F.max("width").alias("width"), F.max("pitch").alias("pitch"), fullest).filter(F.col("entries") >= LEAST_ENTRIES)
    shapes = shapes.withColumns({"__" + n: F.least(F.greatest(peak + sign * reach(widths), F.lit(0)), F.lit(bins - 1)) for n, sign, widths in (("b0", -1, BACKGROUND_AT), ("b1", 1, BACKGROUND_AT), ("e0", -1, EDGES_WITHIN), ("e1", 1, EDGES_WITHIN))})
    along = Window.partitionBy(*by).orderBy("bin")
    dense = shapes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(profiles.select(*by, "bin", "content"), [*by, "bin"], "left").fillna(0.0, ["content"])
    dense = dense.withColumns({"level": F.avg("content").over(along.rowsBetween(-LEVEL_BINS, LEVEL_BINS)), "before": F.lag("content").over(along), "after": F.lead("content").over(along)})
    level = lambda at: F.max(F.when(bin_ == at, F.col("level"))).over(Window.partitionBy(*by))
    dense = dense.withColumn("base", (level(F.col("__b0")) + level(F.col("__b1"))) / 2).withColumn("height", level(peak) - F.col("base"))
    middle = F.col("base") + F.col("height") / 2
    full = (bin_ == peak) | (bin_.between(F.col("__e0"), F.col("__e1")) & (content >= middle))
    outer = {"left": F.min(F.when(full & (bin_ <= peak), F.struct("bin", "content", F.col("before").alias("next")))), "right": F.max(F.when(full & (bin_ >= peak), F.struct("bin", "content", F.col("after").alias("next"))))}
    dense = dense.withColumns({n: e.over(Window.partitionBy(*by)) for n, e in outer.items()})

    def edge(side: str, out: int) -> Column:
        e = F.col(side)
        part = F.coalesce(F.try_divide(e["content"] - middle, e["content"] - e["next"]), F.lit(1.0))
        return low + (e["bin"] + 0.5) * step + F.when(e["next"].isNull(), 0.0).otherwise(out * part * step)

    found = dense.filter(bin_ == peak).select(*by, "width", "pitch", edge("left", -1).alias("__l"), edge("right", 1).alias("__r"))
    side = F.when(bin_.between(F.col("__e0"), F.col("left.bin") - 1), -1).when(bin_.between(F.col("right.bin") + 1, F.col("__e1")), 1)
    weak = dense.withColumn("side", side).filter(F.col("side").isNotNull() & (content > F.col("base") + WEAK * F.col("height")))
    weak = weak.withColumn("run", bin_ - F.row_number().over(Window.partitionBy(*by, "side").orderBy("bin")))
    runs = weak.groupBy(*by, "side", "run").agg(F.count("*").alias("__k"), F.sum(content - F.col("base")).alias("sum"), F.max("pitch").alias("pitch"))
    runs = runs.filter(F.col("__k") >= F.greatest(F.lit(LEAST_RUN), F.round(RUN_IN_PITCHES * F.col("pitch") / step)))
    best = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("sum"))), F.lit(0.0))
    toward = runs.groupBy(*by).agg(F.signum(best(1) - best(-1)).alias("toward"))
    out = found.join(toward, list(by), "left").select(*by, "width", "pitch", ((F.col("__l") + F.col("__r")) / 2).alias("centre"), (F.col("__r") - F.col("__l")).alias("found_width"), F.coalesce("toward", F.lit(0.0)).alias("toward"))
    known, missing = F.col("width") > 0, F.col("found_width") < MISSING_BELOW * F.col("width")
    shift = F.when(F.col("pitch") > 0, F.col("pitch") / 2).otherwise((F.col("width") - F.col("found_width")) / 2)
    told = F.when(F.col("toward") < 0, "moved to the low side").when(F.col("toward") > 0, "moved to the high side").otherwise("no signal on either side, not moved")
    off = F.abs(F.col("found_width") - F.col("width")) / F.col("width")
    warning = F.when(known & missing, F.concat(F.lit("a channel looks missing: "), told)).when(known & (off > tolerance), F.concat(F.lit("the width differs by "), F.round(100 * off).cast("int"), F.lit("%"))).otherwise("")
    return out.select(*by, (F.col("centre") + F.when(known & missing, F.col("toward") * shift).otherwise(0.0)).alias("centre"), "found_width", warning.alias("warning"))


def pads(profiles: DataFrame, by: tuple[str, ...], bins: int, low: float, high: float, share: float = 0.1) -> DataFrame:
    """by, centre, found_width, warning of profiles whose footprint is no one plateau (pads with gaps wider than themselves): from the
    first to the last bin that has at least the share of the fullest one."""
    step, top = (high - low) / bins, F.max("content").over(Window.partitionBy(*by))
    some = profiles.withColumn("__top", top).filter(F.col("content") >= share * F.col("__top"))
    entries = profiles.groupBy(*by).agg(F.sum("content").alias("entries")).filter(F.col("entries") >= LEAST_ENTRIES)
    ends = some.groupBy(*by).agg(F.min("bin").alias("a"), F.max("bin").alias("b")).join(entries, list(by))
    return ends.select(*by, (low + (F.col("a") + F.col("b") + 1) / 2 * step).alias("centre"), ((F.col("b") - F.col("a") + 1) * step).alias("found_width"), F.lit("").alias("warning"))


#: The ways that a layout may name: profiles -> by, centre, found_width, warning.
CENTRES = {"plateau": plateaus, "pads": pads}


def prealigned(tracks: DataFrame, d: Detector, bins: int = 500, reach: float = 10.0) -> tuple[Detector, dict[str, Plateau | None]]:
    """A detector moved to the centres of the plateaus of track positions at its z. Positions are global, so a centre is the
    new position itself. How a profile gives its centre is the layout's choice."""
    z = d.position[2]
    axis = lambda k: F.struct(F.lit("xy"[k]).alias("axis"), (F.col("c" + "xy"[k]) + F.col("m" + "xy"[k]) * z).alias("at"), F.lit(float(d.size()[k])).alias("width"), F.lit(float((d.pitch_x, d.pitch_y)[k])).alias("pitch"))
    both = tracks.select(F.inline(F.array(axis(0), axis(1))))
    profiles = hist.bins_1d(both, "at", bins, -reach, reach, ("axis", "width", "pitch"))
    found = {r["axis"]: Plateau(r["centre"], r["found_width"], r["warning"]) for r in CENTRES[d.rules().centre](profiles, ("axis",), bins, -reach, reach).collect()}  # two rows at most
    place = tuple(found[a].centre if a in found else v for a, v in zip("xyz", d.position, strict=True))
    return replace(d, position=place), {a: found.get(a) for a in "xy"}


# ---- tracks and degrees of freedom


BY = ("event_id", "track_id")


def track_rows(points: DataFrame, detectors: list[Detector]) -> DataFrame:
    """BY and h, a track's points (d: the detector's number, u, v: local), from points (BY, detector, u, v). This is the only shuffle of an
    alignment: all passes work on these rows, where each track is whole."""
    number = F.create_map(*[F.lit(x) for i, d in enumerate(detectors) for x in (d.name, i)])
    known = points.withColumn("d", F.try_element_at(number, F.col("detector"))).filter("d IS NOT NULL")
    return known.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("d", "u", "v"))).alias("h"))


_POINTS = (("n", "<i4"), ("d", "<i4"), ("u", "<f8"), ("v", "<f8"))


def packed(tracks: DataFrame) -> DataFrame:
    """track_rows as arrays: for some thousand tracks a row, how many points each has (n), and d, u, v of all of them, one after the other.
    A pass reads these as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            h = rb.column(0)
            points = h.flatten()
            found = (np.diff(h.offsets.to_numpy()), *[points.field(k).to_numpy(zero_copy_only=False) for k in range(3)])
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, (_, t) in zip(found, _POINTS, strict=True)], [n for n, _ in _POINTS])

    return tracks.select("h").mapInArrow(run, "n binary, d binary, u binary, v binary")


@dataclass
class Geometry:
    """By the detector's number: place, rotation, weights in x and y, and how the rotation moves with each turn."""

    place: np.ndarray
    turn: np.ndarray
    weight: np.ndarray
    slopes: dict[str, np.ndarray]

    @classmethod
    def of(cls, detectors: list[Detector], dofs: tuple[str, ...]) -> Geometry:
        def slope(name: str) -> np.ndarray:
            step = np.eye(3)[DOFS.index(name) - 3] * 1e-6
            return np.array([(_turned(d, step) - _turned(d, -step)) / 2e-6 for d in detectors])

        weight = np.array([[1 / d.res_x**2, 1 / d.res_y**2] for d in detectors])
        return cls(np.array([d.position for d in detectors], float), np.array([d.rotation() for d in detectors], float), weight, {n: slope(n) for n in dofs if n not in DOFS[:3]})


def _turned(d: Detector, by: np.ndarray) -> np.ndarray:
    return np.array(replace(d, orientation=tuple(np.array(d.orientation) + by)).rotation())


@dataclass
class Line:
    """Straight lines of some tracks in one axis, about the weighted mean of z: sums of weights (s) and of w dz^2 (q) and slopes (m) by track,
    dz and what a point misses (e) by point."""

    s: np.ndarray
    q: np.ndarray
    m: np.ndarray
    dz: np.ndarray
    e: np.ndarray

    @classmethod
    def of(cls, t: np.ndarray, n: int, at: np.ndarray, z: np.ndarray, w: np.ndarray) -> Line:
        total = lambda x: np.bincount(t, x, n)
        s = total(w)
        dz, dv = z - (total(w * z) / s)[t], at - (total(w * at) / s)[t]
        q = total(w * dz * dz)
        m = total(w * dz * dv) / q
        return cls(s, q, m, dz, dv - m[t] * dz)


def _by_track(t: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Sums of rows by track; t ascends."""
    if len(t) and (np.diff(t) <= 0).any():  # a track with several points on a detector
        return np.stack([np.bincount(t, values[:, i], n) for i in range(values.shape[1])], axis=1)
    out = np.zeros((n, values.shape[1]))
    out[t] = values
    return out


def _sums(points: list[np.ndarray], g: Geometry, chosen: list[int], dofs: tuple[str, ...], change: np.ndarray | None, worst: float, chi2_most: float) -> np.ndarray:
    """The sums of `normal_equations` over some tracks: matrix, vector, chi2, points, tracks. Tracks without a line (one place along z, or
    a point without a place) do not count."""
    counts, d, u, v = points
    k, size = len(dofs), len(dofs) * len(chosen)
    matrix, vector = np.zeros((size, size)), np.zeros(size)
    n = len(counts)
    t = np.repeat(np.arange(n), counts)
    with np.errstate(all="ignore"):
        x, y, z = (g.place[d, i] + g.turn[d, i, 0] * u + g.turn[d, i, 1] * v for i in range(3))
        at, weight = [x, y], [g.weight[d, i] for i in range(2)]
        lines = [Line.of(t, n, at[i], z, weight[i]) for i in range(2)]
        moves = [[np.full(len(d), float(name == a)) for a in "xyz"] if name in DOFS[:3] else [g.slopes[name][d, i, 0] * u + g.slopes[name][d, i, 1] * v for i in range(3)] for name in dofs]
        # the point moves, and the track is met at another z
        slopes = [np.stack([m[i] - lines[i].m[t] * m[2] for m in moves], axis=1) for i in range(2)]
        if change is not None:
            at = [at[i] + (slopes[i] * change[d]).sum(axis=1) for i in range(2)]
            lines = [Line.of(t, n, at[i], z, weight[i]) for i in range(2)]
        chi2 = np.bincount(t, weight[0] * lines[0].e ** 2 + weight[1] * lines[1].e ** 2, n)
        far = np.zeros(n, bool)
        far[t[np.maximum(np.abs(lines[0].e), np.abs(lines[1].e)) >= worst]] = True
        use = np.isfinite(chi2) & ~far & (chi2 <= chi2_most) & (lines[0].q > 0) & (lines[1].q > 0)
    number = np.full(len(g.place), -1)
    number[chosen] = np.arange(len(chosen))
    own = np.nonzero((number[d] >= 0) & use[t])[0]
    of = number[d[own]]
    held = np.zeros(n, bool)
    held[t[own]] = True
    for i in range(2):
        mean, arm = np.zeros((n, size)), np.zeros((n, size))
        for c in range(len(chosen)):
            p, part = own[of == c], slice(c * k, c * k + k)
            pulled = weight[i][p, None] * slopes[i][p]
            matrix[part, part] += pulled.T @ slopes[i][p]
            vector[part] -= pulled.T @ lines[i].e[p]
            mean[:, part], arm[:, part] = _by_track(t[p], n, pulled), _by_track(t[p], n, pulled * lines[i].dz[p, None])
        mean, arm = mean[held], arm[held]
        matrix -= mean.T @ (mean / lines[i].s[held, None]) + arm.T @ (arm / lines[i].q[held, None])
    return np.concatenate([matrix.ravel(), vector, [chi2[held].sum(), counts[held].sum(), held.sum()]])


@dataclass
class Normal:
    """The reduced normal equations of some detectors: track parameters are eliminated."""

    matrix: np.ndarray
    vector: np.ndarray
    chi2: float
    points: int
    tracks: int


def normal_equations(
    tracks: DataFrame, detectors: list[Detector], chosen: list[int], dofs: tuple[str, ...], change: np.ndarray | None = None, worst: float = math.inf, chi2_most: float = math.inf
) -> Normal:
    """Sums over packed tracks, for the degrees of freedom of the chosen detectors: of tracks with no residual of `worst` or more and a chi2
    of `chi2_most` at most, their points moved by a change (detectors x degrees of freedom) along the derivatives at the detectors' places.

    A point's residual moves with its own detector, and with all points of its track through the straight line: the line's
    share are products of two sums a track, over its points and over their arms. Each task adds up its tracks;
    (6 x detectors)^2 sums reach the driver, in one aggregation.
    """
    g, size = Geometry.of(detectors, dofs), len(dofs) * len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size + size + 3)
        for rb in batches:
            for r in range(rb.num_rows):
                total += _sums([np.frombuffer(rb.column(i)[r].as_buffer(), k) for i, (_, k) in enumerate(_POINTS)], g, chosen, dofs, change, worst, chi2_most)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["at", "sum"])

    total = np.zeros(size * size + size + 3)
    for r in tracks.select(*[n for n, _ in _POINTS]).mapInArrow(run, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():  # as many as the geometry has
        total[r["at"]] = r["sum"]
    chi2, points, n = total[-3:].tolist()
    return Normal(total[: size * size].reshape(size, size), total[size * size : -3].copy(), chi2, int(points), int(n))


def with_change(d: Detector, dofs: tuple[str, ...], values: np.ndarray) -> Detector:
    step = dict(zip(dofs, map(float, values), strict=True))
    move = lambda old, names: tuple(v + step.get(n, 0.0) for v, n in zip(old, names, strict=True))
    return replace(d, position=move(d.position, DOFS[:3]), orientation=move(d.orientation, DOFS[3:]))


@dataclass
class Aligned:
    """The geometry after the last pass, and the corrections of each pass: (pass, detector, degree of freedom, value)."""

    detectors: list[Detector]
    steps: list[tuple[int, str, str, float]] = field(default_factory=list)


def on_all_planes(tracks: DataFrame, planes: int) -> DataFrame:
    """Tracks that have a point in every plane."""
    return tracks.filter(F.size(F.array_distinct(F.transform("h", lambda p: p["d"]))) == planes)


def _constraints(detectors: list[Detector], dofs: tuple[str, ...]) -> np.ndarray:
    """Rows that keep the whole from moving: no common shift in x and y, no shear of x and y along z, no common turn about z, and no
    turn about x and y of the planes up to the fourth against the others. Shifts along z are not constrained."""
    z = np.array([d.position[2] for d in detectors])
    spread = (z - z.mean()) / max(z.var(), 1e-300)
    arms = np.where(np.arange(len(z)) >= 4, 1.0, -1.0)
    rows = []
    for i, name in enumerate(dofs):
        for values in {"x": (np.ones(len(z)), spread), "y": (np.ones(len(z)), spread), "rx": (arms,), "ry": (arms,), "rz": (np.ones(len(z)),)}.get(name, ()):
            row = np.zeros((len(z), len(dofs)))
            row[:, i] = values
            rows.append(row.ravel())
    return np.array(rows).reshape(len(rows), len(z) * len(dofs))


def _solved(n: Normal, constraints: np.ndarray, done: np.ndarray, sigmas: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The step under linear constraints on the whole change, with a prior width for each degree of freedom."""
    a = n.matrix + np.diag(1 / sigmas**2)
    c = n.tracks * constraints[:, free]
    kkt = np.block([[a[np.ix_(free, free)], c.T], [c, np.zeros((len(c), len(c)))]])
    b = np.concatenate([n.vector[free], -n.tracks * (constraints @ done)])
    out = np.zeros(len(done))
    out[free] = np.linalg.lstsq(kkt, b, rcond=None)[0][: int(free.sum())]
    return out


def millepede(
    points: DataFrame, detectors: list[Detector], dofs: tuple[str, ...] = ("x", "y", "rx", "ry", "rz"), fixed: tuple[str, ...] = (), iterations: int = 3, inner: int = 9,
    residual_cut_init: float = 0.6, residual_cut: float = 0.1, deviations: int = 0, sigmas: dict[str, float] | None = None, convergence: float = 1e-5, constrained: bool = True,
) -> Aligned:
    """Corrections of all detectors at once from points (BY, detector, u, v) of the tracks that hit every plane.

    Each pass linearises at the present geometry. Inside it the equations are solved again and again with the same
    derivatives: tracks with a residual beyond the cut (a wide one first), or a chi2 beyond the limit times a factor that falls
    from 100 to 1 by square roots, are left out. A pass's corrections go into the geometry; passes end when they are small.
    """
    done = Aligned(list(detectors))
    planes = [d.name for d in detectors]
    tracks = store.stored(packed(on_all_planes(track_rows(points, detectors), len(planes))), "alignment")
    widths = np.tile([(sigmas or {}).get(k, 0.05 if k in "xyz" else 0.005) for k in dofs], len(planes))
    free = np.repeat([p not in fixed for p in planes], len(dofs))
    for number in range(iterations):
        limits = _constraints(done.detectors, dofs) if constrained else np.zeros((0, len(free)))
        total, factor = np.zeros(len(free)), 100.0
        for k in range(inner):
            most = chi2_limit(deviations, 2 * len(planes) - 4) * factor if deviations else math.inf
            n = normal_equations(tracks, done.detectors, list(range(len(planes))), dofs, total.reshape(len(planes), len(dofs)), residual_cut_init if k == 0 else residual_cut, most)
            if not n.points:
                raise ValueError("no track is left")
            step = _solved(n, limits, total, widths, free)
            total = total + step
            factor = math.sqrt(factor) if math.sqrt(factor) > 1.2 else 1.0
            if k and np.abs(step).max() < 1e-10 and factor == 1.0:
                break
        for i, p in enumerate(planes):
            values = total[i * len(dofs) : (i + 1) * len(dofs)]
            done.detectors[i] = with_change(done.detectors[i], dofs, values)
            done.steps += [(number, p, name, float(v)) for name, v in zip(dofs, values, strict=True)]
        if np.abs(total).sum() / (6 * len(planes)) < convergence:
            break
    return done


def track_chi2(
    points: DataFrame, detectors: list[Detector], dofs: tuple[str, ...] = ("x", "y", "rx", "ry", "rz"), fixed: tuple[str, ...] = (), iterations: int = 5, evaluations: int = 20,
    tolerance: float = 1e-9, convergence: float = 1e-9,
) -> Aligned:
    """Corrections of one detector after the other that minimise the summed chi2 of the tracks with a point on it, tracks refitted.

    One aggregation of a detector's tracks gives chi2 as a quadratic in its corrections, with the refit eliminated;
    Levenberg-Marquardt steps are solved on these numbers, and the next aggregation, at the new place, checks the step and is the next
    quadratic. A detector ends once a step gains nothing to speak of, as the quadratic tells without a further look, and
    passes end once none moves.
    """
    done = Aligned(list(detectors))
    tracks = store.stored(packed(track_rows(points, detectors)), "alignment")
    for number in range(iterations):
        moved = 0.0
        for i, d in enumerate(detectors):
            if d.name in fixed:
                continue

            def at(values: np.ndarray, i=i) -> Normal:
                trial = list(done.detectors)
                trial[i] = with_change(trial[i], dofs, values)
                return normal_equations(tracks, trial, [i], dofs)

            x, damping, now = np.zeros(len(dofs)), 1e-9, at(np.zeros(len(dofs)))
            for _ in range(evaluations):
                if now.points < len(dofs):
                    break
                scale = np.maximum(np.diag(now.matrix), 1e-300)
                step = np.linalg.lstsq(now.matrix + damping * np.diag(scale), now.vector, rcond=1e-12)[0]
                gain = 2 * step @ now.vector - step @ now.matrix @ step
                if gain <= tolerance * max(now.chi2, tolerance) or np.abs(step).max() < 1e-10:
                    x = x + step
                    break
                new = at(x + step)
                if new.chi2 < now.chi2:
                    x, now, damping = x + step, new, damping / 10
                else:
                    damping = max(damping * 100, 1e-6)
            done.detectors[i] = with_change(done.detectors[i], dofs, x)
            done.steps += [(number, d.name, name, float(v)) for name, v in zip(dofs, x, strict=True)]
            moved = max(moved, float(np.abs(x).max()))
        if moved < convergence:
            break
    return done


# ---- detectors under test


def rotation_angle(nominal: np.ndarray, measured: np.ndarray) -> float:
    """The angle that turns one set of points onto the other, both about their means."""
    p, q = (nominal - nominal.mean(axis=0)).T, (measured - measured.mean(axis=0)).T
    return math.atan2(float((p[0] * q[1] - p[1] * q[0]).sum()), float((p * q).sum()))


@dataclass
class Density:
    """Matched track positions in the detector's plane, counted in bins over 1.4 times its size."""

    counts: np.ndarray
    low: tuple[float, float]
    width: tuple[float, float]

    def centroids(self, d: Detector) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all pixels (columns x rows): entries and the centroid over the bins that touch the pixel, from running sums of the map."""
        place = [self.low[k] + (np.arange(self.counts.shape[k]) + 0.5) * self.width[k] for k in range(2)]
        maps = (self.counts, self.counts * place[0][:, None], self.counts * place[1][None, :])
        pitches, centres = (d.pitch_x, d.pitch_y), pixel_centres(d)
        edges = []
        for k in range(2):
            bins = [np.clip(np.trunc((centres[k] + s * pitches[k] / 2 - self.low[k]) / self.width[k]).astype(int), 0, self.counts.shape[k] - 1) for s in (-1, 1)]
            edges.append((bins[0], bins[1] + 1))
        (x0, x1), (y0, y1) = edges
        out = []
        for m in maps:
            s = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
            s[1:, 1:] = m.cumsum(axis=0).cumsum(axis=1)
            out.append(s[np.ix_(x1, y1)] - s[np.ix_(x0, y1)] - s[np.ix_(x1, y0)] + s[np.ix_(x0, y0)])
        n, sx, sy = out
        with np.errstate(divide="ignore", invalid="ignore"):
            return n, sx / n, sy / n


def pixel_centres(d: Detector) -> tuple[np.ndarray, np.ndarray]:
    """Local x of the columns and local y of the rows."""
    px, py = d.effective_pitch()
    return (np.arange(d.n_cols) - (d.n_cols - 1) / 2) * px, (np.arange(d.n_rows) - (d.n_rows - 1) / 2) * py


def local_position(matched: DataFrame, d: Detector) -> DataFrame:
    """matched (gx, gy, gz: global) with u, v in the detector's plane."""
    r = np.array(d.rotation())
    moved = [F.col("g" + a) - float(p) for a, p in zip("xyz", d.position, strict=True)]
    return matched.withColumns({n: sum((moved[i] * float(r[i, k]) for i in range(3)), F.lit(0.0)) for k, n in enumerate("uv")})


def density(matched: DataFrame, d: Detector, bin_size: tuple[float, float] = (0.01, 0.01)) -> Density:
    """One aggregation; as many numbers as bins reach the driver."""
    size = d.size()
    bins = [max(1, math.floor(1.4 * s / b + 0.5)) for s, b in zip(size, bin_size, strict=True)]
    low = (-0.7 * size[0], -0.7 * size[1])
    width = tuple(1.4 * s / b for s, b in zip(size, bins, strict=True))
    at = local_position(matched, d)
    cells = at.groupBy(coords.bin_2d(F.col("u"), F.lit(low[0]), width[0]).alias("ix"), coords.bin_2d(F.col("v"), F.lit(low[1]), width[1]).alias("iy")).agg(F.count("*").alias("n"))
    counts = np.zeros(bins)
    for r in cells.filter(F.col("ix").between(0, bins[0] - 1) & F.col("iy").between(0, bins[1] - 1)).collect():
        counts[r["ix"], r["iy"]] = r["n"]
    return Density(counts, low, width)


def trusted_pixels(found: Density, d: Detector, least: float = 50.0, deviation: float = 0.5, row: int = 0) -> np.ndarray:
    """Pixels (columns x rows) with enough entries and a centroid near their centre; `row` > 0 keeps the last row only, < 0 the first.
    A pixel that fails takes its whole die with it."""
    n, cx, cy = found.centroids(d)
    px, py = pixel_centres(d)
    off = np.hypot(cx - px[:, None], cy - py[None, :])
    good = (n >= least) & (off <= deviation * min(d.pitch_x, d.pitch_y))
    if row:
        good &= np.arange(d.n_rows)[None, :] == (d.n_rows - 1 if row > 0 else 0)
    for pixels in d.die_pixels().values():
        cols, rows = np.array([(int(c), int(r)) for c, r in pixels]).T
        if not good[cols, rows].all():
            good[cols, rows] = False
    return good


def align_dut(
    matched: DataFrame, d: Detector, translate: bool = True, rotate: bool = True, rotations: int = 12, row: int = 0, least: float = 50.0, deviation: float = 0.5, bin_size: tuple[float, float] = (0.01, 0.01)
) -> tuple[Detector, list[float], np.ndarray]:
    """The detector moved and turned to its matched tracks (gx, gy, gz), the steps of the rotation, and the trusted pixels.

    The new place is the mean of the matched positions on trusted pixels, from 100 of them on; where one die alone is trusted, its own
    offset is taken off. The rotation is fitted to the centroids of the trusted pixels again and again; it ends with a step
    below a millionth, and a step that is no smaller than the one before is not taken.
    """
    good = trusted_pixels(density(matched, d, bin_size), d, least, deviation, row)
    if translate:
        px, py = d.effective_pitch()
        near = lambda c, n, p: F.least(F.greatest(F.round(c / p + (n - 1) / 2).cast("int"), F.lit(0)), F.lit(n - 1))
        pixels = matched.sparkSession.createDataFrame([(int(c), int(r)) for c, r in zip(*np.nonzero(good), strict=True)], "col int, row int")
        at = local_position(matched, d).withColumns({"col": near(F.col("u"), d.n_cols, px), "row": near(F.col("v"), d.n_rows, py)})
        mean = at.join(pixels, ["col", "row"], "left_semi").agg(F.avg("gx").alias("x"), F.avg("gy").alias("y"), F.count("*").alias("n")).first()
        if mean["n"] >= 100:
            origin = np.array([mean["x"], mean["y"], d.position[2]])
            ends = good.any(axis=0)[[0, -1]]
            if d.die_pixels() and d.n_rows >= 2 and ends[0] != ends[1]:
                origin = origin - np.array(d.rotation())[:, 1] * pixel_centres(d)[1][0 if ends[0] else -1]
            d = replace(d, position=(float(origin[0]), float(origin[1]), d.position[2]))
    steps: list[float] = []
    cols, rows = np.nonzero(good)
    px, py = pixel_centres(d)
    for _ in range(rotations if rotate else 0):
        n, cx, cy = density(matched, d, bin_size).centroids(d)
        some = n[cols, rows] >= least
        if some.sum() < 2:
            break
        c, r = cols[some], rows[some]
        step = rotation_angle(np.stack([px[c], py[r]], axis=1), np.stack([cx[c, r], cy[c, r]], axis=1))
        if abs(step) >= 1e-6 and steps and abs(step) >= abs(steps[-1]):
            break
        steps.append(step)
        d = with_change(d, ("rz",), np.array([step]))
        if abs(step) < 1e-6:
            break
    return d, steps, good


def corrections(spark: SparkSession, found: Aligned, before: list[Detector]) -> DataFrame:
    """detector and the whole change of each degree of freedom."""
    rows = [(a.name, *[float(n - o) for n, o in zip((*a.position, *a.orientation), (*b.position, *b.orientation), strict=True)]) for a, b in zip(found.detectors, before, strict=True)]
    return spark.createDataFrame(rows, "detector string, " + ", ".join(f"{k} double" for k in DOFS))


def graphs(spark: SparkSession, found: Aligned) -> DataFrame:
    """detector, graph, x (the pass), y (the correction in um or degrees)."""
    rows = [(d, ("displacement" if k in DOFS[:3] else "rotation") + k[-1].upper(), float(n), v * 1000 if k in DOFS[:3] else math.degrees(v)) for n, d, k, v in found.steps]
    return spark.createDataFrame(rows, "detector string, graph string, x double, y double")


def saved(found: list[Detector], source: str, target: str) -> None:
    geometry.write(target, source, found)
