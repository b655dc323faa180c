"""Track finding and fitting.

Seeds are pairs of the outermost populated planes of an event; the planes between are followed
one after the other with running sums, so each refit is a projection. Everything meets on
event_id: the clusters are partitioned by it once and the joins keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import coords, near, scan


def seeds(clusters: DataFrame, min_span: int = 5, time_cut: float = 690_000.0) -> DataFrame:
    """event_id, a and b (first and last cluster: id, plane, x, y, z, ts, w): a span counts all planes between the outermost ones."""
    ends = clusters.groupBy("event_id").agg(F.min("plane").alias("first"), F.max("plane").alias("last"))
    ends = ends.filter((F.col("first") < F.col("last")) & (F.col("last") - F.col("first") + 1 >= min_span))
    hit = F.struct("cluster_id", "plane", "x", "y", "z", "ts", "w")
    some = clusters.select("event_id", "plane", hit.alias("h"))
    a = ends.join(some.select("event_id", F.col("plane").alias("first"), F.col("h").alias("a")), ["event_id", "first"])
    pairs = a.join(some.select("event_id", F.col("plane").alias("last"), F.col("h").alias("b")), ["event_id", "last"])
    return pairs.filter(F.abs(F.col("a.ts") - F.col("b.ts")) <= time_cut)


def line(s: str = "") -> dict[str, Column]:
    """Weighted least squares of x and y on z from running sums (columns sw, sz, szz, sx, sxz, sy, syz, z relative to 0)."""
    c = lambda n: F.col(s + n)
    det = c("sw") * c("szz") - c("sz") * c("sz")
    ok = F.abs(det) >= 1e-12
    slope = lambda v, vz: F.when(ok, (c("sw") * c(vz) - c("sz") * c(v)) / det)
    start = lambda v, vz: F.when(ok, (c("szz") * c(v) - c("sz") * c(vz)) / det)
    return {"mx": slope("sx", "sxz"), "cx": start("sx", "sxz"), "my": slope("sy", "syz"), "cy": start("sy", "syz")}


def line_at(z: float) -> tuple[Column, Column]:
    """Where the line of the running sums is at z, as one quotient: sums of whole numbers stay exact up to the division, so that a place
    on the border of a cut is on it."""
    det = F.col("sw") * F.col("szz") - F.col("sz") * F.col("sz")

    def at(v: str) -> Column:
        s, sz = F.col(f"s{v}"), F.col(f"s{v}z")
        return F.when(F.abs(det) >= 1e-12, ((F.col("szz") * s - F.col("sz") * sz) + (F.col("sw") * sz - F.col("sz") * s) * float(z)) / det)

    return at("x"), at("y")


def fit(points: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """by, mx, cx, my, cy, chi2, ndof, n from points (x, y, z, w) of untilted planes, without Python.

    One shuffle: a track's points are a few, and meet in one array, in which z is taken relative to their mean, so
    that sums do not cancel; two points are met exactly.
    """
    h = points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("z", "x", "y", "w"))).alias("h")).withColumn("n", F.size("h").cast("long")).filter("n >= 2")
    total = lambda e: F.aggregate("h", F.lit(0.0), lambda s, p: s + e(p))
    s = h.withColumns({"sw": total(lambda p: p["w"]), "sx": total(lambda p: p["w"] * p["x"]), "sy": total(lambda p: p["w"] * p["y"]), "zm": total(lambda p: p["w"] * p["z"])})
    s = s.withColumn("zm", F.try_divide(F.col("zm"), F.col("sw")))
    d = lambda p: p["z"] - F.col("zm")
    s = s.withColumns({"sdd": total(lambda p: p["w"] * d(p) * d(p)), "sxd": total(lambda p: p["w"] * p["x"] * d(p)), "syd": total(lambda p: p["w"] * p["y"] * d(p))})
    s = s.filter(F.abs(F.col("sw") * F.col("sdd")) >= 1e-12)
    s = s.withColumns({f"m{a}": F.try_divide(F.col(f"s{a}d"), F.col("sdd")) for a in "xy"})
    s = s.withColumns({f"c{a}": F.try_divide(F.col(f"s{a}"), F.col("sw")) - F.col(f"m{a}") * F.col("zm") for a in "xy"})
    miss = lambda p, a: p[a] - F.col(f"c{a}") - F.col(f"m{a}") * p["z"]
    chi2 = total(lambda p: p["w"] * (miss(p, "x") * miss(p, "x") + miss(p, "y") * miss(p, "y")))
    return s.select(*by, "mx", "cx", "my", "cy", F.when(F.col("n") == 2, 0.0).otherwise(chi2).alias("chi2"), (2 * F.col("n") - 4).cast("int").alias("ndof"), "n")


def chi2_ndof(chi2: Column, ndof: Column) -> Column:
    return F.when(ndof > 0, chi2 / ndof).otherwise(-1.0)


#: Fixed value: the variance of a hit along the normal of its plane.
NORMAL_VARIANCE = 1e-9


def fit_tilted(points: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """by, mx, cx, my, cy, chi2, ndof: the coupled fit for tilted planes, without Python.

    points: by, u, v (local hit), wu, wv, and the plane (px, py, pz, r00..r22), one row a hit. A hit's errors, turned into the
    global frame, couple x and y by a weight of 2 x 2; the four parameters come from the normal equations by blocks (x is
    eliminated). chi2 is that of the residuals in the planes' own frames where the track meets them. One shuffle: a
    track's hits are a few, and meet in one array. Tracks with fewer than two places along z have nulls.
    """
    r = lambda i, j: F.col(f"r{i}{j}")
    place = {a: F.col(f"p{a}") + r(i, 0) * F.col("u") + r(i, 1) * F.col("v") for i, a in enumerate("xyz")}
    spread = lambda i, j: r(i, 0) * r(j, 0) / F.col("wu") + r(i, 1) * r(j, 1) / F.col("wv") + r(i, 2) * r(j, 2) * NORMAL_VARIANCE
    hits = points.withColumns(place | {"s00": spread(0, 0), "s01": spread(0, 1), "s11": spread(1, 1)}).withColumn("det", F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01"))
    hits = hits.withColumns({"a": F.try_divide("s11", "det"), "b": -F.try_divide("s01", "det"), "c": F.try_divide("s00", "det")})
    kept = ["z", "x", "y", "a", "b", "c", "u", "v", "wu", "wv", "px", "py", "pz", *[f"r{i}{j}" for i in range(3) for j in range(3)]]
    t = hits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("h")).withColumn("n", F.size("h"))
    total = lambda e: F.aggregate("h", F.lit(0.0), lambda s, p: s + e(p))
    t = t.withColumn("zm", total(lambda p: p["z"]) / F.col("n"))
    d = lambda p: p["z"] - F.col("zm")
    # weights by powers of z, and the right sides of x and of y
    t = t.withColumns({f"{w}{k}": total(lambda p, w=w, k=k: p[w] * (d(p) * d(p) if k == 2 else d(p) if k else F.lit(1.0))) for w in "abc" for k in range(3)})
    sides = {"p": lambda p: p["a"] * p["x"] + p["b"] * p["y"], "q": lambda p: p["b"] * p["x"] + p["c"] * p["y"]}
    t = t.withColumns({f"{n}{k}": total(lambda p, e=e, k=k: e(p) * (d(p) if k else F.lit(1.0))) for n, e in sides.items() for k in range(2)})
    c = {n: F.col(n) for n in ("a0", "a1", "a2", "b0", "b1", "b2", "c0", "c1", "c2", "p0", "p1", "q0", "q1", "da", "t00", "t01", "t10", "t11", "g0", "g1", "s00", "s01", "s11", "e0", "e1", "ds")}
    over = lambda x, y: F.try_divide(x, c[y])
    t = t.withColumn("da", c["a0"] * c["a2"] - c["a1"] * c["a1"])
    t = t.withColumns(
        {
            **{f"t0{k}": over(c["a2"] * c[f"b{k}"] - c["a1"] * c[f"b{k + 1}"], "da") for k in range(2)},
            **{f"t1{k}": over(c["a0"] * c[f"b{k + 1}"] - c["a1"] * c[f"b{k}"], "da") for k in range(2)},
            "g0": over(c["a2"] * c["p0"] - c["a1"] * c["p1"], "da"), "g1": over(c["a0"] * c["p1"] - c["a1"] * c["p0"], "da"),
        }
    )
    t = t.withColumns(
        {
            "s00": c["c0"] - c["b0"] * c["t00"] - c["b1"] * c["t10"], "s01": c["c1"] - c["b0"] * c["t01"] - c["b1"] * c["t11"], "s11": c["c2"] - c["b1"] * c["t01"] - c["b2"] * c["t11"],
            "e0": c["q0"] - c["b0"] * c["g0"] - c["b1"] * c["g1"], "e1": c["q1"] - c["b1"] * c["g0"] - c["b2"] * c["g1"],
        }
    )
    t = t.withColumn("ds", c["s00"] * c["s11"] - c["s01"] * c["s01"])
    t = t.withColumns({"y0": over(c["s11"] * c["e0"] - c["s01"] * c["e1"], "ds"), "my": over(c["s00"] * c["e1"] - c["s01"] * c["e0"], "ds")})
    t = t.withColumns({"x0": c["g0"] - c["t00"] * F.col("y0") - c["t01"] * F.col("my"), "mx": c["g1"] - c["t10"] * F.col("y0") - c["t11"] * F.col("my")})
    t = t.withColumns({f"c{a}": F.col(f"{a}0") - F.col(f"m{a}") * F.col("zm") for a in "xy"})

    def missed(p: Column) -> Column:
        n = [p[f"r{i}2"] for i in range(3)]
        z = F.try_divide(n[0] * (p["px"] - F.col("cx")) + n[1] * (p["py"] - F.col("cy")) + n[2] * p["pz"], n[0] * F.col("mx") + n[1] * F.col("my") + n[2])
        g = [F.col("cx") + F.col("mx") * z - p["px"], F.col("cy") + F.col("my") * z - p["py"], z - p["pz"]]
        off = [sum((g[i] * p[f"r{i}{k}"] for i in range(3)), F.lit(0.0)) - p[a] for k, a in enumerate("uv")]
        return p["wu"] * off[0] * off[0] + p["wv"] * off[1] * off[1]

    good = F.abs(F.col("ds")) > 0
    t = t.withColumn("chi2", F.when(F.col("n") == 2, 0.0).otherwise(total(missed)))
    real = good & F.col("chi2").isNotNull() & ~F.isnan("chi2") & (F.abs("chi2") < float("inf"))
    found = [F.when(real, F.col(n)).alias(n) for n in ("mx", "cx", "my", "cy", "chi2")] + [F.when(real, (2 * F.col("n") - 4).cast("int")).alias("ndof")]
    # an explode of one row: a filter on the fit would else be pushed below it, and there repeat all its steps
    return t.select(*by, F.inline_outer(F.array(F.struct(*found))))


SUMS = ("sw", "sz", "szz", "sx", "sxz", "sy", "syz", "st", "sn")


def _terms(h: str) -> dict[str, Column]:
    c = lambda n: F.col(f"{h}.{n}")
    w, z = c("w"), c("z")
    return {"sw": w, "sz": w * z, "szz": w * z * z, "sx": w * c("x"), "sxz": w * c("x") * z, "sy": w * c("y"), "syz": w * c("y") * z, "st": c("ts"), "sn": F.lit(1)}


def follow(clusters: DataFrame, planes: list[tuple[int, float]], cut_x: float, cut_y: float, time_cut: float = 690_000.0, min_hits: int = 5) -> DataFrame:
    """Tracks from seeds through all planes between: event_id, a, b, members (cluster ids), n, mx, cx, my, cy.

    In each plane the nearest cluster inside the ellipse and the time window is taken (ties: x,
    y, id) and the line refitted before the next. One join a plane on (event, plane), of the
    candidates with at most the plane's clusters of their event.
    """
    now = seeds(clusters, min_hits, time_cut).withColumn("members", F.array("a.cluster_id", "b.cluster_id"))
    ta, tb = _terms("a"), _terms("b")
    now = now.withColumns({n: ta[n] + tb[n] for n in SUMS})
    hit = F.struct("cluster_id", "x", "y", "z", "ts", "w")
    for plane, z in planes:
        px, py = line_at(z)
        inner = (F.col("first") < plane) & (F.col("last") > plane)
        asked = now.withColumns({"px": F.when(inner, px), "py": F.when(inner, py), "mean_ts": F.col("st") / F.col("sn")})
        here = clusters.filter(F.col("plane") == plane).groupBy("event_id").agg(F.collect_list(hit).alias("near"))
        joined = asked.join(here, "event_id", "left")

        def fits(h: Column) -> Column:
            dx, dy = h["x"] - F.col("px"), h["y"] - F.col("py")
            return (F.abs(h["ts"] - F.col("mean_ts")) <= time_cut) & ((dx * dx + dy * dy * (cut_x / cut_y) ** 2) / (cut_x * cut_x) <= 1)

        def ranked(h: Column) -> Column:
            dx, dy = h["x"] - F.col("px"), h["y"] - F.col("py")
            return F.struct(F.round(dx * dx + dy * dy, 9).alias("d"), h["x"].alias("hx"), h["y"].alias("hy"), h.alias("h"))

        best = F.array_min(F.transform(F.filter("near", fits), ranked))["h"]
        joined = joined.withColumn("hit", F.when(F.col("px").isNotNull(), best))
        terms = _terms("hit")
        got = F.col("hit").isNotNull()
        now = joined.withColumns({n: F.when(got, F.col(n) + terms[n]).otherwise(F.col(n)) for n in SUMS}).withColumn(
            "members", F.when(got, F.concat("members", F.array("hit.cluster_id"))).otherwise(F.col("members"))
        ).drop("near", "hit", "px", "py", "mean_ts")
    fitted = line()
    out = now.select("event_id", "a", "b", "members", F.size("members").alias("n"), *[v.alias(k) for k, v in fitted.items()])
    return out.filter((F.col("n") >= min_hits) & F.col("mx").isNotNull())


def track_number(members: Column) -> Column:
    """A 64-bit number of a set of clusters; with the event it names a track."""
    return F.xxhash64(F.sort_array(members))


def dedup(tracks: DataFrame) -> DataFrame:
    """Of tracks that share clusters in an event, those first by (more clusters, smaller chi2/ndof, id) stay.

    A left fold over each event's tracks in that order; an event's tracks are a few.
    """
    t = F.struct((-F.size("members")).alias("k"), F.col("chi2ndof").alias("c"), F.col("track_id").alias("id"), F.col("members").alias("m"))
    grouped = tracks.groupBy("event_id").agg(F.sort_array(F.collect_list(t)).alias("ts"))
    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    m = lambda x: x["m"].cast("array<bigint>")
    step = lambda acc, x: F.when(F.arrays_overlap(acc["used"], m(x)), acc).otherwise(
        F.struct(F.concat(acc["used"], m(x)).alias("used"), F.concat(acc["kept"], F.array(x["id"].cast("bigint"))).alias("kept"))
    )
    kept = grouped.select("event_id", F.explode(F.aggregate("ts", zero, step)["kept"]).alias("track_id"))
    return tracks.join(kept, ["event_id", "track_id"], "left_semi")


def close_pairs(positions: DataFrame, cut: float, by: tuple[str, ...] = ("event_id",), x: str = "x", y: str = "y") -> DataFrame:
    """by, t1 < t2, distance of the tracks (by, track_id, x, y) nearer than `cut` to each other. Tracks of one wide cell, and those near a
    border with those behind it, meet: the work grows with the tracks that are near, not with an event's tracks squared, and a track
    is sent about 2.6 times."""
    if cut <= 0:
        return positions.filter(F.lit(False)).select(*by, F.col("track_id").alias("t1"), F.col("track_id").alias("t2"), F.lit(0.0).alias("distance"))
    here = near.wide_celled(positions, x, y, cut).select(*by, "__ix", "__iy", F.col("track_id").alias("__a"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    there = near.wide_ahead(positions, x, y, cut).select(*by, "__ix", "__iy", "__own", F.col("track_id").alias("__b"), F.col(x).alias("__u"), F.col(y).alias("__v"))
    d = F.sqrt(F.pow(F.col("__x") - F.col("__u"), 2) + F.pow(F.col("__y") - F.col("__v"), 2))
    met = here.join(there, [*by, "__ix", "__iy"]).filter((F.col("__a") < F.col("__b")) | ~F.col("__own") & (F.col("__a") != F.col("__b")))
    return met.select(*by, F.least("__a", "__b").alias("t1"), F.greatest("__a", "__b").alias("t2"), d.alias("distance")).filter(F.col("distance") < cut)


def close_tracks(positions: DataFrame, cut: float) -> DataFrame:
    """event_id, track_id of tracks nearer than `cut` to another of the same event on a plane (event_id, track_id, x, y)."""
    return close_pairs(positions, cut).select("event_id", F.explode(F.array("t1", "t2")).alias("track_id")).distinct()


def residuals(points: DataFrame, tracks: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """points with rx, ry and pulls against their track."""
    j = points.join(tracks.select(*by, "mx", "cx", "my", "cy"), list(by))
    rx, ry = F.col("x") - F.col("cx") - F.col("mx") * F.col("z"), F.col("y") - F.col("cy") - F.col("my") * F.col("z")
    return j.withColumns({"rx": rx, "ry": ry, "pull_x": rx * F.sqrt("w"), "pull_y": ry * F.sqrt("w")})


def residuals_on(points: DataFrame, tracks: DataFrame, detectors: DataFrame, by: tuple[str, ...] = ("event_id", "track_id")) -> DataFrame:
    """points (by, detector, x, y, z: global) with residuals against where their track meets the detector's plane: res_<axis>_global,
    res_x_local and res_y_local without the detector's rotation, and both pairs of pulls by its resolution."""
    d = F.broadcast(detectors.select("detector", "px", "py", "pz", "tilt", "res_x", "res_y", *[f"r{i}{j}" for i in range(3) for j in range(3)]))  # one row a detector
    j = points.join(d, "detector").join(tracks.select(*by, "mx", "cx", "my", "cy"), list(by))
    ix, iy, iz = coords.intercept(F.col("mx"), F.col("cx"), F.col("my"), F.col("cy"))
    j = j.withColumns({"ix": ix, "iy": iy, "iz": iz})
    hit, met = coords.to_local(F.col("x"), F.col("y"), F.col("z")), coords.to_local(F.col("ix"), F.col("iy"), F.col("iz"))
    out = {f"res_{a}_global": F.col(a) - F.col(f"i{a}") for a in "xyz"} | {f"res_{a}_local": hit[k] - met[k] for k, a in enumerate("xy")}
    j = j.withColumns(out)
    pulls = {f"pull_{a}_{f}": F.col(f"res_{a}_{f}") / F.col(f"res_{a}") for a in "xy" for f in ("local", "global")}
    return j.withColumns(pulls).drop("px", "py", "pz", "tilt", "res_x", "res_y", *[f"r{i}{j}" for i in range(3) for j in range(3)])


def angles(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({"angle_x": coords.slope_angle(F.col("mx")), "angle_y": coords.slope_angle(F.col("my"))})


def per_event(tracks: DataFrame, clusters: DataFrame) -> DataFrame:
    """event_id, tracks: events with a cluster but no track have 0."""
    events = clusters.select("event_id").distinct()
    n = tracks.groupBy("event_id").agg(F.count("*").alias("tracks"))
    return events.join(n, "event_id", "left").select("event_id", F.coalesce("tracks", F.lit(0)).cast("long").alias("tracks"))


def event_times(tracks: DataFrame) -> DataFrame:
    """event_id, ts: the earliest time of the event's tracks."""
    return tracks.groupBy("event_id").agg(F.min("ts").alias("ts"))


def first_tracks(tracks: DataFrame, target: int) -> DataFrame:
    """The tracks of the first events, up to the whole event that reaches a target."""
    per = tracks.groupBy("event_id").agg(F.count("*").alias("k"))
    events = scan.running(per, (), ("event_id",), {"before": ("sum", F.col("k"))}, inclusive=False).filter(F.coalesce("before", F.lit(0)) < target)
    return tracks.join(events.select("event_id"), "event_id", "left_semi")
