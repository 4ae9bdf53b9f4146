"""Image kernels in NumPy: components, morphology, filters, watershed, thinning, ellipses."""

from __future__ import annotations

import heapq
import math

import numpy as np

FOUR, EIGHT = [(-1, 0), (0, -1), (0, 1), (1, 0)], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def label(mask: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Connected components numbered from 1 in order of their first pixel: the least index spreads until nothing moves."""
    h, w = mask.shape
    big = h * w
    lab, out = np.where(mask, np.arange(big).reshape(h, w), big), ~mask
    p, flat = np.full((h + 2, w + 2), big), np.full(big + 1, big)
    while True:
        p[1:-1, 1:-1] = lab
        new = lab.copy()
        for dy, dx in EIGHT if eight else FOUR:
            np.minimum(new, p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], out=new)
        new[out] = big
        flat[:-1] = new.ravel()
        for _ in range(3):
            new = flat[new]
        if (new == lab).all():
            break
        lab = new
    roots, inv = np.unique(lab, return_inverse=True)
    n = len(roots) - int(roots[-1] == big if len(roots) else 0)
    out = inv.reshape(h, w) + 1
    return np.where(mask, out, 0).astype(np.int32), n


def largest(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    lab, n = label(mask, eight)
    return lab == 1 + int(np.argmax(np.bincount(lab.ravel(), minlength=n + 1)[1:])) if n else mask


def dilate(mask: np.ndarray, rounds: int = 1, eight: bool = False) -> np.ndarray:
    for _ in range(rounds):
        p = np.pad(mask, 1)
        out = mask.copy()
        for dy, dx in EIGHT if eight else FOUR:
            out |= p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]]
        mask = out
    return mask


def fill_holes(mask: np.ndarray) -> np.ndarray:
    lab, n = label(~mask)
    edge = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    return mask | ((lab > 0) & ~np.isin(lab, edge[edge > 0]))


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """A blur with reflected ends, cut at four deviations."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        p = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        out = sum(w * np.take(p, range(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def edge_distance(mask: np.ndarray) -> np.ndarray:
    """The exact Euclidean distance of each pixel of a mask to the nearest one outside it."""
    h, w = mask.shape
    big = h + w
    g = np.where(mask, big, 0).astype(float)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    x = np.arange(w)
    d = (x[:, None] - x[None, :]) ** 2
    return np.sqrt(np.stack([(d + row[None, :] ** 2).min(axis=1) for row in g]))


def peaks(image: np.ndarray, mask: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pixels of a mask that no pixel within the distance exceeds, brightest first, none within the distance of one before."""
    out: list[tuple[int, int]] = []
    order = np.argsort(-np.where(mask, image, -np.inf), axis=None, kind="stable")[: int(mask.sum())]
    taken = np.zeros(image.shape, bool)
    for i in order.tolist():
        y, x = divmod(i, image.shape[1])
        if not taken[y, x]:
            out.append((y, x))
            taken[max(0, y - distance) : y + distance + 1, max(0, x - distance) : x + distance + 1] = True
    return out


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels flooded from markers over a mask in order of height, earlier claims first (4 neighbours)."""
    lab = np.where(mask, markers, 0).astype(np.int32)
    heap, n = [], 0
    for y, x in zip(*np.nonzero(lab)):
        heap.append((float(height[y, x]), n, int(y), int(x)))
        n += 1
    heapq.heapify(heap)
    h, w = mask.shape
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for dy, dx in FOUR:
            a, b = y + dy, x + dx
            if 0 <= a < h and 0 <= b < w and mask[a, b] and not lab[a, b]:
                lab[a, b] = lab[y, x]
                n += 1
                heapq.heappush(heap, (float(height[a, b]), n, a, b))
    return lab


def thin(mask: np.ndarray) -> np.ndarray:
    """A skeleton by the two-step parallel thinning of Zhang and Suen."""
    m = np.pad(mask, 1).astype(np.uint8)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        changed = False
        for step in (0, 1):
            p = [np.roll(m, (-dy, -dx), (0, 1)) for dy, dx in ring]
            count = sum(p)
            turns = sum((p[i] == 0) & (p[(i + 1) % 8] == 1) for i in range(8))
            a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if step == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            gone = (m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0)
            changed |= bool(gone.any())
            m[gone] = 0
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def ridges(image: np.ndarray, sigmas=(1.0, 2.0)) -> np.ndarray:
    """The largest bright-ridge strength over scales: the most negative eigenvalue of the Hessian, scaled."""
    best = np.zeros(image.shape)
    for s in sigmas:
        g = gaussian(image, s)
        gy, gx = np.gradient(g)
        yy, yx = np.gradient(gy)
        _, xx = np.gradient(gx)
        low = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
        best = np.maximum(best, np.maximum(-low, 0) * s * s)
    return best


def otsu(values: np.ndarray, bins: int = 256) -> float:
    lo, hi = float(values.min()), float(values.max())
    if hi <= lo:
        return lo
    n, edges = np.histogram(values, bins=bins, range=(lo, hi))
    mid = (edges[:-1] + edges[1:]) / 2
    w, s = np.cumsum(n), np.cumsum(n * mid)
    w2, s2 = w[-1] - w, s[-1] - s
    ok = (w > 0) & (w2 > 0)
    score = np.where(ok, w * w2 * (s / np.maximum(w, 1) - s2 / np.maximum(w2, 1)) ** 2.0, -1)
    return float(edges[int(np.argmax(score)) + 1])


def ellipse(points: np.ndarray) -> dict | None:
    """The direct least-squares ellipse through (y, x) points: centre, half axes, angle; None if there is none."""
    if len(points) < 5:
        return None
    c = points.mean(axis=0)
    y, x = (points - c).T
    s = max(1e-9, np.abs(points - c).max())
    y, x = y / s, x / s
    d1, d2 = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
    s1, s2, s3 = d1.T @ d1, d1.T @ d2, d2.T @ d2
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (s1 + s2 @ t)
        _, vec = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return None
    vec = vec.real
    good = np.flatnonzero(4 * vec[0] * vec[2] - vec[1] ** 2 > 0)
    if not len(good):
        return None
    a, b, cc = vec[:, good[0]]
    d, e, f = t @ vec[:, good[0]]
    den = b * b - 4 * a * cc
    x0, y0 = (2 * cc * d - b * e) / den, (2 * a * e - b * d) / den
    k = a * x0 * x0 + b * x0 * y0 + cc * y0 * y0 - f
    val, vecs = np.linalg.eigh(np.array([[a, b / 2], [b / 2, cc]]))
    axes2 = k / val
    if (axes2 <= 0).any() or not np.isfinite(axes2).all():
        return None
    axes = np.sqrt(axes2) * s
    i = int(np.argmax(axes))
    return {"cy": float(y0 * s + c[0]), "cx": float(x0 * s + c[1]), "major": float(axes[i]), "minor": float(axes[1 - i]), "angle": float(math.atan2(vecs[1, i], vecs[0, i]) % math.pi)}


def ellipses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`ellipse` of many sets (set, point, (y, x)) at once: which sets have one, and of those the rows (cy, cx, major, minor, angle)."""
    there = (np.ptp(points, axis=1) > 0).all(axis=1)  # points of one line or column have none
    at = np.flatnonzero(there)
    if len(at) == 0:
        return there, np.zeros((0, 5))
    p = points[at]
    c = p.mean(axis=1)
    s = np.maximum(1e-9, np.abs(p - c[:, None]).max(axis=(1, 2)))
    y, x = np.moveaxis((p - c[:, None]) / s[:, None, None], 2, 0)
    d1, d2 = np.stack([x * x, x * y, y * y], 2), np.stack([x, y, np.ones_like(x)], 2)
    turned = d1.transpose(0, 2, 1), d2.transpose(0, 2, 1)
    s1, s2, s3 = turned[0] @ d1, turned[0] @ d2, turned[1] @ d2
    try:
        t = -np.linalg.solve(s3, s2.transpose(0, 2, 1))
        m = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (s1 + s2 @ t)
        _, vec = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        # one of the sets has no solution: the others are found without it
        if len(points) == 1:
            return np.zeros(1, bool), np.zeros((0, 5))
        halves = [ellipses(part) for part in np.array_split(points, 2)]
        return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
    vec = vec.real
    with np.errstate(all="ignore"):
        good = 4 * vec[:, 0] * vec[:, 2] - vec[:, 1] ** 2 > 0
        v = vec[np.arange(len(vec)), :, good.argmax(axis=1)]
        a, b, cc = v.T
        d, e, f = (t @ v[:, :, None])[:, :, 0].T
        den = b * b - 4 * a * cc
        x0, y0 = (2 * cc * d - b * e) / den, (2 * a * e - b * d) / den
        k = a * x0 * x0 + b * x0 * y0 + cc * y0 * y0 - f
        val, vecs = np.linalg.eigh(np.stack([np.stack([a, b / 2], 1), np.stack([b / 2, cc], 1)], 1))
        axes2 = k[:, None] / val
        ok = good.any(axis=1) & (axes2 > 0).all(axis=1) & np.isfinite(axes2).all(axis=1)
        axes = np.sqrt(axes2) * s[:, None]
    i, n = axes.argmax(axis=1), np.arange(len(axes))
    angle = [math.atan2(q, r) % math.pi for q, r in zip(vecs[n, 1, i].tolist(), vecs[n, 0, i].tolist())]
    there[at[~ok]] = False
    return there, np.stack([y0 * s + c[:, 0], x0 * s + c[:, 1], axes[n, i], axes[n, 1 - i], np.array(angle)], 1)[ok]


def level(values: np.ndarray) -> float:
    """Otsu's threshold of 8-bit values: the grey level up to which the dark class goes."""
    n = np.bincount(values.astype(np.uint8).ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = w[-1] - w
    apart = np.divide((s[-1] * w - s * w[-1]) ** 2, w * rest, out=np.zeros(256), where=(w > 0) & (rest > 0))
    return float(np.argmax(apart)) if w[-1] else float("nan")


def radial(e: dict, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, radius) of places from an ellipse: the first-order distance, below 0 inside, and the radius in half axes."""
    dy, dx = y - e["cy"], x - e["cx"]
    u, v = dx * math.cos(e["angle"]) + dy * math.sin(e["angle"]), -dx * math.sin(e["angle"]) + dy * math.cos(e["angle"])
    rho = np.hypot(u / e["major"], v / e["minor"])
    slope = np.hypot(u / e["major"] ** 2, v / e["minor"] ** 2) / np.maximum(rho, 1e-15)
    return (rho - 1) / np.maximum(slope, 1e-15), rho


def ellipse_distance(e: dict, points: np.ndarray) -> np.ndarray:
    """How far (y, x) points lie from an ellipse, to first order."""
    return np.abs(radial(e, points[:, 0], points[:, 1])[0])


def boundary(mask: np.ndarray) -> np.ndarray:
    return np.argwhere(mask & dilate(~np.pad(mask, 1), 1)[1:-1, 1:-1])


#: Fixed values of a lid's chord: the least corridor in pixels and in residuals, tries at most, points, share of the boundary, span
#: over the bounding box's diagonal, largest gap over the span, offset from the middle over the extent, and the wider corridor.
CHORD = {"px": 3.5, "residuals": 1.75, "tries": 80, "points": 12, "share": 0.10, "span": 0.25, "gap": 0.30, "offset": 0.90, "wide": 1.5}


def chord(points: np.ndarray, residual: float, tries: int, rng: np.random.Generator) -> np.ndarray:
    """Which points belong to a straight stretch that cuts the shape off, as a lid does; none if the best line doesn't look like one."""
    near = max(CHORD["px"], CHORD["residuals"] * residual)
    none = np.zeros(len(points), bool)
    ends = points[np.array([rng.choice(len(points), 2, replace=False) for _ in range(min(tries, CHORD["tries"]))])].astype(float)
    a, step = ends[:, 0], ends[:, 1] - ends[:, 0]
    step = step / np.hypot(step[:, 0], step[:, 1])[:, None]
    hit = np.abs((points[:, 1] - a[:, 1:]) * step[:, :1] - (points[:, 0] - a[:, :1]) * step[:, 1:]) <= near
    line = points[hit[hit.sum(axis=1).argmax()]].astype(float)
    if len(line) < CHORD["points"] or len(line) < CHORD["share"] * len(points):
        return none
    middle, centre = line.mean(axis=0), points.mean(axis=0)
    along = np.linalg.svd(line - middle, full_matrices=False)[2][0]
    across = np.array([-along[1], along[0]])
    place = np.sort(line @ along)
    span = place[-1] - place[0]
    gap = np.diff(place).max() / max(span, 1e-12)
    offset = abs((middle - centre) @ across) / max(np.abs((points - centre) @ across).max(), 1e-12)
    if span < CHORD["span"] * np.hypot(*np.ptp(points, axis=0)) or gap > CHORD["gap"] or offset > CHORD["offset"]:
        return none
    return np.abs((points - middle) @ across) <= CHORD["wide"] * near


def fit_ellipse(mask: np.ndarray, residual: float = 2.0, trials: int = 200, seed: int = 0) -> dict | None:
    """An ellipse through a mask's boundary without a lid's chord: a direct fit, three times trimmed of far points, and if too little
    of the boundary lies on it, the best of random subsets. Centre in the image, half axes from 2 pixels to half the image's larger
    side, or there is none. residual: the median distance of the points on it; inlier_fraction: of the whole boundary."""
    every = boundary(mask)
    if len(every) < 12:
        return None
    rng = np.random.default_rng(seed)
    cut = chord(every, residual, trials, rng)
    use = every[~cut]
    if len(use) < 12:
        return None

    def sound(e):
        return e is not None and 0 <= e["cx"] < mask.shape[1] and 0 <= e["cy"] < mask.shape[0] and e["minor"] >= 2 and e["major"] <= 0.5 * max(mask.shape)

    def rated(e):
        d = ellipse_distance(e, use)
        on = d <= residual
        return int(on.sum()), -float(np.median(d[on])) if on.any() else -np.inf, on

    def best(picks):
        """Of the sound ellipses through subsets the first with most points on it, of those with the least median distance."""
        rows = ellipses(use[np.array(picks)])[1] if picks else np.zeros((0, 5))
        cy, cx, major, minor, _ = rows.T
        rows = rows[(cx >= 0) & (cx < mask.shape[1]) & (cy >= 0) & (cy < mask.shape[0]) & (minor >= 2) & (major <= 0.5 * max(mask.shape))]
        if not len(rows):
            return None
        cos, sin = (np.array([f(t) for t in rows[:, 4].tolist()])[:, None] for f in (math.cos, math.sin))
        cy, cx, major, minor = (rows[:, k : k + 1] for k in range(4))
        dy, dx = use[:, 0] - cy, use[:, 1] - cx
        u, v = dx * cos + dy * sin, -dx * sin + dy * cos
        rho = np.hypot(u / major, v / minor)
        d = np.abs((rho - 1) / np.maximum(np.hypot(u / major**2, v / minor**2) / np.maximum(rho, 1e-15), 1e-15))
        n = (d <= residual).sum(axis=1)
        first = np.flatnonzero(n == n.max())
        i = first[np.argmin([np.median(d[j][d[j] <= residual]) if n[j] else 0.0 for j in first])]
        return dict(zip(("cy", "cx", "major", "minor", "angle"), rows[i].tolist()))

    def trimmed(e):
        for _ in range(3):
            d = ellipse_distance(e, use)
            mid = np.median(d)
            keep = d <= max(residual, mid + 3 * 1.4826 * np.median(np.abs(d - mid)))
            new = ellipse(use[keep]) if keep.sum() >= 12 else None
            if new is None:
                break
            e = new
        return e

    e, voted = ellipse(use), False
    if e is not None:
        e = trimmed(e)
    if not sound(e) or rated(e)[0] < 0.45 * len(every):
        e, voted = best([rng.choice(len(use), 5, replace=False) for _ in range(trials)]), True
        for _ in range(2):
            new = ellipse(use[rated(e)[2]]) if e is not None else None
            if not sound(new):
                break
            e = new
    if e is None or not rated(e)[0]:
        return None
    n, mid, _ = rated(e)
    a, b = e["major"], e["minor"]
    return {**e, "area": math.pi * a * b, "axis_ratio": b / a, "residual": -mid, "inlier_fraction": n / len(every), "chord_fraction": float(cut.mean()), "diameter": 2 * math.sqrt(a * b), "used_ransac": float(voted)}


def trim_protrusions(mask: np.ndarray, e: dict | None, margin: float = 6.0, fraction: float = 0.06, least: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, float]:
    """(mask, removed share): the largest piece of the mask within a margin of its ellipse, holes filled, if what goes is a fair share
    and 20 pixels stay; else the mask as it is and 0."""
    total = int(mask.sum())
    if e is None or not total:
        return mask, 0.0
    far = radial(e, *np.indices(mask.shape))[0] > max(margin, fraction * e["major"])
    kept = largest(mask & ~far, eight=False)
    removed = 1 - int(kept.sum()) / total
    if not least <= removed <= most or kept.sum() < 20:
        return mask, 0.0
    return fill_holes(kept), removed
