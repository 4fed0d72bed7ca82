"""Neighbourhood operators on whole tiles.

A tile is one row with an array of intensities, so a filter needs no shuffle: Arrow batches of tiles are filtered as one NumPy
array (tiles, height, width) with separable kernels, and one call computes all features that are asked for. Filters are values;
`tile_features` applies a dictionary of them. Tiles of a batch must have the same size; batches are kept small, as a tile of
256 x 256 brings about half a megabyte per feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Filter = Callable[[np.ndarray], np.ndarray]
#: Tiles that are filtered at once.
AT_ONCE = 64
_PAD = {"reflect": "symmetric", "nearest": "edge", "zero": "constant"}


def correlate(x: np.ndarray, kernel: np.ndarray, axis: int, mode: str = "reflect") -> np.ndarray:
    """One-dimensional correlation along an axis; 'reflect' mirrors the border pixel too."""
    k = len(kernel) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (k, len(kernel) - 1 - k)
    while k >= 1 and mode == "reflect" and max(pad[axis]) > x.shape[axis]:
        # a kernel longer than the tile is mirrored over and over
        idx = np.arange(-k, x.shape[axis] + k)
        n = x.shape[axis]
        idx = np.mod(idx, 2 * n)
        padded = np.take(x, np.where(idx < n, idx, 2 * n - 1 - idx), axis)
        break
    else:
        padded = np.pad(x, pad, mode=_PAD[mode])
    n = x.shape[axis]
    out = np.zeros_like(x, dtype=float)
    for i, w in enumerate(kernel):
        if w:
            out += w * np.take(padded, np.arange(i, i + n), axis)
    return out


def separable(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, mode: str = "reflect") -> np.ndarray:
    return correlate(correlate(x, rows, -2, mode), cols, -1, mode)


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    t = np.arange(-radius, radius + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    if order == 2:
        g = g * (t * t / sigma**4 - 1 / sigma**2)
    return g


def gaussian(sigma: float, mode: str = "reflect") -> Filter:
    k = gaussian_kernel(sigma)
    return lambda x: separable(x, k, k, mode)


def box_mean(radius: int) -> Filter:
    k = np.full(2 * radius + 1, 1 / (2 * radius + 1))
    return lambda x: separable(x, k, k)


def box_std(radius: int) -> Filter:
    mean = box_mean(radius)
    return lambda x: np.sqrt(np.maximum(mean(x * x) - mean(x) ** 2, 0))


def sobel_h(x: np.ndarray) -> np.ndarray:
    return separable(x, np.array([-1.0, 0, 1]), np.array([1.0, 2, 1]) / 4)


def sobel_v(x: np.ndarray) -> np.ndarray:
    return separable(x, np.array([1.0, 2, 1]) / 4, np.array([-1.0, 0, 1]))


def sobel_magnitude(x: np.ndarray) -> np.ndarray:
    return np.hypot(sobel_h(x), sobel_v(x))


def laplace_of_gaussian(sigma: float) -> Filter:
    g, d = gaussian_kernel(sigma), gaussian_kernel(sigma, 2)
    return lambda x: separable(x, d, g) + separable(x, g, d)


def difference_of_gaussians(small: float, large: float) -> Filter:
    a, b = gaussian(small, "nearest"), gaussian(large, "nearest")
    return lambda x: a(x) - b(x)


def structure_tensor(sigma: float = 1.0) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Eigenvalues (larger, smaller) of the Gaussian-weighted products of the derivatives; zero outside the tile."""

    def run(x):
        r = correlate(correlate(x, np.array([-1.0, 0, 1]), -2, "zero"), np.array([1.0, 2, 1]) / 4, -1, "zero")
        c = correlate(correlate(x, np.array([-1.0, 0, 1]), -1, "zero"), np.array([1.0, 2, 1]) / 4, -2, "zero")
        g = gaussian(sigma, "zero")
        rr, cc, rc = g(r * r), g(c * c), g(r * c)
        mean, root = (rr + cc) / 2, np.sqrt(((rr - cc) / 2) ** 2 + rc * rc)
        return mean + root, mean - root

    return run


def tensor_part(part: str, sigma: float = 1.0) -> Filter:
    both = structure_tensor(sigma)

    def run(x):
        large, small = both(x)
        return {"large": large, "small": small, "anisotropy": (large - small) / (large + small + 1e-8)}[part]

    return run


def local_entropy(radius: int = 5, normalised: bool = True) -> Filter:
    """Base-2 entropy of gray values in a disk, inside the tile only; divided by the tile's largest, if normalised."""
    from .labels import disk

    at = disk(radius)

    def run(x):
        v = np.clip(np.floor(x), 0, 255).astype(np.int64)
        n, h, w = v.shape
        near = np.full((len(at), n, h, w), -1, np.int64)
        for k, (a, b) in enumerate(at):
            r0, r1, c0, c1 = max(0, -a), min(h, h - a), max(0, -b), min(w, w - b)
            if r0 < r1 and c0 < c1:
                near[k, :, r0:r1, c0:c1] = v[:, r0 + a : r1 + a, c0 + b : c1 + b]
        near.sort(0)
        out, size = np.zeros((n, h, w)), (near >= 0).sum(0)
        # runs of equal values in the sorted stack
        run_length = np.ones((n, h, w))
        for k in range(1, len(at) + 1):
            same = (near[k] == near[k - 1]) if k < len(at) else np.zeros((n, h, w), bool)
            p = run_length / np.maximum(size, 1)
            out -= np.where(~same & (near[k - 1] >= 0), p * np.log2(p), 0)
            run_length = np.where(same, run_length + 1, 1)
        return out / (out.max((1, 2), keepdims=True) + 1e-8) if normalised else out

    return run


def gabor(frequency: float, theta: float, bandwidth: float = 1.0, sds: float = 3.0) -> Filter:
    """Real part of a Gabor filter with a bandwidth in octaves; reflected edges."""
    sigma = math.sqrt(math.log(2) / 2) / math.pi * (2**bandwidth + 1) / (2**bandwidth - 1) / frequency
    half = int(math.ceil(max(abs(sds * sigma * math.cos(theta)), abs(sds * sigma * math.sin(theta)), 1)))
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    along = x * math.cos(theta) + y * math.sin(theta)
    across = -x * math.sin(theta) + y * math.cos(theta)
    kernel = np.exp(-0.5 * (along**2 + across**2) / sigma**2) / (2 * math.pi * sigma**2) * np.cos(2 * math.pi * frequency * along)
    # a rotated Gabor isn't separable; its few leading components are
    u, s, vt = np.linalg.svd(kernel)
    keep = s > s[0] * 1e-12
    parts = [(u[:, i] * s[i], vt[i]) for i in np.flatnonzero(keep)]
    return lambda t: sum(separable(t, a[::-1], b[::-1]) for a, b in parts)


def uniform_lbp(radius: int) -> Filter:
    """Rotation-invariant uniform local binary pattern on 8 * radius points, over (points + 2); zero outside the tile."""
    points = 8 * radius
    angle = 2 * math.pi * np.arange(points) / points
    ring = np.round(np.stack([-radius * np.sin(angle), radius * np.cos(angle)], 1), 5)

    def run(x):
        n, h, w = x.shape
        pad = radius + 1
        p = np.pad(x, ((0, 0), (pad, pad), (pad, pad)))
        bits = []
        for dr, dc in ring:
            r, c = math.floor(dr), math.floor(dc)
            fr, fc = dr - r, dc - c
            cut = lambda a, b: p[:, pad + a : pad + a + h, pad + b : pad + b + w]
            value = (1 - fr) * ((1 - fc) * cut(r, c) + (fc * cut(r, c + 1) if fc else 0))
            if fr:
                value = value + fr * ((1 - fc) * cut(r + 1, c) + (fc * cut(r + 1, c + 1) if fc else 0))
            bits.append(value - x >= -1e-9)
        bits = np.stack(bits)
        changes = (bits != np.roll(bits, 1, 0)).sum(0)
        return np.where(changes <= 2, bits.sum(0), points + 1) / (points + 2)

    return run


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every pixel of (tiles, h, w) to the nearest true pixel of its tile; inf without any."""
    n, h, w = mask.shape
    col = np.full((n, h, w), np.inf)
    last = np.full((n, w), np.inf)
    for r in range(h):
        last = np.where(mask[:, r], 0, last + 1)
        col[:, r] = last
    last = np.full((n, w), np.inf)
    for r in reversed(range(h)):
        last = np.where(mask[:, r], 0, last + 1)
        col[:, r] = np.minimum(col[:, r], last)
    square, out = col**2, np.full((n, h, w), np.inf)
    for d in range(w):  # columns d apart
        out[:, :, d:] = np.minimum(out[:, :, d:], square[:, :, : w - d] + d * d)
        if d:
            out[:, :, :-d] = np.minimum(out[:, :, :-d], square[:, :, d:] + d * d)
    return np.sqrt(out)


def superpixels(x: np.ndarray, segments: int = 200, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Segment numbers from 0 of a tile (h, w) or (h, w, channels): seeded on a grid, k-means in colour and place."""
    if x.ndim == 2:
        x = x[..., None]
    h, w, _ = x.shape
    step = max(1.0, math.sqrt(h * w / segments))
    rs, cs = np.arange(step / 2, h, step), np.arange(step / 2, w, step)
    centre_at = np.stack([a.ravel() for a in np.meshgrid(rs, cs, indexing="ij")], 1)
    centre = x[centre_at[:, 0].astype(int), centre_at[:, 1].astype(int)].astype(float)
    r, c = np.mgrid[:h, :w]
    label = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k, ((cr, cc), v) in enumerate(zip(centre_at, centre)):
            a, b = max(0, int(cr - 2 * step)), max(0, int(cc - 2 * step))
            box = np.s_[a : int(cr + 2 * step) + 1, b : int(cc + 2 * step) + 1]
            d = ((x[box] - v) ** 2).sum(-1) + (compactness / step) ** 2 * ((r[box] - cr) ** 2 + (c[box] - cc) ** 2)
            near = d < best[box]
            best[box] = np.where(near, d, best[box])
            label[box] = np.where(near, k, label[box])
        size = np.bincount(label.ravel(), minlength=len(centre))
        ok = size > 0
        for i, part in enumerate((r, c)):
            centre_at[ok, i] = np.bincount(label.ravel(), part.ravel(), len(centre))[ok] / size[ok]
        for i in range(x.shape[-1]):
            centre[ok, i] = np.bincount(label.ravel(), x[..., i].ravel(), len(centre))[ok] / size[ok]
    return np.unique(label, return_inverse=True)[1].reshape(h, w)


def superpixel_mean(segments: int = 200, compactness: float = 10.0) -> Filter:
    def run(x):
        out = np.empty_like(x, dtype=float)
        for k, tile in enumerate(x):
            s = superpixels(tile, segments, compactness).ravel()
            out[k] = (np.bincount(s, tile.ravel()) / np.bincount(s))[s].reshape(tile.shape)
        return out

    return run


GLCM_PROPS = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")


def glcm(patch: np.ndarray, levels: int = 32, step: int = 8) -> np.ndarray:
    """Six co-occurrence properties of a patch, averaged over four angles at distance 1; symmetric, normalised.

    Patches under 9 pixels give zeros; values in 0-1 are taken for shares of 255. A flat patch has correlation 1.
    """
    if patch.size < 9:
        return np.zeros(len(GLCM_PROPS))
    v = patch * 255 if patch.max() <= 1 else patch
    q = np.clip(np.floor(v), 0, 255).astype(np.int64) // step
    i, j = np.mgrid[:levels, :levels]
    out = []
    for dr, dc in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        h, w = q.shape
        a = q[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)]
        b = q[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
        p = np.bincount((a * levels + b).ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
        p = p + p.T
        p /= max(p.sum(), 1)
        asm = (p * p).sum()
        mi, mj = (p * i).sum(), (p * j).sum()
        si, sj = math.sqrt(max(0, (p * (i - mi) ** 2).sum())), math.sqrt(max(0, (p * (j - mj) ** 2).sum()))
        corr = (p * (i - mi) * (j - mj)).sum() / (si * sj) if si > 1e-15 and sj > 1e-15 else 1.0
        out.append([(p * (i - j) ** 2).sum(), (p * np.abs(i - j)).sum(), (p / (1 + (i - j) ** 2)).sum(), math.sqrt(asm), corr, asm])
    return np.mean(out, 0)


def glcm_at(tile: np.ndarray, at: np.ndarray, half: int = 7) -> np.ndarray:
    """GLCM properties of the patches (2 half + 1 square, cut at the border) around flat indexes of a tile."""
    w = tile.shape[1]
    return np.array([glcm(tile[max(0, i // w - half) : i // w + half + 1, max(0, i % w - half) : i % w + half + 1]) for i in at.tolist()]).reshape(-1, len(GLCM_PROPS))


def tile_features(tiles: DataFrame, height: int, width: int, filters: dict[str, Filter]) -> DataFrame:
    """(image_id, label, r, c, v, <filter>...): every pixel of tiles (image_id, label, v array) with all filters' values.

    NaN and infinities become 0. Tiles that are null or of another size are an error: a silent shift would be worse.
    """
    names = list(filters)
    fields = [("image_id", pa.int64()), ("label", pa.int64()), ("r", pa.int64()), ("c", pa.int64()), ("v", pa.float64()), *((n, pa.float64()) for n in names)]
    r, c = (x.ravel() for x in np.mgrid[:height, :width])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(a, AT_ONCE)
                x = np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, height, width)
                cols = [np.repeat(b.column("image_id").to_numpy(), r.size), np.repeat(b.column("label").to_numpy(), r.size), np.tile(r, b.num_rows), np.tile(c, b.num_rows), x.ravel()]
                cols += [np.nan_to_num(f(x), nan=0.0, posinf=0.0, neginf=0.0).ravel() for f in filters.values()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(cols, fields)], schema=pa.schema(fields))

    shape = "image_id long, label long, r long, c long, v double" + "".join(f", {n} double" for n in names)
    return tiles.select("image_id", "label", "v").mapInArrow(run, shape)


def sampled_glcm(tiles: DataFrame, sampled: DataFrame, height: int, width: int, half: int = 7) -> DataFrame:
    """(image_id, pixel_idx, glcm_*) of sampled pixels only: the sample's indexes join the tile's row before any patch is cut.

    sampled has (image_id, pixel_idx), at most height * width rows an image.
    """
    from pyspark.sql import functions as F

    at = sampled.groupBy("image_id").agg(F.collect_list("pixel_idx").alias("at"))
    rows = tiles.select("image_id", "v").join(at, "image_id")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile = np.array(batch.column("v")[k].as_py(), float).reshape(height, width)
                at = np.sort(np.array(batch.column("at")[k].as_py(), np.int64))
                g = glcm_at(tile, at, half)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), batch.column("image_id")[k].as_py())), pa.array(at), *(pa.array(np.ascontiguousarray(g[:, i])) for i in range(len(GLCM_PROPS)))],
                    names=["image_id", "pixel_idx", *(f"glcm_{p}" for p in GLCM_PROPS)],
                )

    return rows.mapInArrow(run, "image_id long, pixel_idx long, " + ", ".join(f"glcm_{p} double" for p in GLCM_PROPS))


def dense_filters(radii=(3, 7, 15)) -> dict[str, Filter]:
    """The filters of one channel that the dense feature set has: window statistics, texture, gradients, tensors, entropy."""
    out: dict[str, Filter] = {}
    for r in radii:
        out[f"mean_r{r}"], out[f"std_r{r}"] = box_mean(r), box_std(r)
    out |= {f"lbp_r{k}": uniform_lbp(k) for k in (1, 2, 3)}
    for f in (0.1, 0.2, 0.4):
        for name, t in (("0", 0.0), ("pi_4", math.pi / 4), ("pi_2", math.pi / 2), ("3pi_4", 3 * math.pi / 4)):
            out[f"gabor_f{str(f).replace('.', '_')}_t{name}"] = gabor(f, t)
    out |= {"sobel_h": sobel_h, "sobel_v": sobel_v, "sobel_mag": sobel_magnitude, "log_s2": laplace_of_gaussian(2), "log_s4": laplace_of_gaussian(4)}
    out |= {"ev1": tensor_part("large"), "ev2": tensor_part("small"), "anisotropy": tensor_part("anisotropy")}
    out |= {f"dog_s{a}_s{b}": difference_of_gaussians(a, b) for a, b in ((1, 2), (2, 4), (4, 8))}
    return out | {"superpixel": superpixel_mean(), "entropy": local_entropy(5)}
