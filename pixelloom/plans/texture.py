"""Registered queries: neighbourhood and texture operators on 8 x 8 tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.pixels import rounded as R
from ..operators import sampling as S
from ..operators import stencil as N
from ..operators.labels import binary_labels, disk
from ..sources.derived import SIDE, gray_tiles, mask_pixels, with_sql

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_EDGE = {"reflect": "CASE WHEN (({0}) % 16 + 16) % 16 < 8 THEN (({0}) % 16 + 16) % 16 ELSE 15 - (({0}) % 16 + 16) % 16 END", "nearest": "greatest(0, least(7, {0}))", "zero": "{0}"}


def _filtered(name: str, kernel: np.ndarray, mode: str = "reflect", source: str = "gray", value: str = "v") -> str:
    """CTE name(image_id, r, c, x): correlation of a pixel table with a kernel, by a join on shifted coordinates."""
    h, w = (n // 2 for n in kernel.shape)
    cells = ", ".join(f"({i - h}, {j - w}, {float(kernel[i, j])!r}::DOUBLE)" for i in range(kernel.shape[0]) for j in range(kernel.shape[1]) if kernel[i, j])
    return f""", {name}_k(dr, dc, w) AS (VALUES {cells}), {name} AS (
  SELECT g.image_id, g.r, g.c, coalesce(sum(w * n.{value}), 0) AS x FROM {source} g CROSS JOIN {name}_k
  LEFT JOIN {source} n ON n.image_id = g.image_id AND n.r = {_EDGE[mode].format('g.r + dr')} AND n.c = {_EDGE[mode].format('g.c + dc')} GROUP BY 1, 2, 3)"""


def _features(spark, sf_dir, digits: int = 5, **filters):
    px = N.tile_features(gray_tiles(spark, sf_dir), SIDE, SIDE, filters)
    return px.select("image_id", "r", "c", *(R(F.col(n), digits).alias(n) for n in filters))


_BOX = np.full((5, 5), 1 / 25)


@query(with_sql("gray") + _filtered("m", _BOX) + ", sq AS (SELECT *, v * v AS v2 FROM gray)" + _filtered("s", _BOX, source="sq", value="v2") + """
SELECT image_id, r, c, round(m.x, 5) + 0.0 AS box_mean, round(sqrt(greatest(s.x - m.x * m.x, 0)), 3) + 0.0 AS box_std FROM m JOIN s USING (image_id, r, c)""")
def window_mean_std(spark, sf_dir):
    px = N.tile_features(gray_tiles(spark, sf_dir), SIDE, SIDE, {"box_mean": N.box_mean(2), "box_std": N.box_std(2)})
    return px.select("image_id", "r", "c", R(F.col("box_mean"), 5).alias("box_mean"), R(F.col("box_std"), 3).alias("box_std"))


_H = np.outer([-1, 0, 1], [1, 2, 1]) / 4


@query(with_sql("gray") + _filtered("h", _H) + _filtered("w", _H.T) + """
SELECT image_id, r, c, round(h.x, 5) + 0.0 AS sobel_h, round(w.x, 5) + 0.0 AS sobel_v, round(sqrt(h.x * h.x + w.x * w.x), 5) + 0.0 AS magnitude FROM h JOIN w USING (image_id, r, c)""")
def gradient_sobel(spark, sf_dir):
    return _features(spark, sf_dir, sobel_h=N.sobel_h, sobel_v=N.sobel_v, magnitude=N.sobel_magnitude)


def _log_kernel(sigma: float) -> np.ndarray:
    g, d = N.gaussian_kernel(sigma), N.gaussian_kernel(sigma, 2)
    return np.outer(d, g) + np.outer(g, d)


@query(with_sql("gray") + _filtered("f", _log_kernel(1.0)) + " SELECT image_id, r, c, round(x, 5) + 0.0 AS log_s1 FROM f")
def gradient_log(spark, sf_dir):
    return _features(spark, sf_dir, log_s1=N.laplace_of_gaussian(1.0))


_G = {s: np.outer(N.gaussian_kernel(s), N.gaussian_kernel(s)) for s in (1.0, 2.0)}


@query(with_sql("gray") + _filtered("a", _G[1.0], "nearest") + _filtered("b", _G[2.0], "nearest") + " SELECT image_id, r, c, round(a.x - b.x, 5) + 0.0 AS dog FROM a JOIN b USING (image_id, r, c)")
def difference_of_gaussians(spark, sf_dir):
    return _features(spark, sf_dir, dog=N.difference_of_gaussians(1, 2))


@query(with_sql("gray") + _filtered("p", _H, "zero") + _filtered("q", _H.T, "zero") + ", pq AS (SELECT image_id, r, c, p.x * p.x AS rr, q.x * q.x AS cc, p.x * q.x AS rc FROM p JOIN q USING (image_id, r, c))"
       + "".join(_filtered(f"g{n}", _G[1.0], "zero", "pq", n) for n in ("rr", "cc", "rc")) + """, e AS (
SELECT image_id, r, c, (grr.x + gcc.x) / 2 AS m, sqrt(((grr.x - gcc.x) / 2) * ((grr.x - gcc.x) / 2) + grc.x * grc.x) AS d FROM grr JOIN gcc USING (image_id, r, c) JOIN grc USING (image_id, r, c))
SELECT image_id, r, c, round(m + d, 4) + 0.0 AS ev1, round(m - d, 4) + 0.0 AS ev2, round(2 * d / (2 * m + 0.00000001), 4) + 0.0 AS anisotropy FROM e""")
def structure_tensor(spark, sf_dir):
    return _features(spark, sf_dir, 4, ev1=N.tensor_part("large"), ev2=N.tensor_part("small"), anisotropy=N.tensor_part("anisotropy"))


_DISK2 = ", ".join(f"({a}, {b})" for a, b in disk(2))


@query(with_sql("gray") + f""", k(dr, dc) AS (VALUES {_DISK2}),
n AS (SELECT g.image_id, g.r, g.c, floor(n.v) AS v, count(*) AS k FROM gray g CROSS JOIN k JOIN gray n ON n.image_id = g.image_id AND n.r = g.r + dr AND n.c = g.c + dc GROUP BY ALL),
p AS (SELECT image_id, r, c, k / sum(k) OVER (PARTITION BY image_id, r, c) AS p FROM n), e AS (SELECT image_id, r, c, -sum(p * log2(p)) AS x FROM p GROUP BY ALL)
SELECT image_id, r, c, round(x / (max(x) OVER (PARTITION BY image_id) + 0.00000001), 5) + 0.0 AS entropy FROM e""")
def local_entropy(spark, sf_dir):
    return _features(spark, sf_dir, entropy=N.local_entropy(2))


@query(with_sql("gray") + """, q AS (SELECT image_id, r, c, CAST(floor(v) AS BIGINT) // 8 AS v FROM gray),
a(k, dr, dc) AS (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)),
o AS (SELECT x.image_id, k, x.v AS i, y.v AS j FROM q x CROSS JOIN a JOIN q y ON y.image_id = x.image_id AND y.r = x.r + dr AND y.c = x.c + dc),
s AS (SELECT image_id, k, i, j FROM o UNION ALL SELECT image_id, k, j, i FROM o),
p AS (SELECT image_id, k, i, j, count(*) / sum(count(*)) OVER (PARTITION BY image_id, k) AS p FROM s GROUP BY 1, 2, 3, 4),
m AS (SELECT image_id, k, sum(p * i) AS mi, sum(p * j) AS mj FROM p GROUP BY 1, 2),
f AS (SELECT image_id, k, sum(p * (i - j) * (i - j)) AS con, sum(p * abs(i - j)) AS dis, sum(p / (1 + (i - j) * (i - j))) AS hom, sum(p * p) AS asm,
             sum(p * (i - mi) * (j - mj)) AS cov, sqrt(greatest(0, sum(p * (i - mi) * (i - mi)))) AS si, sqrt(greatest(0, sum(p * (j - mj) * (j - mj)))) AS sj FROM p JOIN m USING (image_id, k) GROUP BY 1, 2)
SELECT image_id, 36::BIGINT AS pixel_idx, round(avg(con), 6) + 0.0 AS glcm_contrast, round(avg(dis), 6) + 0.0 AS glcm_dissimilarity, round(avg(hom), 6) + 0.0 AS glcm_homogeneity, round(avg(sqrt(asm)), 6) + 0.0 AS glcm_energy,
       round(avg(CASE WHEN si > 1e-15 AND sj > 1e-15 THEN cov / (si * sj) ELSE 1 END), 6) + 0.0 AS glcm_correlation, round(avg(asm), 6) + 0.0 AS glcm_asm FROM f GROUP BY 1""")
def glcm_sampled(spark, sf_dir):
    tiles = gray_tiles(spark, sf_dir)
    out = N.sampled_glcm(tiles, tiles.select("image_id", F.lit(36).cast("long").alias("pixel_idx")), SIDE, SIDE, half=7)
    return out.select("image_id", "pixel_idx", *(R(F.col(f"glcm_{p}"), 6).alias(f"glcm_{p}") for p in N.GLCM_PROPS))


@query()
def glcm_boundary_sample(spark, sf_dir):
    """Co-occurrence at the pixels that the boundary sample draws."""
    drawn = S.boundary_sample(binary_labels(mask_pixels(spark, sf_dir)), per_class=5, boost=3.0, distance=2, width=SIDE)
    out = N.sampled_glcm(gray_tiles(spark, sf_dir), drawn.select("image_id", "pixel_idx"), SIDE, SIDE, half=7)
    return out.select("image_id", "pixel_idx", *(R(F.col(f"glcm_{p}"), 6).alias(f"glcm_{p}") for p in N.GLCM_PROPS))


@query(with_sql("gray") + """, b AS (SELECT * FROM gray WHERE v >= 150)
SELECT g.image_id, g.r, g.c, round(coalesce(sqrt(min((g.r - b.r) * (g.r - b.r) + (g.c - b.c) * (g.c - b.c))), 0), 5) + 0.0 AS distance FROM gray g LEFT JOIN b ON b.image_id = g.image_id GROUP BY 1, 2, 3""")
def distance_transform(spark, sf_dir):
    return _features(spark, sf_dir, distance=lambda x: N.distance_to(x >= 150))


@query()
def texture_lbp(spark, sf_dir):
    return _features(spark, sf_dir, **{f"lbp_r{k}": N.uniform_lbp(k) for k in (1, 2, 3)})


@query()
def texture_gabor(spark, sf_dir):
    return _features(spark, sf_dir, **{k: f for k, f in N.dense_filters().items() if k.startswith("gabor")})


@query()
def superpixel_means(spark, sf_dir):
    return _features(spark, sf_dir, superpixel=N.superpixel_mean(segments=9))


@query()
def dense_features(spark, sf_dir):
    """All filters of the gray channel in one pass over the tiles, averaged per label."""
    own = N.dense_filters(radii=(1, 2, 3))
    px = N.tile_features(gray_tiles(spark, sf_dir), SIDE, SIDE, own)
    return px.groupBy("label").agg(F.count("*").alias("n"), *(R(F.avg(n), 4).alias(n) for n in own))
