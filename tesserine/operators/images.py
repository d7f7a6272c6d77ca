"""Image geometry and features: numpy over decoded pixels, in Arrow batches, all modes from one decode."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ConfigError
from ..functions.vectors import EPSILON

#: What is lacking to a half at most where a sum of fractions is one.
TIE = 1e-9
GRID, COLOR_BINS, HSV_BINS, HOG_BINS, LBP_BINS = 4, 8, 8, 8, 16
CELLS = GRID * GRID

#: Names of feature modes and resize modes, and what they may also be called.
FEATURE_MODES = {
    "pixels": ("raw",),
    "color": ("histogram", "color-histogram"),
    "hog": ("edges",),
    "combined": (),
    "rich": ("enhanced",),
    "rich-spatial": ("spatial-rich", "rich_spatial"),
    "rich-normalized": ("rich-normalised", "rich-norm", "rich_normalized"),
    "rich-hog": ("rich_hog", "rich-block-hog", "rich-blockhog"),
    "rich-texture": ("rich_texture", "rich-lbp", "rich_lbp"),
    "rich-edge": ("rich_edges", "rich-edge-density", "rich_edge"),
    "rich-layout": ("rich_layout", "rich-symmetry", "rich_symmetry"),
}
RESIZE_MODES = {
    "stretch": ("resize", "resize-exact"),
    "center-crop": ("centercrop", "crop"),
    "letterbox": ("contain", "pad", "padding"),
    "foreground-crop": ("foreground", "object-crop", "object"),
}


def mode_name(name: str, modes: dict[str, tuple[str, ...]]) -> str:
    """The mode that a name or alias stands for."""
    for mode, other in modes.items():
        if name == mode or name in other:
            return mode
    raise ConfigError(f"unknown mode {name}")


@dataclass(frozen=True)
class VectorConfig:
    """Size of the resized image, features, way of resizing."""

    width: int = 16
    height: int = 16
    features: str = "pixels"
    resize: str = "stretch"
    invert: bool = False

    def __post_init__(self):
        if self.width < 1 or self.height < 1:
            raise ConfigError("width and height must be positive")
        object.__setattr__(self, "features", mode_name(self.features, FEATURE_MODES))
        object.__setattr__(self, "resize", mode_name(self.resize, RESIZE_MODES))

    @property
    def length(self) -> int:
        return self.width * self.height if self.features == "pixels" else sum(SIZES[p] for p in PARTS[self.features])


# --- geometry; images are uint8 arrays (height, width, 3), RGB -----------------------------------------


def _triangle_weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights of a triangle filter that takes n samples to m; each row sums to 1."""
    ratio = n / m
    support = max(ratio, 1.0)
    centre = (np.arange(m) + 0.5) * ratio
    distance = np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / support)
    w = np.maximum(0.0, 1.0 - distance)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Triangle-filter resize to exactly this size, rows first; halves go up, whatever sums of fractions make of them."""
    if image.shape[:2] == (height, width):
        return image
    rows = np.tensordot(_triangle_weights(image.shape[0], height), image.astype(float), axes=(1, 0))
    both = np.tensordot(_triangle_weights(image.shape[1], width), rows, axes=(1, 1)).swapaxes(0, 1)
    return np.clip(np.floor(both + (0.5 + TIE)), 0, 255).astype(np.uint8)


def contain(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resized as large as fits, with its aspect kept."""
    ratio = min(width / image.shape[1], height / image.shape[0])
    return resize(image, max(1, round(image.shape[1] * ratio)), max(1, round(image.shape[0] * ratio)))


def center_crop(image: np.ndarray) -> np.ndarray:
    side = min(image.shape[:2])
    top, left = (image.shape[0] - side) // 2, (image.shape[1] - side) // 2
    return image[top : top + side, left : left + side]


def letterbox(resized: np.ndarray, width: int, height: int) -> np.ndarray:
    """Centred on a grey canvas."""
    canvas = np.full((height, width, 3), 127, np.uint8)
    y, x = (height - resized.shape[0]) // 2, (width - resized.shape[1]) // 2
    canvas[y : y + resized.shape[0], x : x + resized.shape[1]] = resized
    return canvas


def border_background(image: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean colour of the border, and the distance from it beyond which a pixel is foreground."""
    edge = np.ones(image.shape[:2], bool)
    edge[1:-1, 1:-1] = False
    border = image[edge] / 255.0
    background = border.mean(axis=0)
    distance = color_distance(border, background)
    return background, float(np.clip(distance.mean() + 2.0 * distance.std(), 0.08, 0.35))


def color_distance(pixels: np.ndarray, color: np.ndarray) -> np.ndarray:
    return np.clip(np.sqrt(((pixels - color) ** 2).sum(axis=-1) / 3.0), 0.0, 1.0)


def foreground_crop(image: np.ndarray) -> np.ndarray:
    """The padded box of what differs from the border; the centre crop if that is next to nothing or next to all."""
    h, w = image.shape[:2]
    if w < 3 or h < 3:
        return image
    background, threshold = border_background(image)
    hit = color_distance(image / 255.0, background) > threshold
    if hit.sum() < max(h * w // 100, 4):
        return center_crop(image)
    ys, xs = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    top, bottom, left, right = int(ys[0]), int(ys[-1]), int(xs[0]), int(xs[-1])
    bw, bh = right - left + 1, bottom - top + 1
    if bw * bh / (h * w) > 0.95:
        return center_crop(image)
    px, py = max(1, int(np.ceil(bw * 0.08))), max(1, int(np.ceil(bh * 0.08)))
    return image[max(0, top - py) : min(bottom + py, h - 1) + 1, max(0, left - px) : min(right + px, w - 1) + 1]


def processing_steps(image: np.ndarray, config: VectorConfig) -> list[tuple[str, np.ndarray]]:
    """The named images on the way to the resized one."""
    w, h = config.width, config.height
    steps = [("original", image)]
    if config.resize == "letterbox":
        small = contain(image, w, h)
        return [*steps, ("resize_contain", small), ("letterbox", letterbox(small, w, h))]
    if config.resize != "stretch":
        name, crop = ("center_crop", center_crop) if config.resize == "center-crop" else ("foreground_crop", foreground_crop)
        steps.append((name, crop(image)))
    return [*steps, ("resize_exact", resize(steps[-1][1], w, h))]


def prepare(image: np.ndarray, config: VectorConfig) -> np.ndarray:
    return processing_steps(image, config)[-1][1]


# --- features; ``gray`` is (height, width) and ``rgb`` (height, width, 3), both within 0..1 --------------


def luma(image: np.ndarray) -> np.ndarray:
    """Integer luma of RGB pixels."""
    return (image.astype(np.int64) @ np.array([2126, 7152, 722]) // 10_000).astype(np.uint8)


def cells_of(height: int, width: int) -> np.ndarray:
    """The cell of the 4 x 4 grid of each pixel."""
    y = np.minimum(np.arange(height) * GRID // max(height, 1), GRID - 1)
    x = np.minimum(np.arange(width) * GRID // max(width, 1), GRID - 1)
    return y[:, None] * GRID + x[None, :]


def _binned(values: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(np.floor(np.clip(values, 0.0, 1.0) * bins).astype(np.int64), bins - 1)


def _channel_histogram(index: np.ndarray, bins: int) -> np.ndarray:
    """Shares by bin of each of the three channels."""
    flat = index.reshape(-1, 3) + np.arange(3) * bins
    return np.bincount(flat.ravel(), minlength=3 * bins) / max(len(flat), 1)


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    top, delta = rgb.max(axis=-1), rgb.max(axis=-1) - rgb.min(axis=-1)
    safe = np.where(delta > EPSILON, delta, 1.0)
    hue = np.select(
        [delta <= EPSILON, np.abs(top - r) <= EPSILON, np.abs(top - g) <= EPSILON],
        [0.0, np.mod((g - b) / safe, 6.0) / 6.0, ((b - r) / safe + 2.0) / 6.0],
        ((r - g) / safe + 4.0) / 6.0,
    )
    saturation = np.where(top > EPSILON, delta / np.where(top > EPSILON, top, 1.0), 0.0)
    return np.stack([np.clip(hue, 0, 1), np.clip(saturation, 0, 1), top], axis=-1)


def mean_std(channels: np.ndarray) -> np.ndarray:
    """Mean and population deviation of each channel, in turn."""
    flat = channels.reshape(-1, 3)
    mean = flat.mean(axis=0)
    return np.stack([mean, np.sqrt(np.maximum((flat**2).mean(axis=0) - mean**2, 0.0))], axis=1).ravel()


def color_histogram(rgb8: np.ndarray) -> np.ndarray:
    return _channel_histogram(np.minimum(rgb8.astype(np.int64) * COLOR_BINS // 256, COLOR_BINS - 1), COLOR_BINS)


def spatial_histogram(hsv: np.ndarray) -> np.ndarray:
    cell = cells_of(*hsv.shape[:2])
    at = cell[..., None] * 3 * HSV_BINS + np.arange(3) * HSV_BINS + _binned(hsv, HSV_BINS)
    counts = np.bincount(cell.ravel(), minlength=CELLS)
    return np.bincount(at.ravel(), minlength=CELLS * 3 * HSV_BINS) / np.repeat(np.maximum(counts, 1), 3 * HSV_BINS)


def cell_intensity(gray: np.ndarray) -> np.ndarray:
    cell = cells_of(*gray.shape).ravel()
    n = np.maximum(np.bincount(cell, minlength=CELLS), 1)
    mean = np.bincount(cell, gray.ravel(), CELLS) / n
    square = np.bincount(cell, gray.ravel() ** 2, CELLS) / n
    return np.stack([mean, np.sqrt(np.maximum(square - mean**2, 0.0))], axis=1).ravel()


def local_patterns(gray: np.ndarray, radius: int) -> np.ndarray:
    """Shares by cell of the coarse codes of which of eight neighbours, clockwise from the top left, reach the centre."""
    h, w = gray.shape
    if radius == 0 or w <= 2 * radius or h <= 2 * radius:
        return np.zeros(CELLS * LBP_BINS)
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    inner = gray[radius : h - radius, radius : w - radius]
    code = sum((gray[radius * (1 + dy) : h - radius * (1 - dy), radius * (1 + dx) : w - radius * (1 - dx)] >= inner).astype(np.int64) << k for k, (dy, dx) in enumerate(ring))
    cell = cells_of(h, w)[radius : h - radius, radius : w - radius]
    table = np.bincount((cell * LBP_BINS + code * LBP_BINS // 256).ravel(), minlength=CELLS * LBP_BINS).reshape(CELLS, LBP_BINS).astype(float)
    return (table / np.maximum(table.sum(axis=1, keepdims=True), 1.0)).ravel()


def _gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell = cells_of(*gray.shape)[1:-1, 1:-1].ravel()
    return (gray[1:-1, 2:] - gray[1:-1, :-2]).ravel(), (gray[2:, 1:-1] - gray[:-2, 1:-1]).ravel(), cell


def oriented_cells(gray: np.ndarray) -> np.ndarray:
    """(cells, bins): gradient magnitude by unsigned direction."""
    if min(gray.shape) < 3:
        return np.zeros((CELLS, HOG_BINS))
    gx, gy, cell = _gradients(gray)
    size = np.sqrt(gx * gx + gy * gy)
    angle = np.arctan2(gy, gx)
    angle = np.where(angle < 0, angle + np.pi, angle)
    angle = np.where(angle >= np.pi, angle - np.pi, angle)
    index = cell * HOG_BINS + np.minimum(np.floor(angle / np.pi * HOG_BINS).astype(np.int64), HOG_BINS - 1)
    keep = size > EPSILON
    return np.bincount(index[keep], size[keep], CELLS * HOG_BINS).reshape(CELLS, HOG_BINS)


def hog(gray: np.ndarray) -> np.ndarray:
    cells = oriented_cells(gray)
    total = cells.sum(axis=1, keepdims=True)
    return np.where(total > EPSILON, cells / np.where(total > EPSILON, total, 1.0), cells).ravel()


def hog_blocks(gray: np.ndarray) -> np.ndarray:
    """3 x 3 overlapping blocks of 2 x 2 cells, each of unit length."""
    cells = oriented_cells(gray).reshape(GRID, GRID, HOG_BINS)
    blocks = np.stack([np.concatenate([cells[y, x], cells[y, x + 1], cells[y + 1, x], cells[y + 1, x + 1]]) for y in range(GRID - 1) for x in range(GRID - 1)])
    return (blocks / np.maximum(np.sqrt((blocks**2).sum(axis=1, keepdims=True)), EPSILON)).ravel()


def edge_density(gray: np.ndarray) -> np.ndarray:
    if min(gray.shape) < 3:
        return np.zeros(3 * CELLS)
    gx, gy, cell = _gradients(gray)
    n = np.maximum(np.bincount(cell, minlength=CELLS), 1)
    sums = [np.bincount(cell, v, CELLS) / n for v in (np.sqrt(gx * gx + gy * gy), np.abs(gx), np.abs(gy))]
    return np.clip(np.stack(sums, axis=1), 0.0, 1.0).ravel()


def layout(gray: np.ndarray) -> np.ndarray:
    """16 numbers on symmetry and on where the contrast lies."""
    h, w = gray.shape
    weight = np.abs(gray - gray.mean())
    total = max(float(weight.sum()), EPSILON)
    place = lambda n: np.full(n, 0.5) if n <= 1 else np.arange(n) / (n - 1)
    x, y = place(w)[None, :], place(h)[:, None]
    cx, cy = (weight * x).sum() / total, (weight * y).sum() / total
    sx, sy = np.sqrt((weight * (x - cx) ** 2).sum() / total), np.sqrt((weight * (y - cy) ** 2).sum() / total)
    share = lambda rows, columns: float(weight[rows, columns].sum()) / total
    upper, lower, left, right, every = slice(0, h // 2), slice(h // 2, None), slice(0, w // 2), slice(w // 2, None), slice(None)
    centre = share(slice(h // 4, h - h // 4), slice(w // 4, w - w // 4))
    across = np.abs(gray[:, : w // 2] - gray[:, ::-1][:, : w // 2]).mean() if w > 1 else 0.0
    down = np.abs(gray[: h // 2] - gray[::-1][: h // 2]).mean() if h > 1 else 0.0
    n = min(w, h)
    below = np.tril_indices(n, -1)
    diagonal = lambda g: np.abs(g - g.T)[below].mean() if n > 1 else 0.0
    values = [across, down, diagonal(gray[:n, :n]), diagonal(gray[:, ::-1][:n, :n]), cx, cy, sx, sy, centre, 1.0 - centre]
    values += [abs(share(every, left) - share(every, right)), abs(share(upper, every) - share(lower, every))]
    values += [share(r, c) for r in (upper, lower) for c in (left, right)]
    return np.clip(values, 0.0, 1.0)


#: The parts that make up each mode, in order, and their lengths.
PARTS = {"color": ["color"], "hog": ["hog"], "combined": ["color", "intensity", "hog"]}
PARTS["rich"] = [*PARTS["combined"], "hsv", "moments", "lbp1"]
PARTS["rich-spatial"] = [*PARTS["rich"], "spatial"]
PARTS["rich-normalized"] = [*PARTS["rich-spatial"], "chromaticity"]
PARTS["rich-hog"] = [*PARTS["rich-normalized"], "blocks"]
PARTS["rich-texture"] = [*PARTS["rich-hog"], "lbp2"]
PARTS["rich-edge"] = [*PARTS["rich-texture"], "edge"]
PARTS["rich-layout"] = [*PARTS["rich-texture"], "layout"]
SIZES = {"color": 24, "intensity": 32, "hog": 128, "hsv": 24, "moments": 12, "lbp1": 256, "spatial": 384, "chromaticity": 6, "blocks": 288, "lbp2": 256, "edge": 48, "layout": 16}


class _Features:
    """The parts of feature vectors of one resized image, each made once however many modes have it."""

    def __init__(self, gray: np.ndarray, color: np.ndarray, rgb: np.ndarray, hsv: np.ndarray):
        sums = np.maximum(rgb.sum(axis=-1, keepdims=True), EPSILON)
        self.gray, self.made = gray, {}
        self.make = {
            "color": lambda: color,
            "intensity": lambda: cell_intensity(gray),
            "hog": lambda: hog(gray),
            "hsv": lambda: _channel_histogram(_binned(hsv, HSV_BINS), HSV_BINS),
            "moments": lambda: np.concatenate([mean_std(rgb), mean_std(hsv)]),
            "lbp1": lambda: local_patterns(gray, 1),
            "spatial": lambda: spatial_histogram(hsv),
            "chromaticity": lambda: mean_std(rgb / sums),
            "blocks": lambda: hog_blocks(gray),
            "lbp2": lambda: local_patterns(gray, 2),
            "edge": lambda: edge_density(gray),
            "layout": lambda: layout(gray),
        }

    def part(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = self.make[name]()
        return self.made[name]

    def vector(self, mode: str) -> np.ndarray:
        return self.gray.ravel() if mode == "pixels" else np.concatenate([self.part(p) for p in PARTS[mode]])


def image_vectors(image: np.ndarray, configs: list[VectorConfig]) -> list[np.ndarray]:
    """The feature vectors of an RGB image for several configs, which is resized once for all that agree in that."""
    prepared: dict[tuple, _Features] = {}
    out = []
    for c in configs:
        key = (c.width, c.height, c.resize, c.invert)
        if key not in prepared:
            pixels = prepare(image, c)
            gray, rgb = luma(pixels) / 255.0, pixels / 255.0
            if c.invert:
                gray, rgb, pixels = 1.0 - gray, 1.0 - rgb, 255 - pixels
            prepared[key] = _Features(gray, color_histogram(pixels), rgb, to_hsv(rgb))
        out.append(prepared[key].vector(c.features))
    return out


def image_vector(image: np.ndarray, config: VectorConfig) -> np.ndarray:
    """The feature vector of an RGB image."""
    return image_vectors(image, [config])[0]


def gray_vector(values: np.ndarray, config: VectorConfig) -> np.ndarray:
    """The feature vector of grey values (height, width) within 0..1; hue and saturation take the grey value too, and chromaticities are 1/3."""
    gray = 1.0 - values if config.invert else values
    same = np.repeat(np.clip(gray, 0.0, 1.0)[..., None], 3, axis=-1)
    vector = _Features(gray, _channel_histogram(_binned(same, COLOR_BINS), COLOR_BINS), same, same).vector(config.features)
    if "chromaticity" in PARTS.get(config.features, ()):
        at = sum(SIZES[p] for p in PARTS["rich-spatial"])
        vector[at : at + 6] = mean_std(np.full((*gray.shape, 3), 1.0 / 3.0))
    return vector


def image_stats(image: np.ndarray) -> dict[str, float]:
    """Size, aspect, brightness, contrast, and the share that a centre crop loses."""
    h, w = image.shape[:2]
    gray = luma(image) / 255.0
    return {"width": w, "height": h, "aspect": w / h, "brightness": float(gray.mean()), "contrast": float(gray.std()), "crop_loss": 1.0 - min(w, h) ** 2 / (w * h)}


# --- Spark ----------------------------------------------------------------------------------------------


def decode_row(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB pixels of a row of Spark's image source, which has blue first."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def vectorize(images: DataFrame, configs: dict[str, VectorConfig], keep: tuple[str, ...] = ()) -> DataFrame:
    """One array<double> column for each config, from rows with Spark's ``image`` struct; every image is decoded once."""
    names = [*keep, *configs]
    schema = ", ".join([*(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` array<double>" for c in configs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("image").to_pylist()
            decoded = [decode_row(r["data"], r["height"], r["width"], r["nChannels"]) for r in rows]
            columns = [batch.column(c) for c in keep]
            made = zip(*(image_vectors(d, [*configs.values()]) for d in decoded)) if decoded else [[]] * len(configs)
            columns += [pa.array(list(v), pa.list_(pa.float64())) for v in made]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return images.select(*keep, "image").mapInArrow(run, schema)


def stats(images: DataFrame) -> DataFrame:
    """(path, width, height, aspect, brightness, contrast, crop_loss) of images (path, image)."""
    names = ["width", "height", "aspect", "brightness", "contrast", "crop_loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_stats(decode_row(r["data"], r["height"], r["width"], r["nChannels"])) for r in batch.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([float(f[n]) for f in found], pa.float64()) for n in names)], names=["path", *names])

    return images.select("path", "image").mapInArrow(run, "path string, " + ", ".join(f"{n} double" for n in names))


def patch_starts(size: int, patch: int, stride: int) -> list[int]:
    """Where patches start along a side: every ``stride`` before the last one, and that."""
    return [0] if size <= patch else [*range(0, size - patch, stride), size - patch]


def vectorize_patch_sets(images: DataFrame, specs: list[tuple[VectorConfig, int, int]], keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(spec, keep, x, y, w, h, vector) for every patch of each image and each spec (config, patch size, stride), clipped to the image; every image is decoded once, and cut once for all specs of a grid."""
    schema = ", ".join(["spec int", *(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep), "x bigint, y bigint, w bigint, h bigint, vector array<double>"])
    grids: dict[tuple[int, int], list[int]] = {}
    for i, (_, patch, stride) in enumerate(specs):
        grids.setdefault((patch, stride), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.column("image").to_pylist()):
                image = decode_row(r["data"], r["height"], r["width"], r["nChannels"])
                for (patch, stride), own in grids.items():
                    parts = [(x, y, image[y : y + patch, x : x + patch]) for x in patch_starts(r["width"], patch, stride) for y in patch_starts(r["height"], patch, stride)]
                    kept = [pa.array([batch.column(c)[i].as_py()] * len(parts), batch.column(c).type) for c in keep]
                    sizes = [pa.array(s, pa.int64()) for s in zip(*((x, y, p.shape[1], p.shape[0]) for x, y, p in parts))]
                    for spec, vectors in zip(own, zip(*(image_vectors(p, [specs[j][0] for j in own]) for _, _, p in parts))):
                        columns = [pa.array([spec] * len(parts), pa.int32()), *kept, *sizes, pa.array(list(vectors), pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["spec", *keep, "x", "y", "w", "h", "vector"])

    return images.select(*keep, "image").mapInArrow(run, schema)


def vectorize_patches(images: DataFrame, config: VectorConfig, patch: int, stride: int, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keep, x, y, w, h, vector) for every patch of each image, clipped to it, from one decode."""
    return vectorize_patch_sets(images, [(config, patch, stride)], keep).drop("spec")


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of RGB or RGBA bytes."""
    h, w, n = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((h, 1 + w * n), np.uint8)
    lines[:, 1:] = image.reshape(h, w * n)
    header = struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


# --- crops and heat maps ------------------------------------------------------------------------------


def pad_to_square(image: np.ndarray, color: tuple[int, int, int]) -> np.ndarray:
    h, w = image.shape[:2]
    side = max(h, w)
    canvas = np.empty((side, side, 3), np.uint8)
    canvas[:] = color
    y, x = (side - h) // 2, (side - w) // 2
    canvas[y : y + h, x : x + w] = image
    return canvas


def replace_background(crop: np.ndarray, box: tuple[int, int, int, int], color: tuple[int, int, int] | None = None, radius: float = 12.0) -> np.ndarray:
    """All but the box in one colour, or blurred."""
    if color is None:
        reach = int(3 * radius)
        kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * radius**2))
        kernel /= kernel.sum()
        out = crop.astype(float)
        for axis in (0, 1):
            padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
            out = np.apply_along_axis(np.convolve, axis, padded, kernel, "valid")
        out = np.clip(np.round(out), 0, 255).astype(np.uint8)
    else:
        out = np.empty_like(crop)
        out[:] = color
    x1, y1, x2, y2 = box
    out[y1:y2, x1:x2] = crop[y1:y2, x1:x2]
    return out


def heat_values(width: int, height: int, patches: list[tuple[int, int, int, int, float]]) -> np.ndarray:
    """Per pixel the highest score of the patches over it, scaled between their least and greatest."""
    scores = [p[4] for p in patches]
    low, span = min(scores, default=0.0), max(max(scores, default=1.0) - min(scores, default=0.0), EPSILON)
    out = np.zeros((height, width))
    for x, y, w, h, s in patches:
        area = out[y : y + h, x : x + w]
        np.maximum(area, np.clip((s - low) / span, 0.0, 1.0), out=area)
    return out


def heat_colors(values: np.ndarray) -> np.ndarray:
    """RGBA colours from transparent over violet to yellow."""
    v = np.clip(values, 0.0, 1.0)
    alpha = np.where(v <= EPSILON, 0.0, np.round(80.0 + 175.0 * v))
    green = np.floor(np.minimum(255.0 * np.maximum(v - 0.45, 0.0) / 0.55, 255.0))
    return np.stack([np.round(255.0 * v), green, np.round(180.0 * (1.0 - v)), alpha], axis=-1).astype(np.uint8)


def overlay(image: np.ndarray, heat: np.ndarray) -> np.ndarray:
    a = heat[..., 3:] / 255.0 * 0.55
    return np.round(image * (1.0 - a) + heat[..., :3] * a).astype(np.uint8)
