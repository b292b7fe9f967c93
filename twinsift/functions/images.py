"""Image kernels in NumPy and the Arrow UDFs over Spark's decoded images.

Spark's image source decodes on the JVM (8-bit BGR rows); a kernel sees one raster at a time.
Batches that cross to Python end at spark.sql.execution.arrow.maxBytesPerBatch (scans set it to
BATCH_BYTES where it is larger), since rows alone are no bound for rasters.
"""

import functools
import importlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinsift import config

LUMA = np.array([0.114, 0.587, 0.299], dtype=np.float32)  # blue, green, red
BATCH_BYTES = 64 << 20
PLACEHOLDER = (60, 60, 60)  # fixed value: shown where an image can't be read
IMAGE_TYPE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
METRIC_TYPE = "struct<dimensions:struct<width:int,height:int>,sharpness_normalized:double,effective_resolution_fraction:double,effective_resolution_px_equiv:double,noise_sigma:double,blockiness:double,brisque:double,niqe:double>"


def gray(data, height, width, channels):
    """The luma raster of row-major 8-bit data, or None if it isn't an image."""
    if data is None or height is None or height < 1 or width < 1 or len(data) < height * width * channels:
        return None
    a = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0].astype(np.float32)
    return np.rint(a[:, :, :3].astype(np.float32) @ LUMA)


def _overlap(n, m):
    """(m, n) weights that average n cells into m by area."""
    edge = np.linspace(0, n, m + 1)
    lo, hi = edge[:-1, None], edge[1:, None]
    cell = np.arange(n)[None, :]
    w = np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None)
    return w / w.sum(1, keepdims=True)


def resize(a, height, width):
    """Area average when shrinking, bilinear between cell centres when enlarging."""
    def along(n, m):
        if m <= n:
            return _overlap(n, m)
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        i = np.minimum(at.astype(int), max(n - 2, 0))
        w = np.zeros((m, n))
        w[np.arange(m), i] = 1 - (at - i)
        if n > 1:
            w[np.arange(m), i + 1] = at - i
        return w

    return along(a.shape[0], height) @ a.astype(np.float64) @ along(a.shape[1], width).T


def _dct(n):
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


DCT32 = _dct(32)


def perceptual_hash(a):
    """64 bits of the low 8x8 frequencies of a 32x32 reduction, as a signed integer."""
    low = (DCT32 @ resize(a, 32, 32) @ DCT32.T)[:8, :8]
    bits = (low > (low.sum() - low[0, 0]) / 63).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def _reflect(a):
    return np.pad(a, [(1, 1), (1, 1)], mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")


def sharpness(a):
    """Population variance of the Laplacian at a common size."""
    p = _reflect(resize(a, config.SHARPNESS_SIDE, config.SHARPNESS_SIDE))
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


@functools.lru_cache(2)
def _ring(h, w):
    """The whole distance of each term of a half spectrum from the zero frequency."""
    return np.hypot((np.fft.fftfreq(h) * h)[:, None], np.arange(w // 2 + 1)[None, :]).astype(int).ravel()


def effective_resolution(a):
    """(share of the Nyquist radius that carries signal, that share of the short side)."""
    short = min(a.shape)
    if short < 3:
        return 0.0, 0.0
    if max(a.shape) > config.SPECTRUM_MAX_SIDE:
        s = config.SPECTRUM_MAX_SIDE / max(a.shape)
        a = resize(a, int(a.shape[0] * s), int(a.shape[1] * s))
    h, w = a.shape
    half = np.fft.rfft2(a)
    power = half.real**2 + half.imag**2
    power[:, 1 : (w + 1) // 2] *= 2  # columns that stand for two of the whole spectrum
    rings = min(h // 2, w // 2)
    mean = np.bincount(_ring(h, w), power.ravel())[:rings] / np.arange(1, rings + 1)
    curve = np.convolve(np.log(mean + 1e-8), np.full(5, 0.2), mode="same")
    above = np.flatnonzero(curve[1:rings] > np.median(curve[-max(5, rings // 20) :]) + 0.5)
    share = (above[-1] + 1 if len(above) else 1) / rings
    return float(share), float(share * short)


def noise(a):
    """Immerkaer's estimate; border pixels are in the sum, as the divisor is not."""
    h, w = a.shape
    if min(h, w) < 3:
        return 0.0
    p = _reflect(a.astype(np.float64))
    rows = p[:-2] - 2 * p[1:-1] + p[2:]
    both = rows[:, :-2] - 2 * rows[:, 1:-1] + rows[:, 2:]
    return float(np.abs(both).sum() * np.sqrt(np.pi / 2) / (6 * (w - 2) * (h - 2)))


def blockiness(a):
    """Step strength at 8-pixel boundaries beyond the mean step, not below 0."""
    excess = 0.0
    for d in (np.abs(np.diff(a, axis=1)), np.abs(np.diff(a, axis=0)).T):
        if d.size:
            at = d[:, config.BLOCK - 1 :: config.BLOCK]
            excess += (at.mean() if at.size else 0.0) - d.mean()
    return float(max(excess / 2, 0.0))


@functools.cache
def optional(name):
    """A module that need not be installed, or None."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def _number(score):
    """What a scorer gives, or None where it fails: a failed score is a missing one."""
    try:
        return float(score())
    except Exception:
        return None


def brisque(bgr):
    """None without the optional package."""
    package = optional("brisque")
    return None if package is None else _number(lambda: package.BRISQUE(url=False).score(img=np.ascontiguousarray(bgr[:, :, ::-1])))


def niqe(bgr):
    """None without the optional packages."""
    package, torch = optional("pyiqa"), optional("torch")
    if package is None or torch is None:
        return None
    return _number(lambda: package.create_metric("niqe")(torch.from_numpy(np.ascontiguousarray(bgr[:, :, ::-1]).transpose(2, 0, 1)[None] / np.float32(255))))


def colour(data, height, width, channels):
    """The BGR raster of row-major 8-bit data that `gray` accepts."""
    a = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def thumbnail(data, height, width, channels, side=config.PREVIEW_MAX_SIDE):
    """(width, height, RGB bytes) that fits in side x side with its aspect kept, never
    enlarged; a gray square where the image can't be read."""
    if gray(data, height, width, channels) is None:
        return side, side, bytes(PLACEHOLDER) * (side * side)
    a = colour(data, height, width, channels)[:, :, ::-1]
    scale = min(side / width, side / height, 1.0)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    if (h, w) != a.shape[:2]:
        a = np.stack([resize(a[:, :, c], h, w) for c in range(3)], axis=2)
    return w, h, np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()


def other_decoder():
    """A function from file bytes to a BGR raster for formats beyond Spark's, if PIL is there;
    HEIC needs its plugin as well."""
    pil = optional("PIL.Image")
    if pil is None:
        return None
    if optional("pillow_heif") is not None:
        optional("pillow_heif").register_heif_opener()

    def decode(content):
        with pil.open(io.BytesIO(content)) as image:
            return np.asarray(image.convert("RGB"))[:, :, ::-1]

    return decode


def decoded(path, content, decode):
    """An image struct as a dict; height -1 where it can't be decoded."""
    try:
        a = np.ascontiguousarray(decode(content))
        return {"origin": path, "height": a.shape[0], "width": a.shape[1], "nChannels": 3, "mode": 16, "data": a.tobytes()}
    except Exception:  # an unreadable file is a row without an image
        return {"origin": path, "height": -1, "width": -1, "nChannels": -1, "mode": -1, "data": b""}


def analyse(data, height, width, channels):
    """The metrics of one image as a dict, or None if it can't be read."""
    a = gray(data, height, width, channels)
    if a is None:
        return None
    share, px = effective_resolution(a)
    bgr = colour(data, height, width, channels)
    return {
        "dimensions": {"width": width, "height": height}, "sharpness_normalized": sharpness(a), "effective_resolution_fraction": share,
        "effective_resolution_px_equiv": px, "noise_sigma": noise(a), "blockiness": blockiness(a), "brisque": brisque(bgr), "niqe": niqe(bgr),
    }


def _each(image, work):
    """work(data, height, width, channels) of each image, one raster at a time: a row's bytes
    become Python's only for its own turn."""
    fields = [image.field(n) for n in ("data", "height", "width", "nChannels")]
    for i in range(len(image)):
        data, *shape = (f[i] for f in fields)
        yield work(data.as_buffer() if data.is_valid and image[i].is_valid else None, *(x.as_py() for x in shape))


def _hash(*image):
    g = gray(*image)
    return None if g is None else perceptual_hash(g)


def image_hash(image="image"):
    """Column: the perceptual hash of an image struct; null if it can't be read."""
    return F.arrow_udf(lambda c: pa.array(_each(c, _hash), pa.int64()), "long")(image)


def image_metrics(image="image"):
    """Column: the metric struct of an image struct; null if it can't be read."""
    def run(c: pa.Array) -> pa.Array:
        kind = pa.struct([("dimensions", pa.struct([("width", pa.int32()), ("height", pa.int32())])), *[(n, pa.float64()) for n in ("sharpness_normalized", "effective_resolution_fraction", "effective_resolution_px_equiv", "noise_sigma", "blockiness", "brisque", "niqe")]])
        return pa.array(_each(c, analyse), kind)

    return F.arrow_udf(run, METRIC_TYPE)(image)


def image_thumbnail(image="image", side=config.PREVIEW_MAX_SIDE):
    """Column: struct<width, height, data> of RGB bytes, the placeholder if it can't be read."""
    def run(c: pa.Array) -> pa.Array:
        kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
        return pa.array((dict(zip(("width", "height", "data"), t)) for t in _each(c, lambda *x: thumbnail(*x, side))), kind)

    return F.arrow_udf(run, "struct<width:int,height:int,data:binary>")(image)


def other_formats(path, content, decode=None):
    """Column: an image struct from a file's bytes, by the optional decoder."""
    def run(p: pa.Array, c: pa.Array) -> pa.Array:
        with_ = decode or other_decoder()
        kind = pa.struct([("origin", pa.string()), *[(n, pa.int32()) for n in ("height", "width", "nChannels", "mode")], ("data", pa.binary())])
        return pa.array((decoded(a.as_py(), b.as_buffer() if b.is_valid else None, with_) for a, b in zip(p, c)), kind)

    return F.arrow_udf(run, IMAGE_TYPE)(path, content)
