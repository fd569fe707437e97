"""Image analyzers: resolution, quality, duplicates, damage, channels.

One pass reads each file once: headers and hashes come from the bytes, pixels from
Spark's image source, and one row of features a file goes to all five analyzers.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.model import Chart, Dataset
from quarrylens.operators.base import Analyzer, error, info, register, rows_of, warning
from quarrylens.plans.shared import save
from quarrylens.sources.sampling import SEED

#: Aspect names in the order they are tried, reference channel means, bucket limits.
ASPECTS = (("1:1", 1.0, 0.05), ("4:3", 4 / 3, 0.1), ("3:4", 3 / 4, 0.1), ("16:9", 16 / 9, 0.1), ("9:16", 9 / 16, 0.1), ("3:2", 3 / 2, 0.1), ("2:3", 2 / 3, 0.1))
REFERENCE_MEANS = (0.485, 0.456, 0.406)
SMALL, LARGE = 32, 8000
DARK, BRIGHT, BLURRY = 0.15, 0.85, 50
NEAR_BITS = 8
LEAK_SPLITS = ("train", "training", "test", "testing", "val", "validation")
THUMBNAIL = 256
MOST_PROBES = 5_000  # values that a hash probes in one chunk
BLOCK = 32_768  # hashes compared with as many others in one piece of work
LEAST_BLOCKS, SMALL_BLOCK = 8, 1_024  # blocks of fewer hashes, as far as these are enough to share out
STRIP = 16  # hashes whose distances to a block are held at once
PAIRS_A_PROBE = 200  # comparisons within blocks that take as long as one row probed in the index


# ---------------------------------------------------------------- bytes and pixels


def header(data: bytes) -> tuple[str | None, int, int, str | None]:
    """(format, width, height, mode) from the first bytes; nothing is decoded."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        w, h = struct.unpack(">II", data[16:24])
        return "PNG", w, h, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(data[25])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
                return "JPEG", w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(channels)
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0] if marker not in (0x01, 0xFF, *range(0xD0, 0xD8)) else 2 - (marker == 0xFF)
        return "JPEG", 0, 0, None
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "GIF", *struct.unpack("<HH", data[6:10]), "P"
    if data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return "BMP", w, abs(h), "RGBA" if bits == 32 else "RGB" if bits == 24 else "P"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "RGBA" if data[20] & 16 else "RGB"
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA"
        return "WEBP", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30])), "RGB"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "TIFF", *_tiff(data)
    return None, 0, 0, None


def _tiff(data: bytes) -> tuple[int, int, str | None]:
    order = "<" if data[:2] == b"II" else ">"
    try:
        at = struct.unpack_from(order + "I", data, 4)[0]
        tags = {}
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            tags[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
        return tags.get(256, 0), tags.get(257, 0), {1: "L", 3: "RGB", 4: "RGBA"}.get(tags.get(277, 1))
    except struct.error:
        return 0, 0, None


def averaged(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box filter down to a size; rows and columns are repeated where the image is smaller."""
    for axis, size in ((0, height), (1, width)):
        n = pixels.shape[axis]
        edges = np.arange(size) * n // size
        if n < size:
            pixels = np.take(pixels, edges, axis=axis)
        else:
            spans = np.diff(np.append(edges, n)).reshape([-1 if a == axis else 1 for a in range(pixels.ndim)])
            pixels = np.add.reduceat(pixels, edges, axis=axis) / spans
    return pixels


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest DCT coefficients of a 32 x 32 image are over their median."""
    n = 32
    small = averaged(gray, n, n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def pixel_features(rgb: np.ndarray) -> dict[str, float]:
    scaled = rgb.astype(np.float64)
    h, w = rgb.shape[:2]
    ratio = min(1.0, THUMBNAIL / max(h, w))
    thumb = averaged(scaled, max(1, round(h * ratio)), max(1, round(w * ratio))) if ratio < 1 else scaled
    gray = thumb @ np.array([0.299, 0.587, 0.114])
    edges = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1] if min(gray.shape) >= 3 else np.zeros(1)
    means, stds = scaled.mean(axis=(0, 1)) / 255, scaled.std(axis=(0, 1)) / 255
    out = {"brightness": gray.mean() / 255, "contrast": gray.std() / 128, "blur": edges.var(), "phash": perceptual_hash(scaled @ np.array([0.299, 0.587, 0.114]))}
    return out | {f"mean_{c}": means[k] for k, c in enumerate("rgb")} | {f"std_{c}": stds[k] for k, c in enumerate("rgb")}


FEATURES = ["brightness", "contrast", "blur", "phash", "mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b"]
FEATURE_SCHEMA = "path string, decoded boolean, " + ", ".join(f"{f} {'long' if f == 'phash' else 'double'}" for f in FEATURES)
HEADER_SCHEMA = "path string, sha256 string, format string, width int, height int, mode string"
PLAIN_PATH = r"^file:/+"


def _headers(batches):
    for batch in batches:
        rows = [(p, hashlib.sha256(c).hexdigest(), *header(bytes(c))) for p, c in zip(batch["path"], batch["content"])]
        yield pd.DataFrame(rows, columns=["path", "sha256", "format", "width", "height", "mode"])


def _pixels(batches):
    for batch in batches:
        rows = []
        for path, h, w, channels, data in zip(batch["path"], batch["height"], batch["width"], batch["channels"], batch["data"]):
            if h <= 0:
                rows.append([path, False] + [None] * len(FEATURES))
                continue
            bgr = np.frombuffer(bytes(data), np.uint8).reshape(h, w, channels)
            rgb = bgr[:, :, [2, 1, 0]] if channels >= 3 else np.repeat(bgr[:, :, :1], 3, axis=2)
            values = pixel_features(rgb)
            rows.append([path, True] + [values[f] for f in FEATURES])
        out = pd.DataFrame(rows, columns=["path", "decoded", *FEATURES])
        out["phash"] = out["phash"].astype("Int64")
        yield out


def image_features(images: DataFrame) -> DataFrame:
    """images (path, size_bytes, split, label ...) with header, hash and pixel features; files that are empty have none."""
    spark = images.sparkSession
    paths = [r["path"] for r in images.where("size_bytes > 0").select("path").collect()]  # the driver has listed these files
    if not paths:
        return images.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for s in (HEADER_SCHEMA, FEATURE_SCHEMA) for c in s.split(", ")) if n != "path"])
    plain = lambda c: F.regexp_replace(c, PLAIN_PATH, "/")
    raw = spark.read.format("binaryFile").load(paths).select(plain("path").alias("path"), "content").mapInPandas(_headers, HEADER_SCHEMA)
    decoded = spark.read.format("image").option("dropInvalid", False).load(paths).select(plain("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return images.join(raw, "path", "left").join(decoded.mapInPandas(_pixels, FEATURE_SCHEMA), "path", "left")


def features_of(dataset: Dataset) -> DataFrame:
    """Computed once a dataset: five analyzers share the rows."""
    if not hasattr(dataset, "_image_features"):
        images = dataset.images
        if dataset.sample_size:
            images = images.orderBy(F.xxhash64(F.lit(SEED), "path")).limit(dataset.sample_size)
        dataset._image_features = image_features(images).persist()
    return dataset._image_features


# ---------------------------------------------------------------- plans


def aspect_column(width, height):
    ratio = width / height
    out = F.format_string("%.2f", ratio)
    for name, value, tolerance in reversed(ASPECTS):
        out = F.when(F.abs(ratio - F.lit(value)) < tolerance, F.lit(name)).otherwise(out)
    return out


def chunks_for(max_bits: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of chunks of a 64-bit hash such that two hashes within max_bits differ by at most its radius in one of them.

    With max_bits = q * chunks + a, one of the first a + 1 chunks differs by at most q bits
    or one of the others by at most q - 1.  Few chunks need many probes, many chunks have
    many hashes in common; the number with the least of both together for n hashes is taken.
    """
    best = None
    for m in range(1, min(max_bits + 1, 64) + 1):
        q, a = divmod(max_bits, m)
        edges = [64 * k // m for k in range(m + 1)]
        found = [(edges[k], edges[k + 1] - edges[k], q if k <= a else q - 1) for k in range(m)]
        found = [c for c in found if c[2] >= 0]
        probes = [sum(comb(bits, r) for r in range(radius + 1)) for _, bits, radius in found]
        cost = sum(probes) + sum(n * p / 2.0**bits for p, (_, bits, _) in zip(probes, found))
        if max(probes) <= MOST_PROBES and (best is None or cost < best[0]):
            best = (cost, found)
    return best[1]


def hamming_pairs(hashes: DataFrame, max_bits: int = NEAR_BITS) -> DataFrame:
    """hashes (id, hash) -> (id_a, id_b, distance) with 1 <= distance <= max_bits, id_a the smaller.

    Equal hashes are one entry.  Either entries meet in an index by chunks, or all are compared
    in blocks, whichever is less work for so many entries: chunks of few bits hardly tell
    hashes apart at large distances.  No pair is missed either way.
    """
    entries = save(hashes.groupBy("hash").agg(F.count("*").alias("n")).select("hash"), "hashes")
    n = entries.count()
    near = index_pairs(entries, n, max_bits) if by_index(n, max_bits) else block_pairs(entries, n, max_bits)
    a, b = (hashes.select(F.col("hash").alias(name), F.col("id").alias(f"id_{name}")) for name in ("probe", "hash"))
    pairs = near.join(a, "probe").join(b, "hash")
    return pairs.select(F.least("id_probe", "id_hash").alias("id_a"), F.greatest("id_probe", "id_hash").alias("id_b"), "distance")


def by_index(n: int, max_bits: int) -> bool:
    """Whether probing n entries in the index is less work than comparing all of them."""
    probes = [(sum(comb(bits, r) for r in range(radius + 1)), bits) for _, bits, radius in chunks_for(max_bits, n)]
    return PAIRS_A_PROBE * sum(p + n * p / 2.0**bits for p, bits in probes) < n / 2


def index_pairs(entries: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(probe, hash, distance) of n different hashes, each pair once with probe < hash.

    An index by the values of their chunks; every entry probes the values within each chunk's
    radius of its own, so hashes meet only under values that nearly agree in some chunk.
    """
    index = chunks_for(max_bits, n)
    value = lambda first, bits: F.shiftrightunsigned("hash", first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))
    kept = entries.select("hash", F.inline(F.array(*[F.struct(F.lit(k).alias("chunk"), value(first, bits).alias("value")) for k, (first, bits, _) in enumerate(index)])))
    masks = [(k, sum(1 << b for b in flips)) for k, (_, bits, radius) in enumerate(index) for r in range(radius + 1) for flips in combinations(range(bits), r)]
    table = entries.sparkSession.createDataFrame([(k, mask - (1 << 64) if mask >> 63 else mask) for k, mask in masks], "chunk int, mask long")  # some hundred rows, MOST_PROBES a chunk at most
    probed = kept.join(F.broadcast(table), "chunk").select(F.col("hash").alias("probe"), "chunk", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    met = probed.join(kept, ["chunk", "value"]).where("probe < hash")
    distance = F.bit_count(F.col("probe").bitwiseXOR(F.col("hash")))
    return met.where(distance <= max_bits).select("probe", "hash", distance.alias("distance")).distinct()


def block_pairs(entries: DataFrame, n: int, max_bits: int) -> DataFrame:
    """The same by comparing every two of n different hashes, a block with another at a time.

    Work grows with the square of n, at some 2 ns a pair; a task holds two blocks and some
    rows of distances, whatever n.  Blocks are dealt by hash, every two of them once.
    """
    blocks = max(-(-n // BLOCK), min(LEAST_BLOCKS, n // SMALL_BLOCK), 1)
    cells = blocks * (blocks + 1) // 2
    dealt = save(entries.groupBy(F.pmod(F.xxhash64("hash"), F.lit(blocks)).alias("block")).agg(F.collect_list("hash").alias("hashes")), "hash-blocks")
    one = dealt.select(F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(blocks - 1).cast("long"))).alias("b"), F.col("hashes").alias("one"))
    other = dealt.select(F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("a"), F.col("block").alias("b"), F.col("hashes").alias("other"))
    met = one.join(other, ["a", "b"]).repartition(cells)  # each two blocks are a task's work

    def compare(batches):
        for batch in batches:
            for same, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                for at in range(0, len(a), STRIP):
                    strip = a[at : at + STRIP]
                    against = b[at:] if same else b
                    distance = np.bitwise_count((strip[:, None] ^ against).view(np.uint64))  # of signed numbers it counts the absolute value's bits
                    i, j = np.divmod(np.flatnonzero(distance <= max_bits), max(len(against), 1))
                    if same:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        x, y = strip[i], against[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(distance[i, j].astype(np.int32))], ["probe", "hash", "distance"])

    return met.select((F.col("a") == F.col("b")).alias("same"), "one", "other").mapInArrow(compare, "probe long, hash long, distance int")


def leaks(hashes: DataFrame) -> DataFrame:
    """hashes (split, hash) -> (split_a, split_b, shared): different hashes found in two splits."""
    each = hashes.where("split IS NOT NULL AND hash IS NOT NULL").distinct()
    pairs = each.alias("a").join(each.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("a.split") < F.col("b.split")))
    return pairs.groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(F.count("*").alias("shared"))


def exact_groups(features: DataFrame) -> DataFrame:
    """sha256, n of files with equal bytes."""
    return features.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")


def near_pairs(features: DataFrame, max_bits: int = NEAR_BITS) -> DataFrame:
    """Pairs of a file and the first file of each earlier perceptual hash within max_bits, equal hashes left out."""
    ordered = features.where("phash IS NOT NULL").select("path", "phash")
    first = ordered.groupBy("phash").agg(F.min("path").alias("first_path"))
    pairs = hamming_pairs(first.select(F.col("first_path").alias("id"), F.col("phash").alias("hash")), max_bits)
    later = pairs.select(F.col("id_a").alias("first_path"), F.col("id_b").alias("other"), "distance")
    either = later.unionByName(later.select(F.col("other").alias("first_path"), F.col("first_path").alias("other"), "distance"))
    members = ordered.join(first, "phash").select("path", F.col("first_path").alias("other"))
    return either.join(members, "other").where("first_path < path").select("first_path", "path", "distance")


def damage(images: DataFrame, features: DataFrame) -> DataFrame:
    """path, issue: zero_size, truncated or corrupted. Formats without a reader here are not judged."""
    joined = images.select("path", "size_bytes").join(features.select("path", "decoded", "format", "width"), "path", "left")
    issue = F.when(F.col("size_bytes") == 0, "zero_size").when(F.col("format") == "WEBP", None).when(~F.coalesce("decoded", F.lit(False)) & F.col("format").isNotNull() & (F.col("width") > 0), "truncated").when(~F.coalesce("decoded", F.lit(False)), "corrupted")
    return joined.select("path", issue.alias("issue")).where("issue IS NOT NULL")


def resolution_stats(features: DataFrame) -> DataFrame:
    """One row over files with a size in pixels: bounds and means of width, height and bytes, small, large, different sizes and modes."""
    return features.where("width > 0 AND height > 0").agg(
        F.count("*").alias("images_analyzed"), *[f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))],
        *[F.round(F.avg(c), 1).alias(f"mean_{c}") for c in ("width", "height", "size_bytes")],
        F.count_if((F.col("width") < SMALL) | (F.col("height") < SMALL)).alias("small"), F.count_if((F.col("width") > LARGE) | (F.col("height") > LARGE)).alias("large"),
        F.count_distinct("width", "height").alias("unique_resolutions"), F.count_distinct("mode").alias("modes"),
    )


def quality_stats(features: DataFrame) -> DataFrame:
    """One row over decoded files: dark, bright and blurry ones, mean and spread of brightness, contrast and blur."""
    return features.where("decoded").agg(
        F.count("*").alias("images_analyzed"), F.count_if(F.col("brightness") < DARK).alias("dark"), F.count_if(F.col("brightness") > BRIGHT).alias("bright"), F.count_if(F.col("blur") < BLURRY).alias("blurry"),
        *[F.round(f(c), 4).alias(f"{c}_{n}") for c in ("brightness", "contrast", "blur") for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )


# ---------------------------------------------------------------- analyzers


class ImageAnalyzer(Analyzer):
    requires = frozenset({"images"})

    def counts(self, rows: DataFrame, column, k: int = 10) -> list[dict]:
        return list(rows_of(rows.groupBy(column.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)))


class Resolution(ImageAnalyzer):
    id, name = "image_resolution", "Image resolution"

    def run(self, dataset: Dataset):
        rows = features_of(dataset).where("width > 0 AND height > 0")
        m = next(rows_of(resolution_stats(rows)))
        if not m["images_analyzed"]:
            return self.skipped("no readable image")
        found = []
        if m["small"]:
            found.append(warning("very_small_images", "Very small images", f"{m['small']} images are under {SMALL} pixels on a side", count=m["small"]))
        if m["large"]:
            found.append(info("very_large_images", "Very large images", f"{m['large']} images are over {LARGE} pixels on a side", count=m["large"]))
        if m["unique_resolutions"] == 1:
            found.append(info("uniform_resolution", "One resolution", "All images have the same size"))
        elif m["unique_resolutions"] > 0.5 * m["images_analyzed"]:
            found.append(info("diverse_resolutions", "Many resolutions", f"{m['unique_resolutions']} sizes among {m['images_analyzed']} images"))
        if m["modes"] > 1:
            found.append(info("mixed_color_modes", "Several colour modes", f"{m['modes']} colour modes"))
        charts = [
            Chart("bar", title, self.counts(rows, column))
            for title, column in (("Resolutions", F.concat_ws("x", "width", "height")), ("Aspect ratios", aspect_column(F.col("width"), F.col("height"))), ("Colour modes", F.col("mode")), ("Formats", F.col("format")))
        ]
        return self.result(m, found, charts)


class Quality(ImageAnalyzer):
    id, name = "image_quality", "Image quality"

    def run(self, dataset: Dataset):
        rows = features_of(dataset).where("decoded")
        m = next(rows_of(quality_stats(rows)))
        if not m["images_analyzed"]:
            return self.skipped("no readable image")
        found = [warning(f"many_{kind}_images", f"Many {kind} images", f"{m[kind]} of {m['images_analyzed']} images are {kind}", count=m[kind]) for kind in ("dark", "bright", "blurry") if m[kind] > 0.1 * m["images_analyzed"]]
        from quarrylens.operators.tables import histogram

        charts = [Chart("histogram", c, list(rows_of(histogram(rows.select(c), c).orderBy("bin")))) for c in ("brightness", "contrast")]
        return self.result(m, found, charts)


class ImageDuplicates(ImageAnalyzer):
    id, name = "image_duplicates", "Duplicate images"

    def run(self, dataset: Dataset):
        rows = features_of(dataset)
        exact = next(rows_of(exact_groups(rows).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))))
        near = near_pairs(rows).count()
        splits = rows.select(F.lower("split").alias("split"), F.col("sha256").alias("hash")).where(F.col("split").isin(*LEAK_SPLITS))
        shared = leaks(splits).agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0]
        found = []
        if exact["extra"]:
            make = warning if exact["extra"] > 10 else info
            found.append(make("exact_duplicates", "Equal images", f"{exact['extra']} images repeat another byte for byte", groups=exact["groups"]))
        if near:
            found.append(warning("near_duplicates", "Similar images", f"{near} pairs of images look alike", pairs=near))
        if shared:
            found.append(error("cross_split_duplicates", "Images in two splits", f"{shared} images are in more than one split", count=shared))
        return self.result({"images_analyzed": rows.count(), "exact_duplicates": exact["extra"], "exact_groups": exact["groups"], "near_duplicates": near, "cross_split_duplicates": shared}, found)


class Corrupted(ImageAnalyzer):
    id, name = "corrupted_images", "Damaged images"

    def run(self, dataset: Dataset):
        features = features_of(dataset) if not dataset.sample_size else image_features(dataset.images)
        counts = {r["issue"]: r["count"] for r in damage(dataset.images, features).groupBy("issue").count().collect()}
        total, issues = dataset.images.count(), sum(counts.values())
        found = []
        if counts.get("corrupted"):
            found.append(error("corrupted_images", "Unreadable images", f"{counts['corrupted']} images cannot be decoded", count=counts["corrupted"]))
        if counts.get("truncated"):
            found.append(warning("truncated_images", "Cut images", f"{counts['truncated']} images end too early", count=counts["truncated"]))
        if counts.get("zero_size"):
            found.append(error("zero_size_images", "Empty files", f"{counts['zero_size']} images have no bytes", count=counts["zero_size"]))
        healthy = round(100 * (total - issues) / total, 2) if total else 100.0
        return self.result({"total_checked": total, "total_issues": issues, "healthy_pct": healthy} | {k: counts.get(k, 0) for k in ("corrupted", "truncated", "zero_size")}, found)


class ChannelStats(ImageAnalyzer):
    id, name = "image_channel_stats", "Colour channels"

    def run(self, dataset: Dataset):
        names = [f"{k}_{c}" for k in ("mean", "std") for c in "rgb"]
        m = next(rows_of(features_of(dataset).where("decoded").agg(*[F.round(F.avg(n), 4).alias(n) for n in names])))
        if m["mean_r"] is None:
            return self.skipped("no readable image")
        apart = sum(abs(m[f"mean_{c}"] - r) for c, r in zip("rgb", REFERENCE_MEANS))
        triple = lambda k: "[" + ", ".join(f"{m[f'{k}_{c}']:.4f}" for c in "rgb") + "]"
        finding = info("non_standard_rgb", "Unusual colours", f"Channel means are {apart:.2f} from common photographs") if apart > 0.3 else info("imagenet_like_rgb", "Common colours", "Channel means are near those of common photographs")
        return self.result({"Channel Means (RGB)": triple("mean"), "Channel Stds (RGB)": triple("std")}, [finding])


for _analyzer in (Resolution(), Quality(), ImageDuplicates(), Corrupted(), ChannelStats()):
    register(_analyzer)
