"""Column functions over image payloads: base64, format, MIME, dimensions, colour mode."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from glyphflow.settings import (
    ALLOWED_EXTENSIONS,
    MIME_TO_EXTENSION,
    RIFF_SIGNATURE,
    SIGNATURES,
    WEBP_TAG,
)

# Fixed value: the characters a whitespace strip removes at both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DATA_URI_MARK = "base64,"
SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def strip_text(text: Column) -> Column:
    """Strip Unicode whitespace at both ends (`trim` alone removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def base64_body(payload: Column) -> Column:
    """The text to decode: what stands between the first and the second data-URI mark, stripped."""
    return strip_text(
        F.when(
            F.contains(payload, F.lit(DATA_URI_MARK)),
            F.split(payload, DATA_URI_MARK, 3)[1],
        ).otherwise(payload)
    )


def decode_base64(df: DataFrame, payload: str, *, content: str = "content", error: str = "decode_error") -> DataFrame:
    """Replace the text column `payload` by its decoded bytes and the error of texts that cannot be decoded.

    Decoding is lenient: a data-URI prefix is dropped, characters outside the
    alphabet are skipped, and reading ends at the first padding that completes
    a group of four. Texts with non-ASCII characters and groups left
    incomplete are errors. The steps are columns of their own, so none of
    them is computed twice.
    """
    body, kept, plain, state = F.col("_body"), F.col("_kept"), F.col("_plain"), F.col("_state")
    # Most texts are clean; the possessive test is several times cheaper than replacing nothing.
    clean = F.rlike(body, F.lit("^[A-Za-z0-9+/]*+=*+$"))
    skipped = F.regexp_replace(body, "[^A-Za-z0-9+/=]+", "")
    out = (
        df.withColumn("_body", base64_body(F.col(payload)))
        .drop(payload)
        .withColumn("_ascii", F.octet_length(body) == F.char_length(body))
        .withColumn("_kept", F.when(F.col("_ascii"), F.when(clean, body).otherwise(skipped)))
        .drop("_body")
        .withColumn("_plain", F.rtrim(kept, F.lit("=")))
    )
    filled = F.length(plain) % 4
    pads = F.length(kept) - F.length(plain)
    simple = F.struct(plain.alias("data"), ((filled >= 2) & (filled + pads >= 4)).alias("done"))
    walked = _read_to_padding(kept)
    out = out.withColumn(
        "_state",
        F.when(F.contains(plain, F.lit("=")), walked).otherwise(simple),
    )
    size = F.length(state["data"])
    problem = (
        F.when(F.col("_ascii").isNull(), F.lit(None).cast("string"))
        .when(~F.col("_ascii"), F.lit("string argument should contain only ASCII characters"))
        .when(state["done"] | (size % 4 == 0), F.lit(None).cast("string"))
        .when(
            size % 4 == 1,
            F.concat(
                F.lit("Invalid base64-encoded string: number of data characters ("),
                size.cast("string"),
                F.lit(") cannot be 1 more than a multiple of 4"),
            ),
        )
        .otherwise(F.lit("Incorrect padding"))
    )
    out = out.withColumn(error, F.concat(F.lit("Invalid base64 data: "), problem))
    padded = F.concat(state["data"], F.repeat(F.lit("="), F.pmod(-size, F.lit(4))))
    return out.withColumn(content, F.when(F.col(error).isNull(), F.unbase64(padded))).drop(
        "_ascii", "_kept", "_plain", "_state"
    )


def _read_to_padding(kept: Column) -> Column:
    """struct<data, done> of a text with '=' inside: walk the pieces between the '=' signs.

    A sign counts only after two or three characters of a group; text after it
    resets the count. The walk sees lengths only, and the text is cut once.
    """
    pieces = F.split(kept, "=")
    sizes = F.transform(pieces, lambda piece: F.length(piece))
    start = F.struct(
        F.element_at(sizes, 1).alias("size"), F.lit(1).alias("used"), F.lit(0).alias("pads"), F.lit(False).alias("done")
    )

    def step(state: Column, size: Column) -> Column:
        filled = state["size"] % 4
        seen = F.when(filled >= 2, state["pads"] + 1).otherwise(state["pads"])
        done = state["done"] | ((filled >= 2) & (filled + seen >= 4))
        return F.struct(
            F.when(done, state["size"]).otherwise(state["size"] + size).alias("size"),
            F.when(done, state["used"]).otherwise(state["used"] + 1).alias("used"),
            F.when(size > 0, F.lit(0)).otherwise(seen).alias("pads"),
            done.alias("done"),
        )

    walked = F.aggregate(F.slice(sizes, 2, F.greatest(F.size(sizes) - 1, F.lit(0))), start, step)
    return F.struct(F.array_join(F.slice(pieces, F.lit(1), walked["used"]), "").alias("data"), walked["done"].alias("done"))


def encode_base64(content: Column, mime: Column | str = "image/jpeg") -> Column:
    """Data URI of binary content (this `base64` breaks lines, a data URI must not)."""
    mime_col = F.lit(mime) if isinstance(mime, str) else mime
    text = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), mime_col, F.lit(";base64,"), text)


def detect_format(content: Column) -> Column:
    """Image format by magic bytes; null when unknown."""
    chain = None
    for mark, name in SIGNATURES:
        test = F.startswith(content, F.lit(mark))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    webp = F.startswith(content, F.lit(RIFF_SIGNATURE)) & (
        F.substring(content, 9, 4) == F.lit(WEBP_TAG)
    )
    return chain.when(webp, F.lit("webp"))


def extension_of_mime(mime: Column) -> Column:
    """Extension for a MIME type; null when unknown."""
    pairs = [F.lit(x) for pair in MIME_TO_EXTENSION.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), mime)


def extension_of_path(path: Column) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_allowed_extension(path: Column) -> Column:
    return extension_of_path(path).isin(ALLOWED_EXTENSIONS)


def _big_endian(content: Column, start: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, n)), 16, 10).cast("bigint")


def _little_endian(content: Column, start: int, n: int) -> Column:
    parts = [F.hex(F.substring(content, start + i, 1)) for i in reversed(range(n))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def _jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first frame header; segments before it are skipped by their length."""
    if data is None:
        return None
    at, end = 2, len(data)
    while at + 4 <= end:
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a body
            at += 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > end:
                return None
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if marker in (0xD9, 0xDA):  # picture data or end before any frame header
            return None
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(SIZE)
def jpeg_dimensions(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Frame size of JPEG content; null for null or unreadable content."""
    for content in batches:
        sizes = [_jpeg_size(data) for data in content]
        yield pd.DataFrame(
            {
                "width": pd.array([s[0] if s else None for s in sizes], dtype="Int64"),
                "height": pd.array([s[1] if s else None for s in sizes], dtype="Int64"),
            }
        )


def header_dimensions(content: Column, format_name: Column) -> Column:
    """struct<width, height> of PNG and BMP content, read from the header inside the JVM."""
    png_ok = (F.length(content) >= 24) & (F.substring(content, 13, 4) == F.lit(b"IHDR"))
    bmp_ok = F.length(content) >= 26
    raw_height = _little_endian(content, 23, 4)
    # A negative height means rows stored top-down.
    bmp_height = F.abs(F.when(raw_height >= 2**31, raw_height - 2**32).otherwise(raw_height))
    return (
        F.when(
            (format_name == "png") & png_ok,
            F.struct(_big_endian(content, 17, 4).alias("width"), _big_endian(content, 21, 4).alias("height")),
        )
        .when(
            (format_name == "bmp") & bmp_ok,
            F.struct(_little_endian(content, 19, 4).alias("width"), bmp_height.alias("height")),
        )
        .otherwise(F.lit(None).cast(SIZE))
    )


def probe_dimensions(content: Column, format_name: Column) -> Column:
    """struct<width, height>: PNG and BMP in the JVM, JPEG in Arrow batches (only JPEG bytes are sent).

    TIFF and WebP give null; see `dimension_reason`.
    """
    jpeg = jpeg_dimensions(F.when(format_name == "jpeg", content))
    return F.when(format_name == "jpeg", jpeg).otherwise(header_dimensions(content, format_name))


def dimension_reason(format_name: Column, size: Column) -> Column:
    """Why a size is missing: unknown format, a format whose size is not read, or a broken header."""
    return (
        F.when(size["width"].isNotNull(), F.lit(None).cast("string"))
        .when(format_name.isNull(), F.lit("unsupported_format"))
        .when(format_name.isin("tiff", "webp"), F.lit("size_not_read"))
        .otherwise(F.lit("unreadable_header"))
    )


def png_colour_mode(content: Column) -> Column:
    """Colour mode from the PNG colour-type byte. 0 L, 2 RGB, 3 P, 4 LA, 6 RGBA."""
    kind = F.conv(F.hex(F.substring(content, 26, 1)), 16, 10).cast("int")
    return (
        F.when(kind == 0, F.lit("L"))
        .when(kind == 2, F.lit("RGB"))
        .when(kind == 3, F.lit("P"))
        .when(kind == 4, F.lit("LA"))
        .when(kind == 6, F.lit("RGBA"))
    )


def colour_action(mode: Column) -> Column:
    """What has to happen to an image of this mode: flatten on white, keep, or convert to RGB."""
    return (
        F.when(mode.isNull(), F.lit(None).cast("string"))
        .when(mode == "RGBA", F.lit("flatten"))
        .when(mode.isin("RGB", "L", "1"), F.lit("keep"))
        .otherwise(F.lit("convert"))
    )
