import base64
import random
import struct
import time

from pyspark.sql import functions as F

from glyphflow.functions import payload as p


def python_decode(text):
    if "base64," in text:
        text = text.split("base64,")[1]
    try:
        return base64.b64decode(text.strip()), None
    except Exception as error:
        return None, f"Invalid base64 data: {error}"


def decode_all(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    rows = p.decode_base64(df, "payload").collect()
    return {r["id"]: (None if r["content"] is None else bytes(r["content"]), r["decode_error"]) for r in rows}


def test_decode_matches_lenient_reading_on_hand_picked_texts(spark):
    texts = [
        "QUJD", "QUI=", "QQ==", "QUI", "Q", "", "====", "=", "QU!JD", "QUI=QUJD", "QQ=Q=", "QQ=!=", "Q=Q=", "Q===",
        "QUJD=", "QUJD====", "QQ==QQ==", "é", "QUJDé", " \t\n", " QUJD ", "\x1cQUJD\x1f", "QU\nJD\r\n",
        "data:image/png;base64,QUJD", "data:image/png;base64,QUJDbase64,QUI=", "base64,", "QUJDR", "QUJD-_", "QUI==",
        "Q" * 5, "=QUJD", "QU=JD", "QUJ=D=", "A" * 400 + "=" + "B" * 400,
    ]
    got = decode_all(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == python_decode(text), repr(text)


def test_decode_matches_lenient_reading_on_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("QUJDab01+/==== !\n") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = decode_all(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == python_decode(text), repr(text)


def test_decode_keeps_null(spark):
    df = spark.createDataFrame([(1, None)], "id int, payload string")
    row = p.decode_base64(df, "payload").first()
    assert row["content"] is None and row["decode_error"] is None


def test_encode_has_no_line_breaks_and_decodes_back(spark):
    content = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    uri = df.select(p.encode_base64(F.col("content"), "image/png").alias("u")).first()["u"]
    assert uri == "data:image/png;base64," + base64.b64encode(content).decode()
    assert decode_all(spark, [uri])[0][0] == content


def test_format_by_magic_bytes(spark):
    cases = [
        (b"\xff\xd8\xff\xe0", "jpeg"), (b"\x89PNG\r\n", "png"), (b"BM12", "bmp"), (b"II\x2a\x00", "tiff"),
        (b"MM\x00\x2a", "tiff"), (b"RIFF\x00\x00\x00\x00WEBP", "webp"), (b"RIFF\x00\x00\x00\x00WAVE", None),
        (b"RIFF\x00\x00\x00\x00WEB", None), (b"", None), (b"\x00\x01\x02", None), (b"\xff\xd8", None), (b"B", None),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "id int, content binary")
    got = {r["id"]: r["f"] for r in df.select("id", p.detect_format(F.col("content")).alias("f")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_mime_and_extension(spark):
    df = spark.createDataFrame(
        [("image/jpeg", "a/b.JPG"), ("image/tiff", "x.tif"), ("text/plain", "x.txt"), (None, "noext"), ("image/webp", "a.b/c")],
        "mime string, path string",
    )
    rows = df.select(
        p.extension_of_mime(F.col("mime")).alias("m"),
        p.extension_of_path(F.col("path")).alias("e"),
        p.is_allowed_extension(F.col("path")).alias("ok"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (".jpg", ".jpg", True), (".tiff", ".tif", True), (None, ".txt", False), (None, "", False), (".webp", "", False),
    ]


def png(width, height, kind=2):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">IIBB", width, height, 8, kind) + b"\0" * 5


def bmp(width, height):
    return b"BM" + b"\0" * 16 + struct.pack("<ii", width, height)


def jpeg(width, height, marker=0xC0, before=b""):
    return b"\xff\xd8" + before + b"\xff" + bytes([marker]) + struct.pack(">HBHH", 17, 8, height, width) + b"\x03"


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def test_dimensions(spark):
    # A thumbnail's frame header inside an application segment must not be taken for the picture's.
    thumbnail = segment(0xE1, b"Exif" + jpeg(16, 12))
    cases = [
        (png(640, 480), 640, 480, None), (png(2**31, 5), 2**31, 5, None), (bmp(300, 200), 300, 200, None),
        (bmp(300, -200), 300, 200, None), (jpeg(50, 60), 50, 60, None), (jpeg(7, 9, 0xC2), 7, 9, None),
        (jpeg(1000, 2000, before=thumbnail * 40), 1000, 2000, None),
        (jpeg(5, 6, before=segment(0xC4, b"tables") + b"\xff"), 5, 6, None),
        (b"\xff\xd8\xff\xd9", None, None, "unreadable_header"), (b"\xff\xd8\xffX", None, None, "unreadable_header"),
        (b"\x89PNG", None, None, "unreadable_header"), (b"BM12", None, None, "unreadable_header"),
        (b"II\x2a\x00....", None, None, "size_not_read"), (b"", None, None, "unsupported_format"),
    ]
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "id int, content binary")
    df = df.withColumn("f", p.detect_format(F.col("content")))
    df = df.withColumn("s", p.probe_dimensions(F.col("content"), F.col("f")))
    rows = df.select("id", "s.width", "s.height", p.dimension_reason(F.col("f"), F.col("s")).alias("reason")).collect()
    assert {r["id"]: tuple(r)[1:] for r in rows} == {i: c[1:] for i, c in enumerate(cases)}


def test_colour_mode_and_action(spark):
    kinds = {0: ("L", "keep"), 2: ("RGB", "keep"), 3: ("P", "convert"), 4: ("LA", "convert"), 6: ("RGBA", "flatten"), 9: (None, None)}
    df = spark.createDataFrame([(k, bytearray(png(1, 1, k))) for k in kinds], "k int, content binary")
    mode = p.png_colour_mode(F.col("content"))
    rows = df.select("k", mode.alias("m"), p.colour_action(mode).alias("a")).collect()
    assert {r["k"]: (r["m"], r["a"]) for r in rows} == kinds


def test_padding_inside_a_long_text_is_read_in_linear_time(spark):
    """Signs inside the text end the data at the first complete group; a million of them take seconds."""
    early = "AAA" + "=" + "AAAA" * 3  # complete after four characters
    long = "AAAA=" * 1_000_000  # a sign after a full group never counts
    df = spark.createDataFrame([(0, early), (1, long)], "id int, payload string")
    started = time.perf_counter()
    got = {r["id"]: (r["n"], r["decode_error"]) for r in p.decode_base64(df, "payload").select("id", F.length("content").alias("n"), "decode_error").collect()}
    assert got == {0: (2, None), 1: (3_000_000, None)}
    assert time.perf_counter() - started < 60
