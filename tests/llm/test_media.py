"""The stored media's colour histograms, counted again from the texts, and media that are damaged."""

import struct

import numpy as np
import pytest

from opsloom.llm import gif
from tests.llm.brute import documents


def recounted(text):
    raw = text.encode()
    rows = np.frombuffer(raw.ljust(max(1, -(-len(raw) // 192)) * 192), np.uint8).reshape(-1, 192)
    frames = [rows[i : i + gif.FRAME_ROWS] for i in range(0, len(rows), gif.FRAME_ROWS)]
    canvas, said = np.zeros((len(frames[0]), 192), np.uint8), []
    for frame in frames:
        canvas[: len(frame)] = frame
        counts = np.zeros(64, int)
        # grey has the same two high bits in red, green and blue
        counts[[0, 21, 42, 63]] = np.bincount((canvas >> 6).ravel(), minlength=4)
        said.append(",".join(map(str, counts)))
    return ";".join(said)


def test_features_are_recounted(spark, sf):
    texts = dict(documents(spark, sf))
    found = {r["doc_id"]: r["feature"] for r in gif.op4_gif_media(spark, sf).select("doc_id", "feature").collect()}
    assert found == {i: recounted(t) for i, t in texts.items()}


def test_features_over_several_frames(spark):
    text = "".join(chr(33 + k % 90) for k in range(192 * (2 * gif.FRAME_ROWS + 5)))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    frames = gif.media_columns(gif.store_texts(docs)).first()["frames"]
    assert [f["height"] for f in frames] == [gif.FRAME_ROWS, gif.FRAME_ROWS, 5]
    assert ";".join(",".join(map(str, f["histogram"])) for f in frames) == recounted(text)


WHOLE = gif.write_gif([np.arange(12, dtype=np.uint8).reshape(3, 4), np.full((2, 2), 9, np.uint8)])
HEAD = b"GIF89a" + struct.pack("<HHBBB", 4, 3, 0, 0, 0)
IMAGE = b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 3, 0)


def fault_of(data):
    try:
        list(gif.read_gif(data))
    except gif.Damaged as why:
        return str(why)


def test_media_cut_off_anywhere():
    assert fault_of(WHOLE) is None
    for n in range(len(WHOLE)):
        assert fault_of(WHOLE[:n]) == ("not a GIF" if n < 3 else "cut off")


@pytest.mark.parametrize(
    "data,why",
    [
        (b"\x89PNG", "not a GIF"),
        (b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b", "too many pixels"),
        (HEAD + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0x80) + bytes(6) + b"\x02\0\x3b", "too many pixels"),
        (HEAD + IMAGE + b"\x02\0\x3b", "no palette"),
        (HEAD + b"\x07\x3b", "unknown block"),
        (HEAD + IMAGE[:-1] + b"\x80" + bytes(6) + b"\x0c\0\x3b", "unknown code size"),
        (HEAD + IMAGE[:-1] + b"\x80" + bytes(6) + b"\x02\0\x3b", "samples missing"),
        (HEAD + IMAGE[:-1] + b"\x80" + bytes(6) + b"\x02\x01\xff\0\x3b", "code without an entry"),
    ],
)
def test_damaged_media_say_why(data, why):
    assert fault_of(data) == why


def test_flipped_bytes_never_end_the_job(spark):
    rng = np.random.default_rng(3)
    rows = [(0, WHOLE), (1, None), (2, b"")]
    for k in range(300):
        data = bytearray(WHOLE)
        # what is said about canvas and frames, and the streams; not the palette
        for at in rng.choice([*range(13), *range(781, len(WHOLE))], 2, replace=False):
            data[at] = rng.integers(256)
        rows.append((3 + k, bytes(data)))
    found = {r["i"]: r for r in gif.media_columns(spark.createDataFrame(rows, "i long, media binary"), "media").collect()}
    assert len(found) == len(rows)
    assert found[0]["fault"] is None and [f["height"] for f in found[0]["frames"]] == [3, 2]
    assert all(found[i]["frames"] == [] and found[i]["samples"] == b"" and found[i]["fault"] is None for i in (1, 2))
    assert all((r["fault"] is None) == (r["frames"] is not None) == (r["samples"] is not None) for r in found.values())
    assert len({r["fault"] for r in found.values()}) > 3
