"""Pictures that are too large to decode say so."""

import struct

import pytest

from plenumlens.llm import gif


def forged(width, height, frame_width, frame_height):
    return (b"GIF89a" + struct.pack("<HHBBB", width, height, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, frame_width, frame_height, 0x80)
            + bytes(6) + b"\x02\x02\x4c\x01\x00;")


@pytest.mark.parametrize("sizes", [(65_000, 65_000, 1, 1), (1, 1, 65_000, 65_000)])
def test_too_large(spark, sizes):
    with pytest.raises(gif.PictureTooLarge):
        list(gif.read_gif(forged(*sizes)))
    rows = [(1, forged(*sizes)), (2, gif.write_gif(gif.padded(b"text"))), (3, b"no picture"), (4, None)]
    got = {r.id: r.frames for r in gif.with_frames(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[1] is None and len(got[2]) == 1 and got[3] == [] and got[4] == []
