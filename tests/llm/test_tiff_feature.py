"""The TIFF feature covers every page."""

import numpy as np

from harborline.llm import media_tiff


def feature(payload: bytes, s=media_tiff.Settings()) -> str:
    return media_tiff.described(media_tiff.as_tiff(payload, s))[3]


def test_feature_tells_long_texts_apart_that_differ_late():
    head = b"the quick brown fox jumps over the lazy dog, 64 bytes a row ok. " * 4096  # one page
    assert len(head) == 4096 * 64
    low, high = b" " * (2048 * 64), b"z" * (2048 * 64)
    a, b = feature(head + low + high), feature(head + high + low)
    assert a.split(":")[:3] == b.split(":")[:3] and a.split(":")[3] != b.split(":")[3]
    assert feature(head).split(":")[3] != a.split(":")[3]


def test_feature_equals_block_means_of_the_whole_payload():
    rng = np.random.default_rng(3)
    for rows in (1, 3, 8, 100, 4096, 4097, 9000):
        x = rng.integers(0, 256, (rows, 64), np.uint8)
        means = np.array([x[r[0] : r[-1] + 1].reshape(len(r), 8, -1).mean(axis=(0, 2)) for r in np.array_split(np.arange(rows), min(8, rows))])
        bits = np.packbits(np.resize(means > means.mean(), 64)).tobytes().hex()
        assert feature(x.tobytes()) == f"{-(-rows // 4096)}:{rows}:{x.mean():.4f}:{bits}"
