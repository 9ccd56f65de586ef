import hashlib
import zlib

import numpy as np
import pytest

from tessel.llm import jpeg, queries

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def expected(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_round_trip_of_any_bytes():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, n * 576, np.uint8).tobytes() for n in (1, 2, 345)] + [b"\xff" * 576, b"\x00\xff" * 288]
    media = jpeg.to_images(payloads)
    assert [b"".join(x.tobytes() for x in images) for images in jpeg.from_images(media)] == payloads
    assert len(jpeg.from_images(media)[2]) == 2  # too long for one image


def test_general_image():
    """Two components with AC coefficients, sampling 2x1, no restarts, written bit by bit."""
    dc = ((0, 2, 3) + (0,) * 13, (0, 3, 1, 2, 4))
    ac = ((0, 2, 1, 2) + (0,) * 12, (0x00, 0x02, 0xF0, 0x11, 0x23))
    code = [{s: (c, n) for s, c, n in jpeg.codes(*t)} for t in (dc, ac)]
    bits = []

    def put(value, n):
        bits.extend(value >> n - 1 - k & 1 for k in range(n))

    def number(d, size):
        put(d if d > 0 else d + (1 << size) - 1, size)

    rng, want, last = np.random.default_rng(3), {0: [], 1: []}, [0, 0]
    for _ in range(6):  # 3 MCUs across, 2 down
        for c in (0, 0, 1):
            d = int(rng.integers(-15, 16))
            size = abs(d).bit_length()
            put(*code[0][size])
            number(d, size) if size else None
            last[c] += d
            want[c].append(last[c])
            for symbol, value in ((0x02, 3), (0xF0, None), (0x23, -5), (0x11, 1)):
                put(*code[1][symbol])
                number(value, symbol & 15) if value else None
            put(*code[1][0x00])
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    table = lambda k, t: jpeg._segment(0xC4, bytes([k]) + bytes(t[0]) + bytes(t[1]))
    image = (
        b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, b"\x00" + bytes([16] * 64)) + jpeg._segment(0xC0, bytes([8, 0, 13, 0, 44, 2, 1, 0x21, 0, 2, 0x11, 0]))
        + table(0, dc) + table(0x10, ac) + jpeg._segment(0xDA, b"\x02\x01\x00\x02\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    )
    (thumb,) = jpeg.from_images([image])[0]
    luma = np.array(want[0]).reshape(2, 6)
    assert (thumb == np.clip(luma * 2 + 128, 0, 255)).all()
    with pytest.raises(ValueError):
        jpeg.from_images([image[:-2]])
    # Filling before markers, and the same image with its second component in a scan of its own.
    filled = image.replace(b"\xff\xc4", b"\xff\xff\xff\xc4").replace(b"\xff\xd9", b"\xff\xff\xd9")
    assert (jpeg.from_images([filled])[0][0] == thumb).all()
    apart, kept = [], {c: iter(want[c]) for c in (0, 1)}
    for c, n in ((0, 12), (1, 6)):
        bits.clear()
        rows = np.array(want[0]).reshape(2, 3, 2).reshape(2, 6).ravel().tolist() if c == 0 else list(kept[1])
        before = 0
        for x in rows[:n]:
            size = abs(x - before).bit_length()
            if size not in code[0]:
                pytest.skip("the small table has no such difference")
            put(*code[0][size])
            number(x - before, size) if size else None
            put(*code[1][0x00])
            before = x
        bits += [1] * (-len(bits) % 8)
        apart.append(jpeg._segment(0xDA, bytes([1, c + 1, 0, 0, 63, 0])) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
    several = image[: image.index(b"\xff\xda")] + b"".join(apart) + b"\xff\xd9"
    assert (jpeg.from_images([several])[0][0] == thumb).all()
    with pytest.raises(ValueError):
        jpeg.from_images([image.replace(b"\xff\xc0", b"\xff\xc2")])


def test_op3_equals_brute_force(spark):
    text_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_media_columns(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in rows} == {k: expected(t) for k, t in text_of.items()}
    assert all(r["width"] == 192 and r["height"] * 24 == r["payload_bytes"] * 8 for r in rows)


def test_damage_stays_with_its_row(spark, odd):
    rng = np.random.default_rng(1)
    good = jpeg.to_images([bytes(range(64)) * 9])[0]
    rows = [(0, good), (1, None), (2, b""), (3, b"no image"), (4, good[:-3]), (5, good + good), (6, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    for k in range(60):
        bad = bytearray(good[: int(rng.integers(2, len(good)))] if k % 2 else good)
        for at in rng.integers(2, len(bad), 3) if len(bad) > 2 else []:
            bad[at] = int(rng.integers(0, 256))
        rows.append((10 + k, bytes(bad)))
    docs = spark.createDataFrame([(i, 576, bytearray(x) if x is not None else None) for i, x in rows], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in jpeg.from_media(docs).collect()}
    assert len(got) == len(rows) and got[0]["error"] is None and got[0]["payload_bytes"] == 576 and got[5]["payload_bytes"] == 1152
    assert all(got[k]["error"] and got[k]["payload_sha256"] is None for k in (1, 2, 3, 4, 6))
    assert all((r["error"] is None) == (r["feature"] is not None) for r in got.values())


def test_op3_odd(odd, none):
    media = jpeg.to_media(odd)
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    rows = jpeg.from_media(media).collect()
    assert sorted((r["doc_id"], *tuple(r)[1:5]) for r in rows) == sorted((i, *expected(t)) for i, t in ODD)
    for r in rows:
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert jpeg.from_media(jpeg.to_media(none)).count() == 0


def test_steps_beyond_the_end_are_errors():
    """An image whose coefficients would take more bits than there are, in each of its last bytes."""
    media = jpeg.to_images([bytes(range(256)) * 9])[0]
    for symbol in (1, 5, 10, 15, 255):
        at = media.index(b"\xff\xc4")  # every table of codes, with its one AC symbol changed
        while at >= 0:
            size = int.from_bytes(media[at + 2 : at + 4], "big")
            changed = bytearray(media)
            changed[at + 1 + size] = symbol
            thumbs, error = jpeg.read_each([bytes(changed)])[0]
            assert (error is None) == bool(thumbs)
            at = media.find(b"\xff\xc4", at + 2)
    for end in range(1, 40):
        jpeg.read_each([media[:-end]])
