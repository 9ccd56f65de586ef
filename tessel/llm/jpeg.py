"""Media columns as baseline JPEG: DC-only luminance thumbnails (operator 3).

``to_media`` stores bytes losslessly: every byte is a grey sample, and every sample becomes an 8x8
block of one colour, whose only coefficient is the DC one. With a quantiser of 8 the DC value is
the sample less 128, so an eighth-size thumbnail, made from DC values alone, is the payload. An
image is 24 blocks wide, each row of blocks is a restart interval, and bytes that don't fit the
65,535 lines of one image follow in further images.

``from_media`` reads baseline JPEG in general (any sampling, tables, restart interval, one scan or
several): it parses the markers, Huffman-decodes the scan of the first component, skips AC
coefficients, and rebuilds the luminance thumbnail. All restart intervals of a batch with the same tables are decoded in step in numpy.

Defined cases: a null or empty text is a payload of 576 bytes 255; equal texts give equal values;
an empty table gives no rows; columns other than doc_id and text are ignored; repeated rows stay;
media that are null, damaged or no baseline JPEG give a row with nulls and ``error``, others go on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.llm.common import portions, texts

UNIT, ACROSS = 576, 24  # payload bytes come in multiples of UNIT, ACROSS to a row of blocks
ROWS = 65_535 // 8 // (UNIT // ACROSS) * (UNIT // ACROSS)  # of blocks in one image

#: How many DC codes of 1 to 16 bits there are, for the bit lengths 0 to 11 of a difference.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The only AC symbol is the end of a block: one bit.
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as its segment states it."""
    out, code, it = [], 0, iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((next(it), code, length))
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, across: int) -> bytes:
    """All that stands before the scan data of one image of ours."""
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\x00" + bytes([8] * 64)), _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * across, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)), _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", across)), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Bits of each difference from -255 to 255 with its block's end, and which of the 16 bits count; then 8 rows of filling."""
    of = {s: (c, n) for s, c, n in codes(DC_COUNTS, DC_SYMBOLS)}
    bits, used = np.zeros((519, 16), bool), np.zeros((519, 16), bool)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = of[size]
        value, n = ((code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1), n + size + 1
        bits[d + 255, :n], used[d + 255, :n] = [value >> n - 1 - k & 1 for k in range(n)], True
    for fill in range(8):
        bits[511 + fill, :fill] = used[511 + fill, :fill] = True
    return bits, used


_BITS, _USED = _patterns()
_LENGTH = _USED.sum(1)


def encode_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes, byte-stuffed, of rows of samples, and the number of bytes of each row."""
    value = samples.astype(np.int16) - 128
    which = np.empty((value.shape[0], value.shape[1] + 1), np.int64)
    which[:, 0] = value[:, 0]
    which[:, 1:-1] = np.diff(value, axis=1)
    which[:, :-1] += 255
    bits = _LENGTH[which[:, :-1]].sum(1)
    which[:, -1] = 511 + -bits % 8
    stream = np.packbits(_BITS[which][_USED[which]])
    size = -(-bits // 8)
    stuffed = np.flatnonzero(stream == 0xFF)
    row = np.searchsorted(np.cumsum(size), stuffed, "right")
    return np.insert(stream, stuffed + 1, 0), size + np.bincount(row, minlength=len(size))


def to_images(payloads: list[bytes], across: int = ACROSS) -> list[bytes]:
    """A stored form of each payload (a multiple of ``across`` bytes, not empty): one or more JPEG images."""
    stream, size = encode_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, across))
    ends = np.cumsum(size)
    marks = [b"\xff" + bytes([0xD0 + k]) for k in range(8)]
    stream, out, row = stream.tobytes(), [], 0
    for payload in payloads:
        left, parts = len(payload) // across, []
        while left:
            rows = min(left, ROWS)
            at = [int(ends[row - 1]) if row else 0, *ends[row : row + rows].tolist()]
            parts.append(header(rows, across))
            for k in range(rows):
                parts += (stream[at[k] : at[k + 1]], marks[k % 8])
            parts[-1] = b"\xff\xd9"
            row, left = row + rows, left - rows
        out.append(b"".join(parts))
    return out


class Image:
    """Markers of one baseline image, and the scan with its first component; ``end`` is where it ends in ``data``.

    Whatever is damaged raises ValueError.
    """

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.restart, self.quantisers, self.tables, self.components, self.scan = 0, {}, {}, [], None
        try:
            self.end = self._markers(data, at + 2)
        except (IndexError, KeyError, StopIteration, struct.error):
            raise ValueError("a damaged image") from None
        if self.scan is None or 2 * len(self.blocks) * self.across * self.down > 8 * len(self.scan):
            raise ValueError("the scan is too short")

    def _markers(self, data: bytes, at: int) -> int:
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one belongs")
            while data[at + 1] == 0xFF:  # filling
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                return at + 2
            size = struct.unpack_from(">H", data, at + 2)[0]
            if size < 2 or at + 2 + size > len(data):
                raise ValueError("a segment is cut off")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]  # of the DC coefficient
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    if n > len(body) - 17:
                        raise ValueError("a table is cut off")
                    self.tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
                if depth != 8 or not n or not self.height or not self.width or not all(1 <= x <= 4 for c in self.components for x in c[1:3]):
                    raise ValueError("only 8-bit samples of a stated size are read")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                end = at
                while True:  # markers other than restarts and stuffing end the scan
                    end = data.find(b"\xff", end)
                    if end < 0:
                        raise ValueError("the scan doesn't end")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                chosen = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
                if self.scan is None and self.components[0][0] in chosen:
                    self._first_scan(data[at:end], chosen)
                at = end

    def _first_scan(self, scan: bytes, chosen: dict[int, int]) -> None:
        """The scan as it stands with the tables and the restart interval that hold now."""
        own = [x for x in self.components if x[0] in chosen]
        if len(own) != len(chosen):
            raise ValueError("a scan of unknown components")
        self.scan, self.interval = scan, self.restart
        most = max(h for _, h, _, _ in self.components), max(v for _, _, v, _ in self.components)
        _, h, v, self.quantiser = self.components[0]
        self.size = -(-self.height * v // (8 * most[1])), -(-self.width * h // (8 * most[0]))  # of the thumbnail
        if len(own) == 1:  # a lone component isn't interleaved: one block at a time
            self.sampling, (self.down, self.across) = (1, 1), self.size
        else:
            self.sampling, self.down, self.across = (h, v), -(-self.height // (8 * most[1])), -(-self.width // (8 * most[0]))
        #: Per block of an MCU: component, DC table, AC table.
        each = [(k, self.tables[chosen[c] >> 4], self.tables[0x10 | chosen[c] & 15], h * v if len(own) > 1 else 1) for k, (c, h, v, _) in enumerate(own)]
        self.blocks = tuple((k, dc, ac) for k, dc, ac, n in each for _ in range(n))
        self.parts = len(own)


def _lookup(table: tuple) -> np.ndarray:
    """For each 16-bit window: the code's length in the high byte, its symbol in the low one."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, code, n in codes(*table):
        if code >> n:
            raise ValueError("a table with too many codes")
        out[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
    return out


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """DC values (MCU, block) of images that share blocks and restart interval."""
    first = images[0]
    luts = {t: _lookup(t) for _, *both in first.blocks for t in both}
    raw = np.frombuffer(b"".join(x.scan for x in images), np.uint8)
    begins = np.cumsum([0, *(len(x.scan) for x in images)])
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    after = raw[mark + 1]
    restarts = mark[after != 0]
    keep = np.ones(len(raw), bool)
    keep[mark + 1] = keep[restarts] = False
    place = np.cumsum(keep) - keep  # in the bytes that stay
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    total = [x.across * x.down for x in images]
    each = [min(first.interval or n, n) for n in total]
    starts, sizes, owner = [], [], []
    for k, (n, per) in enumerate(zip(total, each, strict=True)):
        own = restarts[np.searchsorted(restarts, begins[k]) : np.searchsorted(restarts, begins[k + 1])]
        count = -(-n // per)
        if len(own) != count - 1:
            raise ValueError("restart markers don't fit the size")
        starts.append(np.r_[place[begins[k]], np.minimum(place[own + 1], len(clean) - 8)])
        sizes.append(np.minimum(per, n - per * np.arange(count)))
        owner.append(count)
    at, size = np.concatenate(starts).astype(np.int64) * 8, np.concatenate(sizes)
    limit = 8 * (len(clean) - 8)  # no scan goes on in the spare bytes, and a step passes over less than four

    def peek(p: np.ndarray) -> np.ndarray:
        return window[p >> 3] << (p & 7).astype(np.uint32) >> np.uint32(16)

    values = np.zeros((len(at), int(size.max()), len(first.blocks)), np.int32)
    before = np.zeros((len(at), first.parts), np.int32)
    for step in range(values.shape[1]):
        live = slice(None) if step < size.min() else np.flatnonzero(size > step)
        p = at[live]
        for b, (c, dc, ac) in enumerate(first.blocks):
            found = luts[dc][peek(p)]
            p = p + (found >> 8)
            n = (found & 255).astype(np.uint32)
            if len(n) and (n.max() > 11 or not found.all()):
                raise ValueError("no such code")
            extra = (peek(p) >> (np.uint32(16) - n)).astype(np.int32)
            difference = np.where(extra < (1 << n.astype(np.int32) >> 1), extra - (1 << n.astype(np.int32)) + 1, extra)
            p = p + n
            if len(p) and p.max() > limit:
                raise ValueError("the scan is too short")
            before[live, c] += difference
            values[live, step, b] = before[live, c]
            todo, k = np.arange(len(p)), np.ones(len(p), np.int32)
            while len(todo):  # AC coefficients are passed over
                found = luts[ac][peek(p[todo])]
                if not found.all():
                    raise ValueError("no such code")
                run, n = found >> 4 & 15, found & 15
                p[todo] += (found >> 8) + n
                if p[todo].max() > limit:
                    raise ValueError("the scan is too short")
                k[todo] += np.where(n > 0, run + 1, np.where(run == 15, 16, 64)).astype(np.int32)
                todo = todo[k[todo] < 64]
        at[live] = p
    out, row = [], 0
    for n, count in zip(total, owner, strict=True):
        own = values[row : row + count]
        out.append(own.reshape(-1, own.shape[2]) if count * own.shape[1] == n else np.concatenate([own[k, : size[row + k]] for k in range(count)]))
        row += count
    return out


def thumbnail(image: Image, dc: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, uint8."""
    h, v = image.sampling
    grid = dc[:, : h * v].reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h)
    if image.quantiser not in image.quantisers:
        raise ValueError("no quantiser")
    grid = grid[: image.size[0], : image.size[1]]
    return np.clip(np.rint(grid * (image.quantisers[image.quantiser] / 8)) + 128, 0, 255).astype(np.uint8)


def from_images(media: list[bytes]) -> list[list[np.ndarray]]:
    """The thumbnails of the images in each stored form."""
    alike, where = defaultdict(list), []
    for data in media:
        at, own = 0, []
        while at < len(data):
            image = Image(data, at)
            at = image.end
            group = alike[image.blocks, image.interval]
            own.append((image.blocks, image.interval, len(group)))
            group.append(image)
        where.append(own)
    done = {key: [thumbnail(x, dc) for x, dc in zip(group, decode_scans(group), strict=True)] for key, group in alike.items()}
    return [[done[blocks, restart][k] for blocks, restart, k in own] for own in where]


def read_each(media: list[bytes | None]) -> list[tuple[list[np.ndarray], str | None]]:
    """The same with an error for each stored form that can't be read; the others go on."""
    try:
        if all(media):
            return [(x, None) for x in from_images(media)]
    except ValueError:
        pass
    out = []
    for data in media:  # one by one, to tell which it is
        try:
            out.append((from_images([data])[0], None) if data else ([], "no media"))
        except ValueError as e:
            out.append(([], str(e)))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: which of 8x8 areas are lighter than their mean."""
    rows, cols = (np.arange(9) * s // 8 for s in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    corner = total[np.ix_(rows, cols)]
    area = np.maximum(np.outer(np.diff(rows), np.diff(cols)), 1)
    mean = (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area
    return np.packbits(mean > mean.mean()).tobytes().hex()


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary): each text's UTF-8 bytes, filled up with 255, as JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1 << 20):
                raw = [x.as_buffer().to_pybytes() for x in part.column("text")]
                size = [max(UNIT, -(-len(x) // UNIT) * UNIT) for x in raw]
                media = to_images([x.ljust(n, b"\xff") for x, n in zip(raw, size, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([*map(len, raw)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, error string"


def from_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload digests, pixel size, and size and hash of the thumbnail as ``feature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")[1:]]
        for batch in batches:
            for part in portions(batch.rename_columns(["doc_id", "n_bytes", "text"]), 2 << 20):
                stored, rows = part.column("text").to_pylist(), []
                for data, n, (images, error) in zip(stored, part.column("n_bytes").to_pylist(), read_each(stored), strict=True):
                    if len({x.shape[1] for x in images}) > 1:
                        images, error = [], "images of unlike widths"
                    kept = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                    if error is None:
                        thumb = np.concatenate(images)
                        payload = thumb.tobytes()
                        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *kept, f"{thumb.shape[1]}x{thumb.shape[0]}:{thumbnail_hash(thumb)}", 8 * thumb.shape[1], 8 * thumb.shape[0], None))
                    else:
                        rows.append((n, None, None, None, *kept, None, None, None, error))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
