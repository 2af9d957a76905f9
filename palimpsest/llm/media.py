"""Media columns: progressive JPEG, written and read in numpy.

A progressive file sends its DCT coefficients in scans: bands of the spectrum (spectral selection), first without their
lowest bit and then that bit (successive approximation). The reader accumulates all scans into coefficient arrays, and
from those makes the picture: inverse transform, chroma brought to full resolution, RGB tensors.

Bytes are stored losslessly as coefficients: 64 bytes are the 64 coefficients of an 8x8 block in zigzag order, each byte
one signed 8-bit coefficient, so that reading the coefficients back gives the bytes back. The number of bytes is in a
comment segment. Pictures are 4:2:0: four luma blocks to one of each chroma.

Both directions work on many files at once. Restart markers cut each scan into short segments that can be read apart;
all segments of a kind advance together, one Huffman symbol each per step, so numpy's work a step is that of thousands of
symbols.

The reader takes progressive files with three components (2x2, 1x1, 1x1), 8 bits, whole MCUs, any Huffman
tables, bands, bit positions, end-of-band runs and restart intervals; anything else raises ValueError.

Nulls and odd cases: a null or empty text is 64 bytes 0; a text beyond 6.4 GB, more than a column's value may hold,
would raise ValueError; equal texts give equal files; repeated rows are kept; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESTART = 8
MCUS_A_ROW = 256
#: A side's pixels are told in two bytes.
MOST_MCUS = 4095
BYTES_AT_ONCE = 1_500_000
PARTS = 3
#: (component or None for all, first and last coefficient, bit position before, and after), in file order.
SCANS = (
    (None, 0, 0, 0, 1),
    *((c, 1, 5, 0, 1) for c in range(PARTS)),
    *((c, 6, 63, 0, 1) for c in range(PARTS)),
    *((c, 1, 63, 1, 0) for c in range(PARTS)),
    (None, 0, 0, 1, 0),
)


def zigzag() -> np.ndarray:
    """The place in raster order of each coefficient in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = zigzag()


# ---------------------------------------------------------------------------------------------------------------------
# Huffman tables


def code_lengths(kind: int) -> dict[int, int]:
    """This writer's tables, symbol -> length: short codes for coefficients without zeros before them."""
    if kind == 0:
        return {size: 4 for size in range(12)}
    lengths = {0x00: 4, 0xF0: 8}
    for run in range(16):
        for size in range(1, 11):
            lengths[run << 4 | size] = 4 if run == 0 and size <= 8 else 6 if run == 1 and size <= 8 else 10
    return lengths


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table given as a DHT segment has it."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def table_parts(kind: int) -> tuple[list[int], list[int]]:
    lengths = code_lengths(kind)
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], sorted(lengths, key=lambda s: (lengths[s], s))


@lru_cache(None)
def codes(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, size = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for s, c, n in canonical(*table_parts(kind)):
        code[s], size[s] = c, n
    return code, size


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol << 5 | length; 0 where no code fits."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for s, c, n in canonical(list(counts), list(symbols)):
        table[c << (16 - n) : (c + 1) << (16 - n)] = s << 5 | n
    return table


# ---------------------------------------------------------------------------------------------------------------------
# Shapes


def shape_of(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks of payload: rows widen where there would be more than a file may tell."""
    mcus = max(1, -(-blocks // 6))
    across = max(min(mcus, MCUS_A_ROW), -(-mcus // MOST_MCUS))
    if across > MOST_MCUS:
        raise ValueError(f"a picture holds at most {MOST_MCUS * MOST_MCUS * 6 * 64} bytes")
    return across, -(-mcus // across)


@lru_cache(512)
def mcu_order(across: int, down: int) -> np.ndarray:
    """For each block in the order of an interleaved scan, its place: luma in raster order, then both chroma."""
    n = across * down
    m = np.arange(n)
    row, col = m // across, m % across
    luma = [(2 * row + a) * 2 * across + 2 * col + b for a in (0, 1) for b in (0, 1)]
    return np.stack([*luma, 4 * n + m, 5 * n + m], axis=1).ravel()


def own_blocks(part: int, n: int) -> tuple[int, int]:
    """Where a component's blocks begin and end among 6 * n."""
    return ((0, 4 * n), (4 * n, 5 * n), (5 * n, 6 * n))[part]


# ---------------------------------------------------------------------------------------------------------------------
# Writing


def bit_sizes(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1].astype(np.int64)


def packed(values: np.ndarray, lengths: np.ndarray, segment: np.ndarray, files: np.ndarray, segments: int) -> list[bytes]:
    """Each file's entropy-coded bytes. values, lengths: codes in order, of 32 bits at most; segment: the one each is in,
    ascending; files: the file of each segment, ascending."""
    bits = np.bincount(segment, weights=lengths, minlength=segments).astype(np.int64)
    pad = -bits % 8
    at = np.searchsorted(segment, np.arange(segments), side="right")
    values, lengths = np.insert(values, at, (1 << pad) - 1), np.insert(lengths, at, pad)
    wide = 8 if lengths.sum() < 3 * len(lengths) else 16
    while len(long := np.flatnonzero(lengths > wide)):  # longer codes in two
        above, more = values[long] >> wide, lengths[long] - wide
        values[long] &= (1 << wide) - 1
        lengths[long] = wide
        values, lengths = np.insert(values, long, above), np.insert(lengths, long, more)
    spread = np.unpackbits(values.astype(">u2" if wide == 16 else "u1").view(np.uint8).reshape(-1, wide // 8), axis=1)
    data = np.packbits(spread[np.arange(wide, dtype=np.int8) >= (wide - lengths).astype(np.int8)[:, None]])
    ends = np.cumsum((bits + pad) // 8)
    same = np.append(files[1:] == files[:-1], False)  # a marker follows, unless the file's scan ends
    first = np.searchsorted(files, files)
    marks = 0xD0 + (np.arange(segments) - first) % 8
    full = np.flatnonzero(data == 0xFF)
    where = np.concatenate([full + 1, np.repeat(ends[same], 2)])
    what = np.concatenate([np.zeros(len(full), dtype=np.uint8), np.stack([np.full(int(same.sum()), 0xFF), marks[same]], axis=1).ravel().astype(np.uint8)])
    order = np.argsort(where, kind="stable")
    out = np.insert(data, where[order], what[order])
    last = ends[~same]
    stops = (last + np.searchsorted(np.sort(where), last, side="right")).tolist()
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def signed_bits(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A value's bits after its size, as JPEG has them: negative ones less one."""
    return np.where(x < 0, x + (1 << size) - 1, x)


def ordered_events(keys: list[np.ndarray], values: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate(values)[order], np.concatenate(lengths)[order]


def write_dc(c: np.ndarray, segment: np.ndarray, first: bool, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c: the first coefficients in MCU order."""
    if not first:
        return (c >> low) & 1, np.ones(len(c), dtype=np.int64), segment
    v = c >> low
    part = np.array([0, 0, 0, 0, 1, 2])[np.arange(len(c)) % 6]
    difference = v.copy()
    for p in range(PARTS):
        own = np.flatnonzero(part == p)
        x = v[own]
        previous = np.concatenate([[0], x[:-1]])
        previous[np.concatenate([[True], segment[own][1:] != segment[own][:-1]])] = 0
        difference[own] = x - previous
    size = bit_sizes(np.abs(difference))
    code, length = codes(0)
    return code[size] << size | signed_bits(difference, size), length[size] + size, segment


def write_ac(c: np.ndarray, segment: np.ndarray, band: tuple[int, int], low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First scan of a band. c: blocks x 64 in scan order."""
    a, z = band
    v = c[:, a : z + 1]
    v = np.sign(v) * (np.abs(v) >> low)
    block, k = np.nonzero(v)
    x = v[block, k]
    before = np.concatenate([[-1], k[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])] = -1
    run = k - before - 1
    code, length = codes(1)
    size = bit_sizes(np.abs(x))
    symbol = (run & 15) << 4 | size
    long = np.repeat(np.arange(len(x)), run >> 4)
    last = np.full(len(v), -1)
    last[block] = k
    ended = np.flatnonzero(last < z - a)
    width = 130
    key, value, bits = ordered_events(
        [block[long] * width + 2 * k[long], block * width + 2 * k + 1, ended * width + width - 1],
        [np.full(len(long), code[0xF0]), code[symbol] << size | signed_bits(x, size), np.full(len(ended), code[0])],
        [np.full(len(long), length[0xF0]), length[symbol] + size, np.full(len(ended), length[0])],
    )
    return value, bits, segment[key // width]


def write_refined(c: np.ndarray, segment: np.ndarray, band: tuple[int, int], low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next bit of a band. Coefficients that were nonzero get a bit each; new ones a code, their sign, and before it the
    bits of those passed over."""
    a, z = band
    v = np.abs(c[:, a : z + 1]) >> low
    old, new = v > 1, v == 1
    zeros = np.cumsum(~old & ~new, axis=1)  # zeros up to here
    block, k = np.nonzero(new)
    count = zeros[block, k]
    before = np.concatenate([[0], count[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])] = 0
    run = count - before
    code, length = codes(1)
    place = lambda b, j, s: (b * 64 + j) * 4 + s
    keys, values, lengths = [], [], []
    # a new coefficient's code comes where its run begins: after the coefficient (new, or 16th zero) before it
    new_before = np.concatenate([[-1], k[:-1]])
    new_before[np.concatenate([[True], block[1:] != block[:-1]])] = -1
    start = new_before
    longest = int(run.max(initial=0)) >> 4
    for step in range(longest + 1):
        zrl = (run >> 4) > step
        if zrl.any():
            keys.append(place(block[zrl], start[zrl] + 1, 0))
            values.append(np.full(int(zrl.sum()), code[0xF0]))
            lengths.append(np.full(int(zrl.sum()), length[0xF0]))
            passed = before[zrl] + 16 * (step + 1)
            where = (zeros[block[zrl]] < passed[:, None]).sum(axis=1)  # the 16th zero itself
            start = start.copy()
            start[zrl] = where
    symbol = (run & 15) << 4 | 1
    sign = (c[:, a : z + 1][block, k] > 0).astype(np.int64)
    keys.append(place(block, start + 1, 1))
    values.append(code[symbol] << 1 | sign)
    lengths.append(length[symbol] + 1)
    last = np.full(len(v), -1)
    last[block] = k
    rest = (np.arange(z - a + 1) > last[:, None]).any(axis=1)  # something is left: end the band, then its bits
    ended = np.flatnonzero(rest)
    keys.append(place(ended, last[ended] + 1, 1))
    values.append(np.full(len(ended), code[0]))
    lengths.append(np.full(len(ended), length[0]))
    block, k = np.nonzero(old)
    keys.append(place(block, k, 2))
    values.append(v[block, k] & 1)
    lengths.append(np.ones(len(block), dtype=np.int64))
    key, value, bits = ordered_events(keys, values, lengths)
    return value, bits, segment[key // (64 * 4)]


def segment_bytes(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(None)
def fixed_parts() -> tuple[bytes, list[bytes]]:
    """What all files share: tables before the scans, and each scan's header."""
    tables = segment_bytes(0xDB, b"\0" + b"\1" * 64)
    for kind in (0, 1):
        counts, symbols = table_parts(kind)
        tables += segment_bytes(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(symbols))
    tables += segment_bytes(0xDD, RESTART.to_bytes(2, "big"))
    heads = []
    for part, a, z, high, low in SCANS:
        own = range(PARTS) if part is None else [part]
        heads.append(segment_bytes(0xDA, bytes([len(own)]) + b"".join(bytes([c + 1, 0]) for c in own) + bytes([a, z, high << 4 | low])))
    return tables, heads


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive files whose coefficients are the payloads, each of a positive multiple of 64 bytes."""
    shapes = [shape_of(len(p) // 64) for p in payloads]
    mcus = np.array([x * y for x, y in shapes])
    blocks = np.zeros((6 * int(mcus.sum()), 64), dtype=np.int64)
    starts = (6 * (np.cumsum(mcus) - mcus)).tolist()
    for p, at in zip(payloads, starts, strict=True):
        own = np.frombuffer(p, dtype=np.int8).reshape(-1, 64)
        blocks[at : at + len(own)] = own
    tables, heads = fixed_parts()
    scans = []
    interleaved = np.concatenate([at + mcu_order(*s) for s, at in zip(shapes, starts, strict=True)])
    for part, a, z, high, low in SCANS:
        of = interleaved if part is None else np.concatenate([np.arange(at + own_blocks(part, n)[0], at + own_blocks(part, n)[1]) for n, at in zip(mcus.tolist(), starts, strict=True)])
        each = 6 * mcus if part is None else (4 * mcus if part == 0 else mcus)
        unit = 6 * RESTART if part is None else RESTART
        own_segments = -(-each // unit)
        within = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        segment = np.repeat(np.cumsum(own_segments) - own_segments, each) + within // unit
        if part is None:
            values, lengths, where = write_dc(blocks[of, 0], segment, not high, low)
        elif not high:
            values, lengths, where = write_ac(blocks[of], segment, (a, z), low)
        else:
            values, lengths, where = write_refined(blocks[of], segment, (a, z), low)
        scans.append(packed(values, lengths, where, np.repeat(np.arange(len(payloads)), own_segments), int(own_segments.sum())))
    out = []
    for k, (p, (across, down)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0"
        note = segment_bytes(0xFE, f"payload {len(p)}".encode())
        out.append(b"\xff\xd8" + note + segment_bytes(0xC2, frame) + tables + b"".join(h + s[k] for h, s in zip(heads, scans, strict=True)) + b"\xff\xd9")
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Reading


def parsed(file: bytes) -> tuple[dict, list[dict]]:
    """The frame's facts and the scans with their segments."""
    facts: dict = {"payload": None, "quantization": {}}
    scans: list[dict] = []
    tables: dict[int, tuple[bytes, bytes]] = {}
    at, restart = 2, 0
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if file[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = file[at + 1]
        if marker == 0xD9:
            return facts, scans
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC2:
            if body[0] != 8 or body[5] != 3 or [body[7], body[10], body[13]] != [0x22, 0x11, 0x11]:
                raise ValueError("only 8 bits and 4:2:0 are read")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if height % 16 or width % 16:
                raise ValueError("only whole MCUs are read")
            facts |= {"shape": (width // 16, height // 16), "parts": [body[6], body[9], body[12]], "tables": [body[8], body[11], body[14]]}
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("only progressive files are read")
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("only 8-bit quantization is read")
                facts["quantization"][body[0] & 15], body = np.frombuffer(body[1:65], dtype=np.uint8).astype(np.int64), body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE and (m := re.fullmatch(rb"payload (\d+)", body)):
            facts["payload"] = int(m[1])
        elif marker == 0xDA:
            n = body[0]
            own = [facts["parts"].index(body[1 + 2 * k]) for k in range(n)]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7]").search(file, at).start()
            a, z, bits = body[1 + 2 * n : 4 + 2 * n]
            data = [s.replace(b"\xff\0", b"\xff") for s in re.split(rb"\xff[\xd0-\xd7]", file[at:stop])]
            used = [tables.get(body[2 + 2 * k] >> 4 if not a else 0x10 | (body[2 + 2 * k] & 15)) for k in range(n)]
            if any(u != used[0] for u in used):
                raise ValueError("scans of several tables are not read")
            scans.append({"parts": own, "band": (a, z), "high": bits >> 4, "low": bits & 15, "restart": restart, "segments": data, "table": used[0]})
            at = stop


class Segments:
    """Many segments' bits in one run of bytes, read together: each has a place, in bits."""

    def __init__(self, data: list[bytes]):
        raw = b"".join(data) + b"\xff" * 16
        self.bytes = np.frombuffer(raw, dtype=np.uint8)
        self.ahead = np.ndarray((len(raw) - 8,), dtype=">u8", buffer=raw, strides=(1,))
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        self.at = 8 * (np.cumsum(sizes) - sizes)

    def peek(self, of: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        at = self.at[of]
        word = self.ahead[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        return ((word >> np.uint64(32)).astype(np.int64)) >> (32 - n)

    def take(self, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits of each, 0 where n is 0."""
        x = self.peek(of, n)
        self.at[of] += n
        return x

    def symbols(self, of: np.ndarray, table: np.ndarray) -> np.ndarray:
        found = table[self.peek(of, 16)]
        if not found.all():
            raise ValueError("no Huffman code fits")
        self.at[of] += found & 31
        return found >> 5

    def symbols_and_bits(self, of: np.ndarray, table: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each, and as many bits after it as `extra` has for the symbol."""
        at = self.at[of]
        word = self.ahead[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        if not found.all():
            raise ValueError("no Huffman code fits")
        length, symbol = found & 31, found >> 5
        n = extra[symbol]
        bits = ((word << length.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) >> (24 - n)
        self.at[of] = at + length + n
        return symbol, bits


def extended(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(x < (1 << np.maximum(size - 1, 0)), x - (1 << size) + 1, x) * (size > 0)


def read_dc(c: np.ndarray, bits: Segments, first: np.ndarray, count: np.ndarray, blocks: np.ndarray, scan: dict) -> None:
    """first, count: each segment's blocks, as places in `blocks`."""
    steps = int(count.max(initial=0))
    if scan["high"]:
        segment = np.repeat(np.arange(len(count)), count)
        at = bits.at[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        bit = (bits.bytes[at >> 3] >> (7 - (at & 7))) & 1
        own = blocks[np.repeat(first, count) + np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)]
        c[own, 0] |= bit.astype(np.int64) << scan["low"]
        return
    table, part = lookup(*scan["table"]), np.array([0, 0, 0, 0, 1, 2])
    previous = np.zeros((len(count), PARTS), dtype=np.int64)
    for step in range(steps):
        on = np.flatnonzero(count > step)
        size = bits.symbols(on, table)
        p = part[step % 6] if len(scan["parts"]) > 1 else scan["parts"][0]
        previous[on, p] += extended(bits.take(on, size), size)
        c[blocks[first[on] + step], 0] = previous[on, p] << scan["low"]


#: How many bits follow a symbol in the first scan of a band: the value's, or those of an end-of-band run.
EXTRA = np.array([s & 15 if s & 15 else (s >> 4 if s >> 4 < 15 else 0) for s in range(256)])


def read_ac(c: np.ndarray, bits: Segments, first: np.ndarray, count: np.ndarray, blocks: np.ndarray, scan: dict) -> None:
    (a, z), low, table = scan["band"], scan["low"], lookup(*scan["table"])
    flat, on = c.reshape(-1), np.flatnonzero(count > 0)
    place, stop = first[on], (first + count)[on]  # of the block that each active segment is at
    k, base = np.full(len(on), a), blocks[place] * 64
    while len(on):
        symbol, extra = bits.symbols_and_bits(on, table, EXTRA)
        run, size = symbol >> 4, symbol & 15
        put = size > 0
        if put.all():
            k += run
            flat[base + k] = extended(extra, size) << low
            k += 1
            over = k > z
            if not over.any():
                continue
            place += over
        else:
            going = put | (run == 15)
            k += np.where(going, run, 0)
            flat[(base + k)[put]] = extended(extra[put], size[put]) << low
            k += going
            over = ~going | (k > z)
            place += np.where(going, over, (1 << np.minimum(run, 14)) + extra)
        k[over] = a
        if (place >= stop).any():
            left = place < stop
            on, place, stop, k = on[left], place[left], stop[left], k[left]
        base = blocks[place] * 64


def read_refined(c: np.ndarray, bits: Segments, first: np.ndarray, count: np.ndarray, blocks: np.ndarray, scan: dict) -> None:
    (a, z), low, table = scan["band"], scan["low"], lookup(*scan["table"])
    block, k, ending = np.zeros(len(count), dtype=np.int64), np.full(len(count), a), np.zeros(len(count), dtype=np.int64)
    on = np.flatnonzero(count > 0)
    old = c != 0
    passed: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # place in bits, block, from, to
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    column = np.arange(64)
    while len(on):
        reading = ending[on] == 0
        run, sign, put = np.full(len(on), 64), np.zeros(len(on), dtype=np.int64), np.zeros(len(on), dtype=bool)
        some = on[reading]
        if len(some):
            symbol = bits.symbols(some, table)
            r, size = symbol >> 4, symbol & 15
            extra = bits.take(some, np.where(size > 0, 1, np.where(r < 15, r, 0)))
            ended = (size == 0) & (r < 15)
            ending[some] = np.where(ended, (1 << np.minimum(r, 14)) + extra, 0)
            run[reading] = np.where(ended, 64, r)
            sign[reading], put[reading] = extra, size > 0
        own = blocks[first[on] + block[on]]
        history = old[own]
        free = ~history & (column >= k[on][:, None]) & (column <= z)
        target = np.cumsum(free, axis=1)
        to = np.where(run > 63, z + 1, (target <= run[:, None]).sum(axis=1))  # the place after `run` zeros: a zero itself
        to = np.minimum(to, z + 1)
        n = (history & (column >= k[on][:, None]) & (column < to[:, None])).sum(axis=1)
        passed.append((bits.at[on].copy(), own, k[on].copy(), to))
        bits.at[on] += n
        if put.any():
            new.append((own[put], to[put], np.where(sign[put], 1, -1) << low))
        k[on] = to + 1
        over = k[on] > z
        finished = on[over]
        block[finished] += 1
        k[finished] = a
        ending[finished] = np.maximum(ending[finished] - 1, 0)
        if over.any():
            on = on[block[on] < count[on]]
    if passed:
        at, own, lo, hi = (np.concatenate(x) for x in zip(*passed, strict=True))
        for k in range(0, len(at), 20000):  # each record's bits go to the nonzero coefficients passed, in order
            some = slice(k, k + 20000)
            mask = old[own[some]] & (column >= lo[some][:, None]) & (column < hi[some][:, None])
            row, col = np.nonzero(mask)
            place = at[some][row] + np.cumsum(mask, axis=1)[row, col] - 1
            bit = ((bits.bytes[place >> 3] >> (7 - (place & 7))) & 1).astype(np.int64) << low
            c[own[some][row], col] += np.sign(c[own[some][row], col]) * bit
    for own, at, value in new:
        c[own, at] = value


def together(scans: list[dict]) -> list[list[dict]]:
    """The scans in rounds: neighbours that do the same for different components are read as one."""
    out: list[list[dict]] = []
    for s in scans:
        same = lambda o: all(o[x] == s[x] for x in ("band", "high", "low", "table"))
        if out and len(s["parts"]) == 1 and all(len(o["parts"]) == 1 and o["parts"] != s["parts"] and same(o) for o in out[-1]) and s["band"][0]:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def coefficients(files: list[bytes]) -> tuple[list[dict], list[np.ndarray]]:
    """Facts and coefficients (blocks x 64, zigzag; luma in raster order, then both chroma) of each file."""
    read = [parsed(f) for f in files]
    mcus = np.array([f["shape"][0] * f["shape"][1] for f, _ in read], dtype=np.int64)
    starts = 6 * (np.cumsum(mcus) - mcus)
    c = np.zeros((6 * int(mcus.sum()), 64), dtype=np.int64)
    rounds = [together(scans) for _, scans in read]
    for k in range(max(map(len, rounds), default=0)):
        kinds: dict[tuple, list[tuple[int, dict]]] = {}
        for f, own in enumerate(rounds):
            for s in own[k] if k < len(own) else ():
                kinds.setdefault((len(s["parts"]), s["band"], s["high"], s["low"], s["table"]), []).append((f, s))
        for (parts, band, high, _, _), own in kinds.items():
            blocks, first, count, data, held = [], [], [], [], 0
            for f, scan in own:
                n, at, whole = int(mcus[f]), int(starts[f]), parts > 1
                if whole and scan["parts"] != [0, 1, 2]:
                    raise ValueError("scans of two components are not read")
                b = at + mcu_order(*read[f][0]["shape"]) if whole else np.arange(at + own_blocks(scan["parts"][0], n)[0], at + own_blocks(scan["parts"][0], n)[1])
                unit = (scan["restart"] or len(b)) * (6 if whole else 1)
                cuts = range(0, len(b), unit)
                if len(cuts) != len(scan["segments"]):
                    raise ValueError("restart markers are missing")
                blocks.append(b)
                first += [held + x for x in cuts]
                count += [min(unit, len(b) - x) for x in cuts]
                data += scan["segments"]
                held += len(b)
            reader = read_dc if band[0] == 0 else read_refined if high else read_ac
            reader(c, Segments(data), np.array(first), np.array(count), np.concatenate(blocks), own[0][1])
    return [f for f, _ in read], [c[a : a + 6 * n] for a, n in zip(starts.tolist(), mcus.tolist(), strict=True)]


@lru_cache(None)
def inverse_transform() -> np.ndarray:
    """64 zigzag coefficients -> 64 samples in raster order, in 2^-13, as whole numbers in floats: sums of products with
    whole coefficients are exact, so a picture doesn't depend on what it was computed along with."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.where(u == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(both * (1 << 13))[ZIGZAG]


def tensors(facts: list[dict], found: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Full-resolution RGB, height x width x 3, of each file."""
    for f, c in zip(facts, found, strict=True):
        across, down = f["shape"]
        n = across * down
        planes = []
        for part, wide in enumerate((2 * across, across, across)):
            a, b = own_blocks(part, n)
            raw = (c[a:b] * f["quantization"][f["tables"][part]]).astype(float) @ inverse_transform()
            samples = np.clip(((raw.astype(np.int64) + (1 << 12)) >> 13) + 128, 0, 255)
            planes.append(samples.reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * wide))
        y, cb, cr = planes[0], *(p.repeat(2, axis=0).repeat(2, axis=1) - 128 for p in planes[1:])
        red, green, blue = y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)
        yield np.clip(np.stack([red, green, blue], axis=2), 0, 255).astype(np.uint8)


def payload_of(facts: dict, c: np.ndarray) -> bytes:
    return c.astype(np.int8).tobytes()[: facts["payload"]]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and a checksum of the tensor."""
    h, w, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{w}x{h}:" + ",".join(str(int(s) * 1000 // (h * w)) for s in sums) + f":{zlib.crc32(rgb.tobytes()):08x}"


def runs(sizes: list[int], most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text's bytes as a progressive JPEG file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [padded(t.as_py()) for t in batch["text"]]
            lengths = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in batch["text"].to_pylist()]
            for a, b in runs([len(p) for p in payloads]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(lengths[a:b], pa.int64()), pa.array(encode(payloads[a:b]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame, carry: tuple[str, ...] = (), column: str = "media") -> DataFrame:
    """The carried columns, then width, height and rgb (row by row, three bytes a pixel) of every file."""
    return decoded(media, carry, column, ("width int", "height int", "rgb binary"), lambda facts, c, rgb, file: (rgb.shape[1], rgb.shape[0], rgb.tobytes()))


def digests(media: DataFrame, carry: tuple[str, ...] = (), column: str = "media") -> DataFrame:
    """The carried columns, then what was read back from every file: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature."""

    def facts_of(facts, c, rgb, file):
        payload = payload_of(facts, c)
        return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), sha256(file).hexdigest(), feature(rgb)

    return decoded(media, carry, column, ("payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"), facts_of)


def decoded(media: DataFrame, carry: tuple[str, ...], column: str, fields: tuple[str, ...], of) -> DataFrame:
    held = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried")
    kept = media.select(held).schema["carried"].dataType.simpleString()
    names = [f.split()[0] for f in fields]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch["media"].to_pylist()
            for a, b in runs([len(f) for f in files]):
                facts, found = coefficients(files[a:b])
                rows = [of(f, c, rgb, file) for f, c, rgb, file in zip(facts, found, tensors(facts, found), files[a:b], strict=True)]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["carried"].slice(a, b - a), *columns], names=["carried", *names])

    found = media.select(held, F.col(column).alias("media")).mapInArrow(work, f"carried {kept}, {', '.join(fields)}")
    return found.select(*[F.col("carried")[c].alias(c) for c in carry], *names)
