"""Writes small BAM files and their indexes, for tests and measurements."""

import struct
import zlib

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


def block(data, level=6):
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def tag(key, kind, value):
    raw = key.encode() + kind.encode()
    if kind == "A":
        return raw + value.encode()
    if kind in "ZH":
        return raw + value.encode() + b"\0"
    codes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    if kind == "B":
        return raw + value[0].encode() + struct.pack("<i", len(value[1])) + struct.pack(f"<{len(value[1])}{codes[value[0]]}", *value[1])
    return raw + struct.pack("<" + codes[kind], value)


def record(name, flag, rid, pos, map_q, cigar, tlen=0, seq="ACGT", tags=(), next_rid=None, next_pos=None, qual=None):
    packed = bytes((BASES.index(seq[i]) << 4) | (BASES.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    raw = struct.pack("<iiBBHHHiiii", rid, pos, len(name) + 1, map_q, 0, len(cigar), flag, len(seq), rid if next_rid is None else next_rid, pos if next_pos is None else next_pos, tlen)
    raw += name.encode() + b"\0" + b"".join(struct.pack("<I", int(n) << 4 | OPS.index(o)) for n, o in cigar) + packed + (bytes([30] * len(seq)) if qual is None else qual)
    raw += b"".join(tag(*t) for t in tags)
    return struct.pack("<i", len(raw)) + raw


def header(contigs, sort="coordinate"):
    text = f"@HD\tVN:1.6\tSO:{sort}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    data = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    return data + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


def write(path, contigs, records, size=700, index=True, level=6, sort="coordinate"):
    """Blocks of ``size`` bytes, whatever stands in them; with an index beside the file unless told not to."""
    data = header(contigs, sort) + b"".join(records)
    blocks = [block(data[k : k + size], level) for k in range(0, len(data), size)]
    starts, at = [], 0
    for b in blocks:
        starts.append(at)
        at += len(b)
    starts.append(at)
    path.write_bytes(b"".join(blocks) + block(b""))
    if not index:
        return

    def virtual(place):
        return starts[place // size] << 16 | place % size

    bins, windows = [{} for _ in contigs], [{} for _ in contigs]
    place = len(header(contigs, sort))
    for r in records:
        rid, pos, n_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", r, 4)
        ops = struct.unpack_from(f"<{n_cigar}I", r, 36 + n_name)
        end = pos + max(1, sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X"))
        begin_v, place = virtual(place), place + len(r)
        if rid < 0:
            continue
        number = next((first + (pos >> shift) for shift, first in _LEVELS if pos >> shift == (end - 1) >> shift), 0)
        chunks = bins[rid].setdefault(number, [])
        if chunks and chunks[-1][1] == begin_v:
            chunks[-1][1] = virtual(place)
        else:
            chunks.append([begin_v, virtual(place)])
        for w in range(pos >> 14, ((end - 1) >> 14) + 1):
            windows[rid].setdefault(w, begin_v)
    out = b"BAI\1" + struct.pack("<i", len(contigs))
    for held, wins in zip(bins, windows, strict=True):
        out += struct.pack("<i", len(held) + 1)
        for number, chunks in sorted(held.items()):
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 0, 0)  # the bin of counts
        n = max(wins, default=-1) + 1
        out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *(wins.get(w, 0) for w in range(n)))
    path.with_name(path.name + ".bai").write_bytes(out)
