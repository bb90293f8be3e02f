"""Tagged directories in bytes against a plain reader, over whole, cut and damaged bytes."""

import random
import struct

from specula.functions import directories as D


def plain(data):
    def find():
        if len(data) < 8 or data[:2] != b"\xff\xd8":
            return None
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker, size = struct.unpack(">HH", data[at : at + 4])
            if marker == 0xFFDA:
                return None
            if marker == 0xFFD8 or 0xFFD0 <= marker <= 0xFFD7:
                at += 2
                continue
            if size < 2:
                return None
            if marker == 0xFFE1 and size > 8 and data[at + 4 : at + 10] == b"Exif\0\0":
                return at + 10
            at += 2 + size
        return None

    start = find()
    if start is None:
        return None, {}
    order = {b"II": "<", b"MM": ">"}.get(data[start : start + 2])
    read = lambda at, kind: struct.unpack(order + kind, data[at : at + struct.calcsize(kind)])[0] if 0 <= at <= len(data) - struct.calcsize(kind) else None
    if order is None or read(start + 2, "H") != 42 or read(start + 4, "I") is None:
        return start, {}

    def entries(begin):
        for k in range(read(begin, "H") or 0):
            e = begin + 2 + 12 * k
            if e + 12 <= len(data):
                yield read(e, "H"), read(e + 2, "H"), read(e + 4, "I"), e + 8

    first = list(entries(start + read(start + 4, "I")))
    pointer = next((at for tag, kind, _, at in first if (tag, kind) == (0x8769, 4)), None)
    out = {}
    for tag, kind, count, at in first + (list(entries(start + read(pointer, "I"))) if pointer is not None else []):
        name, far, value = D.TAGS.get(tag), start + read(at, "I"), None
        if name in ("make", "model", "dt", "lens"):
            if kind == 2 and count and far < len(data):
                value = data[far : far + count].split(b"\0")[0].decode("utf-8", "replace")
        elif kind == 5:
            a, b = read(far, "I"), read(far + 4, "I")
            value = None if b is None else 0.0 if b == 0 else a / b
        elif kind == 3:
            value = float(read(at, "h" if name == "bias" else "H"))
        elif kind == 4:
            value = float(read(at, "I"))
        if name and value is not None:
            out[name] = value
    return start, out


def picture(r):
    order = r.choice("<>")
    n = r.randint(0, 5)
    tags = [r.choice([*D.TAGS, 0x8769, 0x9999]) for _ in range(n)]
    body = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(order + "H", n)
    for tag in tags:
        kind = 4 if tag == 0x8769 else 2 if D.TAGS.get(tag) in ("make", "model", "dt", "lens") else r.choice([3, 4, 5, 9])
        value = struct.pack(order + "HH", r.randint(0, 65535), 0) if kind == 3 else struct.pack(order + "I", r.choice([8, 60, 64, 70, 5000]))
        body += struct.pack(order + "HHI", tag, kind, r.randint(0, 9)) + value
    body += bytes(r.randint(0, 255) if r.random() < 0.3 else r.randint(65, 90) for _ in range(40))
    if r.random() < 0.3:
        body = body[: r.randint(0, len(body))]
    if r.random() < 0.2 and body:
        at = r.randrange(min(len(body), 10))
        body = body[:at] + bytes([r.randint(0, 255)]) + body[at + 1 :]
    before = b"".join(r.choice([b"\xff\xe0\0\4ab", b"\xff\xd0", b"xy", b"\xff\xe1\0\6Exif"]) for _ in range(r.randint(0, 2)))
    out = r.choice([b"\xff\xd8"] * 9 + [b"\xff\xd9"]) + before + b"\xff\xe1" + struct.pack(">H", (len(body) + 8) & 0xFFFF) + b"Exif\0\0" + body
    return bytes(b if b < 128 or k < len(out) - len(body) else b & 127 for k, b in enumerate(out)) if r.random() < 0.7 else out


def test_directories(spark):
    r = random.Random(6)
    data = [picture(r) for _ in range(400)] + [b"", b"\xff\xd8", b"\xff\xd8" + b"\xff" * 20, b"\xff\xd8\xff\xda" + b"x" * 30, None]
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(data)], "k int, b binary")
    rows = D.with_values(D.with_start(df, "b", "start"), "b", "start", "v").collect()
    found = 0
    for row in rows:
        start, want = plain(data[row["k"]]) if data[row["k"]] is not None else (None, {})
        assert row["start"] == start
        got = {v["name"]: v["text"] if v["text"] is not None else v["number"] for v in row["v"] or []}
        text = lambda d: {k: v for k, v in d.items() if not isinstance(v, str)}
        assert text(got) == text(want), row["k"]
        assert {k for k in got} == {k for k in want}
        assert all(got[k] == v for k, v in want.items() if isinstance(v, str) and v.isascii())
        found += len(want)
    assert found > 150


def test_pictures_are_dealt_out(spark, sf):
    from specula.plans.metadata_queries import ifd_parse

    assert ifd_parse(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
