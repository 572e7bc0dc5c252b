"""Keys of 64 bits that chunks ask about: hashes of ranges, questions by hash partition, and answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.chunks import expand, ipc, pack, squeeze, unipc, unpack

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd base modulo 2 ** 64, and their inverses; kept for the next call."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        both = (np.full(n + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), b[1:]])) for b in both)
    up, down = _POWERS[base]
    return up[: n + 1], down[: n + 1]


class Ranges:
    """Hashes of any range of a sequence of names, by sums of names times powers of an odd base modulo 2 ** 64."""

    def __init__(self, names: np.ndarray, base: int = _BASE):
        up, self.back = powers(base, len(names))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(names * up[:-1])])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


KEY_FIELDS = "kind int, chunk long, part int, data binary, more binary"
KEY_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
STATE, ASK = 0, 1


CODE_FIELDS, CODE_ARROW = "chunk long, part int, data binary", pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def by_part(home: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, last) of sorted part numbers."""
    cuts = np.searchsorted(home, np.arange(parts + 1))
    return ((p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a)


def home_of(h: np.ndarray, parts: int) -> np.ndarray:
    bits = parts.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def ask_rows(kind: int, chunk: int, key: np.ndarray, region: np.ndarray, parts: int, hot: int) -> list[dict]:
    """A row for each part: its distinct keys, and for each key 16 bits that tell its set of regions, and whether they
    are over hot."""
    order = np.lexsort((region, key))
    k, r = key[order], region[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])[: len(k)]
    keys, start, kinds = np.unique(k[new], return_index=True, return_counts=True)
    sign = (mix(np.add.reduceat(r[new], start)) >> np.uint64(48)).astype(np.uint16) if len(keys) else np.empty(0, np.uint16)
    low, often = ((keys >> np.uint64(32 - (parts.bit_length() - 1))) & np.uint64(0xFFFFFFFF)).astype(np.uint32), kinds > hot
    return [{"kind": kind, "chunk": chunk, "part": p, "data": ipc(c=pa.array([squeeze(np.diff(low[a:b], prepend=np.uint32(0))), pack(sign[a:b]), pack(np.packbits(often[a:b]))], pa.binary()))} for p, a, b in by_part(home_of(keys, parts), parts)]


def answer_asked(rows: list[dict], hot: int) -> list[dict]:
    """For each key of each row: 0 if no other row has it, 1 if it is repeated, 2 if its regions are of over hot kinds."""
    blobs = [unipc(r["data"]).column(0).to_pylist() for r in rows]
    asked = [np.cumsum(expand(b[0], "u4"), dtype=np.uint32) for b in blobs]
    often = np.concatenate([np.unpackbits(unpack(b[2], "u1"), count=len(a)) for b, a in zip(blobs, asked, strict=True)])
    sign = np.concatenate([unpack(b[1], "u2") for b in blobs])
    keys, where, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    kinds = np.bincount((np.unique((where.astype(np.uint64) << np.uint64(16)) | sign) >> np.uint64(16)).astype(np.int64), minlength=len(keys))
    heat = (np.bincount(where, often, len(keys)) > 0) | (kinds > hot)
    code = np.where(heat, 2, counts > 1).astype(np.uint8)[where]
    return [{"chunk": r["chunk"], "part": r["part"], "data": pack(c)} for r, c in zip(rows, np.split(code, np.cumsum([len(a) for a in asked])[:-1]), strict=True)]


def codes_of(key: np.ndarray, answers: list[dict], last: bool) -> np.ndarray:
    """The answer for each region's key; 1 at least where a key comes more than once here. last: nothing is hot."""
    keys, where, times = np.unique(key, return_inverse=True, return_counts=True)
    code = np.concatenate([unpack(r["data"], "u1") for r in sorted(answers, key=lambda r: r["part"])]) if answers else np.zeros(len(keys), np.uint8)
    code = np.maximum(code, times > 1)
    return (np.minimum(code, 1) if last else code)[where]
