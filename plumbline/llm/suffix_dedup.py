"""Suffix-array dedup of byte strings, the suffix array built by linear grouping.

`suffix_array` sorts suffixes in two phases without renaming: groups of suffixes that share a Lyndon prefix are taken
from the greatest down; each member's previous suffix in a lower group moves to a new group just above its own, by how
often the prefix follows it; then the groups' order is emitted from the least suffix up along the same pointers.

A whole corpus can't be one string in one task, so windows that could be equal are brought together first. Of the
101 strings of 100 bytes in a window of 200, the one with the least hash (the leftmost of equals) is its anchor;
equal windows have equal anchors at equal places. The windows of one anchor are one region of at most 300 bytes.
Chunks ask about their anchors' hashes (chunks.py): what nobody else asks about holds no repeat. Regions of repeated
anchors meet by anchor. There identical regions collapse into one that weighs as many as it stands for, an anchor's
bytes and those around it that all its windows hold become one symbol, and suffix arrays over the regions put equal
windows side by side: those whose weights sum to two or more repeat. Nothing else decides, and bytes are compared, not
hashes.

An anchor with more than `hot` kinds of regions would gather too many in a task. Its windows get deeper anchors: by
tens of places, the 191 bytes that all windows starting there share, and where those are hot too, the window's own 200
bytes, of which there is one kind only. Each level asks, meets and is decided as the first; so no anchor, however
common, gathers more than hot * hot regions in a task, and nothing is left out.

Defined cases: null text is empty. Texts are whole UTF-8 byte strings, matches never cross documents, windows of one
document may repeat each other and overlap, and repeated rows repeat each other. Shorter texts lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import expand, gather, in_groups, in_pairs, ipc, pack, parts_for, squeeze, tables, text_bytes, unipc, unpack
from plumbline.llm.common import Scratch
from plumbline.llm.keys import ASK, CODE_ARROW, CODE_FIELDS, KEY_ARROW, KEY_FIELDS, STATE, Ranges, answer_asked, ask_rows, by_part, codes_of, home_of, mix

WINDOW = 200
#: Places that share an anchor, level by level; an anchor is what all windows starting at so many places have in common.
BUCKETS = (101, 10, 1)
ANCHOR = WINDOW + 1 - BUCKETS[0]
CLEAN, DEEP_ASK, DEEP_STATE, MAP = 2, 3, 4, 8
_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(s: list[int]) -> list[int]:
    """Places of s, whose last number is its only least one, in the order of their suffixes.

    Lists of members keep the order of places, and may hold places that have moved on; sizes don't count those.
    """
    n = len(s)
    _, group = np.unique(np.array(s), return_inverse=True)
    order = np.argsort(group, kind="stable")
    size = np.bincount(group).tolist()
    members = [m.tolist() for m in np.split(order, np.cumsum(size)[:-1])]
    group = group.tolist()
    lower, upper = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    before, done = [-1] * n, bytearray(n + 1)  # the last one answers for place -1, which is never done
    now = len(members) - 1

    def raise_(js: list[int], g: int) -> None:
        """Moves some members of g to a new group just above it, unless they are all of it."""
        if len(js) == size[g]:
            return
        fresh, up = len(members), upper[g]
        members.append(js)
        size.append(len(js))
        size[g] -= len(js)
        lower.append(g)
        upper.append(up)
        upper[g] = lower[up] = fresh  # the group being taken is higher, so there is one above
        for j in js:
            group[j] = fresh

    while now >= 0:
        mine = members[now]
        if size[now] == 1:  # nearly all groups, in the end
            i = mine[0]
            if len(mine) > 1:
                for i in mine:
                    if group[i] == now:
                        break
            done[i] = 1
            j = i - 1
            while done[j]:
                j = before[j]
            before[i] = j
            if j >= 0 and size[g := group[j]] > 1:  # raise_([j], g)
                fresh, up = len(members), upper[g]
                members.append([j])
                size.append(1)
                size[g] -= 1
                lower.append(g)
                upper.append(up)
                upper[g] = lower[up] = group[j] = fresh
            now = lower[now]
            continue
        mine = [i for i in mine if group[i] == now]
        for i in mine:
            done[i] = 1
        # How often the prefix follows each place; those come in order, as pointers of one group never cross.
        last, k, moved = -2, 0, {}
        times: list[tuple[int, int]] = []
        for i in mine:
            j = i - 1
            while done[j]:
                j = before[j]
            before[i] = j
            if j == last:
                k += 1
                continue
            if last >= 0:
                times.append((k, last))
            last, k = j, 1
        if last >= 0:
            times.append((k, last))
        for k, j in times:
            moved.setdefault((-k, group[j]), []).append(j)
        # Each new group goes just above the old one, so those that the prefix follows most often go first.
        for (_, g), js in sorted(moved.items()) if len(moved) > 1 else moved.items():
            raise_(js, g)
        now = lower[now]
    start, at, g = [0] * len(members), 0, group[n - 1]
    while g >= 0:
        start[g] = at
        at += size[g]
        g = upper[g]
    out, placed = [0] * n, bytearray(n + 1)
    out[0], placed[n - 1], placed[n] = n - 1, 1, 1
    for i in range(n):
        j = out[i] - 1
        while not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def repeated_windows(strings: list[np.ndarray], weights: list[int], window: int) -> list[np.ndarray]:
    """For each string of symbols (2 or more each), which of its windows also start elsewhere in the strings.

    weights: how many strings each one stands for. The suffix array puts equal windows side by side.
    """
    text = np.concatenate([np.append(s, 1) for s in strings] + [np.zeros(1, np.int64)])
    order = np.array(suffix_array(text.tolist()), np.int64)
    cuts = np.cumsum([0, *(len(s) + 1 for s in strings)])
    weight = np.zeros(len(text), np.int64)  # 0 where no window starts
    for a, b, w in zip(cuts[:-1].tolist(), cuts[1:].tolist(), weights, strict=True):
        weight[a : max(a, b - window)] = w
    order = order[weight[order] > 0]
    views = np.lib.stride_tricks.sliding_window_view(text.astype(np.int32), window)
    fresh = np.ones(len(order), bool)
    for at in range(0, len(order) - 1, 8192):
        a, b = order[at : at + 8192], order[at + 1 : at + 8193]
        fresh[at + 1 : at + 1 + len(b)] = (views[a[: len(b)]] != views[b]).any(1)
    hit = np.zeros(len(text), bool)
    if len(order):
        run = np.cumsum(fresh) - 1
        hit[order] = np.bincount(run, weight[order])[run] > 1
    return [hit[a : max(a, b - window)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def compare_regions(keys: list[int], offs: list[int], regions: list[bytes], weights: list[int], batch: int = 2_000) -> list[np.ndarray]:
    """For each region (its anchor off bytes from its start): which of its windows repeat.

    Identical regions collapse into one of their summed weight. The bytes that all windows of a key hold, the anchor
    and some around it, are one symbol, which regions share if the bytes are the same. A suffix array holds whole keys,
    of some batch symbols together, as only windows of one key can be equal.
    """
    number: dict[tuple[int, int, bytes], int] = {}
    of = [number.setdefault(e, len(number)) for e in zip(keys, offs, regions, strict=True)]
    weight = np.bincount(of, weights, len(number)).astype(np.int64).tolist()
    reach: dict[int, tuple[int, int]] = {}  # the fewest and the most bytes that windows of a key have before its anchor
    for k, o, r in number:
        least = o - len(r) + WINDOW
        low, high = reach.get(k, (least, o))
        reach[k] = min(low, least), max(high, o)
    symbols: dict[tuple[int, bytes], int] = {}
    own = []
    for (k, o, r), i in number.items():
        low, high = reach[k]
        own.append((high - low + 1, symbols.setdefault((k, r[o - low : o + WINDOW - high]), len(symbols)), i, o - low, o + WINDOW - high, r))
    own.sort(key=lambda e: e[:3])
    masks: list[np.ndarray] = [np.empty(0, bool)] * len(number)
    strings, held, size = [], [], 0
    for n, (width, symbol, i, before, after, r) in enumerate(own):
        raw = np.frombuffer(r, np.uint8).astype(np.int64) + 2
        strings.append(np.concatenate([raw[:before], [258 + symbol], raw[after:]]))
        held.append(i)
        size += len(strings[-1])
        if n + 1 == len(own) or own[n + 1][0] != width or size > batch and own[n + 1][1] != symbol:
            for i, mask in zip(held, repeated_windows(strings, [weight[i] for i in held], width), strict=True):
                masks[i] = mask
            strings, held, size = [], [], 0
    return [masks[i] for i in of]


#: Windows are scanned so many places at a time, which bounds memory for texts of any length.
BLOCK, PLACE_BITS = 1 << 19, np.uint64(20)


class Anchors:
    """The anchors of all windows of some documents: place, first and last window, hash, hash of the region.

    At a block's end the windows of one anchor may come as two entries, which are two regions of that anchor.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.cumsum([0, *map(len, texts)])
        valid = np.zeros(len(self.data) + 1, np.int8)
        a, b = self.starts[:-1], self.starts[1:] - WINDOW + 1
        np.add.at(valid, a[b > a], 1)
        np.add.at(valid, b[b > a], -1)
        valid = np.cumsum(valid, dtype=np.int8)
        found = [self._block(at, np.flatnonzero(valid[at : at + BLOCK])) for at in range(0, len(self.data), BLOCK)]
        self.at, self.first, self.last = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in range(3))
        self.hash, self.region = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]) for k in (3, 4))

    def _block(self, at: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(x):
            return (*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2)
        names = _NAMES[self.data[at : at + BLOCK + WINDOW - 1]]
        p = np.arange(len(names) - ANCHOR + 1)
        ranges = Ranges(names)
        h = ranges.of(p, p + ANCHOR)
        order = (h >> PLACE_BITS << PLACE_BITS) | p.astype(np.uint64)
        width = WINDOW - ANCHOR + 1
        blocks = -(-len(order) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max)
        padded[: len(order)] = order
        grid = padded.reshape(blocks, width)
        ahead, back = np.minimum.accumulate(grid, 1).ravel(), np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = (np.minimum(back[x], ahead[x + width - 1]) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        first, last = x[new], x[np.concatenate([new[1:], [len(x)]]) - 1]
        return least[new] + at, first + at, last + at, mix(h[least[new]] ^ _NAMES[0]), ranges.of(first, last + WINDOW)  # anchors' own hashes are all small


REPLY, REPLY_ARROW = "chunk long, part int, kind int, data binary, n long", pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("n", pa.int64())])


def meet_rows(chunk: int, parts: int, level: int, key: np.ndarray, off: np.ndarray, first: np.ndarray, size: np.ndarray, raw: bytes) -> tuple[list[dict], np.ndarray, int]:
    """Rows that take regions (raw[first : first + size]) to the parts where they meet, each kind once; the number of
    each region's kind in the order of the rows; how many kinds."""
    order = np.argsort(key, kind="stable")
    number: dict[tuple[int, int, bytes], int] = {}
    of = np.empty(len(key), np.int64)
    for i, k, o, a, n in zip(order.tolist(), key[order].tolist(), off[order].tolist(), first[order].tolist(), size[order].tolist(), strict=True):
        of[i] = number.setdefault((k, o, raw[a : a + n]), len(number))
    kinds, several = list(number), np.minimum(np.bincount(of, minlength=len(number)), 2) - 1 if len(of) else np.empty(0, np.int64)
    hashes, out = np.array([e[0] for e in kinds], np.uint64), []
    for p, a, b in by_part(home_of(hashes, parts), parts):
        blobs = [squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))), pack(np.array([e[1] for e in kinds[a:b]], np.uint8)), squeeze(np.array([len(e[2]) for e in kinds[a:b]], np.uint16)), pack(np.packbits(several[a:b].astype(bool))), pack(b"".join(e[2] for e in kinds[a:b]))]
        out.append({"kind": ASK, "chunk": chunk, "part": p, "data": ipc(c=pa.array(blobs, pa.binary())), "more": bytes([level])})
    return out, of, len(kinds)


def deepen(raw: bytes, start: np.ndarray, off: np.ndarray, window: np.ndarray, bucket: int) -> tuple[np.ndarray, ...]:
    """Cuts windows, in order, (window: where each starts from its region's start; start, off: that of the region in
    raw and that of its first anchor) into runs that share a deeper anchor.

    For each run: the place of its first window among all, how many, its key, its anchor's place from the run's start,
    the run's place in raw and its size, and a hash of its bytes.
    """
    at = start + window
    turn = (off - window) // bucket
    base = start + off - turn * bucket  # where the deeper anchor starts
    new = np.flatnonzero(np.concatenate([[True], (np.diff(base) != 0) | (np.diff(at) != 1)])[: len(at)])
    n = np.diff([*new, len(at)])
    ranges, base, first = Ranges(_NAMES[np.frombuffer(raw, np.uint8)]), base[new], at[new]
    key = mix(ranges.of(base, base + WINDOW + 1 - bucket) ^ mix(turn[new].astype(np.uint64) + np.uint64(bucket << 32)))
    return new, n, key, base - first, first, n + WINDOW - 1, ranges.of(first, first + n + WINDOW - 1)


def suffix_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", chunk_bytes: int = 4 << 20, hot: int = 64) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row. The key must be an integer.

    hot: kinds of regions from which an anchor's windows get deeper anchors; it doesn't change the result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    source = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    parts = parts_for(text_bytes(source, "_text"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = pa.int64()
    out_fields = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out_arrow = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in gather(batches, chunk_bytes):
            anchors = Anchors(texts)
            state = {"kind": STATE, "chunk": chunk, "part": -1, "data": ipc(id=pa.array(ids, kind), text=pa.array(texts, pa.large_binary()))}
            yield from tables([state, *ask_rows(ASK, chunk, anchors.hash, anchors.region, parts, hot)], KEY_ARROW)

    def codes(asked: DataFrame, which: int) -> DataFrame:
        return in_groups(asked.filter(F.col("kind") == which).select("chunk", "part", "data"), "part", lambda rows: answer_asked(rows, hot), CODE_FIELDS, CODE_ARROW)

    first = scratch.save(source.mapInArrow(ask, KEY_FIELDS), by="kind")
    answered = scratch.save(codes(first, ASK))
    scratch.drop_part(first, "kind", ASK)

    def deep_rows(chunk: int, bucket: int, raw: bytes, start: np.ndarray, off: np.ndarray, window: np.ndarray, number: np.ndarray) -> list[dict]:
        """What goes on to the next level: runs of hot windows (number: of each among the chunk's hot windows)."""
        at, n, keys, offs, places, sizes, regions = deepen(raw, start, off, window, bucket)
        columns = [squeeze(np.asarray(c, np.uint32)) for c in (start, off, window, number, at, n, offs, places, sizes)] + [squeeze(keys)]
        state = {"kind": DEEP_STATE, "chunk": chunk, "part": -1, "data": ipc(c=pa.array(columns, pa.binary())), "more": pack(raw)}
        return [state, *ask_rows(DEEP_ASK, chunk, keys, regions, parts, hot)]

    def gather_regions(states: list[dict], answers: list[dict]) -> list[dict]:
        out = []
        for s in states:
            table = unipc(s["data"])
            ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
            anchors = Anchors(texts)
            code = codes_of(anchors.hash, answers, False)
            live = np.flatnonzero(code)
            doc = np.searchsorted(anchors.starts, anchors.at[live], "right") - 1
            busy = np.unique(doc)
            done = [(ids[i], len(texts[i]), 0, 0, hashlib.sha256(texts[i]).hexdigest()) for i in np.setdiff1d(np.arange(len(ids)), busy).tolist()]
            out.append({"kind": CLEAN, "chunk": s["chunk"], "part": -1, "data": ipc(**{n: pa.array([d[k] for d in done], t) for k, (n, t) in enumerate(zip(out_arrow.names, out_arrow.types, strict=True))})})
            if not len(live):
                continue
            sizes = np.array([len(texts[i]) for i in busy.tolist()], np.int64)
            shift = (np.cumsum(sizes) - sizes) - anchors.starts[busy]  # from places in the chunk to those in busy texts
            move = np.zeros(len(anchors.at), np.int64)
            move[live] = shift[np.searchsorted(busy, doc)]
            raw, offset, many = anchors.data.tobytes(), anchors.at - anchors.first, anchors.last - anchors.first + 1
            mild, warm = live[code[live] == 1], live[code[live] == 2]
            rows, of, kinds = meet_rows(s["chunk"], parts, 0, anchors.hash[mild], offset[mild], anchors.first[mild], many[mild] + WINDOW - 1, raw)
            out += rows
            # Regions of hot anchors, each kind once; their windows are numbered through.
            number: dict[tuple[int, bytes], int] = {}
            which = np.array([number.setdefault((o, raw[a : a + n + WINDOW - 1]), len(number)) for o, a, n in zip(offset[warm].tolist(), anchors.first[warm].tolist(), many[warm].tolist(), strict=True)], np.int64)
            n = np.array([len(r) - WINDOW + 1 for _, r in number], np.int64)
            if len(warm):
                # One that comes more than once here goes on twice, under the same numbers.
                go = np.concatenate([np.arange(len(n)), np.flatnonzero(np.bincount(which) > 1)])
                start, base, m = (np.cumsum(n + WINDOW - 1) - n - WINDOW + 1)[go], (np.cumsum(n) - n)[go], n[go]
                inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                out += deep_rows(s["chunk"], BUCKETS[1], b"".join(r for _, r in number), np.repeat(start, m), np.repeat(np.array([o for o, _ in number], np.int64)[go], m), inner, np.repeat(base, m) + inner)
            state = ipc(id=pa.array([ids[i] for i in busy.tolist()], kind), text=pa.array([texts[i] for i in busy.tolist()], pa.large_binary()))
            places = [kinds], of, anchors.first[mild] + move[mild], many[mild], which, anchors.first[warm] + move[warm], n
            out.append({"kind": STATE, "chunk": s["chunk"], "part": -1, "data": state, "more": ipc(c=pa.array([squeeze(np.asarray(a, np.uint32)) for a in places], pa.binary()))})
        return out

    def gather_deeper(level: int):
        def work(states: list[dict], answers: list[dict]) -> list[dict]:
            out = []
            for s in states:
                *columns, keys = unipc(s["data"]).column(0).to_pylist()
                start, off, window, number, at, n, offs, places, sizes = (expand(c, "u4").astype(np.int64) for c in columns)
                keys, raw = expand(keys, "u8"), unpack(s["more"])
                code = codes_of(keys, answers, level + 1 == len(BUCKETS))
                mild, warm = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
                rows, of, kinds = meet_rows(s["chunk"], parts, level, keys[mild], offs[mild], places[mild], sizes[mild], raw)
                out += rows
                found = [kinds], of, number[at[mild]], n[mild]
                out.append({"kind": MAP + level, "chunk": s["chunk"], "part": -1, "data": ipc(c=pa.array([squeeze(np.asarray(a, np.uint32)) for a in found], pa.binary()))})
                if len(warm):
                    go = np.repeat(at[warm], n[warm]) + np.arange(n[warm].sum()) - np.repeat(np.cumsum(n[warm]) - n[warm], n[warm])
                    out += deep_rows(s["chunk"], BUCKETS[level + 1], raw, start[go], off[go], window[go], number[go])
            return out

        return work

    second = scratch.save(in_pairs(first.filter(F.col("kind") == STATE).select("chunk", "data"), answered, "chunk", gather_regions, KEY_FIELDS, KEY_ARROW), by="kind")
    scratch.drop(first, answered)
    levels = [second]
    for level in range(1, len(BUCKETS)):
        asked = levels[-1].filter(F.col("kind") == DEEP_ASK)
        if asked.isEmpty():
            break
        deeper = levels[-1].filter(F.col("kind") == DEEP_STATE).select("chunk", "data", "more")
        levels.append(scratch.save(in_pairs(deeper, codes(levels[-1], DEEP_ASK), "chunk", gather_deeper(level), KEY_FIELDS, KEY_ARROW), by="kind"))

    def decide(rows: list[dict]) -> list[dict]:
        out = []
        for level in sorted({r["more"] for r in rows}):
            mine, keys, offs, regions, weights, cuts = [r for r in rows if r["more"] == level], [], [], [], [], [0]
            for r in mine:
                h, off, size, several, raw = unipc(r["data"]).column(0).to_pylist()
                h, ends, raw = np.cumsum(expand(h, "u8"), dtype=np.uint64).tolist(), np.cumsum(expand(size, "u2").astype(np.int64)).tolist(), unpack(raw)
                keys += h
                offs += unpack(off, "u1").tolist()
                weights += (1 + np.unpackbits(unpack(several, "u1"), count=len(h))).tolist()
                regions += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                cuts.append(len(regions))
            masks = compare_regions(keys, offs, regions, weights)
            out += [{"chunk": r["chunk"], "part": r["part"], "kind": level[0], "data": pack(np.packbits(bits := np.concatenate(masks[a:b]))), "n": len(bits)} for r, a, b in zip(mine, cuts[:-1], cuts[1:], strict=True)]
        return out

    regions = reduce(DataFrame.unionByName, [t.filter(F.col("kind") == ASK).select("chunk", "part", "data", "more") for t in levels])
    replies = in_groups(regions, "part", decide, REPLY, REPLY_ARROW)
    maps = [t.filter(F.col("kind") >= MAP).select("chunk", "part", "kind", "data", F.lit(0).cast("long").alias("n")) for t in levels[1:]]

    def bits_of(answers: list[dict], level: int, n: int) -> np.ndarray:
        rows = sorted((r for r in answers if r["kind"] == level), key=lambda r: r["part"])
        out = np.concatenate([np.empty(0, bool), *[np.unpackbits(unpack(r["data"], "u1"), count=r["n"]).astype(bool) for r in rows]])
        if len(out) != n:
            raise ValueError("answers don't fit their questions")
        return out

    def spread(mask: np.ndarray, kinds: int, of: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places whose windows repeat: region i starts at first[i] and has the n[i] bits of its kind of[i]."""
        size = np.zeros(kinds, np.int64)
        size[of] = n
        begin, inner = np.cumsum(size) - size, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (np.repeat(first, n) + inner)[mask[np.repeat(begin[of], n) + inner]]

    def total(kinds: int, of: np.ndarray, n: np.ndarray) -> int:
        size = np.zeros(kinds, np.int64)
        size[of] = n
        return int(size.sum())

    def finish(states: list[dict], answers: list[dict]) -> list[dict]:
        out = []
        for s in states:
            table = unipc(s["data"])
            texts = table.column("text").to_pylist()
            starts = np.cumsum([0, *map(len, texts)])
            kinds, of, place, n, which, warm, hot_n = (expand(b, "u4").astype(np.int64) for b in unipc(s["more"]).column(0).to_pylist())
            again = np.zeros(int(starts[-1]) + 1, bool)
            again[spread(bits_of(answers, 0, total(kinds[0], of, n)), kinds[0], of, place, n)] = True
            if len(warm):
                hit = np.zeros(int(hot_n.sum()), bool)
                for r in answers:
                    if r["kind"] >= MAP:
                        k, of, number, n = (expand(b, "u4").astype(np.int64) for b in unipc(r["data"]).column(0).to_pylist())
                        hit[spread(bits_of(answers, r["kind"] - MAP, total(k[0], of, n)), k[0], of, number, n)] = True
                begin = np.cumsum(hot_n) - hot_n
                n = hot_n[which]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                again[(np.repeat(warm, n) + inner)[hit[np.repeat(begin[which], n) + inner]]] = True
            change = np.zeros(len(again) + WINDOW, np.int64)
            at = np.flatnonzero(again)
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            gone = np.cumsum(change)[: starts[-1]] > 0
            for i, (k, text) in enumerate(zip(table.column("id").to_pylist(), texts, strict=True)):
                mine = gone[starts[i] : starts[i + 1]]
                kept = np.frombuffer(text, np.uint8)[~mine].tobytes()
                spans = int((mine[1:] & ~mine[:-1]).sum() + (mine[:1].sum()))
                out.append({"_id": k, "n_bytes": len(text), "n_removed": int(mine.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return out

    cut = in_pairs(second.filter(F.col("kind") == STATE).select("chunk", "data", "more"), reduce(DataFrame.unionByName, maps, replies), "chunk", finish, out_fields, out_arrow)

    def unwrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from unipc(data).to_batches()

    clean = second.filter(F.col("kind") == CLEAN).select("data").mapInArrow(unwrap, out_fields)
    return clean.unionByName(cut).withColumnRenamed("_id", key)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
