"""Substring dedup on words by recompression.

Rounds rename a text's words from the bottom up: maximal runs of one word become a symbol, then in each of two rounds
every pair of neighbours whose left symbol falls in one half of the alphabet and whose right one in the other becomes a
symbol. Names and halves are hashes of the content, so every chunk gives a symbol the same name without a dictionary to
join with: equal passages get equal symbols but near their ends.

How near is bounded. The runs at a window's two ends may go on beyond it; those between are the same wherever the
window stands. So are symbols of the first pair round that lie two runs inside of the ends, and of the second one four
runs inside. A second-round symbol takes four runs at most, so where a window of 20 words has 15 runs or more (most
have 20, of one word each) one or more starts in the part that leaves it room; the one with the least hash (the
leftmost of equals) is the window's symbol. Its name and those of the first-round symbols up to two runs beside it are
a key that equal windows share. A window of fewer runs has their symbols for a key, cut where the window cuts them.

All windows of one key that follow each other are a region. One Spark round groups regions by key: a key that nobody
else has rules its windows out, shared ones reveal the repeats. A second one takes the words of the regions left to
where their keys meet, and compares them window by window, words and not hashes: the least (document id, start) of
equal ones stays, all others are removed. A key with more than `hot` kinds of regions would gather too many; its
windows meet by the words of each, of which a chunk sends one copy only.

The corpus is cut into chunks; each asks hash partitions about its distinct keys in packed rows (chunks.py), so a
passage that a third of the documents share is asked about once a chunk.

Defined cases: null text is empty; a text of fewer words than a window loses nothing. Null ids come last in order;
rows that share an id come in the order of their chunks, which is stable for a given layout of the input. Words are
`[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import expand, gather, in_groups, in_pairs, ipc, pack, parts_for, squeeze, tables, text_bytes, unipc, unpack
from plumbline.llm.common import Scratch
from plumbline.llm.keys import _M1, _M2, ASK, CODE_ARROW, CODE_FIELDS, KEY_ARROW, KEY_FIELDS, STATE, Ranges, answer_asked, ask_rows, by_part, codes_of, home_of, mix

WINDOW = 20
ROUNDS = 2
#: A window's symbol starts so many runs after its first and before its last one; with fewer runs than FEW there may be none.
AFTER, BEFORE, FEW = 4, 7, 15
_PLACE = np.uint64((1 << 26) - 1)
def names_of(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for each word of all lists, and the place where each list begins (and the end)."""
    import xxhash

    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.fromiter((put(w, len(number)) for words in lists for w in words), np.int64)
    names = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    return names[ids], np.cumsum([0, *map(len, lists)])


def run_symbols(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, name) of the maximal runs of each list; a run of one word keeps its name."""
    n = len(names)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    at = np.flatnonzero(first[:n] | (np.concatenate([[0], names[:-1]]) != names) | (np.arange(n) == 0))
    ends = np.concatenate([at[1:], [n]]).astype(np.int64)[: len(at)]
    length = ends - at
    return at, ends, np.where(length > 1, mix(names[at] + mix(length.astype(np.uint64))), names[at])


def pair_round(k: int, at: np.ndarray, ends: np.ndarray, name: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after round k has named pairs; first: whether a list starts at a word, which no pair crosses."""
    right = (mix(name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
    pair = np.flatnonzero(~right[:-1] & right[1:] & ~first[at[1:]])
    name, ends = name.copy(), ends.copy()
    name[pair] = mix(name[pair] * _M1 + mix(name[pair + 1]) + np.uint64(k + 1))
    ends[pair] = ends[pair + 1]
    keep = np.ones(len(name), bool)
    keep[pair + 1] = False
    return at[keep], ends[keep], name[keep]


class Parsed:
    """The regions of some documents: where each starts, its number of windows, its key, and a hash of its words."""

    def __init__(self, lists: list[list[bytes]], window: int = WINDOW):
        self.names, self.starts = names_of(lists)
        n = len(self.names)
        self.ranges = Ranges(self.names)
        valid = np.zeros(n + 1, bool)
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b - a >= window:
                valid[a : b - window + 1] = True
        w = np.flatnonzero(valid)
        runs = run_symbols(self.names, self.starts)
        first = np.zeros(n + 1, bool)
        first[self.starts] = True
        rounds = [runs]
        for k in range(ROUNDS):
            rounds.append(pair_round(k, *rounds[-1], first) if n else runs)
        run_of = np.zeros(n, np.int64)
        run_of[runs[0]] = 1
        run_of = np.cumsum(run_of) - 1
        low, high = run_of[w], run_of[w + window - 1]
        many = high - low >= FEW - 1
        plain, broken, low, high = w[many], w[~many], low[many], high[many]
        (s1, e1, name1), (s, e, name) = rounds[1], rounds[-1]
        least = self._least(run_of[s], name, len(runs[0]), low, high)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(plain) != 1)])[: len(plain)])
        at = least[new]
        x = np.searchsorted(s, runs[0][at])
        i = np.searchsorted(s1, runs[0][at - 2])
        j = np.maximum(i, np.searchsorted(e1, runs[1][run_of[e[x] - 1] + 2], "right"))
        key = mix(Ranges(name1).of(i, j) ^ mix(name[x]))
        self.first = np.concatenate([plain[new], broken])
        self.n = np.concatenate([np.diff([*new, len(plain)]), np.ones(len(broken), np.int64)]).astype(np.int64)
        self.key = np.concatenate([key, self._run_keys(runs, broken, window)])
        self.region = self.ranges.of(self.first, self.first + self.n + window - 1)

    def _least(self, s: np.ndarray, name: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The run at which the symbol of each window (its runs: low to high) starts; s: the run where each symbol does.

        Windows of as many runs look over as many places: a least value is taken by blocks of that width.
        """
        value = np.full(n + 2 * WINDOW, np.iinfo(np.uint64).max)
        value[s] = (mix(name ^ _M2) & ~_PLACE) | (s.astype(np.uint64) & _PLACE)
        out = np.empty(len(low), np.int64)
        for width in np.unique(high - low).tolist():
            mine, width = np.flatnonzero(high - low == width), width - AFTER - BEFORE + 1
            grid = value[: len(value) // width * width].reshape(-1, width)
            ahead, back = np.minimum.accumulate(grid, 1).ravel(), np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
            begin = low[mine] + AFTER
            place = np.minimum(back[begin], ahead[begin + width - 1]) & _PLACE
            out[mine] = begin + ((place - begin.astype(np.uint64)) & _PLACE).astype(np.int64)
        return out

    def _run_keys(self, runs: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, window: int) -> np.ndarray:
        """Keys of windows with runs: the symbols of the runs inside, and the words of those at the ends with as many
        times as the window holds them."""
        at, ends, name = runs
        i, j = np.searchsorted(at, w, "right") - 1, np.searchsorted(at, w + window - 1, "right") - 1
        head = np.minimum(ends[i], w + window) - w
        tail = w + window - np.maximum(at[j], w)
        inner = Ranges(name).of(i + 1, np.maximum(i + 1, j))
        return ~mix(inner + mix(self.names[w] + mix(head.astype(np.uint64))) * _M1 + mix(self.names[w + window - 1] ^ mix(tail.astype(np.uint64))))

    def windows(self, regions: np.ndarray) -> np.ndarray:
        """Starts of the windows of some regions."""
        n = self.n[regions]
        return np.repeat(self.first[regions], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def removed_words(n: int, windows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, windows, 1)
    np.add.at(change, np.minimum(windows + window, n), -1)
    return np.cumsum(change)[:n] > 0


ANSWER_FIELDS = "chunk long, part int, data binary, n long"
ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("n", pa.int64())])


def answered(rows: list[dict]) -> np.ndarray:
    """All parts' answers to one chunk, in order."""
    bits = [np.unpackbits(unpack(r["data"], "u1"), count=r["n"]).astype(bool) for r in sorted(rows, key=lambda r: r["part"])]
    return np.concatenate(bits) if bits else np.empty(0, bool)


def later_bits(rows: list[dict]) -> list[dict]:
    """Of the windows that rows hold (by region: key, windows, id, start, words): those whose words a lesser (id, start)
    of the same key has."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    columns, words = [], []
    for r in rows:
        key, n, ids, start, text = unipc(r["data"]).column(0).to_pylist()
        columns.append((np.cumsum(expand(key, "u8"), dtype=np.uint64), expand(n, "u1").astype(np.int64), expand(ids, "i8"), expand(start, "u4")))
        words.append(unpack(text))
    key, n, ids, start = (np.concatenate(c) for c in zip(*columns, strict=True))
    raw = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
    # A region of n windows has n + 19 words; they follow each other in raw.
    first = np.cumsum(n + WINDOW - 1) - n - WINDOW + 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    order = np.lexsort((start, ids, key))
    m = n[order]
    inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    word, place = np.repeat(first[order], m) + inner, np.repeat((np.cumsum(n) - n)[order], m) + inner
    later = np.zeros(len(place), np.uint8)
    last, seen, hits = None, set(), []
    for k, a, b, p in zip(np.repeat(key[order], m).tolist(), begins[word].tolist(), ends[word + WINDOW - 1].tolist(), place.tolist(), strict=True):
        if k != last:
            last, seen = k, set()
        text = raw[a:b]
        if text in seen:
            hits.append(p)
        else:
            seen.add(text)
    later[hits] = 1
    cuts = np.cumsum([0, *(int(c[1].sum()) for c in columns)])
    return [{"chunk": r["chunk"], "part": r["part"], "data": pack(np.packbits(later[i:j])), "n": int(j - i)} for r, i, j in zip(rows, cuts[:-1], cuts[1:], strict=True)]


def ranks(ids: list) -> np.ndarray:
    """Sortable numbers of ids: the ids themselves, null last."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)


def substring_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", chunk_bytes: int = 4 << 20, hot: int = 64) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for each row. The key must be an integer.

    hot: kinds of regions from which a key's windows meet by their own words; it doesn't change the result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    source = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    parts = parts_for(text_bytes(source, "_text"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = pa.int64()
    out_fields, out_arrow = "_id long, n_words long, n_removed long, kept_sha256 string", pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in gather(batches, chunk_bytes):
            parsed = Parsed([t.split() for t in texts])
            state = ipc(id=pa.array(ids, kind), text=pa.array(texts, pa.large_binary()))
            yield from tables([{"kind": STATE, "chunk": chunk, "part": -1, "data": state}, *ask_rows(ASK, chunk, parsed.key, parsed.region, parts, hot)], KEY_ARROW)

    first = scratch.save(source.mapInArrow(ask, KEY_FIELDS), by="kind")
    codes = scratch.save(in_groups(first.filter(F.col("kind") == ASK).select("chunk", "part", "data"), "part", lambda rows: answer_asked(rows, hot), CODE_FIELDS, CODE_ARROW))
    scratch.drop_part(first, "kind", ASK)

    def verify(states: list[dict], answers: list[dict]) -> list[dict]:
        out = []
        for s in states:
            table = unipc(s["data"])
            ids, lists = table.column("id").to_pylist(), [t.split() for t in table.column("text").to_pylist()]
            parsed = Parsed(lists)
            code = codes_of(parsed.key, answers, False)
            live = np.flatnonzero(code)
            busy = np.unique(np.searchsorted(parsed.starts, parsed.first[live], "right") - 1)
            clean = np.setdiff1d(np.arange(len(ids)), busy)
            done = [(ids[i], len(lists[i]), 0, hashlib.sha256(b" ".join(lists[i])).hexdigest()) for i in clean.tolist()]
            out.append({"kind": 2, "chunk": s["chunk"], "part": -1, "data": ipc(**{n: pa.array([d[k] for d in done], t) for k, (n, t) in enumerate(zip(out_arrow.names, out_arrow.types, strict=True))})})
            if not len(live):
                continue
            mild, alone = live[code[live] == 1], parsed.windows(live[code[live] == 2])
            at, n = np.concatenate([parsed.first[mild], alone]), np.concatenate([parsed.n[mild], np.ones(len(alone), np.int64)])
            keys = np.concatenate([parsed.key[mild], mix(parsed.ranges.of(alone, alone + WINDOW) ^ _M2)])
            doc = np.searchsorted(parsed.starts, at, "right") - 1
            start, rank = (at - parsed.starts[doc]).astype(np.uint32), ranks(ids)[doc]
            # The bytes of words i to j, each with a space after it, are raw[edges[i] : edges[j]].
            raw = b" ".join([w for words in lists for w in words]) + b" "
            edges = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1])
            # Of equal regions the least goes on, and the windows of all others have it before them.
            order = np.lexsort((at, start, rank, keys))
            seen: set[tuple[int, bytes]] = set()
            fresh, texts = np.zeros(len(order), bool), []
            for i, k, a, b in zip(range(len(order)), keys[order].tolist(), edges[at[order]].tolist(), edges[(at + n + WINDOW - 1)[order]].tolist(), strict=True):
                entry = (k, raw[a : b - 1])
                if entry not in seen:
                    seen.add(entry)
                    fresh[i] = True
                    texts.append(entry[1])
            asked, again = order[fresh], order[~fresh]
            # Places among the words of the documents that go on.
            sizes = np.array([len(lists[i]) for i in busy.tolist()], np.int64)
            moved = (np.cumsum(sizes) - sizes)[np.searchsorted(busy, doc)] + start
            state = ipc(id=pa.array([ids[i] for i in busy.tolist()], kind), text=pa.array([b" ".join(lists[i]) for i in busy.tolist()], pa.large_binary()))
            out.append({"kind": STATE, "chunk": s["chunk"], "part": -1, "data": state, "more": ipc(c=pa.array([squeeze(np.asarray(c, np.uint32)) for c in (moved[asked], n[asked], moved[again], n[again])], pa.binary()))})
            for p, i, j in by_part(home_of(keys[asked], parts), parts):
                mine = asked[i:j]
                columns = np.diff(keys[mine], prepend=np.uint64(0)), n[mine].astype(np.uint8), rank[mine], start[mine]
                out.append({"kind": ASK, "chunk": s["chunk"], "part": p, "data": ipc(c=pa.array([*map(squeeze, columns), pack(b" ".join(texts[i:j]))], pa.binary()))})
        return out

    second = scratch.save(in_pairs(first.filter(F.col("kind") == STATE).select("chunk", "data"), codes, "chunk", verify, KEY_FIELDS, KEY_ARROW), by="kind")
    scratch.drop(first, codes)
    bits_2 = scratch.save(in_groups(second.filter(F.col("kind") == ASK).select("chunk", "part", "data"), "part", later_bits, ANSWER_FIELDS, ANSWER_ARROW))
    scratch.drop_part(second, "kind", ASK)

    def finish(states: list[dict], answers: list[dict]) -> list[dict]:
        out = []
        for s in states:
            table = unipc(s["data"])
            at, n, again, m = (expand(c, "u4").astype(np.int64) for c in unipc(s["more"]).column(0).to_pylist())
            asked, again = (np.repeat(x, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) for x, k in ((at, n), (again, m)))
            lists = [t.split() for t in table.column("text").to_pylist()]
            starts = np.cumsum([0, *map(len, lists)])
            gone = removed_words(int(starts[-1]), np.concatenate([asked[answered(answers)], again]))
            for i, (k, words) in enumerate(zip(table.column("id").to_pylist(), lists, strict=True)):
                mine = gone[starts[i] : starts[i + 1]]
                n = int(mine.sum())
                kept = [w for w, g in zip(words, mine.tolist(), strict=True) if not g] if n else words
                out.append({"_id": k, "n_words": len(words), "n_removed": n, "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()})
        return out

    cut = in_pairs(second.filter(F.col("kind") == STATE).select("chunk", "data", "more"), bits_2, "chunk", finish, out_fields, out_arrow)

    def unwrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from unipc(data).to_batches()

    clean = second.filter(F.col("kind") == 2).select("data").mapInArrow(unwrap, out_fields)
    return clean.unionByName(cut).withColumnRenamed("_id", key)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
