"""Each operator against brute force on a table of awkward rows, on an empty one, and on the driver's small tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, common, components, language_id, lattice, mixing, packing, recompression, simhash, suffix_dedup, vector_search
from plumbline.llm.common import Scratch
from plumbline.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import same

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(folder, rows):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    columns = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
    clash = {n: pa.array([i for i in range(len(rows))], pa.int64()) for n in ("_id", "_row", "fp", "score", "size", "kept", "kind", "_text", "lang_pred", "_maybe")}
    pq.write_table(pa.table(columns | clash), f"{folder}/documents.parquet")
    return str(folder)


def awkward_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, passage = text(120), text(60)
    texts = [
        None, "", " \t\n\x0b", "a", "!!! 123", base, base, base.replace(" ", "\n", 3), base + " tail", passage, text(30) + " " + passage + " " + text(30), text(40) + " " + passage,
        "the " * 500, "ab" * 400, "Größe über Straße " * 40, "x <|endoftext|> y <|im_end|>", "   no break", text(20_000), text(5) + " " + passage[:230], "\x00\x01 nul", "A B C", "a b c", "日本語の文章です",
        "z" * 70_000, " ".join(["same words again"] * 200),
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "\U0001f600", None][i % 4], None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, base, "en", "s1", 1), (None, None, None, None, None), (None, "only here " + text(50), "fr", "s2", 2)]


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    rows = awkward_rows()
    return documents(tmp_path_factory.mktemp("awkward"), rows), rows


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    pq.write_table(pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}), f"{folder}/conversations.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}), f"{folder}/embeddings.parquet")
    return documents(folder, [])


def tokens(text):
    return (text or "").encode().split()


def listed(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == ([] if name != "op2_chat" else QUERIES[name](spark, empty).filter("conv_id = -1").collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SMALL)


# 9: exact dedup


def test_exact_dedup_of_awkward_rows(spark, awkward):
    folder, rows = awkward
    import re

    shas = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, *_ in rows]
    ids, size = {}, Counter(shas)
    for (i, *_), h in zip(rows, shas, strict=True):
        ids.setdefault(h, []).append(i)
    least = {h: min((i for i in v if i is not None), default=None) for h, v in ids.items()}
    expected = Counter((i, least[h], size[h], i == least[h], h) for (i, *_), h in zip(rows, shas, strict=True))
    assert listed(QUERIES["op9_exact_dedup"](spark, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == expected


def test_keep_first_returns_one_row_a_text(spark, awkward):
    from plumbline.llm.exact_dedup import keep_first

    folder, rows = awkward
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = keep_first(df)
    assert kept.columns == df.columns
    import re

    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows})


def test_exact_dedup_by_ranges_of_the_hash(spark, awkward):
    from plumbline.llm.exact_dedup import exact_dedup, keep_first

    df = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    ranged = exact_dedup(df, filter_bits=128)
    assert listed(ranged) == listed(exact_dedup(df))
    assert listed(keep_first(df, filter_bits=128).select("doc_id", "n_chars")) == listed(keep_first(df).select("doc_id", "n_chars"))


def test_keep_first_does_not_depend_on_order(spark):
    from plumbline.llm.exact_dedup import keep_first

    df = spark.createDataFrame([(1, "a  b", n) for n in range(40)] + [(2, "a b", 99), (None, "c", 1), (None, "c", 2)], "doc_id long, text string, n int")
    first = sorted(map(tuple, keep_first(df).collect()), key=repr)
    assert len(first) == 2 and all(sorted(map(tuple, keep_first(df.orderBy(F.rand(i)).repartition(i + 2)).collect()), key=repr) == first for i in range(3))


# 6: SimHash


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    distinct, of = sorted(set(prints)), {}
    for a in distinct:
        of[a] = a

    def root(a):
        while of[a] != a:
            a = of[a]
        return a

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= distance:
            of[root(a)] = root(b)
    return [root(p) for p in prints]


def plain_groups(rows, n=5, similarity=0.8):
    """The least id of each group of rows (id: text) by brute force: two bits, or so large a share of their shingles."""
    ids, sets = sorted(rows), {}
    for i in ids:
        words = (rows[i] or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    prints, of = {i: plain_fingerprint(rows[i], n) for i in ids}, {i: i for i in ids}

    def root(a):
        while of[a] != a:
            a = of[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if (prints[a] ^ prints[b]).bit_count() <= 2 or both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            of[b] = a
    return {root(i) for i in ids}


@pytest.mark.parametrize("few", [64, 2])
def test_keep_one_holds_texts_of_high_similarity(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("doc_id < 400").collect()}
    for base in range(12):
        text = rng.choices(words, k=rng.choice([8, 60, 700]))
        for copy in range(25):
            t = list(text)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows[10_000 + 100 * base + copy] = " ".join(t)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    expected = plain_groups(rows)
    assert len(expected) < len(plain_groups(rows, similarity=2)) - 10  # two bits alone miss many
    assert got == expected


def left_in(folder):
    """The columns of every table that is left in a shared folder."""
    return [set(pq.read_schema(next(t.glob("*.parquet"))).names) for t in folder.iterdir()]


def test_keep_one_leaves_no_table_that_its_result_does_not_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = simhash.keep_one(docs)
    # What goes or repeats, and two bitmaps of it.
    assert sorted(left_in(tmp_path), key=sorted) == [{"_bucket0", "_map0"}, {"_bucket1", "_map1"}, {"_sha", "_gone"}]
    assert {r["doc_id"] for r in got.collect()} == plain_groups(rows)


def test_keep_one_tells_rows_apart_whatever_their_ids(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]

    def text():
        return " ".join(rng.choices(words, k=200))

    def near(t):
        return t + " " + rng.choice(words)

    with_id, none, shared, repeated = text(), text(), text(), text()
    groups = [  # (rows, ids that may name the one that stays)
        ([(1, with_id), (None, near(with_id)), (None, near(with_id))], {1}),
        ([(None, none), (None, near(none)), (None, near(none))], {None}),
        ([(7, shared), (7, near(shared)), (7, near(shared))], {7}),
        ([(8, repeated), (8, repeated), (None, repeated), (None, repeated)], {8}),
        ([(9, None), (9, ""), (None, None)], {9}),
        *[([(i, text())], {i}) for i in (None, None, None, 7, 7, 8, 9, 11)],
    ]
    rows = [(i, t, n, n) for n, (members, _) in enumerate(groups) for i, t in members]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_no int, _sha int").repartition(5)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(got.collect(), key=lambda r: r["group_no"])
    assert [r["group_no"] for r in kept] == list(range(len(groups)))
    assert all(r["doc_id"] in groups[r["group_no"]][1] and (r["doc_id"], r["text"]) in groups[r["group_no"]][0] for r in kept)
    text_ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "group_no")
    empty = text_ids.withColumn("doc_id", F.when(F.col("group_no") == 1, "").otherwise(F.col("doc_id")))
    assert sorted(r["group_no"] for r in simhash.keep_one(empty).collect()) == list(range(len(groups)))


def test_signatures_rule_out_no_similar_pair(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a = rng.sample(range(10**6), rng.choice([1, 3, 40, 400, 4000]))
        b = a[rng.randint(0, len(a) // 6) :] + rng.sample(range(10**6, 10**7), rng.randint(0, len(a) // 6))
        hashes = [np.array([xxhash.xxh64_intdigest(str(x)) for x in t], np.uint64) for t in (a, b)]
        (_, u, n, _), (_, v, m, _) = (simhash.sketch_of([h]) for h in hashes)
        both = len({*hashes[0].tolist()} & {*hashes[1].tolist()})
        rows.append((u, n, v, m, both / (n + m - both)))
    df = spark.createDataFrame(rows, "u_sign array<long>, u_size long, v_sign array<long>, v_size long, j double")
    got = df.select("j", simhash.in_reach("u", "v", 0.8).alias("near")).collect()
    assert all(r["near"] for r in got if r["j"] >= 0.8) and sum(r["j"] >= 0.8 for r in got) > 50
    assert any(not r["near"] for r in got)


def check_simhash(spark, folder, rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(prints)
    least = {r: min((i for (i, *_), x in zip(rows, roots, strict=True) if x == r and i is not None), default=None) for r in set(roots)}
    expected = Counter((i, f"{p:016x}", least[r]) for (i, *_), p, r in zip(rows, prints, roots, strict=True))
    assert listed(QUERIES["op6_simhash"](spark, folder).select("doc_id", "fingerprint", "component_id")) == expected


def test_simhash_of_awkward_rows(spark, awkward):
    check_simhash(spark, *awkward)


def test_simhash_of_the_small_table(spark):
    check_simhash(spark, SMALL, [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("n", [10, 5_000_000, 10**9])
def test_links_are_all_pairs_in_reach(spark, n):
    rng = random.Random(n)
    seeds = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), n).collect()}
    assert got == {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(900 + i, 900 + (i + 1) % 7) for i in range(7)] + [(rng.randint(2000, 2080), rng.randint(2000, 2080)) for _ in range(60)]
    of = {x: x for p in pairs for x in p}
    for _ in range(len(of)):
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
    links = spark.createDataFrame(pairs, "u long, v long").repartition(12)
    for block in (1 << 18, 40, 15):
        got = components.components(Scratch(spark), links, block=block).collect()
        assert len(got) == len({r["node"] for r in got})
        assert dict(map(tuple, got)) == {k: v for k, v in of.items() if any(a != b and k in (a, b) for a, b in pairs)}


# 7: recompression


def plain_words(rows, window=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    for k in order:
        words = tokens(rows[k][1])
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[k] = (rows[k][0], len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
    return Counter(out)


def test_substring_dedup_of_awkward_rows(spark, awkward):
    folder, rows = awkward
    assert listed(QUERIES["op7_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256")) == plain_words(rows)


@pytest.mark.parametrize("hot", [0, 2, 64])
def test_substring_dedup_over_many_chunks(spark, hot):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = recompression.substring_dedup(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5), chunk_bytes=20_000, hot=hot)
    assert listed(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == plain_words(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), min_size=20, max_size=60), st.lists(st.sampled_from([b"a", b"b", b"q"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"q"]), max_size=12))
def test_equal_windows_share_a_key(passage, before, after):
    one, two = recompression.Parsed([passage]), recompression.Parsed([before + passage + after])
    keys = set(two.key.tolist())
    shared = np.flatnonzero([k in keys for k in one.key.tolist()])
    assert sorted(one.windows(shared).tolist()) == list(range(len(passage) - 19))


# 3: suffix arrays


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain_bytes(rows, window=200):
    data = [(t or "").encode() for _, t, *_ in rows]
    times = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for (k, *_), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if times[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [0, 2, 64])
def test_suffix_dedup_of_awkward_rows(spark, awkward, hot):
    folder, rows = awkward
    assert max(len(r[1] or "") for r in rows) > 60_000
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = suffix_dedup.suffix_dedup(df, chunk_bytes=4_000, hot=hot)
    assert listed(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_bytes(rows)


def test_suffix_dedup_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert listed(QUERIES["op3_suffix_dedup"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_bytes(rows)


def test_suffix_dedup_where_one_passage_is_everywhere(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(420))
    texts = ["".join(rng.choice("xyz") for _ in range(rng.randint(0, 260))) + passage[: rng.choice([230, 420])] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 260))) for _ in range(250)]
    rows = list(enumerate([*texts, *texts[:40]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot in (4, 1_000):
        got = suffix_dedup.suffix_dedup(df, chunk_bytes=3_000, hot=hot)
        assert listed(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_bytes(rows)


def test_suffix_arrays_decide_every_repeat(spark, awkward, monkeypatch):
    texts = [t.encode() for _, t, *_ in awkward[1] if t] * 2
    anchors = suffix_dedup.Anchors(texts)
    raw = anchors.data.tobytes()
    regions = [(h, at - a, raw[a : b + suffix_dedup.WINDOW]) for h, at, a, b in zip(anchors.hash.tolist(), anchors.at.tolist(), anchors.first.tolist(), anchors.last.tolist(), strict=True)]
    compare = lambda: sum(m.sum() for m in suffix_dedup.compare_regions(*map(list, zip(*regions, strict=True)), [1] * len(regions)))
    assert compare() == sum(len(r) - suffix_dedup.WINDOW + 1 for _, _, r in regions)
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda strings, weights, window: [np.zeros(len(s) - window + 1, bool) for s in strings])
    assert compare() == 0


def test_anchors_across_blocks(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = suffix_dedup.Anchors([text])
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = suffix_dedup.Anchors([text])
    places = [{x: a for a, f, t in zip(p.at.tolist(), p.first.tolist(), p.last.tolist(), strict=True) for x in range(f, t + 1)} for p in (whole, parts)]
    assert places[0] == places[1] and sorted(places[0]) == list(range(len(text) - 199))


# 8: lattice


def plain_lattice(word, pieces, score):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [*[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if all(p in pieces.number for p in parts):
            total += math.exp(sum(score[pieces.number[p]] for p in parts))
    return math.log(total)


def test_lattice_sums_all_segmentations():
    rng = random.Random(4)
    listed_ = sorted({bytes(rng.choice(b" abc"[i > 0 :]) for i in range(rng.randint(1, 4))) for _ in range(60)} | {b" ", b"a", b"b", b"c"})
    pieces, score = lattice.Pieces(listed_), np.log(np.array([rng.random() for _ in listed_]))
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(50)]
    expected = [plain_lattice(b" " + w, pieces, score) for w in words]
    assert np.allclose(lattice.log_probabilities(words, pieces, score), expected)
    assert np.allclose([lattice.one_word(b" " + w, pieces, score)[0][-1] for w in words], expected)
    counts = np.arange(1.0, len(words) + 1)
    use = lattice.expected_use(words, counts, pieces, score)
    assert np.isclose(sum(u * len(p) for u, p in zip(use, listed_, strict=True)), sum(c * (len(w) + 1) for c, w in zip(counts, words, strict=True)))
    long = [w * 9 for w in words[:3] if len(w) * 9 > lattice.LONG] or [b"abc" * 20]
    short = np.array([lattice.forward(m, pieces.spans(m), score)[-1][0] for m in (np.frombuffer(b" " + w, np.uint8)[None, :] for w in long)])
    assert np.allclose(lattice.log_probabilities(long, pieces, score), short)


def test_base_scores_of_awkward_rows(spark, awkward):
    folder, rows = awkward
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, *_ in rows]
    texts = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    c = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    expected = Counter((i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for (i, *_), t, h in zip(rows, texts, held, strict=True))
    got = QUERIES["op8_lm_scoring"](spark, folder)
    assert listed(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4))) == expected
    assert got.filter("score >= 0 or isnan(score) or score is null").count() == 0


def test_scores_are_lattice_marginals_over_all_cuts(spark, tmp_path):
    import sentencepiece

    rng = random.Random(12)
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    listed_, weight = lattice.vocabulary(path)
    assert sentencepiece.SentencePieceProcessor(model_file=path).vocab_size() >= len(listed_) - 256
    pieces = lattice.Pieces(listed_)
    words = ["the", "these", "cat", "Cats", "über", "a", "xq", "ing", "z9"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(30)] + [(100, None), (101, "never seen")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    texts = {i: (t or "").encode().lower().split() for i, t in rows}

    def paths(word):
        out = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [*[k + 1 for k, c in enumerate(cuts) if c], len(word)]
            parts = [pieces.number.get(word[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            if None not in parts:
                out.append(parts)
        return out

    every = {w: paths(b" " + w) for t in texts.values() for w in t}
    p, end, smooth = weight / weight.sum() * 0.9, 0.1, 0.1
    train, docs = Counter(w for i, t in texts.items() if not held[i] for w in t), sum(not h for h in held.values())
    for _ in range(2):
        use = np.zeros(len(p))
        for w, n in train.items():
            share = [math.prod(p[k] for k in path) for path in every[w]]
            for cut, x in zip(every[w], share, strict=True):
                for k in cut:
                    use[k] += n * x / sum(share)
        total = use.sum() + smooth * len(use) + docs + smooth
        p, end = (use + smooth) / total, (docs + smooth) / total
    expected = {i: math.log10(end) + sum(math.log10(sum(math.prod(p[k] for k in path) for path in every[w])) for w in t) for i, t in texts.items()}
    got = {r["doc_id"]: r["score"] for r in lattice.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, chunk_bytes=40).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[i], expected[i], abs_tol=1e-6) for i in got)


# 10: packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_plan_places_every_piece_once(lengths):
    capacity, counts = 60, [0] * 61
    for n in lengths:
        counts[n] += 1
    runs, bins = packing.plan(counts, capacity)
    filled: dict[int, list[tuple[int, int]]] = {}
    for k, (n, rank, first, offset) in enumerate(runs):
        last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        for i in range(last - rank):
            filled.setdefault(first + i, []).append((offset, n))
    assert len(filled) == bins and sorted(n for b in filled.values() for _, n in b) == sorted(lengths)
    for b in filled.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert bins <= 11 * max(1, -(-sum(lengths) // capacity)) / 9 + 6 + sum(2 * n > capacity for n in lengths)


def check_packing(spark, got, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, total = Counter(), 0
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % 2048 or 2048) if k == 0 else 2048
            expected[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at, k = at + n, k + 1
    assert listed(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == expected
    bins: dict[int, list] = {}
    for s, o, n in got.select("sequence_id", "offset", "length").collect():
        bins.setdefault(s, []).append((o, n))
    for b in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(b)))
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    return len(bins), total


def test_packing_of_awkward_rows(spark, awkward):
    check_packing(spark, QUERIES["op10_packing"](spark, awkward[0]), awkward[1])


def test_packing_is_tight(spark):
    bins, total = check_packing(spark, QUERIES["op10_packing"](spark, MIDDLE), [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()])
    assert bins <= 1.01 * total / 2048 + 1


# 1: mixing


def test_targets_reshare_what_full_sources_cannot_take():
    assert mixing.targets([100, 100, 100]) == [50.0, 100.0, 150.0]
    assert mixing.targets([1000, 10, 10]) == [960.0, 30.0, 30.0]
    assert mixing.targets([]) == [] and mixing.targets([0]) == [0.0]


def test_split_tree_keeps_counts():
    colours = np.array([5, 0, 17, 100])
    leaves = mixing.split_tree(colours, 8, np.random.default_rng(1))
    assert leaves.shape == (8, 4) and (leaves.sum(0) == colours).all() and np.ptp(leaves.sum(1)) <= 3


@pytest.mark.parametrize("which", ["awkward", MIDDLE])
def test_mix(spark, awkward, which):
    folder = awkward[0] if which == "awkward" else which
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in df.collect()]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(tokens(t))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    goal = dict(zip(names, mixing.targets([size[s] for s in names]), strict=True))
    got = mixing.mix(df, carry=True).select("doc_id", "_row.source", "size", "source_size", "target", "taken", "shards").collect()
    assert Counter((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in got) == Counter((i, s, len(tokens(t)), size[s], round(goal[s], 6)) for i, t, s in rows)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"]) for r in got)
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    # Repeated rows share a place, so up to three rows go in together here.
    assert all(abs(taken[s] - goal[s]) <= 2 * largest[s] for s in names)
    again = mixing.mix(df.repartition(7)).select("doc_id", "size", "taken")
    assert listed(again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_mixed_rows_are_the_taken_ones(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mixed(df)
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(df).collect() if r["size"]}
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in times.items() if n})


# 4: language ID


def test_language_id_holds_on_held_out_rows(spark):
    got = QUERIES["op4_language_id"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_of_awkward_rows(spark, awkward):
    folder, rows = awkward
    got = QUERIES["op4_language_id"](spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, zlib.crc32(str(i).encode() if i is not None else b"") % 4 == 2) for i, *_ in rows)
    texts = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert (r["lang_pred"] == "und") == (t is None or not any(map(str.isalpha, t)))


def test_language_id_votes_family_first_then_language(spark):
    rng = np.random.default_rng(3)
    langs = ["en", "de", "nl", "fr", "es", "xx", "yy", "zz"]
    x = rng.normal(size=(160, 12)).astype(np.float32) + np.repeat(rng.normal(size=(8, 12)) * 1.5, 20, axis=0).astype(np.float32)
    model = language_id.Model(x, [c for c in langs for _ in range(20)])
    assert model.top.classes == ["germanic", "other 0", "other 1", "other 2", "romance"]

    def winner(pairs, v):
        votes = {c: [0, 0.0] for c in pairs.classes}
        for w, (i, j) in zip(pairs.w, pairs.pairs, strict=True):
            m = float(v @ w[:-1] + w[-1])
            votes[pairs.classes[i if m >= 0 else j]][0] += 1
            votes[pairs.classes[i]][1] += m
            votes[pairs.classes[j]][1] -= m
        return max(pairs.classes, key=lambda c: (votes[c][0], votes[c][1]))

    family, _ = model.top.predict(x)
    assert [model.top.classes[f] for f in family] == [winner(model.top, v) for v in x]
    for f, pairs in enumerate(model.within):
        assert [pairs.classes[c] for c in pairs.predict(x)[0]] == [winner(pairs, v) for v in x]
    assert model.top.classes[0] == "germanic" and model.within[0].classes == ["de", "en", "nl"]


def test_language_id_reads_neither_labels_nor_sources_of_what_it_predicts(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("one"))
    changed.write.parquet(str(tmp_path / "documents.parquet"))
    assert listed(QUERIES["op4_language_id"](spark, str(tmp_path))) == listed(QUERIES["op4_language_id"](spark, SMALL))


# 2: chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\im_endstar>\n :x", max_size=30), st.text(alphabet="<|\\im_endstar>\n :x", max_size=40)), max_size=4))
def test_chat_round_trip(turns):
    done = [chat.format_turn(r, [{"type": "text", "text": t}]) for r, t in turns]
    assert chat.read_turns("".join(s for s, _, _ in done)) == turns
    for (r, t), (s, spans, _) in zip(turns, done, strict=True):
        assert [chat.unescape(s[a:b]) for a, b in spans] == ([t] if r == "assistant" else [])


def test_chat_parts(spark):
    parts = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 90, None), ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df).first()
    assert r["segment"] == "<|im_start|>user\nsee <\\|image:0|><|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [("image", 0, "a.png", 4), ("audio", 1, "b.wav", 3), ("document", 2, "c.pdf", 1536)] and r["expanded_tokens"] == 1543
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_chat_of_awkward_rows(spark, tmp_path):
    rows = [(1, 1, None, None), (1, 0, "user", "a\nb"), (1, 0, "user", "a\nb"), (None, 5, "assistant", "x<|im_end|>"), (None, None, "assistant", ""), (2, 0, "assistant", "é" * 100_000)]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op2_chat"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, sha("user\na\nb\n" * 2 + "\n\n"), 0, sha(""))
    assert (got[None]["n_turns"], got[None]["turns_sha256"], got[None]["loss_sha256"]) == (2, sha("assistant\n\nassistant\nx<|im_end|>\n"), sha("x<|im_end|>"))
    assert got[2]["loss_chars"] == 100_000 and got[-1]["loss_chars"] == 34


def test_chat_ties_go_by_role_then_text(spark, tmp_path):
    texts = ["ok", "ok then", "ok!", "ok<", "ok<|im_end|>", "ok<a", "ok<\\|", "", "\nok", "\tok", "é", None]
    rows = [(1, 3, role, t) for t in texts for role in ("assistant", "user", "a\nb", "a\tb", None)]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), f"{tmp_path}/conversations.parquet")
    same(spark, QUERIES["op2_chat"], ORACLE_SQL["op2_chat"], str(tmp_path))
    said = "".join(f"{r or ''}\n{t or ''}\n" for *_, r, t in sorted(rows, key=lambda r: ((r[2] or "").encode(), (r[3] or "").encode())))
    got = QUERIES["op2_chat"](spark, str(tmp_path)).filter("conv_id = 1").first()
    assert (got["n_turns"], got["turns_sha256"]) == (len(rows), hashlib.sha256(said.encode()).hexdigest())


# 5: top-k


def plain_top(rows, k=5):
    """The result by brute force, in whole numbers of any size; rows: (id, vector)."""
    from fractions import Fraction

    known = [(n, i, [math.floor(256 * Fraction(c)) for c in v]) for n, (i, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, q in known:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in known if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, None if none else j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, none, j) in enumerate(best)]
    return Counter(out)


def test_top_k_of_repeated_and_large_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(260, 6))
    x[30:200] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, x[0].tolist()), (50, x[3].tolist()), (50, x[50].tolist()), (None, x[100].tolist()), (7, x[7].tolist())]
    small = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    small.write.parquet(str(tmp_path / "embeddings.parquet"))
    same(spark, QUERIES["op5_vector_search"], ORACLE_SQL["op5_vector_search"], str(tmp_path))
    assert listed(vector_search.top_k(small, F.col("vec_id") % 50 == 0, queries_block=3)) == plain_top(rows)
    rows += [(300, [1e20, 1.0, 0.0, 0.0, 0.0, -3e38]), (350, [1e300, -1e300, 1.0, 0.0, 0.0, 0.5]), (301, [-1e20, 2.0, 0.0, 0.0, 0.0, 1e15]), (302, [5e3, 0.0, 0.0, 0.0, 0.0, 0.0]), (303, [1e20, 1.0]), (400, [2.0, 1e20])]
    large = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert listed(vector_search.top_k(large, F.col("vec_id") % 50 == 0)) == plain_top(rows)


def test_top_k_of_awkward_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x[50:120] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [1.0, float("nan")] + [0.0] * 6), (1100, [None] + [0.0] * 7), (1150, [0.5, 0.5]), (1200, []), (None, [0.0] * 8), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert listed(vector_search.top_k(df, F.col("vec_id") % 50 == 0, queries_block=3)) == plain_top(rows)


# The pipeline


def test_pipeline_keeps_clean_documents_and_drops_copies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, docs, SMALL)
    assert known.columns == docs.columns and known.count() == docs.count()
    one = stages["exact dedup"](spark, known, SMALL)
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    firsts = {}
    for r in docs.orderBy("doc_id").collect():
        firsts.setdefault(b" ".join(r["text"].encode().split()), r["doc_id"])
    assert set(rows) >= set(firsts.values()) and len(rows) == len(set(" ".join(t.split(" ")) for t in rows.values()))
    near = {r["doc_id"] for r in stages["SimHash near-dedup"](spark, one, SMALL).collect()}
    assert near == plain_groups(rows)


def test_pipeline_against_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()}
    rows = {i: t for i, t in rows.items() if t and any(map(str.isalpha, t))}
    import re

    first = {}
    for i, t in rows.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    kept = plain_groups({i: rows[i] for i in first.values()})
    near = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.col("doc_id").isin(sorted(kept)))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(near).collect() if r["size"]}
    taken = [(i, rows[i]) for i, n in times.items() for _ in range(n)]
    assert taken and set(times) == kept
    check_packing(spark, corpus_pipeline.run(spark, SMALL), taken)


def test_pipeline_keeps_one_copy_of_the_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SMALL)
    assert sum(bool(names & {"text", "_text"}) for names in left_in(tmp_path)) == 1
    assert out.count()


def test_pipeline_of_awkward_rows(spark, awkward, empty):
    assert corpus_pipeline.run(spark, awkward[0]).count() > 10
    assert corpus_pipeline.run(spark, empty).count() == 0
