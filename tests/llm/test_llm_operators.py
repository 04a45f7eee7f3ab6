"""Each operator against brute force, a round trip or held-out labels."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm import chunk_dedup, hilbert, language_id, licenses, line_dedup, mixing, ngram_join, packing, queries, repetition, transport

DOCS = "doc_id long, text string"


def prose(rng: random.Random, n: int, vocab: int = 3000) -> list[str]:
    return [f"w{min(int(rng.paretovariate(0.6)), vocab) + rng.randrange(40)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(name, spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) > 0
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


# ~~ 1 mixing
def test_prefixes_of_the_mix_are_close_to_the_weights(spark, documents):
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    got = mixing.schedule(documents, block_tokens=64, weights=weights).select("slot", "source", "block", "epoch").distinct().toPandas()
    slots = got.sort_values("slot")
    assert slots["slot"].tolist() == list(range(len(slots)))
    for n in (10, 50, len(slots)):
        head = slots.head(n)["source"].value_counts()
        for s, w in weights.items():
            assert abs(head.get(s, 0) - w * n) <= 3
    for s in weights:  # each block once before any a second time
        own = slots[slots["source"] == s].reset_index(drop=True)
        blocks = own["block"].max() + 1
        assert own["block"].tolist() == [i % blocks for i in range(len(own))]
        assert own["epoch"].tolist() == [i // blocks for i in range(len(own))]


def test_mix_covers_every_word_once_an_epoch(documents):
    got = mixing.schedule(documents, block_tokens=128).filter("epoch = 0").toPandas()
    n = {r["doc_id"]: r["n"] for r in documents.select("doc_id", C.words(F.col("text")).alias("n")).collect()}
    have = defaultdict(list)
    for d, a, b in zip(got["doc_id"], got["tok_start"], got["tok_end"], strict=True):
        have[d].append((a, b))
    for d, size in n.items():
        at = 0
        for a, b in sorted(have[d]):
            assert a == at
            at = b
        assert at == size


def test_applied_mix_follows_the_schedule(documents):
    plan = mixing.schedule(documents, block_tokens=256)
    begins = Counter(r["doc_id"] for r in plan.filter("tok_start = 0").collect())
    got = Counter(r["doc_id"] for r in mixing.apply(documents, block_tokens=256).collect())
    assert got == begins


# ~~ 2 transport streams
def test_round_trip_of_units():
    rng = random.Random(5)
    for _ in range(120):
        units = [rng.randbytes(rng.choice([0, 1, 150, 152, 153, 164, 165, 166, 183, 184, 185, 700])) for _ in range(rng.randrange(1, 7))]
        data = transport.mux(units, b"meta")
        rows = [r for r in transport.parse(data) if r[1] == 0x100]
        assert [r[12] for r in rows] == units and all(r[10] for r in rows)
        assert [r[4] for r in rows] == [7200 + 3600 * i for i in range(len(units))]
        assert [r[5] for r in rows] == [3600 * i for i in range(len(units))]
        assert [r[6] for r in rows] == [i % 8 == 0 for i in range(len(units))]
        noisy = b"noise" * 9 + data[: 188 * 2] + b"xyz" + data[188 * 2 :]
        assert [r[12] for r in transport.parse(noisy) if r[1] == 0x100] == units


def test_lost_repeated_and_damaged_packets():
    units = [b"a" * 1000, b"b" * 1000]
    whole = transport.mux(units, b"m")
    lost = [r for r in transport.parse(transport.mux(units, b"m", lose=2)) if r[1] == 0x100]
    assert lost[0][9] == 1 and not lost[0][10] and lost[1][9] == 0 and lost[1][10]
    packet = whole[188 * 4 : 188 * 5]
    twice = whole[: 188 * 5] + packet + whole[188 * 5 :]
    assert transport.parse(twice) == transport.parse(whole)
    broken = bytearray(whole)
    broken[188 + 10] ^= 255  # the program map's CRC no longer fits
    assert transport.parse(bytes(broken)) == []
    assert transport.parse(b"\x00" * 2000) == [] and transport.parse(None) == []


def test_query_gives_back_every_line(spark, documents):
    import zlib

    got = transport.demux(transport.encode(documents)).filter("pid = 256 AND doc_id % 17 <> 3")
    for r in got.select("doc_id", F.sort_array(F.collect_list(F.struct("unit", "payload")).over(_w())).alias("u")).distinct().limit(20).collect():
        assert all(isinstance(x["unit"], int) for x in r["u"])
    sums = {(r["doc_id"], r["unit"]): r["crc32"] for r in got.collect()}
    for r in documents.filter("doc_id % 17 <> 3").collect():
        for i, line in enumerate(r["text"].split("\n")):
            assert sums[r["doc_id"], i] == zlib.crc32(line.encode())


def _w():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id")


# ~~ 3 language
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 2 = 0"), per_language=60)
    got = language_id.predict(docs.filter("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.98
    assert set(model["families"]) == {"germanic", "romance"}
    short = language_id.predict(spark.createDataFrame([(1, "der die und"), (2, None), (3, "123 !")], DOCS), model).collect()
    assert {r["doc_id"]: r["language"] for r in short if r["doc_id"] > 1} == {2: "und", 3: "und"}


# ~~ 4 lines
def _jac(a: str, b: str, w: int = line_dedup.SHINGLE) -> float:
    sets = [{s[i : i + w] for i in range(max(1, len(s) - w + 1))} for s in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(prose(rng, rng.randrange(6, 30))) for _ in range(60)]
    lines = list(base)
    for s in base[:40]:
        for _ in range(3):
            w = s.split()
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
            lines.append(" ".join(w))
    lines += base[:10]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    distinct = sorted(set(lines))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    true = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if _jac(a, b) >= line_dedup.THRESHOLD]
    for a, b in true:
        root[find(a)] = find(b)
    got = line_dedup.duplicates(df).toPandas()
    place = {(d, i): s for d, t in enumerate(texts) for i, s in enumerate(t.split("\n"))}
    comp = {place[d, i]: c for d, i, c in zip(got["doc_id"], got["line_no"], got["component"], strict=True)}
    met = [comp.get(a) == comp.get(b) and a in comp for a, b in true]
    assert len(true) > 50 and np.mean(met) >= 0.9
    by = defaultdict(set)
    for s, c in comp.items():
        by[c].add(find(s))
    assert all(len(v) == 1 for v in by.values())  # nothing joined that brute force keeps apart
    assert got.groupby("component")["keep"].sum().eq(1).all()
    firsts = got.groupby("component")[["doc_id", "line_no"]].apply(lambda g: min(map(tuple, g.values)))
    kept = got[got["keep"]].set_index("component")[["doc_id", "line_no"]].apply(tuple, axis=1)
    assert (firsts.sort_index() == kept.sort_index()).all()


def test_jaccard_of_lines_is_exact():
    a, b = ["same text here", "abc", "abcdefghijkl"], ["same text here", "abd", "abcdefghijkm"]
    got = line_dedup.jaccard(pa.array(a), pa.array(b), 8)
    assert got.tolist() == pytest.approx([_jac(x, y) for x, y in zip(a, b, strict=True)])


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# ~~ 5 Hilbert
def test_curve_is_a_walk_over_all_cells():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1)
        h = hilbert.curve_index(grid, bits)
        assert sorted(h) == list(range(1 << dims * bits))
        assert np.abs(np.diff(grid[:, np.argsort(h)], axis=1)).sum(axis=0).max() == 1


def test_shards_prune_and_write(spark, documents, tmp_path):
    got = hilbert.shards(documents, shard_rows=32).toPandas()
    assert got["position"].tolist() != got["doc_id"].tolist()
    assert got.groupby("shard").size().iloc[:-1].eq(32).all()
    spread = got.groupby("shard")["x2"].agg(lambda s: s.max() - s.min()).mean()
    assert spread < (got["x2"].max() - got["x2"].min()) * 0.8
    hilbert.write(documents, str(tmp_path / "out"), shard_rows=32)
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


# ~~ 6 n-gram join
def _grams(t: str, n: int = ngram_join.N) -> frozenset:
    w = t.split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def _classes(texts, threshold):
    """Brute force: text number -> (least number of its class, size of the class, copies) of all that have a partner."""
    sets = [_grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for a, s in enumerate(sets):
        for b in range(a):
            both = len(s & sets[b])
            if s and both and both >= threshold * (len(s) + len(sets[b]) - both):
                near += s != sets[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    size = Counter(find(i) for i in range(len(texts)) if sets[i])
    return {i: (find(i), size[find(i)], sets.count(sets[i])) for i in range(len(texts)) if sets[i] and size[find(i)] > 1}, near


def _check_join(spark, texts, threshold, least):
    want, near = _classes(texts, threshold)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = ngram_join.join(df, threshold=threshold).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_class"], r["copies"]) for r in got} == want and near > least
    assert all((r["links"] > 0) == (r["n_class"] > r["copies"]) for r in got)


def test_join_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for size in (3, 5, 8, 12, 20, 40, 80, 160, 400, 1200):
        for _ in range(6):
            w = [f"v{rng.randrange(100_000)}" for _ in range(size)]
            texts.append(w)
            for rate in (0.02, 0.08, 0.15, 0.2, 0.3):
                texts.append([x if rng.random() > rate else f"e{rng.randrange(100_000)}" for x in w])
    texts = [" ".join(w) for w in texts]
    texts += [texts[0], "one", "one", ""]
    _check_join(spark, texts, ngram_join.THRESHOLD, 100)


@pytest.mark.parametrize("threshold", (0.5, 0.6, 0.8))
def test_join_leaves_out_no_link(spark, threshold):
    """Pairs only, each of its own words and as far apart as the threshold allows, so that no third text can help."""
    rng = random.Random(12)
    texts = []
    for size in (4, 5, 9, 10, 15, 16, 18, 24, 32, 46, 60, 127, 260, 900):
        for _ in range(6):
            w = [f"v{rng.randrange(10**8)}" for _ in range(size + 1)]
            texts += [w, w[: -(-size * int(threshold * 100) // 100) + 1]]  # a contained text, just similar enough
            w = [f"v{rng.randrange(10**8)}" for _ in range(size + 1)]
            diff = int(size * (1 - threshold) / (1 + threshold))
            texts += [w, w[:-diff] + [f"e{rng.randrange(10**8)}" for _ in range(diff)] if diff else w[:-1]]
    _check_join(spark, [" ".join(w) for w in texts], threshold, 130)


def test_signatures_keep_their_promise():
    """Sets of one band or of neighbouring ones at the threshold share a signature, or both are weak and share a prefix."""
    rng = np.random.default_rng(5)
    for threshold in (0.5, 0.7, 0.8, 0.9):
        for size in (5, 7, 10, 20, 50, 120, 400, 2000):
            for _ in range(60):
                n = size + int(rng.integers(0, 3))
                most = int(n * (1 - threshold) / (1 + threshold) + 1e-9)
                a = rng.integers(0, 1 << 32, n).astype(np.uint32)
                gone = int(rng.integers(0, most + 1))
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 32, gone).astype(np.uint32)])
                if rng.random() < 0.5:
                    b = a[: int(np.ceil(threshold * n))]
                a, b = np.unique(a), np.unique(b)
                same = len(np.intersect1d(a, b))
                if same < threshold * (len(a) + len(b) - same) or np.array_equal(a, b):
                    continue
                doc = np.repeat([0, 1], [len(a), len(b)])
                feat = np.concatenate([a, b])
                signed, need = {0: set(), 1: set()}, np.zeros(2, bool)
                for ahead in (0, 1):
                    who, sig, weak = ngram_join.signatures(doc, feat, 2, threshold, ahead)
                    need |= weak
                    for i in (0, 1):
                        signed[i] |= set(sig[who == i].tolist())
                assert signed[0] & signed[1] or need.all()
                common = np.sort(feat[::3])
                pre, token = ngram_join.prefixes(doc, feat, 2, threshold, common, np.arange(1, len(common) + 1))
                assert len(np.intersect1d(token[pre == 0], token[pre == 1])) > 0


def test_links_are_counted_whole(spark):
    """Every pair of different sets counts, also of those that other links connect already; brute force."""
    rng = random.Random(14)
    texts = []
    for size in (6, 30, 200):
        w = [f"v{rng.randrange(100_000)}" for _ in range(size)]
        for rate in (0, 0, 0.03, 0.06, 0.1, 0.15, 0.2, 0.25):
            texts += [" ".join(x if rng.random() >= rate else f"e{rng.randrange(100_000)}" for x in w) for _ in range(4)]
    sets = [_grams(t) for t in texts]
    want = {
        i: len({t for t in sets if t != s and len(s & t) >= ngram_join.THRESHOLD * len(s | t)}) for i, s in enumerate(sets)
    }
    got = ngram_join.join(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r["doc_id"]: r["links"] for r in got if r["links"]} == {i: n for i, n in want.items() if n} and max(want.values()) > 10


def test_a_hot_n_gram_loses_no_pair(monkeypatch):
    """One n-gram of 300 sets, in runs of few pairs."""
    monkeypatch.setattr(ngram_join, "PAIRS", 1000)
    size = np.arange(300) % 5 + 3
    node = np.arange(300, dtype=np.int64) * 7 - 900
    pairs = [p for a, b in ngram_join.meet(np.zeros(300, np.uint32), node, size, np.zeros(300, np.int64), 0.5) for p in zip(a.tolist(), b.tolist())]
    want = {(x, y) for i, x in enumerate(node.tolist()) for j, y in enumerate(node.tolist()) if i < j and 2 * min(size[i], size[j]) >= max(size[i], size[j])}
    assert set(pairs) == want and len(want) > 30_000


def test_a_pair_comes_from_few_partitions():
    """30 near copies that share most of 200 n-grams, which lie in 64 partitions: every pair arises, few do so twice."""
    rng = np.random.default_rng(3)
    every = rng.choice(1 << 32, 230, replace=False).astype(np.uint32)
    sets = [every[np.sort(rng.choice(230, 200, replace=False))][:101] for _ in range(30)]
    node, feat = np.repeat(np.arange(30), 101), np.concatenate(sets)
    place = np.tile(np.arange(101), 30)
    pairs = []
    for i in range(64):
        on = feat % 64 == i
        names = np.unique(node[on])
        heads = np.array([np.sort(sets[k][:51])[: ngram_join.HEADS] for k in names]).reshape(-1, ngram_join.HEADS)
        for a, b in ngram_join.meet(feat[on], node[on], np.full(on.sum(), 200), place[on], 0.5, heads):
            pairs += zip(a.tolist(), b.tolist())
    assert len(set(pairs)) == 435 and len(pairs) < 2 * 435


def test_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    dense = np.sort(rng.integers(0, 1 << 32, 1 << 19)).astype(np.uint64)
    far = np.array([0, 0, 5, 1 << 16, 1 << 40, 1 << 62] + list(range((1 << 62) + 1, (1 << 62) + 100)), np.uint64)
    for values in (dense, far, dense[:1], dense[:0], dense[::-1], np.array([7, 3], np.uint64)):
        assert np.array_equal(ngram_join._decode(ngram_join._encode(values)), values)
    assert len(ngram_join._encode(dense)) < 2.1 * len(dense)


def test_set_tables_are_small_and_not_shuffled_again(spark, monkeypatch):
    """Sets without a chance aren't kept, and no pair is verified with a shuffle of all sets."""
    kept = []
    cut_by = C.cut_by
    monkeypatch.setattr(C, "cut_by", lambda df, key: kept.append((key, cut_by(df, key))) or kept[-1][1])
    monkeypatch.setattr(C, "drop_cut", lambda df: None)
    alone = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(50)]
    alike = [" ".join(f"v{j}" for j in range(i, i + 30)) for i in range(3)]
    got = ngram_join.join(spark.createDataFrame(list(enumerate(alone + alike)), DOCS)).collect()
    assert {(r["doc_id"], r["class_id"], r["links"]) for r in got} == {(i, 50, 2) for i in (50, 51, 52)}
    assert [key for key, _ in kept] == ["pack"] and kept[0][1].count() == 3


def test_hot_buckets_give_the_same_links(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id % 3 AS bucket", "id AS node")
    want = {(r["bucket"], r["node"], r["first"]) for r in C.meeting(rows, lambda d: d).collect()}
    monkeypatch.setattr(C, "_HOT_ROWS", 1)
    monkeypatch.setattr(C, "_HOT_SAMPLE", 0.9)
    assert {(r["bucket"], r["node"], r["first"]) for r in C.meeting(rows, lambda d: d).collect()} == want and len(want) == 3000


def test_prefixes_are_unpacked_in_ranges():
    rng, rows, whole = np.random.default_rng(5), [], []
    for k in range(6):
        feat = np.sort(np.concatenate([rng.integers(0, 1 << 32, 900, np.uint64), np.full(100, 77, np.uint64)]))
        number = rng.integers(0, 40, 1000).astype(np.uint16)
        node, size, place = np.arange(40) + (k << 20), rng.integers(50, 70, 40), rng.integers(0, 9, 1000)
        heads = rng.integers(0, 1 << 32, (40, ngram_join.HEADS)).astype(np.uint32)
        rows.append((ngram_join._encode(feat), number.tobytes(), ngram_join._narrow(place).tobytes(), ngram_join._encode(node), ngram_join._narrow(size).tobytes(), heads.tobytes()))
        whole += zip(feat.tolist(), node[number].tolist(), size[number].tolist(), place.tolist())
    got = []
    for feat, node, size, place, heads in ngram_join.spans(rows, 500):
        assert (feat != 77).sum() <= 500 and (feat == 77).sum() in (0, 600)
        assert len(heads) == len(np.unique(node))
        got += zip(feat.tolist(), node.tolist(), size.tolist(), place.tolist())
    assert sorted(got) == sorted(whole)
    assert list(ngram_join.spans([], 500)) == []


def test_buckets_meet_without_a_sort_of_rows(spark):
    """Negative and large keys, repeated rows and buckets of one node; rows aren't shuffled and sorted one by one."""
    rng = random.Random(6)
    rows = [(rng.randrange(-(1 << 63), 1 << 63) if i % 3 else i % 9 - 4, rng.randrange(-40, 40)) for i in range(2000)]
    got = C.meeting(spark.createDataFrame(rows, "bucket long, node long"), lambda d: d)
    held = {}
    for bucket, node in rows:
        held.setdefault(bucket, []).append(node)
    want = sorted((b, v, min(have)) for b, have in held.items() if len(set(have)) > 1 for v in have)
    assert sorted(tuple(r) for r in got.select("bucket", "node", "first").collect()) == want and len(want) > 500
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_short_lines_are_shingles_of_their_own():
    a, b = ["ab", "ab", "abcdefgh", "ab\x00"], ["ab", "ab\x00", "abcdefg", "ab\x00"]
    assert line_dedup.jaccard(pa.array(a), pa.array(b), 8).tolist() == [1, 0, 0, 1]


def test_links_connect_all_that_meet_and_agree(spark, monkeypatch):
    """One bucket of 700 nodes in 7 kinds: those of one kind are similar."""
    monkeypatch.setattr(C, "_BLOCK", 16)
    members = C.cut(spark.range(700).selectExpr("1L AS bucket", "id AS node", "0L AS first"))
    _, found = C.linked(members, lambda p: p.filter("a % 7 = b % 7"))
    root = {r["node"]: r["root"] for r in found.collect()}
    assert root == {i: i % 7 for i in range(700)}


# ~~ 7 repetition
def _measure(t: str, n: int) -> int:
    w = t.split()
    seen, inside = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            inside |= set(range(i, i + n))
        seen.add(g)
    return sum(len(w[i]) for i in inside)


def test_repetition_against_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    texts += ["", "x", "a b c d e " * 9, "l one\nl two\n l one \n\nl one"]
    got = repetition.measure(*C.codes(pa.array(texts)), (5, 7, 10))
    for i, t in enumerate(texts):
        assert got["word_chars"][i] == sum(map(len, t.split()))
        for n in (5, 7, 10):
            assert got[f"ngram{n}"][i] == _measure(t, n)
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        assert got["dup_line_chars"][i] == sum(len(x) for k, x in enumerate(lines) if x in lines[:k])


# ~~ 8 licenses
def test_licenses_against_brute_force(spark, documents):
    rng = random.Random(8)
    rows = []
    names = sorted(licenses.TEMPLATES)
    for i in range(120):
        w = prose(rng, rng.randrange(0, 200))
        at = rng.randrange(len(w) + 1)
        name = names[i % len(names)] if i % 3 else None
        rows.append((i, " ".join(w[:at] + (licenses.TEMPLATES[name][1].upper().split() if name else []) + w[at:]), name))
    got = licenses.scan(spark.createDataFrame(rows, DOCS + ", want string")).toPandas()
    hits = set(zip(got["doc_id"], got["template"], strict=True))
    want = {(i, n) for i, _, n in rows if n}
    assert len(hits & want) >= 0.97 * len(want)
    assert {i for i, _ in hits} <= {i for i, _ in want}
    assert got["containment"].between(licenses.CONTAINMENT, 1).all()
    found = {(r["doc_id"]) for r in licenses.scan(documents).filter("license = 'MIT'").collect()}
    assert found == {r["doc_id"] for r in documents.filter("text LIKE '%Released under the MIT License.%'").collect()}


def test_band_settings_guarantee_retrieval():
    # a window of 2t words that holds 0.8 of a template's t - 1 pairs, at its worst
    for t in (6, 12, 48):
        both, union = 0.8 * (t - 1), (2 * t - 1) + 0.2 * (t - 1)
        assert 1 - (1 - (both / union) ** licenses.ROWS) ** licenses.BANDS > 0.985


# ~~ 9 packing
def test_plan_uses_up_the_histogram():
    rng = random.Random(4)
    for _ in range(15):
        hist = {u: rng.choice([0, 1, 5, 80, 3000]) for u in range(1, 65)}
        used: Counter = Counter()
        packs = 0
        for parts, times in packing.plan(hist):
            assert sum(parts) <= 64 and times > 0
            packs += times
            for p in parts:
                used[p] += times
        assert used == Counter({u: c for u, c in hist.items() if c})
        assert packs >= -(-sum(u * c for u, c in hist.items()) // 64)


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 30)), rng.random(20)
    x = packing.nnls(a, b)
    y = np.zeros(30)
    for _ in range(60_000):
        y = np.maximum(0, y - (a.T @ (a @ y - b)) / np.linalg.norm(a.T @ a))
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_packs_hold_every_word_once(documents):
    got = packing.pack(documents, window=512, with_text=True).toPandas()
    assert got.groupby("pack_id")["n_tokens"].sum().max() <= 512
    assert not got.duplicated(["pack_id", "slot"]).any() and not got.duplicated(["doc_id", "piece"]).any()
    whole = got.sort_values("piece").groupby("doc_id")["piece_text"].apply(lambda s: " ".join(s).split())
    for r in documents.collect():
        assert whole[r["doc_id"]] == r["text"].split()
    fill = got["n_tokens"].sum() / (got["pack_id"].nunique() * 512)
    assert fill > 0.9


def test_retrieval_of_every_template_in_its_own_windows():
    """The lowest probability over the registered templates, for a window that holds 0.8 of one and nothing else known."""
    index = licenses.Index(licenses.TEMPLATES, licenses.BANDS, licenses.ROWS)
    for step, held in index.classes.items():
        for name, _, shingles, _ in held:
            n = len(shingles)
            both = int(np.ceil(0.8 * n))
            j = both / (2 * step - 1 + n - both)
            assert 1 - (1 - j**licenses.ROWS) ** index.bands[step] > 0.985, name


def test_exact_and_near_copies_of_every_template(spark):
    rng = random.Random(9)
    rows, want = [], []
    for name in sorted(licenses.TEMPLATES):
        for k in range(10):
            w = licenses.TEMPLATES[name][1].split()
            if k >= 5 and len(w) > 10:
                w[len(w) - 1] = "other"
            rows.append((len(rows), " ".join(prose(rng, rng.randrange(3, 90)) + w + prose(rng, 60))))
            want.append(name)
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).toPandas()
    hits = set(zip(got["doc_id"], got["template"], strict=True))
    missed = [n for i, n in enumerate(want) if (i, n) not in hits]
    assert len(missed) <= 0.03 * len(want)
    assert {"mit-text", "gpl3-text", "apache-header", "isc-text"} <= {n for _, n in hits}


# ~~ 10 chunks
def test_cuts_resist_insertions():
    rng = random.Random(6)
    t = " ".join(prose(rng, 900))
    cuts = lambda s: {s[a:b] for _, a, b in zip(*chunk_dedup.chunk(*C.codes(pa.array([s])), 24, 1000), strict=True)}
    a, b = cuts(t), cuts(t[:2000] + "INSERTED" + t[2000:])
    assert len(a & b) >= len(a) - 3
    doc, start, end = chunk_dedup.chunk(*C.codes(pa.array([t, "", t])), 24, 1000)
    assert "".join((t + t)[x:y] for x, y in zip(start, end, strict=True)) == t + t and set(doc) == {0, 2}
    gear = chunk_dedup.gear(np.arange(50, 90, dtype=np.uint32))
    assert gear[30] == sum(int(chunk_dedup._GEAR[50 + 30 - j]) << j for j in range(16)) % (1 << 32)


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(7)
    passages = [" ".join(prose(rng, 55)) for _ in range(30)]
    rows, want = [], {}
    for i in range(150):
        w = prose(rng, 300)
        if i < 90:
            at = rng.randrange(300)
            w[at:at] = passages[i % 30].split()
            want[i] = i % 30
        rows.append((i, " ".join(w)))
    got = chunk_dedup.spans(spark.createDataFrame(rows, DOCS)).toPandas()
    hit = set(got["doc_id"])
    assert hit <= set(want) and len(hit) >= 0.95 * len(want)
    text = dict(rows)
    for d, a, b in zip(got["doc_id"], got["start"], got["end"], strict=True):
        # a short chunk beside the passage may be shared by chance
        inner = text[d][a:b].split()[4:-4]
        assert len(inner) >= 10 and " ".join(inner) in passages[want[d]]


def test_passages_repeated_in_one_document_or_without_ids_are_found(spark):
    rng = random.Random(17)
    a, b = " ".join(prose(rng, 60)), " ".join(prose(rng, 60))
    rest = lambda: " ".join(prose(rng, 80))
    rows = [(1, f"{rest()} {a} {rest()} {a} {rest()}"), (None, f"{rest()} {b}"), (None, f"{b} {rest()}"), (2, rest())]
    got = chunk_dedup.spans(spark.createDataFrame(rows, DOCS)).collect()
    for i, text in ((1, a), (None, b)):
        own = [r for r in got if r["doc_id"] == i]
        # a short chunk may be shared by chance
        assert len(own) == 2 and all(r["repeat_chars"] < 0.1 * len(text) for r in own)
        cut = sorted(r["own_repeat_chars"] for r in own)
        assert cut[0] < 0.1 * len(text) and cut[1] > 0.6 * len(text)
    assert len(got) == 4


# ~~ pipeline
def test_pipeline_end_to_end(spark, sf, documents):
    import corpus_pipeline

    seen, docs = {}, documents
    for name, f in corpus_pipeline.STAGES:
        docs = C.cut(f(spark, docs, sf))
        seen[name] = docs
    keep = {r["doc_id"] for r in repetition.coverage(documents).filter("keep").collect()}
    assert {r["doc_id"] for r in seen["quality_rules"].collect()} == keep
    lines = [x.strip() for r in seen["line_dedup"].collect() for x in r["text"].split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    texts = [r["text"] for r in seen["ngram_jaccard"].collect()]
    sets = [_grams(t) for t in texts]
    close = sum(1 for i, a in enumerate(sets) for b in sets[:i] if a and len(a & b) >= ngram_join.THRESHOLD * len(a | b))
    assert close == 0
    assert {r["doc_id"] for r in seen["source_mix"].collect()} == {r["doc_id"] for r in seen["ngram_jaccard"].collect()}
    words = sum(len(r["text"].split()) for r in seen["source_mix"].collect())
    assert seen["packing"].agg(F.sum("n_tokens")).first()[0] == words
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.drop("pack_id", "slot").collect())) == sorted(map(str, seen["packing"].drop("pack_id", "slot").collect()))


# ~~ after the first round
def test_mix_with_a_token_budget(documents):
    weights = {"src0": 0.7, "src1": 0.3, "src2": 1e-11}
    with pytest.raises(ValueError, match="token budget"):
        mixing.schedule(documents, weights=weights).count()
    got = mixing.schedule(documents, block_tokens=64, weights=weights, token_budget=64_000).select("slot", "source").distinct()
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["src0"] - 700) <= 3 and abs(n["src1"] - 300) <= 3


def test_two_notices_in_one_window_and_no_sister(spark):
    t = licenses.TEMPLATES
    texts = [
        f"{t['mit-notice'][1]} {t['apache-notice'][1]}",
        f"{t['gpl2-notice'][1]} {t['gpl3-notice'][1]}",
        t["gpl2-notice"][1],
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    found = {i: {r["template"] for r in got if r["doc_id"] == i} for i in range(3)}
    assert found[1] == {"gpl2-notice", "gpl3-notice"} and found[2] == {"gpl2-notice"}
    assert {"mit-notice", "apache-notice"} <= found[0]


def test_packets_without_header_fields_and_repeats_with_a_new_clock():
    data = transport.mux([b"first unit", b"second"], b"meta")
    pk = transport.packets(data).copy()
    head = np.flatnonzero(((pk[:, 1] & 0x1F) == 1) & (pk[:, 2] == 0) & ((pk[:, 1] & 0x40) != 0))
    want = transport.parse(data)
    clocked = pk[head[0]].copy()
    assert clocked[3] & 0x20 and clocked[4] > 8
    clocked[5] |= 0x10
    again = clocked.copy()
    again[6:12] = 7
    pk = np.concatenate([pk[: head[0]], clocked[None], again[None], pk[head[0] + 1 :]])
    assert [(r[8], r[9], r[-1]) for r in transport.parse(pk.tobytes())] == [(r[8], r[9], r[-1]) for r in want]
    at = bytes(pk[head[0]]).index(b"\0\0\1\xe0")
    private = pk.copy()
    private[head[0] : head[0] + 2, at + 3] = 0xBF
    row = next(r for r in transport.parse(private.tobytes()) if r[1] == 256 and r[3] == 0)
    assert row[4] is None and row[-1].endswith(b"first unit") and len(row[-1]) == 10 + 13


def test_repeats_are_cut_out(spark, monkeypatch):
    """What is left after cutting holds no passage twice, and every word once more than nowhere."""
    rng = random.Random(31)
    passage = " ".join(prose(rng, 80))
    own = [" ".join(prose(rng, 60)) for _ in range(4)]
    rows = [(i, f"{a} {passage} {a[::-1]}") for i, a in enumerate(own)] + [(9, None), (None, ""), (None, passage), (7, own[0] + "\u00e9\U0001f600" + own[0])]
    df = spark.createDataFrame(rows, DOCS + "")
    got = chunk_dedup.apply(df)
    assert got.columns == df.columns and got.count() == len(rows)
    text = [r["text"] for r in got.collect()]
    middle = passage[100:300]
    assert sum(middle in t for t in text if t) == 1 and None in text
    assert sum(len(t or "") for t in text) < sum(len(t or "") for _, t in rows) - 3.5 * len(passage)
    assert chunk_dedup.spans(got).count() == 0
    monkeypatch.setattr(C, "_HOT_ROWS", 1)
    monkeypatch.setattr(C, "_HOT_SAMPLE", 0.9)
    assert sorted(map(str, chunk_dedup.spans(df).drop("row").collect())) == sorted(map(str, chunk_dedup.spans(df).collect()))
    assert sorted(str(r["text"]) for r in chunk_dedup.apply(df).collect()) == sorted(map(str, text))
