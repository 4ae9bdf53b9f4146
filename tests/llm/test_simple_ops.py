"""Sharding, packing, byte-level BPE and SimHash against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from fixtures import docs, empty, rows

P = pytest.importorskip("public_tokenizers")
from ephyra.llm import byte_bpe, packing, sharding, simhash  # noqa: E402


def test_sharding_holds_its_law(spark):
    got = [r.asDict() for r in sharding.histogram_shards(docs(spark), shards=8, tolerance=0.01).collect()]
    assert len(got) == len(rows())
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert set(by) <= set(range(8))


def test_sharding_is_even_and_keeps_equal_texts_together(spark):
    r = random.Random(1)
    data = [(i, "x" * r.randrange(50), "en", "s", 1) for i in range(3000)] + [(10_000 + i, f"t{i % 700} " * 20, "en", "s", 1) for i in range(2800)]
    got = sharding.histogram_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), with_text=True).collect()
    size, of = Counter(), defaultdict(set)
    for x in got:
        size[x["shard"]] += x["size"]
        of[x["text"]].add(x["shard"])
    assert max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 8
    assert sum(len(s) > 1 for s in of.values()) <= 7


def test_sharding_cuts_a_hot_text_and_takes_empty_tables(spark):
    data = [(i, "same", "en", "s", 1) for i in range(4000)]
    got = Counter(r["shard"] for r in sharding.histogram_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).collect())
    assert len(got) == 8 and max(got.values()) - min(got.values()) < 30
    assert sharding.histogram_shards(empty(spark)).count() == 0
    clash = docs(spark).withColumn("Size", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("_k", F.lit(2))
    assert sharding.histogram_shards(clash).count() == len(rows())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, *_ in rows())
    pieces = [p.asDict() for p in packing.pack(docs(spark).repartition(5), path, 64).collect()]
    seqs = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p["ids"])) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        seqs[p["sequence_id"]].append(p)
    assert sorted(seqs) == list(range(len(seqs)))
    for s, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 64 or s == max(seqs)
    ids = [x for s in sorted(seqs) for p in sorted(seqs[s], key=lambda p: p["offset"]) for x in p["ids"]]
    starts = [(p["doc_id"], s * 64 + p["offset"], p["doc_tokens"]) for s in seqs for p in seqs[s] if p["start"] == 0]
    assert Counter((d, tuple(ids[a : a + n])) for d, a, n in starts) == want
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack(empty(spark), path).count() == 0


def test_packing_special_token_text_is_encoded_whole():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    encode, wide = packing.encoder(path)
    tok = Tokenizer.from_file(path)
    import numpy as np

    texts = ["a <|endoftext|> b", "  two  spaces\n\n x", "日本語 text", "it's we'll 3.14!!", " x y", ""]
    for t, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, wide).tolist() == tok.encode(t, add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_the_library(spark, bpe):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = byte_bpe.encode_documents(docs(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter()
    for i, t, *_ in rows():
        ids = ref.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got)
    assert byte_bpe.encode_documents(empty(spark).withColumn("n_tokens", F.lit("x")), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_on_very_long_pre_tokens(bpe):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(3)
    for text in ["a" * 50_000, "".join(r.choice("abcdeth") for _ in range(60_000)), "!" * 9999, "ß" * 7000, " " * 5000]:
        assert list(memoryview(bpe.encode([text])[0]).cast("I")) == ref.encode_ordinary(text)


def test_bpe_is_exact_for_ranks_out_of_order():
    """Ranks that no training gives: a join may make a pair of a lower rank."""
    r = random.Random(5)
    pieces = [bytes([b]) for b in range(256)]
    more = list({bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(60)})
    r.shuffle(more)
    toy = byte_bpe.ByteBPE({p: i for i, p in enumerate(pieces + more)}, r"[\s\S]+")

    def slow(piece):
        parts = [bytes([b]) for b in piece]
        if piece in toy.ranks:
            return [toy.ranks[piece]]
        while True:
            best = min(((toy.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return [toy.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(500):
        s = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 30)))
        assert toy.encode_pieces([s])[0].tolist() == slow(s)
    many = [bytes(r.choice(b"abc") for _ in range(r.randrange(0, 30))) for _ in range(400)]
    assert [x.tolist() for x in toy.encode_pieces(many)] == [slow(s) if s else [] for s in many]


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(fps):
    seen = {}
    for i, f in fps:
        seen.setdefault(f, []).append(i)
    keys, root = list(seen), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [i for i in seen[k] if i is not None]
        least[find(k)] = min([*ids, *([least[find(k)]] if least.get(find(k)) is not None else [])], default=None)
    return {k: least[find(k)] for k in keys}


@pytest.mark.parametrize("with_text", [False, True])
def test_sharding_cuts_rows_equal_in_every_column(spark, with_text):
    d = spark.createDataFrame([(7, "same text")] * 4000 + [(i, f"t{i}") for i in range(800)], "doc_id long, text string")
    got = sharding.histogram_shards(d, with_text=with_text).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 4800 and len(size) == 8 and max(size.values()) <= 1.02 * min(size.values())
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert not with_text or Counter(r["text"] for r in got)["same text"] == 4000


@pytest.mark.parametrize("bucket", [1, 64])
def test_simhash_equals_brute_force(spark, bucket):
    got = simhash.simhash_components(docs(spark), pair_bucket=bucket).collect()
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows()]
    comp = components(fps)
    assert Counter((r["doc_id"], r["_fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((i, f, comp[f]) for i, f in fps)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_connect_chains_of_close_fingerprints(spark, bucket):
    r = random.Random(7)
    fps = {0, 1, 3, 7, (1 << 64) - 1}
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for _ in range(r.randrange(1, 4)):
                f ^= 1 << r.randrange(64)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), pair_bucket=bucket).collect()
    assert all((e["a"] % (1 << 64) ^ e["b"] % (1 << 64)).bit_count() <= 2 for e in edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for e in edges:
        root[find(e["a"] % (1 << 64))] = find(e["b"] % (1 << 64))
    assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= 2)


def test_dedup_keeps_one_row_of_each_group(spark):
    kept = simhash.dedup(docs(spark)).collect()
    comp = {r["component_id"] for r in simhash.similar_components(docs(spark)).collect()}
    assert Counter(r["doc_id"] for r in kept) == Counter(comp)
    assert simhash.dedup(empty(spark)).count() == 0
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_dedup_keeps_one_row_of_each_group_whatever_its_ids(spark):
    """Unlike texts with null ids or one repeated id all stay; their copies go, and a copy with an id goes before one without."""
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    none, same, mixed = [text() for _ in range(5)], [text() for _ in range(3)], text()
    data = [(None, x) for x in none] + [(None, none[0])] + [(7, x) for x in same] + [(9, same[1]), (8, same[2])] + [(None, mixed), (12, mixed), (11, mixed)]
    kept = simhash.dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter(tuple(x) for x in kept) == Counter([(None, x) for x in none] + [(7, x) for x in same] + [(11, mixed)])


def jaccard(a, b, width=5):
    s = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def near_copies(seed=0):
    """Groups of texts, each a source with copies of which a few words are others, and texts that only share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    data, passage = [], " ".join(word() for _ in range(60))
    for g in range(40):
        w = [word() for _ in range(r.randrange(80, 500))]
        data.append((1000 * g, " ".join(w)))
        for c in range(1, 4):
            v = list(w)
            for _ in range(len(w) // 60):
                v[r.randrange(len(v))] = word()
            data.append((1000 * g + c, " ".join(v)))
    data += [(100_000 + i, passage + " " + " ".join(word() for _ in range(150))) for i in range(40)]
    return data


def test_similar_components_catch_near_copies_and_leave_others(spark):
    data = near_copies()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(data, "doc_id long, text string"), chunk=16).collect()}
    text = dict(data)
    close = [(a, b) for a in text for b in text if a < b and a // 1000 == b // 1000 and a < 100_000 and jaccard(text[a], text[b]) >= 0.82]
    assert len(close) > 100 and sum(got[a] == got[b] for a, b in close) >= 0.98 * len(close)
    assert all(got[i] == i for i in text if i >= 100_000)
    assert all(got[i] // 1000 == i // 1000 for i in text if i < 100_000)


def test_similar_components_on_awkward_rows(spark):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_components(docs(spark)).collect())
    assert sum(got.values()) == len(rows())
    assert all(got[i, 0] == 1 for i in (0, 1, 2, 3)) and all(c == 10 for i, c in got if i is not None and 10 <= i < 100)
    assert simhash.similar_components(empty(spark)).count() == 0


def at_similarity(target, groups, seed=0, n=400):
    """Pairs of texts of n words whose five-word shingle sets have about this similarity, by words changed far apart."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    data, true = [], {}
    for g in range(groups):
        w = [word() for _ in range(n)]
        v, shingles = list(w), n - 4
        for k in range(round(shingles * (1 - target) / (1 + target) / 5)):
            v[5 + 5 * k] = word()
        data += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
        true[g] = jaccard(data[-2][1], data[-1][1])
    return data, true


def test_similar_components_hold_the_similarity_itself(spark):
    data, true = [], {}
    for i, target in enumerate((0.75, 0.77, 0.785, 0.805, 0.82, 0.85)):
        d, t = at_similarity(target, 60, seed=i)
        data += [(1000 * i + k, x) for k, x in d]
        true |= {1000 * i + 2 * g: s for g, s in t.items()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    joined = {k: got[k + 1] == k for k in true}
    below, above = [joined[k] for k, s in true.items() if s < 0.8], [joined[k] for k, s in true.items() if s >= 0.8]
    assert len(below) > 100 and not any(below)
    assert len(above) > 100 and sum(above) >= 0.97 * len(above)


def test_a_failed_candidate_leaves_no_pair_out(spark):
    """A family whose members are all candidates of one another, of which only some pairs reach the similarity: as brute force."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(300)]
    data = []
    for i in range(60):
        v = list(base)
        for k in r.sample(range(50), 4):
            v[5 * k] = word()
        data.append((i, " ".join(v)))
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_components(spark.createDataFrame(data, "doc_id long, text string"), miss=1e-6, chunk=8).collect()}
    root = list(range(60))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(60):
        for b in range(a):
            if jaccard(data[a][1], data[b][1]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert 1 < len({find(a) for a in root}) < 60
    assert all(got[a] == find(a) for a in range(60))


@pytest.mark.parametrize("chunk", [2, 64])
def test_spanning_edges_equal_all_pairs(chunk):
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(1)
    centre = g.integers(0, 256, (5, 64), dtype=np.uint8)
    fps = np.concatenate([c ^ np.packbits(g.random((12, 512)) < 0.06, axis=1) for c in centre])
    n = len(fps)
    key = np.zeros(n, np.int64)
    part = pa.table([pa.array(key)] * 3 + [pa.array(np.arange(n)), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array(np.arange(n))], names=list("abcdef"))
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for batch in simhash._spanning(part, 70):
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            assert np.bitwise_count(fps[a] ^ fps[b]).sum() <= 70
            root[find(a)] = find(b)
    want = list(range(n))
    top = lambda x: x if want[x] == x else top(want[x])
    for a in range(n):
        for b in range(n):
            if np.bitwise_count(fps[a] ^ fps[b]).sum() <= 70:
                want[top(a)] = top(b)
    assert all((find(a) == find(b)) == (top(a) == top(b)) for a in range(n) for b in range(n))


def test_sharding_runs_no_python(spark, sf):
    import re

    df = sharding.histogram_shards(spark.read.parquet(f"{sf}/documents.parquet"))
    df.count()
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_nodes_with_more_candidates_than_they_give_say_so():
    """One of four close ones in other groups is given, and each node that has more is named, so that it is asked again."""
    import numpy as np
    import pyarrow as pa

    from ephyra.llm import simhash

    n = 5
    part = pa.table({"key": [7] * n, "lo": [0] * n, "hi": [0] * n, "nid": list(range(n)), "_fp": [np.array([1 << i, 0], "<u8").tobytes() for i in range(n)], "grp": list(range(n))})
    rows = lambda k: [(r["a"], r["b"]) for b in simhash._closest(part, 2, k) for r in b.to_pylist()]
    assert {a for a, b in rows(1) if a == b} == set(range(n)) and not [a for a, b in rows(4) if a == b]
    assert {p for p in rows(4)} == {(a, b) for a in range(n) for b in range(a + 1, n)}


def lines_family(n, q=13, k=5, shingles=400):
    """n texts of which no two reach a similarity of 0.8 and all come near: each changes k places of one text, two of them share one at most."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(shingles + 4)]
    data = []
    for m in range(n):
        v = list(base)
        for i in range(k):
            v[4 + 5 * (q * i + (m // q * i + m) % q)] = word()
        data.append((m, " ".join(v)))
    return data


def test_pairs_to_verify_grow_with_the_members_of_a_family(spark, monkeypatch):
    """All are candidates of one another and none is linked: what is rooted and verified by joins grows far slower than its pairs."""
    made = []

    class Kept(simhash.Linking):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(simhash, "Linking", Kept)
    for n in (40, 160):
        data = lines_family(n)
        assert max(jaccard(data[a][1], data[b][1]) for a in range(n) for b in range(a)) < 0.8
        got = simhash.similar_components(spark.createDataFrame(data, "doc_id long, text string"), chunk=32).collect()
        assert all(x["doc_id"] == x["component_id"] for x in got) and len(got) == n
    few, many = (x.n_tried for x in made)
    assert 0 < many < 8 * few and many < 160 * 159 // 4  # 4 times the members have 16 times the pairs


@pytest.mark.parametrize("chunk", [4, 7, 64])
def test_families_are_compared_whole(spark, monkeypatch, chunk):
    """A long chain of like sets beside others of its family: the links are those of brute force, however chunks fall."""
    import numpy as np

    from ephyra.llm.common import materialize

    monkeypatch.setattr(simhash, "CHUNK_BYTES", 5000)
    g = np.random.default_rng(chunk)
    base = g.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, g.choice(90, 9, replace=False)), g.integers(0, 2**63, int(g.integers(0, 9))).astype(np.uint64)])) for _ in range(50)]
    near = [(a, b) for a in range(50) for b in range(a) if simhash.jaccard_reaches(sets[a], sets[b], 0.8)]
    nodes = materialize(spark.createDataFrame([(i,) for i in range(50)], "node long"))
    held = materialize(spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(sets)], "node long, s binary"))
    links = simhash.Linking(nodes, held, 0.8)
    links.take(spark.createDataFrame([(i, i + 1, 1) for i in range(49)], "a long, b long, d long"))
    apart = links.apart()
    links.compare(apart, spark.createDataFrame([], "a long, b long"), chunk)
    got = {r["node"]: r["root"] for r in links.label.collect()}
    root = list(range(50))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in near:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert 0 < len(near) < 50 * 49 // 2 and len({find(a) for a in range(50)}) > 1
    assert all(got.get(a, a) == find(a) for a in range(50))


def test_common_counts_equal_intersections(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "COLUMNS", 16)
    g = np.random.default_rng(3)
    sets = [np.unique(g.integers(0, 120, int(n)).astype(np.uint64)) for n in g.integers(0, 90, 30)] + [np.arange(500, 600, dtype=np.uint64)]
    x, y = np.arange(0, 31, 2), np.arange(31)
    assert (simhash.common(sets, x, y) == [[len(np.intersect1d(sets[a], sets[b])) for b in y] for a in x]).all()
    assert not simhash.common(sets[-1:], np.array([0]), np.array([], int)).size
