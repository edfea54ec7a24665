"""The ten operators against brute force, on small tables with nulls, ties, copies and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import bpe, bpe_words, embedding_dedup, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, url_filters
from logloom.llm.common import as_bytes, buffers
from logloom.llm.components import connected_components
from logloom.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, key string, n_words long"  # columns whose names clash with what operators make
ODD = [None, "", " \n\t", "a", "one two", "x " * 3000, "é" * 500, "b<|endoftext|> c", "  　  z\x0b\x0cq", "Ünï code 日本語 🙂 'll"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(60)
    out = list(ODD)
    for _ in range(30):
        out.append("\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))))
    out += [out[12]] * 3 + [out[13] + " tail"] + [line(20) + " " + passage + "\n" + line(9) for _ in range(3)]
    near = out[14].split(" ")
    near[2] = "changed"
    return out + [" ".join(near)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], DOC).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, texts, nothing):
    path = vocabulary("byte_bpe_50k.json")
    library = bpe.load(path)
    got = by_id(token_counts.token_counts(docs, path, chunk=300, overlap=8))
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)), t
    assert token_counts.token_counts(nothing, path).count() == 0


def test_resynchronisation_widens():
    library = bpe.load(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice([" ", "\n", "a", "é", "<|endoftext|>", "1", ".", "'s", "日", "  "]) for _ in range(rng.randint(0, 500)))
        assert token_counts.count_long(library, t, rng.choice([70, 100]), rng.choice([2, 40])) == len(library.encode(t, add_special_tokens=False).ids)
    assert token_counts.count_long(library, "a" * 5000, 200, 4) == len(library.encode("a" * 5000).ids)


def test_bpe_words(docs, texts, nothing):
    path = vocabulary("word_bpe_49k.json")
    library = bpe.load(path)
    got = by_id(bpe_words.digests(docs, path))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))))
        assert tuple(got[i])[1:] == want, t
    assert bpe_words.encode(nothing, path).count() == 0


def test_packing(docs, texts, nothing):
    path = vocabulary("byte_bpe_50k.json")
    library = bpe.load(path)
    rows = packing.pack(docs, path, length=64).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at[r["doc_id"]], len(ids[r["doc_id"]]), zlib.crc32(piece.tobytes()))
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 64 and n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(nothing, path).count() == 0


def test_hilbert_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def _fingerprint(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(near):
    label = np.arange(len(near))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(near))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash(docs, texts, nothing, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    got = by_id(simhash.near_duplicates(docs))
    fp = [_fingerprint(t) for t in texts]
    a = np.array(fp, np.uint64)
    label = _components(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", label[i]) for i, f in enumerate(fp)}
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4))]))
    df = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(fp.view(np.int64))], "id long, fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df), "a", "b").collect()}
    want = _components(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert [got.get(i, i) for i in range(len(fp))] == want.tolist()


@pytest.mark.parametrize(("radius", "tile"), [(9, 4096), (9, 2), (0, 2)])
def test_simhash_links_are_complete_for_any_radius(spark, monkeypatch, radius, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64).astype(np.uint64)
    # one changed bit in each of nine places that are spread over the blocks, or set bits only (so counts differ by nine)
    spread = np.uint64(sum(1 << b for b in range(0, 63, 7)))
    fp = np.unique(np.concatenate([base, base ^ spread, base & ~spread, base | spread]))
    df = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(fp.view(np.int64))], "id long, fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, radius), "a", "b").collect()}
    assert [got.get(i, i) for i in range(len(fp))] == _components(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius).tolist()


@pytest.mark.parametrize("batch", [20_000, 1])
def test_suffix_dedup(docs, texts, nothing, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH_ROWS", batch)
    monkeypatch.setattr(suffix_dedup, "QUEUE_ROWS", 2)
    length = 40
    raw = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for r in raw:
        for i in range(len(r) - length + 1):
            (twice if r[i : i + length] in seen else seen).add(r[i : i + length])
    got = by_id(suffix_dedup.removal_digests(docs, length=length, gram=8))
    for k, r in enumerate(raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if r[i : i + length] in twice:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~gone[:-1]].tobytes()
        assert tuple(got[k])[1:] == (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), k
    assert suffix_dedup.removal_digests(nothing).count() == 0
    cut = suffix_dedup.without_repeats(docs, length=length, gram=8)
    assert cut.columns == docs.columns and cut.count() == len(texts)


def test_line_dedup(docs, texts, nothing):
    gone, earlier = {}, []
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            s = set(WORD.findall(line))
            if not s:
                continue
            if any(5 * len(s & x) >= 4 * len(s | x) for x in earlier):
                gone.setdefault(i, []).append(p)
            earlier.append(s)
    got = by_id(line_dedup.removals(docs))
    assert {i: r["removed_lines"] for i, r in got.items() if r["n_removed"]} == {i: ",".join(map(str, p)) for i, p in gone.items()}
    assert gone and len(got) == len(texts)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()}
    for i, t in enumerate(texts):
        assert kept[i] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, [])))
    assert line_dedup.removals(nothing).count() == 0


def test_line_dedup_short_lines(spark):
    """Lines of few words go like any other; only those without a word stay."""
    lines = ["yes", "a b", "a b c", "b  a", "yes", " \t", "", "", "a b c d", "d c b a", "a b c d e", "x y z v w", "w v y x", "osó " * 9, "osó", "p q r", "p q r s", "yes no"]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 6 : i * 6 + 6]), "k", 1) for i in range(3)], DOC)
    earlier, want = [], []
    for i, line in enumerate(lines):
        s = set(WORD.findall(line))
        if s and any(5 * len(s & x) >= 4 * len(s | x) for x in earlier):
            want.append(i)
        earlier += [s] if s else []
    got = [6 * r["doc_id"] + int(p) for r in line_dedup.removals(docs).orderBy("doc_id").collect() for p in r["removed_lines"].split(",") if p]
    assert got == want == [3, 4, 9, 10, 12, 14]


def test_line_dedup_hot_groups(spark):
    """A line there hundreds of times, a large group of near copies, near misses of it, repeated ids, null ids, very long lines."""
    rng = random.Random(12)
    words = ["w%d" % i for i in range(3000)]
    base = rng.sample(words, 40)
    changed = lambda n: " ".join(rng.choice(words) if i in set(rng.sample(range(40), n)) else w for i, w in enumerate(base))
    lines = ["the very common line"] * 300 + [changed(rng.choice([1, 2, 3])) for _ in range(150)] + [changed(rng.choice([4, 5, 6, 7, 8])) for _ in range(60)]
    long = [rng.choice(words) for _ in range(6000)]
    lines += [" ".join(long), " ".join([*long[:5000], *("z%d" % i for i in range(300))]), " ".join(rng.sample(words, 90)), "\t".join(words[:9]), "\x0b ".join(words[:9][::-1])]
    rng.shuffle(lines)
    rows = [(i // 2, "\n".join(lines[i * 9 : i * 9 + 9]), "k", 1) for i in range(len(lines) // 9 + 1)]
    rows = sorted(rows, key=lambda r: r[0]) + [(None, "the very common line\nonly here with no id at all", "k", 1)]
    docs = spark.createDataFrame(rows, DOC).withColumn("h", F.xxhash64("text"))
    ordered = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    earlier, want = [], set()
    for r in ordered:
        for p, line in enumerate(r["text"].split("\n")):
            s = set(WORD.findall(line))
            if s and any(5 * len(s & x) >= 4 * len(s | x) for x in earlier):
                want.add((r["doc_id"], r["h"], p))
            earlier += [s] if s else []
    got = [tuple(r) for r in line_dedup.removed_lines(docs.select("doc_id", "h", "text")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    twice = docs.drop("h").unionByName(docs.drop("h"))
    assert line_dedup.without_repeats(twice).count() == 2 * len(rows)


@pytest.mark.parametrize("tile", [2048, 3])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = [(base[i % 30] + rng.standard_normal(16) * (0.05 if i >= 30 else 0)).tolist() for i in range(120)]
    rows += [rows[0]] * 4 + [[x * 3 for x in rows[1]], [0.0] * 16, None, [], [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0, None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    good = [i for i, x in enumerate(rows) if x and len(x) == 16 and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    m = np.array([rows[i] for i in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    label = _components(near)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, recall=0.9999).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in good} == {i: (int(near[k].sum()), good[label[k]]) for k, i in enumerate(good)}
    for i in set(range(len(rows))) - set(good):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_base_rules(docs, texts, spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = by_id(quality_rules.judge(docs, labels))
    for i, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(words) < 500 else set(range(len(words)))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert tuple(got[i][c] for c in quality_rules.BASE) == want, (i, t)
        assert got[i]["base_failed"] == (len(words) < 10 or 100 * len(cover) > 20 * len(words))
    assert quality_rules.judge(nothing, labels).count() == 0


def _junk(rng, n):
    return " ".join("".join(rng.choice("#*$%|&") for _ in range(3)) + rng.choice(["ab", "cd"]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, _junk(rng, 40) if i % 4 == 0 else good(60)) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(240)], "doc_id long, quality int, text string")


def test_forest_and_classifier_on_labels(labelled):
    docs, labels = labelled
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert sum(kept[i] == (i % 4 != 0) for i in kept) >= 235
    scored = quality_classifier.classify(docs, labels).collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored) and held
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_classifier_odd_texts(docs, texts, labelled, nothing):
    got = quality_classifier.classify(docs, labelled[1].limit(0)).collect()
    assert len(got) == len(texts) and {r["score"] for r in got} == {0.5}
    assert quality_classifier.accepted(docs, labelled[1]).columns == docs.columns
    assert quality_classifier.classify(nothing, labelled[1]).count() == 0


def test_gradients():
    x, first = quality_classifier.encode(*buffers(as_bytes(pa.array(["one two three " * 40, "x", "", "| a | b " * 30]))))
    y = np.array([1, 0, 0, 1], np.float32)
    m = quality_classifier.Model(0.4)
    m.w = {k: (v + 0.1).astype(np.float64) for k, v in m.w.items()}
    loss = lambda: -float(np.mean(y * np.log(m.forward(x, first)["p"]) + (1 - y) * np.log(1 - m.forward(x, first)["p"])))
    g = m.gradients(x, first, y)
    for k, w in m.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        w[at] += 1e-5
        high = loss()
        w[at] -= 2e-5
        low = loss()
        w[at] += 1e-5
        assert abs((high - low) / 2e-5 - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k


def test_url_rules(spark):
    pages = [(1, "https://A.Example.NET/en/x?q", None), (2, "http://x.net/", ""), (3, "http://example.com/de/1", None), (4, "ftp://o.org/fr/#f", None), (5, None, None), (6, "no scheme", None), (7, "http://x.net", None), (8, "http://notnet/", None)]
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4)] == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("x.net", "/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"), ("o.org", "/fr/", "org/fr/", "allow")]
    assert (got[5]["host"], got[6]["path"], got[7]["rule"], got[8]["rule"]) == ("", "", None, None)


def test_link_graph(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/">x</a>' for h in hosts)
    pages = [(1, "http://good.org/fr/", link("friend.com", "friend.com")), (2, "http://friend.com/", link("bad.net")), (3, "http://spam.com/", link("bad.net", "evil.net")), (4, "http://far.com/", link("spam.com")), (5, "http://alone.com/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in url_filters.judge(df).collect()}
    edges = {("good.org", "friend.com"): 1, ("friend.com", "bad.net"): 1, ("spam.com", "bad.net"): 1, ("spam.com", "evil.net"): 1, ("far.com", "spam.com"): 1}
    hosts = sorted({h for e in edges for h in e} | {"alone.com"})
    trust, distrust = ({h: 0.0 for h in hosts} for _ in range(2))
    for _ in range(50):
        trust = {h: 0.15 * (h == "good.org") + 0.85 * sum(trust[a] * w / sum(x for (s, _), x in edges.items() if s == a) for (a, b), w in edges.items() if b == h) for h in hosts}
        distrust = {h: 0.15 * h.endswith(".net") + 0.85 * sum(distrust[b] * w / sum(x for (_, t), x in edges.items() if t == b) for (a, b), w in edges.items() if a == h) for h in hosts}
    for h, r in got.items():
        assert abs(r["trust"] - trust[h]) < 1e-4 and abs(r["distrust"] - distrust[h]) < 1e-4
    assert {h: r["verdict"] for h, r in got.items()} == {"good.org": "allow", "friend.com": "allow", "spam.com": "block", "far.com": "block", "alone.com": "allow"}


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5), (7, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
