"""The pipeline, stage by stage, against brute force on the stage's own input."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from logloom.llm import bpe, quality_classifier, simhash
from logloom.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    junk = lambda n: " ".join("###" + rng.choice(words) for _ in range(n))
    passage = good(70)
    rows = [(i, junk(40) if i % 5 == 0 else good(30) + "\n" + good(45), "en", "s", 0) for i in range(160)]
    rows += [(160 + i, rows[i][1], "en", "s", 0) for i in range(1, 9)]
    rows += [(170 + i, good(20) + " " + passage + "\n" + good(12), "en", "s", 0) for i in range(4)]
    rows += [(180, None, "en", "s", 0), (181, "", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def collected(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _firsts(texts):
    """The least id of each group that a Jaccard similarity of 0.8 of five-word shingles connects."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return sorted(i for i in sets if root[i] == i)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, [collected(docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
            seen.append(collected(docs))
            if k:
                assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect()) or name == "simhash_near_dedup"
    source, kept, lined, single, cut = seen
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    assert set(kept) == {i for i, p in scores.items() if p} and not any(i % 5 == 0 for i in kept if i < 160) and len([i for i in kept if i < 160]) >= 126

    earlier, want = [], {}
    for i in sorted(kept):
        left = []
        for line in (kept[i] or "").split("\n"):
            s = set(WORD.findall(line))
            if s:
                if any(5 * len(s & x) >= 4 * len(s | x) for x in earlier):
                    continue
                earlier.append(s)
            left.append(line)
        want[i] = None if kept[i] is None else "\n".join(left)
    assert lined == want and lined != kept

    assert single == {i: lined[i] for i in _firsts(lined)}

    raw = {i: (t or "").encode() for i, t in single.items()}
    once, twice = set(), set()
    for r in raw.values():
        for i in range(len(r) - 199):
            (twice if r[i : i + 200] in once else once).add(r[i : i + 200])
    for i, r in raw.items():
        gone = np.zeros(len(r), bool)
        for a in range(len(r) - 199):
            if r[a : a + 200] in twice:
                gone[a : a + 200] = True
        left = np.frombuffer(r, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert (cut[i] or "") == left
    assert cut != single

    library = bpe.load(vocabulary("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in cut.items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}


def test_run(spark, tables):
    pieces = corpus_pipeline.run(spark, tables)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0


def test_near_copies_by_five_word_shingles(spark):
    """Of each group that a Jaccard similarity of 0.8 or more of five-word shingles connects, the first stays."""
    rng = random.Random(8)
    words = ["w%d" % i for i in range(2000)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        rows.append(" ".join(base))
        for changes in (0, 1, 2, 3, 5):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", "  "]).join(near).upper() if changes == 1 else " \n".join(near))
    rng.shuffle(rows)
    rows += ["", None, " \t\n", "one", "ONE", "one two"]

    want = _firsts(dict(enumerate(rows)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == want
    assert len(want) < len(rows) - 40


def test_near_copies_by_row(spark):
    """Equal rows leave one, an id's other text is judged by itself, null ids and an empty table work, columns may clash."""
    words = ["w%d" % i for i in range(60)]
    base, other = " ".join(words[:50]), " ".join(words[::-1])
    rows = [(1, base, "x", 1), (1, base, "x", 1), (2, base + " more", "y", 2), (2, other, "z", 3), (None, other + " end", "n", 4), (None, None, "m", 5), (7, "", "o", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string, id long")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[0], rows[4], rows[5]]))
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_in_a_large_group(spark, monkeypatch):
    """Hundreds of near copies, over several tiles, and near misses of them."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 50)
    rng = random.Random(3)
    words = ["w%d" % i for i in range(5000)]
    base = rng.sample(words, 400)
    rows = []
    for k in range(260):
        near = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9, 12, 16])):
            near[rng.randrange(400)] = rng.choice(words)
        rows.append(" ".join(near))
    rows += [" ".join(rng.sample(words, 200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = _firsts(dict(enumerate(rows)))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want and 40 < len(want) < 250


def test_radius_of_near_copies():
    """Of pairs at the similarity, fewer than one in a thousand differ in more bits than the radius."""
    rng = random.Random(11)
    words = ["w%d" % i for i in range(20000)]
    beyond = tried = 0
    while tried < 3000:
        base = [rng.choice(words) for _ in range(rng.choice([30, 60, 120, 300]))]
        near = list(base)
        for _ in range(max(1, len(base) // 45)):
            near[rng.randrange(len(base))] = rng.choice(words)
        a, b = shingles(" ".join(base)), shingles(" ".join(near))
        if 5 * len(a & b) < 4 * len(a | b):
            continue
        tried += 1
        x, y = (simhash.fingerprint(" ".join(t).encode(), simhash.NEAR_WORDS) for t in (base, near))
        beyond += (x ^ y).bit_count() > simhash.NEAR_RADIUS
    assert beyond <= 3
