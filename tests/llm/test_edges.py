"""Repeated rows, null ids, very long texts, clashing columns, ties, empty tables; recall at the production settings."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import bpe, bpe_words, embedding_dedup, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, url_filters
from logloom.llm.queries import vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def twice(spark):
    """Rows that are there twice, an id with two texts, null ids, a null text."""
    rng = random.Random(1)
    text = lambda n: " ".join("w%d" % rng.randrange(500) for _ in range(n))
    a, b, c = text(90), text(80), text(60)
    rows = [(1, a), (1, a), (2, b), (2, c), (None, c), (None, c), (None, None), (None, None), (9, text(40))]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_repeated_rows_and_null_ids(spark, twice):
    docs, rows = twice
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    key = lambda r: (str(r["doc_id"]),)
    ids = sorted((str(i),) for i, _ in rows)
    library = bpe.load(BYTES)
    tokens = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(docs, BYTES).collect()) == tokens
    words = bpe.load(WORDS)
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, words.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in bpe_words.digests(docs, WORDS).collect()) == want
    assert sorted(map(key, quality_rules.judge(docs, labels).collect())) == ids
    assert sorted(map(key, quality_classifier.classify(docs, labels).collect())) == ids
    assert sorted(map(key, simhash.near_duplicates(docs).collect())) == ids
    assert {r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id = 1").collect()} == {1}
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removal_digests(docs).collect())
    size = lambda t: len((t or "").encode())
    copies = lambda t: size(t) if sum(x == t for _, x in rows) > 1 and size(t) >= 200 else 0
    assert got == sorted((str(i), size(t), copies(t)) for i, t in rows)
    gone = line_dedup.without_repeats(docs).collect()
    assert sorted(map(key, gone)) == ids and sorted(str(r["text"]) for r in gone if r["doc_id"] is None) == sorted([rows[4][1], rows[4][1], "None", "None"])
    pieces = packing.pack(docs, BYTES).collect()
    assert sum(r["length"] for r in pieces) == sum(n + 1 for _, n in tokens)


def test_equal_texts_have_equal_verdicts_and_places(spark):
    """Ties: scores of one text are equal, and equal keys are packed whole."""
    rng = random.Random(2)
    texts = [" ".join("w%d" % rng.randrange(300) for _ in range(50)) for _ in range(4)]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(400)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    verdicts = {(r["doc_id"] % 4, r["kept"]) for r in quality_rules.judge(docs, labels).collect()}
    assert len(verdicts) == 4
    n = {i: len(bpe.load(BYTES).encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    at = {}
    for r in packing.pack(docs, BYTES, length=64).orderBy("doc_id", "start").collect():
        assert r["start"] == at.get(r["doc_id"], 0)
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {i: n[i % 4] for i in range(400)}


def test_very_long_texts(spark):
    """Past every block and segment size, at the production settings."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    half = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(34_000))
    long = half + "\n" + half
    assert len(long) > 2 * packing.TEXT_BLOCK // 2
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, half[:5000])], "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES).collect()}
    packed = {r["doc_id"]: (r["doc_tokens"], r["n"]) for r in packing.pack(docs, BYTES).groupBy("doc_id").agg(F.max("doc_tokens").alias("doc_tokens"), F.sum("length").alias("n")).collect()}
    assert packed == {i: (n + 1, n + 1) for i, n in counts.items()}
    library = bpe.load(WORDS)
    ids = library.encode(long, add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in bpe_words.digests(docs, WORDS).collect()}
    assert (got[1]["n_tokens"], got[1]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert got[1]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removal_digests(docs).collect()}
    assert cut[1][0] == len(long) and cut[1][1] >= 2 * len(half) and cut[2] == (10, 0) and cut[3] == (5000, 5000)
    base = {r["doc_id"]: r for r in quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert (base[1]["n_words"], base[1]["n_dup_lines"]) == (2 * 34_000 * 40, 34_000)
    lines = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.removals(docs).collect()}
    assert lines[1] == (68_000, 34_000)
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}[1] == f"{simhash.fingerprint(long.encode()):016x}"
    assert quality_classifier.classify(docs, spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, quality int")).count() == 3


def test_clashing_columns(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [1.0, 0.01], 6, "y"), (None, [1.0, 0.0], 7, "z")], "vec_id long, embedding array<double>, id long, key string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False)}
    pages = spark.createDataFrame([(1, "http://a.net/", "", "h", 1.0)], "page_id long, url string, html string, host string, trust double")
    assert url_filters.judge(pages).first()["verdict"] == "block"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_recall_of_embedding_links(spark):
    """12,000 vectors, half of them close to the threshold: at the production setting, 0.9 of the pairs at least are found, and none below."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((6000, 48))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.93, (6000, 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.zeros(len(unit), np.int64)
    for at in range(0, len(unit), 1000):
        near = unit[at : at + 1000] @ unit.T >= 0.9
        want[at : at + 1000] = near.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    got = np.zeros(len(unit), np.int64)
    for r in embedding_dedup.near_duplicates(df).collect():
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0


def test_special_strings_and_scripts():
    """Words encoded many at a time give the library's ids, whatever stands in them."""
    rng = random.Random(6)
    library = bpe.encoder(BYTES)
    bits = [" ", "  ", "\n", "\t", "\xa0", "　", "a", "Zebra", "1234", "é", "ж", "日本", "🙂", "<|endoftext|>", "'s", "don't", ".", "...", "\x85", "ǆ", "½", "́"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    import pyarrow as pa

    from logloom.llm.common import as_bytes, buffers

    ids, at = library.ids(bpe.Words(*buffers(as_bytes(pa.array(texts)))))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert zlib.crc32(ids.tobytes()) and library.fast


def test_rarity_table_stays_out_of_rows(spark, tmp_path):
    """The optimizer has the subquery where words are looked up, and no plan node hands the table on."""
    from logloom.llm.common import Stored

    docs = spark.createDataFrame([(1, 5, "a b c\nd e")], "doc_id long, h long, text string")
    keyed = line_dedup._described(line_dedup._with_keys(line_dedup._lines(docs), line_dedup._classes(Stored(spark, "test"), docs)))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert "classes" not in plan and "scalar-subquery" in plan
    assert [r["n"] for r in keyed.orderBy("pos").collect()] == [3, 2]


def test_bpe_words_go_out_in_few_rows(spark):
    """A block has one row for each part at most, and one of codes; rows of different splittings don't make texts."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j}" for j in range(200))) for k in range(40)], "doc_id long, text string").coalesce(1)
    rows = bpe_words._split(docs, 3)
    assert 2 <= rows.count() <= 4
    other = bpe_words._encoded(rows, WORDS, 3).withColumn("sum", F.when(F.col("part") == 0, 0).otherwise(F.col("sum")))
    with pytest.raises(Exception, match="different splittings"):
        bpe_words._assembled(other, WORDS, lambda n, ids, text: (n, ids, text), "doc_id long, n_tokens long, ids string, decoded string").collect()


def test_a_stored_step_leaves_no_shuffle_files(spark):
    import glob

    from logloom.llm.common import Stored

    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    stored = Stored(spark, "leaves").put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before and stored.count() == 7


def test_white_space_is_replaced_only_where_it_is(spark):
    """Texts without tabs and the like are only searched for them, in each pass over the texts; with them, words are the same."""
    from logloom.llm.common import Stored

    texts = ["a b c d e", "a\tb\x0bc\x0cd\re", "\t\r \x0b\x0c\n\tz y\n\n \r", "q\rr s", None, "", "q\x0cs r"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, h long, text string")
    lines = line_dedup._lines(docs)
    got = [(r["doc_id"], r["pos"], r["line"].split(" ")) for r in lines.orderBy("doc_id", "pos").collect()]
    want = [(i, p, re.split("[ \t\x0b\x0c\r]", x)) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n")) if WORD.search(x)]
    assert got == want
    keyed = line_dedup._with_keys(lines, line_dedup._classes(Stored(spark, "test"), docs))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 4 and plan.count("Contains(") == 4 and "CASE WHEN" in plan
    removed = {r["doc_id"]: r["removed_lines"] for r in line_dedup.removals(docs.drop("h")).collect()}
    assert removed == {0: "", 1: "0", 2: "", 3: "", 4: "", 5: "", 6: "0"}
