"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import exact_dedup, html_text, licenses, mixing, packing, phrases, quality, queries, records, simhash, warc
from engramlake.session import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, row long, taken long, fingerprint string, _row string, `a.b` string"
PAGES = "page_id long, url string, html string, digest string, path string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), None, "x", 1, 1, "f", "r", "dot") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = "Word word2 " * 9000 + "Released under the MIT License."
    rows = [(0, None, "a"), (1, "", None), (2, "same text here now", "a"), (3, "same  text\nhere now", "b"), (3, "same  text\nhere now", "b"), (None, "no id", "a"), (5, long, None), (5, "another text of five", "a"), (6, "a\x00b \U0001f600 é́", "b"), (7, " \t\n", "a")]
    return stage(docs(spark, rows), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return stage(docs(spark, []), "none")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "licenses": lambda d, _: licenses.scan(d),
    "records": lambda d, _: records.read(records.write(d, queries.VOCABULARY)),
    "mixing": lambda d, _: mixing.mix(d),
    "dedup": lambda d, _: exact_dedup.decide(d),
    "simhash": lambda d, _: simhash.components(d),
    "quality": lambda d, labels: quality.score(d, labels),
    "phrases": lambda d, _: phrases.compare(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, odd, none, labels):
    got = OPERATORS[name](odd, labels)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.select("doc_id").collect()) == sorted((r["doc_id"] is None, r["doc_id"]) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](none, labels).count() == 0
    assert OPERATORS[name](none, labels).columns == got.columns


@pytest.mark.parametrize("stage_no", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, stage_no, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, apply = corpus_pipeline.STAGES[stage_no]
    got = apply(spark, odd, str(tmp_path))
    got.write.format("noop").mode("overwrite").save()
    assert apply(spark, none, str(tmp_path)).count() == 0
    if name != "packing":
        assert got.columns == odd.columns
        assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in odd.collect()}
    if name == "exact_dedup":
        assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == [0, 2, 5, 5, 6, 7]


def test_quality_without_labels(odd, labels):
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_learns_once_from_a_repeated_id(spark):
    rows = [(i, f"text number {i} " * (3 + i % 5), "a") for i in range(40)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    once = stage(docs(spark, rows), "once")
    more = stage(docs(spark, rows + [(i, "z later text " * 4, "a") for i in range(40)] + rows[:9]), "more")
    a, b, c = quality.fit(once, marks), quality.fit(more, marks), quality.fit(more, marks, 20)
    d = quality.fit(once, marks, 20)
    assert (a.linear == b.linear).all() and (a.factors == b.factors).all() and a.bias == b.bias
    assert (c.linear == d.linear).all() and c.bias == d.bias


def test_packing(odd, none):
    p = packing.pieces(odd, queries.VOCABULARY)
    rows = packing.pack(p).collect()
    assert len(rows) == p.count() and packing.pack(packing.pieces(none, queries.VOCABULARY)).count() == 0
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in map(sorted, bins.values()):
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(x[1] for x in b) <= 4096


def test_pages(spark):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(0, None, None, "d", "p"), (1, "u", "", "d", "p"), (4, "u\r\nInjected: 1", same, "d", "p"), (2, "u", same, "d", "p"), (2, "u", same, "d", "p"), (None, "u", same, "d", "p"), (7, "u", "<article><p>a&amp;b<p>c</article>", "d", "p")]
    p = stage(spark.createDataFrame(rows, PAGES), "odd-pages")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(p).collect())
    assert got == [("0", "response", None), ("1", "response", None), ("2", "response", None), ("2", "response", None), ("4", "revisit", 2), ("7", "response", None), ("None", "revisit", 2)]
    texts = {r["page_id"]: r["text"] for r in html_text.extract(p).collect()}
    assert texts[0] == "" and texts[7] == "a&b c" and len(html_text.extract(p).collect()) == 7
    empty = stage(spark.createDataFrame([], PAGES), "no-pages")
    assert warc.round_trip(empty).count() == 0 and html_text.extract(empty).count() == 0


def test_records_by_index_and_damage(spark, odd, tmp_path):
    shards = records.write(odd, queries.VOCABULARY)
    want = {(r["doc_id"], r["ids_crc32"]) for r in records.read(shards).where("doc_id in (2, 6)").collect()}
    got = records.read_at(shards, spark.createDataFrame([(2,), (6,)], "doc_id long")).collect()
    assert {(r["doc_id"], zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))) for r in got} == want
    path = shards.where("n_records > 0").first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        records.read(shards).collect()


def test_index_grows_by_batches(spark):
    index = exact_dedup.new_index(spark)
    one = exact_dedup.decide(docs(spark, [(4, "a b", "x"), (2, "a  b", "x"), (3, "c", "x")]), index, "1")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in one.collect()} == {(4, 2, False), (2, 2, True), (3, 3, True)}
    two = exact_dedup.decide(docs(spark, [(1, "a b", "x"), (9, "new", "x")]), index, "2")
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in two.collect()} == {(1, 2, 3, False), (9, 9, 1, True)}
    with pytest.raises(ValueError):
        exact_dedup.decide(docs(spark, [(1, "a", "x")]), index, "2")
    assert index.table().where("fresh").count() == 3


def test_mix_of_copies(spark):
    d = stage(docs(spark, [(i, "w " * 50, "big" if i % 3 else "small") for i in range(60)]), "mix")
    m = mixing.mix(d, block=16).collect()
    for r in m:
        assert r["taken"] <= 3 * r["size"]
    for s in ("big", "small"):
        own = [r for r, x in zip(m, range(60)) if r["source_size"] == (2000 if s == "big" else 1000)]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    assert sorted(map(tuple, m)) == sorted(map(tuple, mixing.mix(d, block=16).collect()))
    assert mixing.mixed_documents(d).columns == d.columns


def test_words_and_their_parts_are_remembered_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from engramlake.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    words, text = tokens.WordIds(path), "Straße, straße Straße. word WORD, (word) it's été 12,5 ..."
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert words.encode(text) == words.packed(want)
    assert not hasattr(words, "parts") and {"word", "straße", ","} <= set(words)
    monkeypatch.setattr(tokens, "WORDS", 3)
    few = tokens.WordIds(path)
    assert few.encode(text) == words.packed(want) and len(few) <= 3
