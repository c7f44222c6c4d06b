"""The pipeline's stages against brute force."""

import random
import re
import string

import corpus_pipeline
import pytest
from cairnstore.llm import near_copies
from cairnstore.llm.common import documents, staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _stored(spark, texts, name="made"):
    rows = [(i, t, "en", f"s{i % 7}", len(t)) for i, t in texts]
    return staged(spark.createDataFrame(rows, SCHEMA).coalesce(2), name)


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def _grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _first_of_groups(texts):
    """The smallest id of each group that pairs of Jaccard similarity 0.8 or more join."""
    grams, root = {i: _grams(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in grams:
        for j in grams:
            if i < j and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in grams}


def _copies(rng):
    """Texts and copies of them with a few words replaced, of similarity 0.6 to 1; chains too."""
    texts = []
    for _ in range(40):
        words = _words(rng, rng.randint(50, 300))
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 35))):
                words[rng.randrange(len(words))] = "new" + str(rng.random())
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_similarity_0_8_go(spark, seed):
    texts = _copies(random.Random(seed))
    want = _first_of_groups(texts)
    kept = corpus_pipeline.near_duplicates(spark, _stored(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and len(want) < len(texts)


def test_near_copies_of_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(_first_of_groups([(r.doc_id, r.text) for r in docs.collect()]))


def test_near_copies_edges(spark):
    odd = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "w x y z")]
    rows = [(i, t, "en", None, 0) for i, t in odd]
    docs = staged(spark.createDataFrame(rows, SCHEMA).coalesce(1), "odd")
    assert sorted(str(r.doc_id) for r in near_copies.keep_first(docs).collect()) == ["1", "4", "5", "None"]
    assert near_copies.keep_first(staged(docs.where("false"), "none")).count() == 0


def _without_repeats(texts):
    """The texts without later copies of byte-equal runs of 51 words, punctuation around words aside."""
    seen, out = set(), {}
    for i, text in texts:
        data, words = text.encode(), []
        for m in re.finditer(rb"[^ \t-\r]+", data):
            marks = string.punctuation.encode()
            core = m[0].strip(marks)
            at = m.start() + (len(m[0]) - len(m[0].lstrip(marks)) if core else 0)
            words.append((at, at + len(core or m[0])))
        gone = bytearray(len(data))
        for n in range(len(words) - 50):
            a, b = words[n][0], words[n + 50][1]
            if data[a:b] in seen:
                gone[a:b] = b"\1" * (b - a)
            seen.add(data[a:b])
        out[i] = bytes(x for x, g in zip(data, gone) if not g).decode()
    return out


def test_repeated_passages_of_51_words_go(spark):
    rng = random.Random(6)
    passage = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [passage(n) for n in (50, 51, 51, 55, 90, 140)] + [" ".join("ab"[rng.random() < 0.5] for _ in range(51))]
    texts = []
    for i in range(1, 61):
        parts = [p for _ in range(3) for p in (" ".join(_words(rng, rng.randint(0, 60))), rng.choice(["{}", "({})", '"{},"', "- {}\n\n"]).format(rng.choice(shared)))]
        texts.append((i, " ".join(parts)))
    texts += [(61, ""), (62, "a b"), (63, texts[0][1]), (64, "x y z " * 60)]
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, _stored(spark, texts), "").collect()}
    assert got == _without_repeats(texts)
    assert sum(t.count(shared[1]) for t in got.values()) == 1 and sum(t.count(shared[0]) for t in got.values()) > 1


def test_stages_keep_clashing_columns_and_take_empty_tables(spark):
    schema = SCHEMA + ", _cs_text string, _cs_row long, _cs_source string, uid string, bin_id string, shard long, cluster string, spans string, kept string"
    rng = random.Random(6)
    made = lambda i, n: (i, " ".join(_words(rng, 80)) if n % 4 else None, "en", f"s{n % 2}", None, f"t{n}", -n, f"o{n}", f"u{n}", "b", 7, "c", "s", "k")
    rows = [*(made(i, i) for i in range(1, 30)), made(None, 31), made(5, 33)]
    docs = staged(spark.createDataFrame(rows, schema).coalesce(2), "clashing")
    given = {(r.doc_id, r._cs_text, r._cs_row, r._cs_source, r.uid, r.bin_id, r.shard, r.cluster, r.spans, r.kept) for r in docs.collect()}
    nothing = staged(docs.where("false"), "nothing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, nothing = staged(stage(spark, docs, ""), "stage"), staged(stage(spark, nothing, ""), "stage")
        assert docs.columns == nothing.columns == [c.split()[0] for c in schema.split(", ")], name
        assert {(r.doc_id, r._cs_text, r._cs_row, r._cs_source, r.uid, r.bin_id, r.shard, r.cluster, r.spans, r.kept) for r in docs.collect()} <= given, name
        assert docs.count() and not nothing.count(), name
    last = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, docs, "").collect()} == {r.doc_id for r in docs.collect()} and not last(spark, nothing, "").count()


def test_stages_hand_rows_to_workers_in_small_batches(spark):
    import pyarrow as pa

    from cairnstore.llm import common

    docs = staged(spark.range(4000).selectExpr("id AS doc_id", "repeat(concat(id, ' '), 1000) AS text").coalesce(1), "wide")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    before = spark.conf.get(common._BYTES)
    try:
        corpus_pipeline.personal_data(spark, docs, "")
        found = docs.select("text").mapInArrow(common.lean(sizes), "n long, size long").collect()
    finally:
        spark.conf.set(common._BYTES, before)
    assert sum(r.n for r in found) == 4000
    assert max(r.size for r in found) < 1.5 * common.BATCH_BYTES and len(found) > 3


def test_stages_agree_whatever_the_size_of_batches(spark):
    from cairnstore.llm import common

    docs = staged(spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 120), x -> concat('w', x * (1 + id div 2)))) AS text").coalesce(1), "copies")
    stage = lambda: sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    before, size, found = spark.conf.get(common._BYTES), common.BATCH_BYTES, []
    try:
        for common.BATCH_BYTES in (size, 1 << 11):
            found.append(stage())
    finally:
        common.BATCH_BYTES = size
        spark.conf.set(common._BYTES, before)
    assert found[0] == found[1] == list(range(0, 60, 2))
