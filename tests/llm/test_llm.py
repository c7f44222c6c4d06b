"""The corpus operators against brute force, round trips and held-out rows, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cairnstore.llm import bpe, mpeg_audio, packing, pii, quality_fm, quality_rules, simhash, suffix_dedup, token_orc, toxicity
from cairnstore.llm.common import documents, labels, numbered, staged
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp long, uid long"
EDGES = [(1, None, None, None, None, "x", 1, 1), (2, "", "en", "s", 0, None, None, None), (3, " \n\t ", "en", "s", 4, None, 0, 0), (None, "a b c d e", "en", "s", 9, None, 0, 0),
         (4, "a b c d e", "en", None, 9, None, 0, 0), (4, "a b c d e", "en", None, 9, None, 0, 0), (5, "wörd +1 (555) 555-1234 a@b.cd " * 3000, "en", "s", 1, None, 0, 0)]


@pytest.fixture(scope="module")
def edges(spark):
    return staged(spark.createDataFrame(EDGES, SCHEMA).coalesce(1), "edges")


@pytest.fixture(scope="module")
def empty(spark):
    return staged(spark.createDataFrame([], SCHEMA), "empty")


def _rule_counts(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, edges, empty):
    for docs in (documents(spark, SF), edges):
        want = collections.Counter((r.doc_id, *_rule_counts(r.text)) for r in docs.collect())
        assert want == collections.Counter((r.doc_id, *(r[m] for m in quality_rules.METRICS)) for r in quality_rules.assess(docs).collect())
    assert quality_rules.assess(empty).count() == 0
    assert quality_rules.filter_documents(edges).columns == edges.columns


@pytest.mark.parametrize("bits", [0, 2, 40])
def test_windows_whose_hashes_collide(spark, bits):
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = rows.select("n", "t", quality_rules._words(F.col("t")).alias("w"), F.lit((1 << bits) - 1 << 20 if bits else 0).cast("long").alias("m"))
    rows = rows.withColumn("m", F.col("m").bitwiseOR(F.lit(0).cast("long"))).withColumn("x", quality_rules._windows(F.col("w"), F.col("m")))
    # All bits outside of the mask are the window's place.
    found = rows.withColumn("x", F.transform("x", lambda v: v)).select("n", quality_rules._covered(F.col("x"), F.col("w"), F.col("m")).alias("k")).collect()
    assert {r.n: r.k for r in found} == {n: _rule_counts(t)[4] for n, t in enumerate(texts)}


def test_beta_prior_shrinks_small_hosts():
    a, b = quality_rules.beta_prior(100, 10, 2, 100 * 0.02)
    assert 0.05 < a / (a + b) < 0.15
    assert quality_rules.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_chunks_and_pieces_encode_like_the_library(most):
    random.seed(1)
    library, joiner, pieces = _library(), bpe.Joiner(bpe.default_tokenizer(), 8, 64, 7), bpe.PieceEncoder(bpe.default_tokenizer(), most)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "'", "'ll", "1", "é", "　", "\xa0", "\x1c", "\0", "<|endoftext|>", "\t", "word ", " the", "word.", "x" * 30]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 150))) for _ in range(600)] + ["word the " * 100, "", "\n"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 60):
        ids, at = pieces.encode(pa.array(texts[a : a + 60], pa.string()))
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == want[a : a + 60]
    given = []  # every second chunk's ids are known
    for text in texts:
        cuts = joiner.cuts(text)
        chunks = [text[x:y] for x, y in zip([0, *cuts], cuts)]
        given.append({k: library.encode(c, add_special_tokens=False).ids for k, c in enumerate(chunks) if k % 2})
    got = joiner.encode(texts, [{k: np.array(v, joiner.stored).tobytes() for k, v in g.items()} for g in given])
    assert [x.tolist() for x in got] == want and joiner.repaired
    assert list(joiner.written(got)) == [",".join(map(str, ids)).encode() for ids in want]
    assert joiner.decode(got) == library.decode_batch(want, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    common = " ".join(word() for _ in range(2000))
    rows = [(i, word() + " " + common + " " + word()) for i in range(6)] + [(9, " ".join(word() for _ in range(900)))]
    docs = staged(spark.createDataFrame(rows, "uid long, text string").repartition(3), "shared")
    found = {r.uid: {g.place: bytes(g.ids) for g in r.given} for r in bpe.shared_chunks(docs, bpe.default_tokenizer())[0].collect()}
    assert set(found) == set(range(6)) and all(len(found[u]) > 1 for u in range(6))


def test_numbers_do_not_depend_on_splits(spark):
    docs = staged(documents(spark, SF).repartition(7), "many-files")
    numbers = numbered(docs).select("doc_id", "uid")
    first = sorted(map(tuple, numbers.collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert sorted(map(tuple, numbers.collect())) == first and len({u for _, u in first}) == len(first)
        moved = numbered(docs.where("doc_id >= 0").withColumn("n", F.lit(1)))
        assert moved.select("uid").distinct().count() == moved.count() and moved.columns[-1] == "uid"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_round_trip_and_orc(spark, edges, empty):
    library = _library()
    for docs in (documents(spark, SF), edges):
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        start, tokens, trips = 0, [], []
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            trips.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
            tokens.append((r.doc_id, start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
            start += len(ids) + 1
        assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(trips, key=str)
        assert sorted(map(tuple, token_orc.store_and_read(docs).collect()), key=str) == sorted(tokens, key=str)
    assert bpe.round_trip(empty).count() == token_orc.store_and_read(empty).count() == 0


def _fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [2048, 2])
def test_simhash(spark, block):
    docs = documents(spark, SF)
    fps = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {(i, f"{f:016x}", find(i)) for i, f in fps.items()}
    assert want == set(map(tuple, simhash.near_duplicates(docs, block=block).collect()))


def test_simhash_edges(edges, empty):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(edges).count() == 4  # one without words, the null id, one of each text


def test_segments_find_every_pair():
    rng = random.Random(3)
    for _ in range(2000):
        bits = rng.sample(range(64), 4)
        assert any(sum(first <= b < first + n for b in bits) <= radius for first, n, radius in simhash.SEGMENTS)


def test_suffix_ranks_are_the_order_of_the_bytes():
    rng = random.Random(8)
    for length in (1, 3, 7, 8, 20):
        data = bytes(rng.choice(b"ab\xff") for _ in range(400))
        ranks = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8).astype(np.int64) + 1, length)
        strings = [data[i : i + length] for i in range(len(data))]
        place = {x: n for n, x in enumerate(sorted(set(strings)))}
        assert np.unique(ranks, return_inverse=True)[1].tolist() == [place[x] for x in strings]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_strings_of_one_file_are_told_by_their_bytes(keep):
    """Whatever hashes say: contexts that share a file are compared byte for byte."""
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(12)]
    rows = [{"file": 1, "way": 0, "context": n, "doc_id": n, "uid": n, "start": 0, "size": 33, "data": t, "prints": None, "places": None} for n, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pylist(rows, suffix_dedup._DEALT_ARROW)
    got = {(r["context"], p) for b in suffix_dedup._comparer(8, keep, "bytes")([batch]) for r in b.to_pylist() for x in r["own"] for p in range(x["a"], x["b"])}
    seen = collections.defaultdict(list)
    for n, t in enumerate(texts):
        for p in range(33):
            seen[t[p : p + 8]].append((n, p))
    assert got == {x for same in seen.values() if len(same) > 1 for x in (same if keep == "none" else same[1:])}


def test_word_bounds():
    import re

    rng = random.Random(10)
    for _ in range(300):
        data = "".join(rng.choice(["a", "é", ".", ",", "(", " ", "\n", "\t", "B1"]) for _ in range(rng.randint(0, 40))).encode()
        want, marks = [], suffix_dedup.np.flatnonzero(suffix_dedup._MARK).astype(np.uint8).tobytes()
        for m in re.finditer(rb"[^ \t-\r]+", data):
            core = m[0].strip(marks)
            a = m.start() + len(m[0]) - len(m[0].lstrip(marks))
            want.append((a, a + len(core)) if core else m.span())
        assert list(map(tuple, suffix_dedup.word_bounds(data).T.tolist())) == want


def test_texts_longer_than_a_segment(spark):
    rng = np.random.default_rng(11)
    long = rng.integers(97, 123, suffix_dedup.SEGMENT + 5000).astype(np.uint8).tobytes()
    seam = long[suffix_dedup.SEGMENT - 700 : suffix_dedup.SEGMENT + 300]
    texts = [long, b"xyz" + seam + b"!", long[:300] + seam[:399], seam[100:500] + b"?"]
    docs = staged(spark.createDataFrame([(n, t.decode()) for n, t in enumerate(texts)], "doc_id long, text string").coalesce(1), "long")
    seen = collections.Counter(hash(t[p : p + 400]) for t in texts for p in range(len(t) - 399))
    for row, t in zip(sorted(suffix_dedup.digest(docs).collect()), texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[hash(t[p : p + 400])] > 1:
                gone[p : p + 400] = b"1" * 400
        assert row.n_removed == gone.count(b"1") and row.kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [256, 1])
def test_suffix_dedup(spark, keep, hot):
    random.seed(5)
    passages = ["".join(random.choice("abé ") for _ in range(40)) for _ in range(4)]
    piece = lambda: random.choice([random.choice(passages), random.choice(passages)[5:30], "".join(random.choice("abcdefgh") for _ in range(random.randint(0, 30)))])
    rows = [(i if i % 17 else None, "".join(piece() for _ in range(random.randint(0, 4)))) for i in range(60)]
    rows += [(200, "a" * 70), (201, None), (202, ""), (203, "ab" * 30), (204, rows[3][1]), (204, rows[3][1])]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "passages")
    rows, found = [tuple(r) for r in docs.collect()], collections.defaultdict(list)
    for n, (i, text) in enumerate(rows):
        data = (text or "").encode()
        for p in range(len(data) - 15):
            found[data[p : p + 16]].append((i is not None, i or 0, n, p))
    want = []
    for n, (i, text) in enumerate(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 15):
            where = found[data[p : p + 16]]
            if len(where) > 1 and (keep == "none" or min(where) != (i is not None, i or 0, n, p)):
                gone[p : p + 16] = b"\1" * 16
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        want.append((i, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    assert sorted((tuple(r)[:5] for r in suffix_dedup.digest(docs, 16, 5, keep, hot).collect()), key=str) == sorted(want, key=str)


def test_suffix_dedup_edges(edges, empty):
    assert suffix_dedup.digest(edges).count() == len(EDGES) and suffix_dedup.digest(empty).count() == 0
    kept = suffix_dedup.remove(edges)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)


def test_audio_round_trip(spark, edges, empty):
    for docs in (documents(spark, SF), edges):
        want = []
        for r in docs.collect():
            payload = mpeg_audio.pad((r.text or "").encode())
            want.append((r.doc_id, len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
        got = mpeg_audio.store_and_read(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert mpeg_audio.store_and_read(empty).count() == 0


def test_audio_parser_resynchronises_and_checks():
    media = mpeg_audio.store(b"x" * 192 * 5)
    stream = mpeg_audio.parse(media)
    assert (len(stream.offsets), stream.samples, stream.milliseconds, stream.table[:3]) == (5, 5760, 180.0, ("Xing", 5, 1296))
    at = int(stream.offsets[2])
    broken = mpeg_audio.parse(media[:at] + b"\xff\xfbgarbage" + media[at:])
    assert (len(broken.offsets), broken.resyncs, broken.bad_checksums) == (5, 1, 0)
    assert mpeg_audio.parse(media[: at + 10] + b"\1" + media[at + 11 :]).bad_checksums == 1
    assert stream.seek(2304) == at and mpeg_audio.parse(None).samples == 0 and mpeg_audio.parse(b"\xff" * 50).samples == 0


def _base(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, p, a, b in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if a <= len(d) <= b and (k == 3 or sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                out.append((k, m.start(), m.end()))
    return out


def test_patterns():
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choice(["a", "@", ".", "1", "25", "4111 1111 1111 1111", "+1 (555) 555-1234", " ", "-", "300", "b.c"]) for _ in range(random.randint(0, 40)))
        assert sorted(pii.pattern_spans(text)) == sorted(_base(text)), text


def test_tagger(edges, empty):
    tagger, rng, hit, missed, extra = pii.trained(), np.random.default_rng(99), 0, 0, 0
    for _ in range(150):
        text, spans = pii.labelled(rng)
        ((base, every),) = pii.find([text], tagger)
        assert set(base) <= set(every)
        want, every = {s for s in spans if pii._counts(text[s[1] : s[2]])}, set(every)
        hit, missed, extra = hit + len(want & every), missed + len(want - every), extra + len(every - want)
    assert hit / (hit + missed) > 0.9 and hit / (hit + extra) > 0.9
    assert pii.detect(edges).count() == len(EDGES) and pii.detect(empty).count() == 0
    assert "a@b.cd" not in "".join(r.text or "" for r in pii.redact(edges).collect())


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger(rng)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    codes, path = rng.integers(1, 98, (2, 6)), rng.integers(0, len(pii.LABELS), (2, 6))

    def loss():
        e, _ = tagger.emissions(codes)
        a = e[0]
        for t in range(1, len(e)):
            a = e[t] + pii._logsum(a[:, :, None] + tagger.p["trans"], 1)
        y = path.T
        gold = sum(e[t][np.arange(2), y[t]] for t in range(len(e))) + sum(tagger.p["trans"][y[t - 1], y[t]] for t in range(1, len(e)))
        return float((pii._logsum(a, 1) - gold).mean())

    grads = tagger.step(codes, path)
    for k in ("trans", "out", "hf", "xb", "bf"):
        at = tuple(rng.integers(0, n) for n in tagger.p[k].shape)
        tagger.p[k][at] += 1e-2
        high = loss()
        tagger.p[k][at] -= 2e-2
        low = loss()
        tagger.p[k][at] += 1e-2
        assert abs((high - low) / 2e-2 - grads[k][at]) < 2e-3


def test_factorisation_machine(spark, edges, empty):
    docs, marks = documents(spark, "/root/testdata/sf0.01"), labels(spark, "/root/testdata/sf0.01")
    machine = quality_fm.train(docs, marks)
    rows = quality_fm.score(docs, machine).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    got = quality_fm.score(edges, machine).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got) and quality_fm.score(empty, machine).count() == 0
    ids, x = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0], np.float32)
    machine.v[ids] = np.random.default_rng(0).standard_normal((3, quality_fm.FACTORS))
    margin = machine.margins(ids, x, np.array([0]))[0][0]
    pairs = sum(machine.v[ids[i]] @ machine.v[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert margin == pytest.approx(machine.w0 + machine.w[ids] @ x + pairs, rel=1e-4)
    assert quality_fm.train(docs, marks.where("false")).w0 == 0


def test_classifier_chain(spark, edges, empty):
    docs, marks = documents(spark, "/root/testdata/sf0.1"), labels(spark, "/root/testdata/sf0.1")
    chain = toxicity.train(docs, marks.where("doc_id % 4 <> 2"))
    rows = toxicity.score(docs, chain).withColumnRenamed("toxic", "found").join(marks.where("doc_id % 4 = 2"), "doc_id").collect()
    assert np.mean([r.found for r in rows if r.toxic]) > 0.9 and np.mean([r.found for r in rows if not r.toxic]) < 0.05
    assert toxicity.score(edges, chain).count() == len(EDGES) and toxicity.score(empty, chain).count() == 0


def test_packing_finds_the_tightest_bin():
    rng = random.Random(4)
    lengths, sources, clusters = [rng.randint(1, 150) for _ in range(300)], [1 << rng.randint(0, 5) for _ in range(300)], [rng.randint(0, 200) for _ in range(300)]
    bins, want = [], {}
    for row in sorted(range(300), key=lambda i: (-lengths[i], i)):
        pieces = [100] * (lengths[row] // 100) + ([lengths[row] % 100] if lengths[row] % 100 else [])
        for n, size in enumerate(pieces):
            fit = [b for b in bins if b[0] >= size and sources[row] not in b[1] and clusters[row] not in b[2]]
            chosen = min(fit, key=lambda b: b[0]) if fit else [100, set(), set()]
            want[row, n] = chosen[0] if fit else None
            if not fit:
                bins.append(chosen)
            chosen[0] -= size
            chosen[1].add(sources[row])
            chosen[2].add(clusters[row])
    got, held = packing.pack_rows(lengths, sources, clusters, 100), collections.defaultdict(list)
    for row, piece, n, offset, length in got:
        assert offset == sum(x[1] for x in held[n]) and offset + length <= 100
        assert not any(sources[row] == sources[r] or clusters[row] == clusters[r] for r, _ in held[n])
        assert (100 - offset if held[n] else None) == want[row, piece]
        held[n].append((row, length))
    assert len(got) == len(want)


def test_packing_edges(edges, empty):
    rows = packing.pack(edges, capacity=64).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None} and packing.pack(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    docs = documents(spark, SF)
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "stage")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == kept


def test_paths_are_the_best_ones():
    rng = np.random.default_rng(3)
    tagger = pii.Tagger(rng)
    tagger.p["trans"] = rng.standard_normal(tagger.p["trans"].shape).astype(np.float32)
    codes, sizes, n = rng.integers(1, 98, (7, 5)), np.array([5, 1, 4, 5, 3, 2, 5]), len(pii.LABELS)
    got = tagger.decode(codes, sizes)
    for row, size, path in zip(codes, sizes, got):
        e, _ = tagger.emissions(row[None, :size])
        total = lambda y: sum(e[t, 0, y[t]] for t in range(size)) + sum(tagger.p["trans"][y[t - 1], y[t]] for t in range(1, size))
        best = max(total(y) for y in itertools.product(range(n), repeat=int(size)))
        assert abs(total(path[:size]) - best) < 1e-3


class _Perfect:
    """Labels digits as a phone number, from one window alone."""

    def decode(self, codes, sizes):
        digit = (codes >= 17) & (codes <= 26)
        begin = digit & ~np.concatenate([np.zeros((len(codes), 1), bool), digit[:, :-1]], axis=1)
        begin[:, 0] = False  # a window can't tell whether a span goes on from before
        return np.where(digit, np.where(begin, 7, 8), 0).astype(np.int8)


@pytest.mark.parametrize("size", [9, 80, 700])
def test_spans_of_any_length_survive_any_offset(size):
    texts = ["x" * at + "1" * size + "y" * 90 for at in range(0, pii.WINDOW + 40)] + ["", "1" * size, "2" * 10 + " " + "3" * size]
    want = [[(3, len(t) - 90 - size, len(t) - 90)] for t in texts[:-3]] + [[], [(3, 0, size)], [(3, 0, 10), (3, 11, 11 + size)]]
    assert pii.tagged(texts, _Perfect()) == want


def test_results_do_not_depend_on_what_is_tagged_together():
    rng = np.random.default_rng(5)
    texts = [pii.labelled(rng)[0] * int(rng.integers(1, 9)) for _ in range(40)] + ["", "a"]
    tagger = pii.trained()
    assert pii.tagged(texts, tagger) == [s for t in texts for s in pii.tagged([t], tagger)]


def test_training_without_labels_of_both_kinds(spark, edges, empty):
    marks = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(4, 1, 1), (5, 1, 1)], [(None, 1, 1), (4, None, None)], [(None, 0, 0), (4, 1, 1), (4, 1, 1)]):
        p = {r.p_toxic for r in toxicity.score(edges, toxicity.train(edges, marks(rows))).collect()}
        s = {r.score for r in quality_fm.score(edges, quality_fm.train(edges, marks(rows))).collect()}
        assert len(p) == len(s) == 1 and 0 < p.pop() < 1 and 0 < s.pop() < 1
    assert toxicity.score(empty, toxicity.train(empty, marks([(1, 1, 1)]))).count() == 0


def test_near_copies_are_in_one_group():
    rng = random.Random(12)
    words = lambda: ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(200)]
    a, b = words(), words()
    texts = [a, a[:150] + b[:10] + a[150:], b, a[20:]]
    groups = toxicity.near_groups([toxicity.copies(toxicity.words(" ".join(t))) for t in texts])
    assert groups[0] == groups[1] == groups[3] != groups[2]


def test_base_columns_against_sql(spark):
    """What SQL can say of operators 7, 8 and 10: hashes of the texts, payloads, and counts by pattern."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW d AS SELECT doc_id, coalesce(text, '') AS t FROM '{sf}/documents.parquet'")
    same = lambda rows, sql: sorted(map(tuple, rows.collect())) == sorted(con.sql(sql).fetchall())
    assert same(bpe.round_trip(docs).select("doc_id", "decoded_sha256"), "SELECT doc_id, sha256(t) FROM d")
    stored = mpeg_audio.store_and_read(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")
    assert same(stored, """SELECT doc_id, n, p, sha256(t || repeat(' ', CAST(p - n AS INT))) FROM (SELECT *, greatest(192, (n + 191) // 192 * 192) AS p FROM (SELECT *, CAST(strlen(t) AS BIGINT) AS n FROM d))""")
    found = pii.detect(docs).select("doc_id", "n_email", "n_ip", "n_phone")
    assert same(found, r"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')),
      len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)),
      len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) FROM d""")


MEMORY = """
import numpy as np, pyarrow as pa
from cairnstore.llm import bpe, token_orc

rss = lambda: int(open("/proc/self/statm").read().split()[1]) >> 8
words = ["".join(w) for w in np.array(list("abcdefghijklmnopqrstuvwxyz"))[np.random.default_rng(1).integers(0, 26, (1_000_000, 7))]]
texts = pa.array([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
del words
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "_cs_text"])
most = max(rss() for _ in token_orc.encoded(iter([batch]), bpe.default_tokenizer(), 2, 0))
print("MEMORY", most, rss())
"""


def test_token_memory_goes_back_after_each_slice():
    """Six processes share an executor: what encoding took isn't held by its allocators."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    said = subprocess.run(["timeout", "200", sys.executable, "-c", MEMORY], env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True)
    most, after = map(int, said.stdout.split("MEMORY")[1].split())
    assert after < most - 60


def test_windows_repeat_few_characters():
    assert pii.WINDOW - pii.STRIDE == 48 and 20 * (pii.WINDOW - pii.STRIDE) <= pii.WINDOW


def test_the_decoder_reads_as_the_trained_cells_do():
    rng = np.random.default_rng(8)
    for scale in (1, 30):  # the second drives cells and gates to their ends
        tagger = pii.Tagger(rng)
        for k in ("xf", "xb", "bf", "bb"):
            tagger.p[k] *= np.float32(scale)
        codes, sizes = rng.integers(1, 98, (5, 90)), np.array([90, 90, 40, 90, 1])
        e = np.zeros((90, len(pii.LABELS), 5), np.float32)
        order = np.argsort(-sizes, kind="stable")
        active = [int(np.count_nonzero(sizes > t)) for t in range(90)]
        for d in "fb":
            tagger._scan(np.ascontiguousarray(codes[order].T), active, d, e)
        for place, n in enumerate(order.tolist()):
            want = tagger.emissions(codes[n : n + 1, : sizes[n]])[0][:, 0] - tagger.p["out_b"]
            assert np.allclose(e[: sizes[n], :, place], want, atol=1e-4), (scale, n)


def test_windows_that_end_at_any_time_are_read_whole():
    rng, most = np.random.default_rng(9), 2 * pii.TIMES + 50
    sizes = np.array([most, 2 * pii.TIMES + 1, 2 * pii.TIMES, pii.TIMES + 1, pii.TIMES, pii.TIMES - 1, 1])
    codes, e = rng.integers(1, 98, (len(sizes), most)), np.zeros((most, len(pii.LABELS), len(sizes)), np.float32)
    tagger = pii.Tagger(rng)
    for d in "fb":
        tagger._scan(np.ascontiguousarray(codes.T), [int(np.count_nonzero(sizes > t)) for t in range(most)], d, e)
    for n, size in enumerate(sizes.tolist()):
        assert np.allclose(e[:size, :, n], tagger.emissions(codes[n : n + 1, :size])[0][:, 0] - tagger.p["out_b"], atol=1e-4), size


def test_reading_takes_no_longer_than_bare_cells_in_numpy():
    """What numpy takes for the products, exponentials and divisions of as many cells, and for nothing else."""
    import time

    rng, times, size = np.random.default_rng(4), 256, pii.HIDDEN
    tagger, codes = pii.Tagger(rng), rng.integers(1, 98, (times, pii.BATCH))
    real = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    w, table, h, x, z = real(4 * size, size), real(4 * size, 98), real(size, pii.BATCH), real(4 * size, pii.BATCH), real(4 * size, pii.BATCH)
    e, took = np.zeros((times, len(pii.LABELS), pii.BATCH), np.float32), {}

    def bare():
        for t in range(times):
            np.take(table, codes[t], axis=1, mode="clip", out=x)
            x.__iadd__(np.matmul(w, h, out=z))
            np.exp(x, out=z)
            np.exp(h, out=z[:size])
            for k in range(3):
                np.divide(h, x[:size], out=z[k * size : (k + 1) * size])

    for _ in range(5):
        for name, run in (("read", lambda: tagger._scan(codes, [pii.BATCH] * times, "f", e)), ("bare", bare)):
            began = time.thread_time()
            run()
            took[name] = min(took.get(name, 99.0), time.thread_time() - began)
    assert took["read"] < took["bare"], took
