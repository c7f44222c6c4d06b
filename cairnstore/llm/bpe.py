"""Byte-pair encoding of whole texts: remembered words, and content-defined chunks that a corpus encodes once.

Two layers, both exact:

* :class:`PieceEncoder` cuts texts at line feeds and at spaces that follow a character which isn't white
  space.  A byte-level pre-tokenizer never joins characters across such a place, so the pieces can
  be encoded one by one and remembered.  New pieces are split by the byte-level pre-tokenizer's published
  pattern, and new pre-tokens go to the tokenizers library's model, many in a call.
* :func:`round_trip` cuts texts where a rolling hash of the last 32 characters says so.  Copies, near
  copies and shared passages are cut at the same places.  A chunk that occurs more than once in the corpus
  is encoded once, and its ids are joined to the texts that hold it; all other chunks are encoded where
  they are, and texts that share nothing aren't shuffled.  Where two chunks meet, the text around the join is encoded anew, and its tokens must agree
  with those of both chunks beside it; else the text is encoded in one.

The table of pieces is emptied when it reaches a number of entries: memory is bounded and results don't
depend on it.  A shared chunk is told by 128 bits of hash.

Defined results: a null text is an empty text and has no tokens; repeated rows give repeated rows; a
text that holds a special token's string is encoded whole by the library; a text of any length is read
whole, and a batch's texts are encoded some megabytes at a time; rows without texts give an empty table;
extra columns are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.common import bits_of, discard, marked, marks, numbered, release, staged, text_or_empty

MAX_PIECES = 600_000
#: Bytes of text that are encoded in one go.
SLICE = 4 << 20
#: Texts to which a shared chunk goes in one way, and copies of a shared chunk's name.
WAY, SALTS = 4096, 8
#: Characters in a chunk: least, most, and (as a mask of the rolling hash) on average above the least.
CHUNK_LEAST, CHUNK_MOST, CHUNK_MASK = 512, 16_384, 0x7FF
#: Fixed value: the byte-level pre-tokenizer's pattern.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: Marks that often end a word; a run of them after a letter or a digit is a pre-token of its own.
_STOPS = ".,;:!?"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in chars:
            chars[b], spare = chr(spare), spare + 1
    return [chars[b] for b in range(256)]


_BYTE_CHARS = _byte_chars()
_BYTE_TABLE = dict(enumerate(_BYTE_CHARS))


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that begin at ``begins``, one after the other, and their sizes."""
    ends = np.cumsum(sizes, dtype=np.int32)
    places = np.repeat(begins - ends + sizes, sizes)
    places += np.arange(len(places), dtype=np.int32)
    return values[places], sizes


class PieceEncoder:
    """Encodes batches of texts by their pieces; what a piece's ids are is remembered.

    A table holds all remembered ids in one array, and a piece is a row of the table, so a batch is cut,
    looked up and put together column by column; only pieces that are new in the batch cost Python a step.
    """

    def __init__(self, path: str, most: int = MAX_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.most = self.tokenizer.model.tokenize, most
        # Merges alone, for many pre-tokens in a call: they stand between NULs, which are no part of them.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = Split(_BYTE_CHARS[0], "isolated")
        self.nul = self.tokenizer.token_to_id(_BYTE_CHARS[0])
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, dict[str, int]] = {"": {}, " ": {}}  # by what stands before the piece and by the piece
        self.sizes, self.open, self.lead, self.ids = array("i"), array("b"), array("b"), array("I")

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after the other, and how many each has; NUL may not be in them."""
        text = "\0".join(words).encode().decode("latin-1").translate(_BYTE_TABLE)
        ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.nul)
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return np.delete(ids, cuts), sizes

    def _learn(self, before: str, pieces: list[str]) -> None:
        """Rows for new pieces; ``open`` and ``lead`` are set for those that end, or begin, in white space."""
        for a in range(0, len(pieces), 1 << 16):
            some, words, counts = pieces[a : a + (1 << 16)], [], []
            for piece in some:
                if piece.isalpha():
                    words.append(before + piece)
                    counts.append(1)
                else:
                    found = _PRE_TOKEN.findall(before + piece)
                    words += found
                    counts.append(len(found))
            odd = [n for n, w in enumerate(words) if "\0" in w]
            plain = [w.replace("\0", "") for w in words] if odd else words
            ids, sizes = self._merged(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            if odd:
                at = np.concatenate([[0], np.cumsum(sizes)])
                every = [ids[at[n] : at[n + 1]] for n in range(len(words))]
                for n in odd:
                    every[n] = np.array([t.id for t in self.merge("".join([_BYTE_CHARS[b] for b in words[n].encode()]))], np.uint32)
                ids, sizes = np.concatenate(every), np.array([len(x) for x in every])
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            self.rows[before].update(zip(some, range(len(self.sizes), len(self.sizes) + len(some))))
            self.ids.frombytes(ids.astype(np.uint32).tobytes())
            self.sizes.frombytes(np.diff(ends).astype(np.int32).tobytes())
            self.open.extend([p[-1:].isspace() for p in some])
            self.lead.extend([p[:1].isspace() for p in some])

    def _rows(self, pieces: list[str], before: str = "") -> np.ndarray:
        known = self.rows[before]
        found = list(map(known.get, pieces))
        if None in found:
            self._learn(before, list(dict.fromkeys([p for p, r in zip(pieces, found) if r is None])))
            found = map(known.__getitem__, pieces)
        return np.fromiter(found, np.int32, len(pieces))

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, the one after the last, all their ids, and where each text's begin) of some texts at a time."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE)))
            ids, counts = self._encode(texts[a:b])
            yield a, b, ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            a = b

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin (with the end of all)."""
        every, begins, size = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for _, _, ids, at in self.slices(texts):
            every.append(ids)
            begins.append(at[1:] + size)
            size += len(ids)
        return np.concatenate(every), np.concatenate(begins)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.sizes) > self.most:
            self._reset()
        self._empty, special = self._rows([""])[0], {}
        if self.added:
            held = pc.match_substring(texts, self.added[0])
            for token in self.added[1:]:
                held = pc.or_(held, pc.match_substring(texts, token))
            special = {n: self.tokenizer.encode(texts[n].as_py(), add_special_tokens=False).ids for n in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist()}
            if special:
                texts = pc.if_else(held, "", texts)
        lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
        line_bounds = lines.offsets.to_numpy().astype(np.int64)
        cut = pc.split_pattern(lines.flatten(), " ")
        bounds, pieces = cut.offsets.to_numpy().astype(np.int64), cut.flatten()
        coded = pieces.dictionary_encode()
        # Marks that end a word are a row of their own, so that a word is learned once whatever follows it.
        cores = pc.utf8_rtrim(coded.dictionary, _STOPS)
        ended = pc.match_substring_regex(cores, r"[\pL\pN]$")
        cores = pc.if_else(ended, cores, coded.dictionary)
        words = cores.dictionary_encode()
        first = self._rows(_strings(words.dictionary), " ")[words.indices.to_numpy()]
        second = np.full(len(first), -1, np.int32)
        more = np.flatnonzero(pc.not_equal(pc.binary_length(cores), pc.binary_length(coded.dictionary)).to_numpy(zero_copy_only=False))
        if len(more):
            places = pa.array(more)
            long, short = _strings(coded.dictionary.take(places)), pc.utf8_length(cores.take(places)).to_pylist()
            second[more] = self._rows([p[n:] for p, n in zip(long, short)])
        heads, lasts, n = bounds[:-1], bounds[1:] - 1, len(first)
        # The slice's own table: its pieces, its lines' first pieces, and both once more with a line feed behind.
        own = self._rows(_strings(pieces.take(pa.array(heads))))
        code = coded.indices.to_numpy().copy()
        ends_text = np.zeros(len(heads), bool)
        ends_text[line_bounds[1:] - 1] = True
        # Texts in which a run of white space isn't one space or one or two line feeds are cut with care instead.
        wrong = (np.frombuffer(self.open, np.int8) > 0)[first][code]
        wrong[heads] = (np.frombuffer(self.open, np.int8) > 0)[own]
        wrong[lasts[ends_text & (np.diff(bounds) == 1)]] = False  # at a text's end there is nothing to run on to
        wrong = np.logical_or.reduceat(wrong, heads)
        blank, alone = own == self._empty, np.diff(bounds) == 1
        wrong |= (np.frombuffer(self.lead, np.int8) > 0)[own] | ~alone & blank
        wrong[1:] |= (alone & blank)[1:] & (alone & blank)[:-1]
        wrong = np.flatnonzero(np.logical_or.reduceat(wrong, line_bounds[:-1])).tolist()
        code[heads] = n + np.arange(len(heads), dtype=np.int32)
        n += len(heads)
        code[lasts[~ends_text]] += n
        first, second = np.concatenate([first, own]), np.concatenate([second, np.full(len(own), -1, np.int32)])
        none, feed = np.full(n, -1, np.int32), np.full(n, self._rows(["\n"])[0], np.int32)
        table, bounds = [np.stack([first, second, none], axis=1), np.stack([first, second, feed], axis=1)], bounds[line_bounds]
        if wrong:
            parts, lengths, at, n = [], np.diff(bounds), 0, 2 * n
            for m in wrong:
                rows = self._rows([p for p in _SAFE.split(texts[m].as_py()) if p])
                table.append(np.stack([rows, *[np.full(len(rows), -1, np.int32)] * 2], axis=1))
                parts += [code[at : bounds[m]], np.arange(n, n + len(rows), dtype=np.int32)]
                n, lengths[m], at = n + len(rows), len(rows), bounds[m + 1]
            code = np.concatenate([*parts, code[at:]])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
        rows = np.concatenate(table).ravel()
        sizes = np.append(np.frombuffer(self.sizes, np.int32), np.int32(0))  # row -1 has no ids
        known, sizes = _gathered(np.frombuffer(self.ids, np.uint32), np.cumsum(sizes, dtype=np.int32)[rows] - sizes[rows], sizes[rows])
        sizes = sizes.reshape(-1, 3).sum(axis=1, dtype=np.int32)
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        ids, took = _gathered(known, begins[code], sizes[code])
        sums = np.concatenate([[0], np.cumsum(took, dtype=np.int64)])
        counts = sums[bounds[1:]] - sums[bounds[:-1]]
        if special:
            at = np.concatenate([[0], np.cumsum(counts)])
            every = [np.asarray(special.get(n, ids[at[n] : at[n + 1]]), np.uint32) for n in range(len(counts))]
            ids, counts = np.concatenate(every), np.array([len(x) for x in every], np.int64)
        return ids, counts


@lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def text_lengths(texts: pa.Array, path: str) -> np.ndarray:
    """The number of ids of each text."""
    return np.concatenate([np.empty(0, np.int64), *(np.diff(at) for _, _, _, at in encoder(path).slices(texts))])


def count_tokens(docs: DataFrame, keys: list[str], tokenizer: str | None = None) -> DataFrame:
    """``keys`` and n_tokens of each row's whole text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(text_lengths(batch.column("_cs_text"), path))], names=[*keys, "n_tokens"])

    picked = docs.select(*keys, text_or_empty().alias("_cs_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return picked.mapInArrow(run, f"{schema}, n_tokens long")


# Chunks


def rolling_cuts(text: str, least: int = CHUNK_LEAST, most: int = CHUNK_MOST, mask: int = CHUNK_MASK) -> list[int]:
    """Ends of the content-defined chunks of ``text``, in characters."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    power = 0x85EBCA6B
    for width in (1, 2, 4, 8, 16):  # after each step h covers twice as many characters
        step = h.copy()
        step[width:] += h[:-width] * np.uint32(power)
        h, power = step, power * power & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    marks = np.flatnonzero((h & np.uint32(mask)) == 0) + 1
    cuts, at = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - at > most:
            at += most
            cuts.append(at)
        if mark - at >= least or mark == n and mark > at:
            at = mark
            cuts.append(at)
    return cuts


class Joiner:
    """Encodes and decodes texts by way of chunks, some of whose ids are given."""

    def __init__(self, path: str, least: int = CHUNK_LEAST, most: int = CHUNK_MOST, mask: int = CHUNK_MASK):
        self.encoder, self.bounds = encoder(path), (least, most, mask)
        tokenizer = self.encoder.tokenizer
        self.stored = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        written = [f"{n}," for n in range(max(tokenizer.get_vocab().values()) + 1)]
        self.digits = np.array(written, "S").view(np.uint8).reshape(len(written), -1)
        self.n_digits = np.array([len(w) for w in written])
        self.repaired = 0

    def cuts(self, text: str) -> list[int]:
        """Ends of a text's chunks; a text that holds a special token's string is one chunk."""
        return [len(text)] if any(t in text for t in self.encoder.added) else rolling_cuts(text, *self.bounds)

    def encode(self, texts: list[str], given: list[dict[int, bytes]]) -> list[np.ndarray]:
        """The ids of each text; ``given`` holds, by number, the ids of chunks that were encoded elsewhere.

        Where two chunks meet, the text between the last safe place of the one and the first of the
        other is encoded anew; the chunks' own ends are encoded too and must agree with the ids that they
        replace.  A text without such places, or whose windows overlap, is encoded in one.
        """
        ends = [self.cuts(t) for t in texts]
        own = [(n, k) for n, cut in enumerate(ends) for k in range(len(cut)) if k not in given[n]]
        ids, at = self._ids([texts[n][ends[n][k - 1] if k else 0 : ends[n][k]] for n, k in own])
        found = {key: ids[at[m] : at[m + 1]] for m, key in enumerate(own)}
        found |= {(n, k): np.frombuffer(v, self.stored) for n, some in enumerate(given) for k, v in some.items()}
        windows, wanted, whole = [], [], []
        for n, cut in enumerate(ends):
            places = _windows(texts[n], cut)
            if places is None:
                whole.append(n)
                continue
            for k, (low, high) in enumerate(places):
                windows.append((n, k))
                wanted += [texts[n][low:high], texts[n][low : cut[k]], texts[n][cut[k] : high]]
        ids, at = self._ids(wanted)
        parts = [[found[n, k] for k in range(len(cut))] for n, cut in enumerate(ends)]
        for m, (n, k) in enumerate(windows):
            both, left, right = (ids[at[3 * m + i] : at[3 * m + i + 1]] for i in range(3))
            before, after = parts[n][2 * k], parts[n][2 * k + 1]
            if n not in whole and np.array_equal(before[len(before) - len(left) :], left) and np.array_equal(after[: len(right)], right):
                parts[n][2 * k : 2 * k + 2] = [before[: len(before) - len(left)], both, after[len(right) :]]
                self.repaired += 1
            else:  # keeps the places of what follows
                parts[n][2 * k : 2 * k + 2] = [before, both, after]
                whole.append(n)
        out = [np.concatenate(x) if x else np.empty(0, np.uint32) for x in parts]
        whole = sorted(set(whole))
        ids, at = self._ids([texts[n] for n in whole])
        for m, n in enumerate(whole):
            out[n] = ids[at[m] : at[m + 1]]
        return out

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(pa.array(texts, pa.string()))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.encoder.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def written(self, ids: list[np.ndarray]) -> Iterator[bytes]:
        """The ids of each text as decimal numbers between commas."""
        for x in ids:
            rows = self.digits[x]
            yield rows[np.arange(rows.shape[1]) < self.n_digits[x][:, None]].tobytes()[:-1]


def _windows(text: str, cuts: list[int]) -> list[tuple[int, int]] | None:
    """For each place where chunks meet, the nearest safe places in the chunks beside it; None if one has none."""
    out, done, low = [], 0, 0
    for at, high in zip(cuts, cuts[1:]):
        left = right = None
        reach = 32
        while left is None or right is None:
            start, end = max(low, at - reach), min(high, at + reach)
            left = max((start + m.start() for m in _SAFE.finditer(text[start:at]) if m.start()), default=None)
            right = next((at + m.start() for m in _SAFE.finditer(text[at : end + 1]) if 0 < m.start() < end - at), None)
            if start == low and end == high:
                break
            reach *= 4
        if left is None or right is None or left < done:
            return None
        out.append((left, right))
        done, low = right, at
    return out


@lru_cache(1)
def joiner(path: str) -> Joiner:
    return Joiner(path)


def _name(chunk: str) -> tuple[int, int]:
    """128 bits that name a chunk, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(chunk.encode())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _chunk_names(rows: DataFrame, path: str) -> DataFrame:
    """uid, place and name (h, g) of each chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text")):
                text, low = text.as_py(), 0
                for k, high in enumerate(joiner(path).cuts(text)):
                    found.append((uid, k, *_name(text[low:high])))
                    low = high
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["uid", "place", "h", "g"])

    return rows.select("uid", "text").mapInArrow(run, "uid long, place int, h long, g long")


def _encoded_chunks(rows: DataFrame, owned: DataFrame, path: str) -> DataFrame:
    """h, g and ids of the chunks that ``owned`` (uid, places) names, each encoded once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = joiner(path)
        for batch in batches:
            names, chunks = [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                text = text.as_py()
                cuts = own.cuts(text)
                for p in places.as_py():
                    chunks.append(text[cuts[p["place"] - 1] if p["place"] else 0 : cuts[p["place"]]])
                    names.append((p["h"], p["g"]))
            ids, at = own._ids(chunks)
            stored = [ids[a:b].astype(own.stored).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            h, g = zip(*names) if names else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(stored, pa.binary())], names=["h", "g", "ids"])

    return rows.join(owned.hint("merge"), "uid").select("text", "places").mapInArrow(run, "h long, g long, ids binary")


def shared_chunks(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """uid and ``given`` (place and ids) of the chunks that occur more than once, the rows that may hold some, and the bits that mark these.

    Names of chunks are shuffled, not texts; each shared chunk is encoded once, where it comes first, and
    its ids go to the texts that hold it.  A chunk that very many texts hold goes out several ways.  All sides
    grow with the corpus, so none is broadcast, however small it is at first.
    """
    names = staged(_chunk_names(rows, path), "chunks")
    shared = names.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "place")).alias("first")).where("n > 1")
    shared = staged(shared.select("h", "g", F.ceil(F.col("n") / WAY).cast("int").alias("ways"), "first.uid", "first.place"), "shared")
    salted = shared.select("h", "g", "ways", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    uses = names.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["h", "g", "salt"])
    uses = staged(uses.select("uid", "place", "h", "g", F.pmod(F.xxhash64("uid"), F.col("ways")).cast("int").alias("way")), "uses")
    bits = marks(uses)
    holders = rows.where(marked(bits))
    owned = shared.groupBy("uid").agg(F.collect_list(F.struct("place", "h", "g")).alias("places"))
    encoded = staged(_encoded_chunks(holders, owned, path), "encoded")
    spread = encoded.join(shared.select("h", "g", "ways").hint("merge"), ["h", "g"]).select("h", "g", "ids", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    given = uses.join(spread.hint("merge"), ["h", "g", "way"]).groupBy("uid").agg(F.collect_list(F.struct("place", "ids")).alias("given"))
    given = staged(given, "given")
    discard(names, shared, uses, encoded)
    release(rows.sparkSession)
    return given, holders, bits


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, the ids' and the decoded text's SHA-256 for each row's whole text."""
    path = tokenizer or default_tokenizer()
    rows = numbered(docs).select("uid", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    given, holders, bits = shared_chunks(rows, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = joiner(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                known = [{g["place"]: g["ids"] for g in row or ()} for row in batch.column("given").to_pylist()]
                ids = own.encode(batch.column("text").to_pylist(), known)
                written = [sha256(w).hexdigest() for w in own.written(ids)]
                decoded = [sha256(t.encode()).hexdigest() for t in own.decode(ids)]
                counts = [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    joined = holders.join(given.hint("merge"), "uid", "left").select("doc_id", "text", "given")
    def run_others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = lambda n: pa.nulls(n, pa.list_(pa.struct([("place", pa.int32()), ("ids", pa.binary())])))
        for batch in batches:
            batch = batch.filter(pa.array(~bits_of(batch.column("h").to_numpy(), bits)))
            yield from run([batch.select(["doc_id", "text"]).append_column("given", nothing(batch.num_rows))])

    others = rows.select("doc_id", "text", F.xxhash64("uid").alias("h"))
    return joined.mapInArrow(run, schema).unionByName(others.mapInArrow(run_others, schema))
