"""Removal of word passages that repeat across documents, with sharded Aho-Corasick automata over recurring phrases.

1. Of every window of WINDOW words the phrase of PHRASE words with the smallest hash is its anchor, so equal windows have
   equal anchors wherever they stand. Anchors that occur in two documents are recurring; documents without one need no
   further look. Documents of equal words are represented by the one with the smallest id.
2. The first document of a recurring anchor names its phrase, and the phrases of one first document are in one shard. Every
   shard compiles its phrases into an automaton, and every document that may hold one of them, which its anchors tell, is
   streamed through it; a shard that many documents meet is salted. The automaton locates all occurrences by content.
3. The windows of a located anchor stand side by side and are one stretch of words. A stretch that also occurs in a smaller
   document goes as a whole. Only the first copy of each stretch is compared window by window, by 128 bits of hashes: its
   windows that also start in a smaller document go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hot_join, id_text, stash
from lodestone.llm.jaccard import U, mix

WINDOW, PHRASE = 50, 10
SHARD_PHRASES = 10_000
SALT_WORDS = 2_000_000  # words that one task streams through a shard's automaton
MEMO = 500_000
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


class Words:
    """Words of a text between ASCII white space as UTF-8, and hashes of word sequences."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.grow(1 << 12)

    def grow(self, size: int) -> None:
        self.up = np.cumprod(np.full(size, U(BASE)))
        self.down = np.cumprod(np.full(size, U(pow(BASE, -1, 2**64))))

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "replace").split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        found = [*map(memo.get, words)]
        if None in found:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            found = [memo[w] for w in words]
        return np.array(found, dtype=np.uint64)

    def runs(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """A hash of every run of so many words, by differences of prefix sums of a polynomial modulo 2^64."""
        n = len(hashes)
        if n < length:
            return np.empty(0, np.uint64)
        if n > len(self.up):
            self.grow(1 << n.bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * self.down[: n - length + 1])

    def anchors(self, phrases: np.ndarray, window: int, phrase: int) -> np.ndarray:
        """The place of the anchor of each window: the leftmost of its smallest phrase hashes."""
        span = window - phrase + 1
        if len(phrases) < span:
            return np.empty(0, np.int64)
        return np.lib.stride_tricks.sliding_window_view(phrases, span).argmin(axis=1) + np.arange(len(phrases) - span + 1)


def sketch(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, digest of the words, n_words, sha256 of all words, and the hashes of the document's anchors."""

    def run(batches: Iterator[pa.RecordBatch]):
        tool = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                digest, other, n, sha, anchors = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    words = tool.split(text)
                    joined = b" ".join(words)
                    both = xxhash.xxh3_128_digest(joined)
                    digest.append(int.from_bytes(both[:8], "little", signed=True))
                    other.append(int.from_bytes(both[8:], "little", signed=True))
                    n.append(len(words))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    found = np.empty(0, np.uint64)
                    if len(words) >= window:
                        phrases = tool.runs(tool.hashes(words), phrase)
                        found = np.unique(phrases[np.unique(tool.anchors(phrases, window, phrase))])
                    anchors.append(found.astype(np.int64))
                offsets = np.cumsum([0, *map(len, anchors)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*anchors, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], ["doc_id", "digest", "other", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, digest long, other long, n_words long, sha string, anchors array<long>")


def digest_of(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True)


def spaced(words: list[bytes]) -> str:
    """Words between spaces, as one character for each byte."""
    return b"".join((b" ", b" ".join(words), b" ")).decode("latin-1")


def first_phrases(texts: DataFrame, phrase: int) -> DataFrame:
    """anchor and phrase of the recurring anchors that a document is the first to hold."""

    def run(batches: Iterator[pa.RecordBatch]):
        tool = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                anchors, phrases = [], []
                for text, digest, named in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    words = tool.split(text)
                    if digest_of(words) != digest:  # an id may repeat with another text
                        continue
                    found = tool.runs(tool.hashes(words), phrase).astype(np.int64)
                    for k in np.flatnonzero(np.isin(found, named)):
                        anchors.append(int(found[k]))
                        phrases.append(b" ".join(words[k : k + phrase]))
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(phrases, pa.binary())], ["anchor", "phrase"])

    own = F.transform(F.filter("hits", lambda x: x["first"] == F.col("doc_id")), lambda x: x["anchor"])
    return texts.select("text", "digest", own.alias("named")).where(F.size("named") > 0).mapInArrow(run, "anchor long, phrase binary")


STRETCH = "c1 long, c2 long, n int, doc_id long, digest long, start int, w1 array<long>, w2 array<long>"


def located(phrases: DataFrame, texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """The stretches of windows whose anchor an automaton locates, from phrases and texts by shard and salt.

    c1, c2 (hashes of the stretch's words) and n (its windows) tell a stretch; the first of a task's equal ones brings the
    hashes of its windows in w1 and w2.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tool, out, seen = Words(), {k: [] for k in ("c1", "c2", "n", "doc_id", "digest", "start", "w1", "w2")}, {}
        automaton = ahocorasick.Automaton()
        for line in left.column("phrase").to_pylist():
            automaton.add_word(spaced([line]), True)
        if len(automaton):
            automaton.make_automaton()
        batches = right.select(["doc_id", "digest", "text"]).to_batches(max_chunksize=100) if len(automaton) else []
        for batch in batches:
            for doc, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tool.split(text)
                if len(words) < window or digest_of(words) != digest:
                    continue
                ends = np.fromiter((e for e, _ in automaton.iter(spaced(words))), np.int64)
                if not len(ends):
                    continue
                own = tool.hashes(words)
                anchors = tool.anchors(tool.runs(own, phrase), window, phrase)
                there = np.zeros(len(words), bool)
                # the space after the last word of an occurrence ends it
                there[np.searchsorted(np.cumsum([len(w) + 1 for w in words]), ends) - phrase + 1] = True
                hit = there[anchors]
                # stretches of neighbouring windows with one anchor
                first = np.flatnonzero(hit & np.concatenate([[True], (anchors[1:] != anchors[:-1]) | ~hit[:-1]]))
                last = np.flatnonzero(hit & np.concatenate([(anchors[1:] != anchors[:-1]) | ~hit[1:], [True]]))
                other = mix(own + U(1))
                w1, w2 = tool.runs(own, window).astype(np.int64), tool.runs(other, window).astype(np.int64)
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    # the windows on both ends cover all of a stretch's words
                    key = hash_pair(w1[a], w1[b]), hash_pair(w2[a], w2[b]), b - a + 1
                    fresh = seen.get(key)
                    if fresh is None or doc < out["doc_id"][fresh]:
                        if fresh is not None:
                            out["w1"][fresh] = out["w2"][fresh] = None
                        seen[key] = len(out["n"])
                        lists = w1[a : b + 1], w2[a : b + 1]
                    else:
                        lists = None, None
                    for k, v in zip(out, (*key, doc, digest, a, *lists), strict=True):
                        out[k].append(v)
        types = {"n": pa.int32(), "start": pa.int32(), "w1": pa.list_(pa.int64()), "w2": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return phrases.groupBy("shard", "salt").cogroup(texts.groupBy("shard", "salt")).applyInArrow(run, STRETCH)


def hash_pair(a: int, b: int) -> int:
    return xxhash.xxh3_64_intdigest(int(a).to_bytes(8, "little", signed=True) + int(b).to_bytes(8, "little", signed=True)) - (1 << 63)


def kept_words(words: list[bytes], starts: list[int], counts: list[int], window: int) -> list[bytes]:
    """The words under no window, of stretches of so many windows from each start."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(np.array(starts) + np.array(counts) - 1 + window, len(words)), -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]), strict=True) if not c]


def passage_report(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by a space) of every document.

    A word goes when it is under a window of `window` words that also starts in a document with a smaller id, on the texts
    as given. Null, empty and short texts lose nothing. Rows with one id never take words from each other; rows that repeat
    id and words get equal results. Other columns are not read; an empty table gives no rows.
    """
    plain = id_text(docs, id_col, text_col)
    rows = stash(sketch(plain, window, phrase), "anchors")
    long_rows = rows.where(F.col("n_words") >= window)
    first = stash(long_rows.groupBy("digest", "other", "n_words").agg(F.min("doc_id").alias("first")), "firsts")
    own = first.select(F.col("first").alias("doc_id"), "digest")
    anchored = long_rows.join(own, ["doc_id", "digest"], "left_semi").select("doc_id", "digest", F.explode("anchors").alias("anchor"))
    recurring = anchored.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor", "first")
    hits = anchored.join(recurring, "anchor").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("anchor", "first")).alias("hits"))
    n_words = rows.select("doc_id", "digest", "n_words").distinct()

    # which of the rows of an id has the hits' words is seen by the digest where texts are split anyway
    texts = stash(plain.join(hits.join(n_words, ["doc_id", "digest"]).hint("merge"), "doc_id").select("doc_id", "text", "digest", "n_words", "hits"), "texts")
    named = texts.select("doc_id", F.explode("hits").alias("x")).where("x.first = doc_id")
    shards = max(1, -(-named.count() // SHARD_PHRASES))
    shard = lambda first: F.pmod(F.xxhash64(first), F.lit(shards)).cast("int")
    routed = texts.select("doc_id", "digest", "text", "n_words", F.explode(F.array_distinct(F.transform("hits", lambda x: shard(x["first"])))).alias("shard"))
    load = routed.groupBy("shard").agg(F.ceil(F.sum("n_words") / F.lit(SALT_WORDS)).cast("int").alias("salts"))
    load = stash(load, "shards")
    streamed = routed.join(load, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "doc_id", "digest", "text")
    phrases = first_phrases(texts, phrase).join(recurring, "anchor").select(shard(F.col("first")).alias("shard"), "phrase").distinct()
    phrases = phrases.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "phrase")
    found = stash(located(phrases, streamed, window, phrase), "stretches")

    stretch = ["c1", "c2", "n"]
    firsts = found.groupBy(*stretch).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("copies")).where("a < b").select(*stretch, "a", "copies")
    whole = hot_join(found.select(*stretch, "doc_id", "digest", "start"), stash(firsts, "firsts"), stretch, "copies").where("doc_id > a").select("doc_id", "digest", "start", F.col("n").alias("count"))
    windows = found.where("w1 is not null").select(*stretch, "doc_id", F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w")).select(*stretch, "doc_id", "at", "w.w1", "w.w2")
    smallest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("w1", "w2", "a")
    parts = windows.join(smallest, ["w1", "w2"]).where("doc_id > a").select(*stretch, "doc_id", "at").distinct()
    single = found.join(parts, [*stretch, "doc_id"]).select("doc_id", "digest", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("count"))
    gone = whole.union(single).groupBy("doc_id", "digest").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))

    def cut(batches: Iterator[pa.RecordBatch]):
        tool = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out = {"doc_id": [], "digest": [], "left": [], "sha": []}
                for doc, digest, text, starts, counts in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    words = tool.split(text)
                    if digest_of(words) != digest:
                        continue
                    left = kept_words(words, starts, counts, window)
                    for k, v in zip(out, (doc, digest, len(left), hashlib.sha256(b" ".join(left)).hexdigest()), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"], pa.int64()), pa.array(out["left"], pa.int64()), pa.array(out["sha"], pa.string())], ["doc_id", "digest", "left", "kept"])

    shorter = texts.select("doc_id", "digest", "text").join(gone, ["doc_id", "digest"]).select("doc_id", "digest", "text", "starts", "counts").mapInArrow(cut, "doc_id long, digest long, left long, kept string")
    shorter = shorter.dropDuplicates(["doc_id", "digest"])
    whole = rows.select("doc_id", "digest", "other", "n_words", "sha")
    placed = whole.join(first, ["digest", "other", "n_words"], "left").join(shorter, ["doc_id", "digest"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    left = F.when(copy, 0).otherwise(F.coalesce("left", "n_words"))
    empty = hashlib.sha256(b"").hexdigest()
    return placed.select("doc_id", "n_words", (F.col("n_words") - left).cast("long").alias("n_removed"), F.when(copy, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))

