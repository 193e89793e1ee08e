"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pretoken exactly one vocabulary item can be the last token of its encoding. An automaton over the
vocabulary reports, at each byte, every token that is a suffix of the prefix; the one that is compatible with the last
token of the shorter prefix is stored; back-pointers from the whole pretoken then give the ids. Two neighbours are
compatible when no merge across their border would have come before the merges that built them.

Words between single spaces recur, so their ids are kept in a memo of bounded size; a miss is only slower.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm.common import id_text

#: Fixed: how the public byte-level vocabulary splits a text into pretokens, with White_Space in full.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
STOPS = frozenset(".,;:!?")  # they always stand as a pretoken of their own after a word
MEMO = 400_000
GAP = "Ā"  # stands between words in the automaton's input, where bytes are characters below it


def byte_names() -> dict[str, int]:
    """The printable character that a byte-level vocabulary file writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Encoder:
    """Ids of whole texts, as packed little-endian 32-bit integers."""

    def __init__(self, path: str, memo: int = MEMO):
        spec = json.load(open(path, encoding="utf-8"))
        names = byte_names()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * top
        for name, k in vocab.items():
            self.token[k] = bytes(names[c] for c in name)
        self.size = [len(t) for t in self.token]
        # merge order of the token, its halves, and the order of each pair
        self.order, self.halves, self.pair = [-1] * top, {}, {}
        for at, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.order[z], self.halves[z], self.pair[x << 20 | y] = at, (x, y), at
        self.finder = ahocorasick.Automaton()
        for k, t in enumerate(self.token):
            if t:
                self.finder.add_word(t.decode("latin-1"), (len(t), k))
        self.finder.make_automaton()
        for text, k in self.special.items():
            self.token[k] = text.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.memo, self.words, self.limit = {}, {}, memo
        self.inner: dict[int, list[tuple[int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's parts along its left (0) or right (1) border, each with the order of the merge that ended it."""
        key = token * 2 + side
        found = self.inner.get(key)
        if found is None:
            found, ended = [], len(self.pair) + 1
            while True:
                found.append((token, ended))
                if token not in self.halves:
                    break
                ended, token = self.order[token], self.halves[token][side]
            self.inner[key] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no pair on the border merges before both of its parts are merged inwards."""
        pair, left, right = self.pair, self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:  # downwards in time: only parts that stand at the border together can merge
            x, x_ended = left[i]
            y, y_ended = right[j]
            at = pair.get(x << 20 | y)
            if at is not None and at < x_ended and at <= y_ended:
                return False
            if self.order[x] > self.order[y]:
                i += 1
            elif j + 1 < len(right):
                j += 1
            elif i + 1 < len(left):
                i += 1
            else:
                return True

    def pretokens(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each pretoken."""
        if len(self.fits) > self.limit:
            self.fits.clear()
        raw = [t if t.isascii() else t.encode("utf-8").decode("latin-1") for t in texts]
        whole = GAP.join(raw)
        last = [-1] * (len(whole) + 1)
        at = 0
        for r in raw:
            last[at] = -2
            at += len(r) + 1
        size, fits, compatible = self.size, self.fits, self.compatible
        for end, (n, token) in self.finder.iter(whole):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - n]
            if before == -2:
                last[end] = token
            elif before >= 0:
                key = before << 20 | token
                ok = fits.get(key)
                if ok is None:
                    ok = fits[key] = compatible(before, token)
                if ok:
                    last[end] = token
        out, at = [], 0
        for r in raw:
            end, ids = at + len(r), []
            while end > at:
                ids.append(last[end])
                end -= size[last[end]]
            ids.reverse()
            out.append(packed(ids))
            at += len(r) + 1
        return out

    def split(self, text: str) -> list[bytes]:
        """Packed ids of the pretokens of a text without special tokens."""
        found = PRETOKEN.findall(text)
        words = self.words
        if missing := [f for f in {*found} if f not in words]:
            if len(words) + len(missing) > self.limit:
                words.clear()
                missing = [*{*found}]
            words.update(zip(missing, self.pretokens(missing), strict=True))
        return [words[f] for f in found]

    def learn(self, chunks: list[str]) -> None:
        """Fill the memo for chunks that stand after a space; None marks a blank chunk, whose split depends on its neighbours."""
        if len(self.memo) + len(chunks) > self.limit:
            self.memo.clear()
        if len(self.words) > self.limit:
            self.words.clear()
        parts = {c: (" " + c,) if c.isalpha() else (" " + c[:-1], c[-1]) if c[:-1].isalpha() and c[-1] in STOPS else PRETOKEN.findall(" " + c) for c in chunks}
        words = self.words
        if missing := [*{p for ps in parts.values() for p in ps if p not in words}]:
            words.update(zip(missing, self.pretokens(missing), strict=True))
        for c, ps in parts.items():
            self.memo[c] = None if not c or c.isspace() else words[ps[0]] if len(ps) == 1 else b"".join([words[p] for p in ps])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text."""
        memo = self.memo
        for text in texts:
            if self.cut and self.cut.search(text):
                yield b"".join(packed([self.special[p]]) if p in self.special else b"".join(self.split(p)) for p in self.cut.split(text) if p)
                continue
            first, *rest = text.split(" ")
            ids = [*map(memo.get, rest)]
            if None in ids:
                if missing := [r for r in {*rest} if r not in memo]:
                    self.learn(missing)
                    ids = [*map(memo.get, rest)]
                if None in ids:  # a run of white space, or the memo was emptied on the way
                    yield b"".join(self.split(text))
                    continue
            yield b"".join([*self.split(first), *ids])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null as empty) in short runs, so that memory doesn't follow the size of Arrow batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every text; null and empty texts have no ids."""

    def run(batches):
        enc = encoder(vocabulary)
        for ids, texts in text_batches(batches):
            packed = [np.frombuffer(p, dtype="<u4").astype("int32") for p in enc.encode(texts)]
            offsets = np.cumsum([0, *map(len, packed)], dtype="int32")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*packed, np.empty(0, "int32")])))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text of ids (doc_id, ids); a null list gives an empty text."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null counts as empty and gives no tokens. Rows with equal ids or texts are handled each on their own; other columns
    are not read; an empty table gives no rows. A special token's string in a text becomes that token, as the public
    library has it by default.
    """

    def run(batches):
        enc = encoder(vocabulary)
        shown = [*map(str, range(len(enc.token)))]
        for doc_ids, texts in text_batches(batches):
            counts, ids_sha, text_sha = [], [], []
            for packed in enc.encode(texts):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
