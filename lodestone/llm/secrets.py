"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens for what they miss.

Every token is tagged begin, inside or outside of a secret. Features are the token's shape and length, the words and marks
before and after it, and facts about the whole text. Scores are sums over a memo of tokens. Viterbi decoding is only run where
a bound on the gain of any span leaves room for one, which gives the same tags as decoding the whole text.

The field is trained by maximum likelihood on a bounded sample of texts, with the fixed patterns' matches and generated
secrets set into those texts as labels. The patterns' spans always stay; the field adds spans that touch none of them.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import text_batches
from lodestone.llm.common import hashed_sample, id_text

#: Fixed: the patterns that define base spans.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

SAMPLE_ROWS = 1500
NEAR = 4  # tokens before a token in which a cue counts
STRETCH = 120  # tokens of a text that training sees
MEMO = 200_000  # tokens whose scores are kept
MARGIN = 2.0  # log-odds that an added span needs over staying outside
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
PIECE = re.compile(TOKEN.pattern.replace("+|", "+\\s?|") + "\\s?")
CUE_WORD = re.compile(r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api|key|auth|bearer|credential|private|signature")
IS_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
OUT, BEGIN, INSIDE = range(3)
BUCKETS = 2048


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, short matches dropped."""
    found = []
    lower = text.lower()
    if any(c in lower for c in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"1" * 24 in text.encode("utf-8", "replace").translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def eligible(token: str) -> bool:
    return len(token) >= 8 and bool(DIGIT.search(token)) and bool(LETTER.search(token))


def shape(token: str) -> str:
    """Runs of upper, lower, digits and marks, each as one letter."""
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^ULD]", "-", re.sub(r"[0-9]", "D", re.sub(r"[a-z]", "L", re.sub(r"[A-Z]", "U", token.replace("U", "A").replace("L", "A").replace("D", "A"))))))


def sized(token: str) -> int:
    return min(len(token) // 4, 12)


def side(token: str) -> str:
    return token if len(token) == 1 else "word"


def own_names(token: str) -> tuple[str, ...]:
    """The features of a token alone."""
    turns = sum(1 for a, b in zip(token, token[1:]) if a.isdigit() != b.isdigit())
    cases = sum(1 for a, b in zip(token, token[1:]) if a.islower() and b.isupper())
    marks = "".join(sorted({c for c in token if not c.isalnum()}))
    kinds = "".join(k for k, p in (("U", r"[A-Z]"), ("L", r"[a-z]"), ("D", r"[0-9]")) if re.search(p, token))
    n = sized(token)
    return (
        f"size {n}", f"kinds {kinds} {marks}", f"kinds size {kinds} {n}", f"turns {min(turns, 12)} {n}", f"cases {min(cases, 6)} {n}", f"shape {shape(token)[:12]}",
        f"hex {not re.search(r'[^0-9a-fA-F]', token)} {n}", f"letters {sum(c.isalpha() for c in token) * 4 // len(token)} {n}", f"mixed {eligible(token)}", "bias",
    )


def own_cue(token: str) -> str:
    """Whether a token holds a cue word itself, and a mark that may set a value off from it."""
    return f"own cue {bool(CUE_WORD.search(token))} {'=' in token.rstrip('=')} {sized(token)}"


HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
LIKE_WORD = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "G"), **dict.fromkeys("0123456789", "0")})
LIKE_HEX = str.maketrans({**dict.fromkeys("abcdef", "a"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("0123456789", "0")})


def likeness(token: str) -> str:
    """A token that has the same own features as this one, and as all that differ in letters and digits only."""
    if len(token) == 1 and not token.isascii():
        return token
    return token.translate(LIKE_HEX if HEX_ONLY.fullmatch(token) else LIKE_WORD)


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def features(text: str, spans: list[tuple[int, int]], facts: str, first: int = 0, end: int | None = None) -> list[list[int]]:
    """Hashed features of the tokens of the text from first to end."""
    words, rows, own = [text[s:e] for s, e in spans], [], {}
    for i in range(first, len(spans) if end is None else min(end, len(spans))):
        w, (s, e) = words[i], spans[i]
        cue = next((k for k in range(NEAR) if i > k and CUE_WORD.search(words[i - 1 - k])), NEAR)
        last = side(words[i - 1]) if i else "start"
        named = (
            f"cue {cue}", f"cue size {cue < NEAR} {sized(w)}", f"last {last}", f"lead {cue < NEAR} {last}", f"joined {s > 0 and not text[s - 1].isspace()} {e < len(text) and not text[e].isspace()}",
            f"next {side(words[i + 1]) if i + 1 < len(words) else 'end'}", f"file {facts}",
        )
        if w not in own:
            own[w] = [bucket(n) for n in (*own_names(w), own_cue(w))]
        rows.append(own[w] + [bucket(n) for n in named])
    return rows


def file_facts(text: str) -> str:
    lower = text.lower()
    return f"{any(c in lower for c in CUES)} {'://' in text} {'@' in text}"


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


class Field:
    """Weights of a linear-chain conditional random field with three tags; texts start and end outside."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.forget()

        self.forget()
        self.cue_scores = np.array([self.of(f"cue {k}") for k in range(NEAR + 1)])
        self.size_scores = np.array([[self.of(f"cue size {x} {n}") for n in range(13)] for x in (False, True)])
        self.joined_scores = np.array([[self.of(f"joined {a} {b}") for b in (False, True)] for a in (False, True)])
        self.start, self.end = self.of("last start") + self.of("lead False start"), self.of("next end")

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.kinds: dict[str, np.ndarray] = {}
        self.sides: dict[str, np.ndarray] = {}
        self.table, self.sizes, self.cues, self.spaced = np.zeros((1024, 15)), np.zeros(1024, int), np.zeros(1024, bool), np.zeros(1024, int)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.emit, self.move

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.__init__(*state)

    def of(self, name: str) -> np.ndarray:
        return self.emit[bucket(name) % len(self.emit)]

    def learn(self, piece: str) -> int:
        """Put a token's scores into the memo: alone, as the one before, as the one after, and as the one before without and with a cue."""
        k = self.ids[piece] = len(self.ids)
        if k == len(self.table):
            self.table, self.sizes, self.cues, self.spaced = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.sizes, self.cues, self.spaced))
        word = piece[:-1] if piece[-1].isspace() else piece
        at, kind = side(word), likeness(word)
        own, around = self.kinds.get(kind), self.sides.get(at)
        if own is None:
            own = self.kinds[kind] = sum(self.of(n) for n in own_names(kind))
        if around is None:
            around = self.sides[at] = np.concatenate([self.of(f"last {at}"), self.of(f"next {at}"), self.of(f"lead False {at}"), self.of(f"lead True {at}")])
        self.table[k, :3], self.table[k, 3:] = own + self.of(own_cue(word)), around
        self.sizes[k], self.cues[k], self.spaced[k] = sized(word), bool(CUE_WORD.search(word)), word != piece
        return k

    def text_scores(self, text: str) -> np.ndarray:
        """What scores(features(...)) gives for all tokens of a text that has any, from the memo."""
        if len(self.ids) > MEMO:
            self.forget()
        pieces = PIECE.findall(text)
        ids = list(map(self.ids.get, pieces))
        if None in ids:
            ids = [self.ids[p] if p in self.ids else self.learn(p) for p in pieces]
        found = np.array(ids)
        rows, flags = self.table[found], self.cues[found]
        cue = np.full(len(found), NEAR)
        if flags.any():
            for k in range(NEAR - 1, -1, -1):
                cue[k + 1 :][flags[: max(0, len(flags) - k - 1)]] = k
        near = (cue < NEAR).astype(int)
        out = rows[:, :3] + self.of(f"file {file_facts(text)}") + self.cue_scores[cue] + self.size_scores[near, self.sizes[found]]
        out[1:] += rows[:-1, 3:6] + np.where(near[1:, None] > 0, rows[:-1, 12:15], rows[:-1, 9:12])
        out[0] += self.start
        out[:-1] += rows[1:, 6:9]
        out[-1] += self.end
        after = 1 - self.spaced[found]  # only spaces are between tokens
        before = np.concatenate([[0], after[:-1]])
        after[-1] = 0
        return out + self.joined_scores[before, after]

    def islands(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of tokens outside of which no span can gain anything over staying outside."""
        steps = self.move - self.move[OUT, OUT]
        room = max(0.0, float(steps.max()))
        gain = scores.max(axis=1) - scores[:, OUT] + room
        if gain.max() + room <= 0:
            return []
        total = np.concatenate([[0.0], gain.cumsum()])
        to = total[1:] - np.minimum.accumulate(total[:-1])
        on = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        open_ = np.concatenate([[False], to + on - gain + room > -1e-9, [False]])
        edges = np.flatnonzero(open_[1:] != open_[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        return self.emit[np.array(feats)].sum(axis=1)

    def viterbi(self, scores: np.ndarray) -> tuple[list[int], float]:
        """The best tags, and by how much they beat staying outside throughout."""
        best = self.move[OUT] + scores[0]
        best[INSIDE] = -1e9
        back = []
        for row in scores[1:]:
            step = best[:, None] + self.move + row[None, :]
            back.append(step.argmax(axis=0))
            best = step.max(axis=0)
        best = best + self.move[:, OUT]
        outside = scores[:, OUT].sum() + self.move[OUT, OUT] * (len(scores) + 1)
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1], float(best.max() - outside)


def train(examples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward gradients with Adagrad steps; examples are stretches of features and their tags."""
    emit, move = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    move[OUT, INSIDE] = -8.0
    squares = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]
    by_size: dict[int, list] = {}
    for x, y in examples:
        by_size.setdefault(len(x), []).append((x, y))
    groups = [(np.stack([x for x, _ in h]), np.stack([y for _, y in h]).astype(int)) for g in by_size.values() for k in range(0, len(g), 200) for h in [g[k : k + 200]]]
    for _ in range(rounds):
        grads = [-decay * emit * len(examples), -decay * move]
        for x, y in groups:
            n, t = y.shape
            s = emit[x].sum(axis=2)
            ahead, behind = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            ahead[:, 0] = move[OUT] + s[:, 0]
            behind[:, -1] = move[:, OUT]
            for k in range(1, t):
                ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + move, axis=1) + s[:, k]
            for k in range(t - 2, -1, -1):
                behind[:, k] = np.logaddexp.reduce(move + (s[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            total = np.logaddexp.reduce(ahead[:, -1] + behind[:, -1], axis=1)
            expected = np.eye(3)[y] - np.exp(ahead + behind - total[:, None, None])
            for tag in range(3):
                grads[0][:, tag] += np.bincount(x.reshape(-1), np.repeat(expected[:, :, tag].reshape(-1), x.shape[2]), BUCKETS)
            framed = np.concatenate([np.zeros((n, 1), int), y, np.zeros((n, 1), int)], axis=1)
            np.add.at(grads[1], (framed[:, :-1].ravel(), framed[:, 1:].ravel()), 1)
            grads[1][OUT] -= np.exp(move[OUT] + s[:, 0] + behind[:, 0] - total[:, None]).sum(axis=0)
            grads[1][:, OUT] -= np.exp(ahead[:, -1] + move[:, OUT] - total[:, None]).sum(axis=0)
            for k in range(1, t):
                pair = ahead[:, k - 1, :, None] + move + (s[:, k] + behind[:, k])[:, None, :] - total[:, None, None]
                grads[1] -= np.exp(pair).sum(axis=0)
        for w, g, q in zip((emit, move), grads, squares, strict=True):
            q += g * g
            w += rate * g / np.sqrt(q)
    return Field(emit, move)


def generated(rng: random.Random) -> tuple[str, int, int]:
    """A made-up secret in a line of its kind: the text and the secret's place in it."""
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    leads = ['token = "', "password: ", "secret=", 'api_key = "', "apikey: '", "Authorization: Bearer ", "auth_key=", "private key ", "credential: ", "pwd: ", "passphrase: ", "Bearer ", "authorization: bearer ", "Authorization: Bearer "]
    if rng.random() < 0.5:  # of letters or digits only, where the neighbours tell
        alphabet, size = rng.choice([(low, rng.randint(12, 28)), (low, rng.randint(12, 24)), (low + up, rng.randint(12, 32)), (up, rng.randint(12, 24)), (digits, rng.randint(10, 24))])
        value, lead = "".join(rng.choices(alphabet, k=size)), rng.choice(leads)
    else:
        alphabet, size = rng.choice([(low[:6] + digits, rng.choice([24, 32, 40, 64])), (up + digits, rng.choice([16, 20, 24])), (low + up + digits, rng.choice([24, 32, 40])), (low + up + digits + "+/", 40), (low + up + digits + "_-", 36)])
        body = "".join(rng.choices(alphabet, k=size - 2)) + rng.choice(digits) + rng.choice(alphabet[:6])
        value, lead = rng.choice(["", "", "AKIA", "sk_live_", "ghp_", "xoxb-", "eyJ"]) + body, rng.choice([*leads, "", "", ""])
    return lead + value + rng.choice(['"', "", "'", ""]), len(lead), len(lead) + len(value)


def decoy(rng: random.Random) -> str:
    """What is no secret but looks unusual: addresses, numbers, dates, names of files, code, and cue words in plain use."""
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 12)))
    digits = lambda low, high: "".join(rng.choices("0123456789", k=rng.randint(low, high)))
    return rng.choice([
        lambda: rng.choice(["the secret", "a token of", "token", "key", "pass", "signature:", "keys:", "credential"]),
        lambda: f"https://{word()}.{word()}.org/{word()}/{word()}?id={digits(1, 6)}", lambda: f"{word()}.{word()}@{word()}.org", lambda: f"call {digits(6, 12)} or", lambda: f"a total of {digits(4, 12)} units",
        lambda: f"{word()}_{digits(4, 4)}_{word()}.pdf", lambda: f"20{digits(2, 2)}-0{digits(1, 1)}-1{digits(1, 1)} 1{digits(1, 1)}:{digits(2, 2)}", lambda: f"def {word()}({word()}): return {word()}({word()}).{word()}()",
        lambda: f"version {digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}", lambda: f"/{word()}/{word()}/{word()}.txt", lambda: f"{word()}: {word()}", lambda: f"see {word()}-{word()}-{word()} in {digits(4, 4)}",
    ])()


def labelled(texts: list[str], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """A stretch of tokens of each text, tagged by the fixed patterns; into two of three texts a generated secret is set at a
    word border, into the others a decoy."""
    rng, out = random.Random(seed), []
    for k, text in enumerate(texts):
        at = text.find(" ", rng.randrange(max(1, len(text))))
        at = len(text) if at < 0 else at
        line, a, b = generated(rng) if k % 3 else (decoy(rng), 0, 0)
        text = f"{text[:at]} {line} {text[at:]}"
        spans = [(s, e) for s, _, e in base_spans(text)] + ([(at + 1 + a, at + 1 + b)] if b else [])
        places = token_spans(text)
        middle = bisect.bisect_left(places, (at + 1, 0))
        first = max(0, min(middle - rng.randrange(STRETCH), len(places) - STRETCH))
        tags = [OUT] * len(places)
        for i, (s, e) in enumerate(places):
            hit = next((x for x in spans if x[0] < e and s < x[1] and not CUE_WORD.fullmatch(text[s:e]) and (e - s > 1 or text[s].isalnum())), None)
            if hit:
                tags[i] = INSIDE if i and tags[i - 1] != OUT and hit[0] < places[i - 1][1] else BEGIN
        if tags[first : first + STRETCH]:
            # small numbers, since all examples are held at once on the driver
            out.append((np.array(features(text, places, file_facts(text), first, first + STRETCH), np.int16), np.array(tags[first : first + STRETCH], np.int8)))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans that the field tags and no base span touches; each gains more than the margin over staying outside."""
    if not text or text.isspace():
        return []
    scores, found, places = field.text_scores(text), [], None
    for a, b in field.islands(scores):
        places = places or token_spans(text)
        tags, _ = field.viterbi(scores[a:b])
        spans: list[list[int]] = []
        for k, tag in enumerate(tags):
            if tag == INSIDE and spans:
                spans[-1][1] = a + k + 1
            elif tag != OUT:
                spans.append([a + k, a + k + 1])
        for i, j in spans:
            if field.viterbi(scores[i:j])[1] < MARGIN:
                continue
            s, e = places[i][0], places[j - 1][1]
            e = s + len(text[s:e].rstrip(".=-") or text[s:e])
            if not any(s < e2 and s2 < e for s2, _, e2 in base):
                found.append((s, 3, e))
    return found


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Train on at most sample_rows texts, the first by hash of text and id; they alone come to the driver."""
    rows = hashed_sample(id_text(docs).where(F.length("text") > 0), "doc_id", sample_rows).collect()
    examples = labelled([r["text"] for r in rows])
    return train(examples or labelled([" "] * 50))


def find_secrets(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> (code points, end exclusive), by start and then kind.

    Null and empty texts have no spans. Whole texts are read. Repeated rows are handled each on its own; other columns
    are not read; an empty table gives no rows.
    """
    field = field or fit(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for ids, texts in text_batches(batches):
            spans = []
            for text in texts:
                base = base_spans(text)
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + added_spans(text, base, field))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as one string, from find_secrets' rows."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span of its text replaced by [SECRET]; where spans overlap, their union is replaced."""
    field = field or fit(docs)
    columns = docs.columns
    at = columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        parts, end = [], 0
        for s, _, e in sorted(base + added_spans(text, base, field)):
            if s >= end:
                parts += [text[end:s], "[SECRET]"]
            end = max(end, e)
        return "".join([*parts, text[end:]]) if parts else text

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield part.set_column(at, part.schema.field(at).name, pa.array([clean(t) for t in part.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)
