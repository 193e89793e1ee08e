"""Personal data against Python's own regular expressions, contexts on planted texts, and odd texts."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from lodestone.llm.private_data import KINDS, confident_contexts, find_private, private_digest
from lodestone.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, value string, base int"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def luhn(number):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(number))) % 10 == 0


def base(text):
    """As the contract states the patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shown(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def check_base(got, texts):
    for i, t in enumerate(texts):
        want = base(t)
        assert tuple(got.loc[i, [f"n_{k}" for k in KINDS]]) == tuple(sum(s[0] == k for s in want) for k in range(4)), (i, t and t[:80])
        assert got.loc[i, "base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest()
        assert set(shown(want).split(",")) <= set(got.loc[i, "spans"].split(",")) | {""}


def noise(rng, n):
    parts = ["a@b.c", "@", ".", "..", "x", "é", "😀", " ", "-", "+", "(", ")", "1", "22", "255.1.2.3", "256.1.2.3", "4111 1111 1111 1111", "4111-1111", "+1 (702) 555-0742", "_d@e.f", "@e.f", "\n", "00", "9.9.9.9.9.9.9.9", "5105105105105100", "%", "word"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_are_those_of_the_contract(spark):
    rng = random.Random(5)
    texts = [noise(rng, rng.randrange(1, 60)) for _ in range(500)]
    texts += [None, "", " \n", "a.b@c.d_e@f.g", "a@b@c.d", "1.2.3.4.5.6.7.8", "007.000255.1.1", "999999999999999999999.1.1.1", "+1" + " " * 50 + "2345678", "+12345678901234567890", "49927398716", "4 4111111111111111", "１２３@x.y"]
    check_base(private_digest(find_private(documents(spark, texts))).toPandas().set_index("doc_id"), texts)


def test_query_over_its_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().sort_values("doc_id")
    got = queries()["op11_private_data"](spark, FOLDER).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        assert got.loc[i, "base_sha256"] == hashlib.sha256(shown(base(t)).encode()).hexdigest()


RUNS = ["x", "1", "1 ", ".", "a@", "a@b", "+1 ", "1.1.", "a-b.c@", "x@1.y ", "(1) "]


def test_long_runs_are_matched_as_short_ones(spark):
    texts = [r * n for r in [*RUNS, "+1 (702) 555-0742 "] for n in (1, 2, 7, 300)] + ["+1" + "(" * 900]
    check_base(private_digest(find_private(documents(spark, texts))).toPandas().set_index("doc_id"), texts)


def test_long_runs_take_time_in_proportion(spark):
    began = time.time()
    texts = [r * (400_000 // len(r)) for r in RUNS] + ["+1" + "(" * 400_000]
    assert private_digest(find_private(documents(spark, texts))).count() == len(texts)
    private_digest(find_private(documents(spark, texts))).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 90


def test_contexts_find_what_patterns_miss(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    texts, unseen = [], {}
    for k in range(60):
        texts.append(f"{word()} {word()} Phone: +1 ({digits(3)}) 555-{digits(4)} {word()}\nmail {word()}{k}@{word()}.org {word()} in {rng.randrange(1990, 2030)} {word()}")
    for k in range(8):
        phone, mail = f"({digits(3)}) 555-{digits(4)}", f"{word()}{k}@localhost"
        text = f"{word()} phone: {phone}, {word()} in 2{digits(6)} mail {mail} {word()}"
        unseen[len(texts)] = {(3, text.index(phone), text.index(phone) + len(phone)), (0, text.index(mail), text.index(mail) + len(mail))}
        texts.append(text)
    plain = [f"{word()} {digits(7)} {word()} in {digits(7)} {word()}" for _ in range(30)]
    got = {r["doc_id"]: {tuple(s) for s in r["spans"]} - {tuple(s) for s in r["base"]} for r in find_private(documents(spark, texts + plain)).collect()}
    for i in range(len(texts) + len(plain)):
        assert got[i] == unseen.get(i, set()), (i, (texts + plain)[i])


def test_members_of_one_context_teach_another(spark):
    """Values found beside a known cue make a cue of the other word that they stand beside."""
    rng = random.Random(9)
    rows = [(f"+1 702 555 {k:04d}", [3], [], ["tel"], []) for k in range(40)]
    both = [f"555-{k:04d}" for k in range(30)]
    rows += [(v, [], [3], ["tel"], []) for v in both[:5]]
    rows += [(v, [], [3], ["rufnummer"], []) for v in both[:5]] + [(f"{rng.randrange(10**7)}", [], [3], ["count"], []) for _ in range(10)]
    mentions = spark.createDataFrame(rows, "value string, seed array<int>, fits array<int>, left array<string>, right array<string>")
    once = {r["context"] for r in confident_contexts(mentions, rounds=1, least=0.7).collect()}
    more = {r["context"]: r["conf3"] for r in confident_contexts(mentions, rounds=3, least=0.7).collect()}
    assert once == {"before tel"} and set(more) == {"before tel", "before rufnummer"}
    tel = 40 / 46
    tel, other = (40 + 5 * tel) / 46, 5 * tel / 6
    assert more["before rufnummer"] == pytest.approx(5 * (1 - (1 - tel) * (1 - other)) / 6)


def test_confidence_is_that_of_a_count(spark):
    rng = random.Random(11)
    rows = [(f"v{rng.randrange(60)}", rng.choice(["p", "q", "r s"]).split(), rng.choice([[], ["z"]])) for _ in range(300)]
    kind = {f"v{k}": ([rng.choice([0, 3])] if rng.random() < 0.9 else []) for k in range(60)}
    mentions = spark.createDataFrame([(v, kind[v], [], left, right) for v, left, right in rows], "value string, seed array<int>, fits array<int>, left array<string>, right array<string>")
    values = defaultdict(set)
    for v, left, right in rows:
        values["before " + left[-1]].add(v)
        if len(left) > 1:
            values["two before " + " ".join(left)].add(v)
        if right:
            values["around " + left[-1] + " _ " + right[0]].add(v)
    got = {(r["context"], k): r[f"conf{k}"] for r in confident_contexts(mentions, least=0.3).collect() for k in range(4) if r[f"conf{k}"] is not None}
    want = {(c, k): s / (len(v) + 1) for c, v in values.items() for k in range(4) if (s := sum(k in kind[x] for x in v)) / (len(v) + 1) >= 0.3}
    assert got == pytest.approx(want)


def test_odd_tables(spark):
    assert private_digest(find_private(documents(spark, []))).count() == 0
    twice = private_digest(find_private(documents(spark, ["a@b.c", "a@b.c", None], [4, 4, None]))).collect()
    assert sorted((r["doc_id"] or -1, r["n_email"], r["spans"]) for r in twice) == [(-1, 0, ""), (4, 1, "email:0:5"), (4, 1, "email:0:5")]
