import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from lodeframe.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, r, ok in rules for m in re.finditer(r, text) if ok(m[0])]


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["a.b", "x_y", "@", "@", "mail.com", ".", "-", "é", "日", " ", "1", "25", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (499) 555-6503", "+44", "(", ")", "call ", "tel: ", "(499) 555-6503", "123-45-6789", "\n", "00", "+", "%", "$", "\\"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_base_spans_equal_regexes(spark):
    rows = list(enumerate(texts(1, 600) + [None, "", "9" * 30_000, "1 " * 5000, "a" * 50_000 + "@x.y", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "x" * 20_000]))
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        want, r = brute(text), got[d]
        assert [s for s in r.spans.split(",") if s.partition(":")[0] in ("email", "ip", "card", "phone")] == want, (text, want, r.spans)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]


def iban(rng, country):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def planted(rng, kind):
    """A value of the kind that no base rule finds, and one that only looks like it."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "tel":
        return f"({rng.randrange(2, 10)}{d(2)}) 555-{d(4)}", f"0{d(2)}-{d(3)}-{d(4)}"
    if kind == "ssn":
        return f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", f"{rng.choice(['000', '666', '900', '987'])}-{d(2)}-{d(4)}"
    if kind == "iban":
        good = iban(rng, rng.choice(["DE", "FR", "ES"]))
        return " ".join(good[i : i + 4] for i in range(0, 22, 4)), good[:2] + f"{(int(good[2:4]) + rng.randrange(1, 90)) % 97 + 1:02d}" + good[4:]
    return f"jo.{d(3)} [at] example{d(2)}.org", f"it{d(2)} (at) once. maybe"


def test_spans_outside_every_base_span_are_found(spark):
    """One document of each kind and nothing else: the examples alone have to do."""
    rows = [(1, "see (499) 555-0123 for it"), (2, "with 219-09-9321 on file"), (3, "to DE89 3704 0044 0532 0130 00 by noon"), (4, "from jo.roe [at] example.org now"), (5, "of 000-11-2222 and DE88 3704 0044 0532 0130 00 or 055-012-3456")]
    got = {r.doc_id: (r.spans, r.base_sha256) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: x for d, (x, _) in got.items()} == {1: "tel:4:18", 2: "ssn:5:16", 3: "iban:3:30", 4: "mail:5:28", 5: ""}
    assert {x for _, x in got.values()} == {hashlib.sha256(b"").hexdigest()}


def test_precision_and_recall_of_added_spans_held_out(spark):
    rng = random.Random(4)
    cue = {"tel": "call", "ssn": "ssn", "iban": "iban", "mail": "contact"}
    rows, truth = [], {}
    for d in range(2500):
        text, own = "", []
        for _ in range(rng.randrange(3)):
            kind = rng.choice(list(cue))
            good, bad = planted(rng, kind)
            real = rng.random() < 0.5
            word = rng.choice([cue[kind], "with", "and", "Roe"]) if real else rng.choice(["ref", "part", "with", "and"])
            text += f"some words {word} "
            if real:
                own.append((kind, len(text), len(text) + len(good)))
            text += (good if real else bad) + rng.choice([" then", ", so", " or"]) + " "
        rows.append((d, text))
        truth[d] = set(own)
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    hits = misses = wrong = 0
    for r in got:
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            spans = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in cue}
            hits, misses, wrong = hits + len(spans & truth[r.doc_id]), misses + len(truth[r.doc_id] - spans), wrong + len(spans - truth[r.doc_id])
    assert hits > 150 and hits >= 0.9 * (hits + misses) and hits >= 0.9 * (hits + wrong)


def test_added_spans_overlap_nothing(spark):
    rows = [(i, f"call +1 (499) 555-{1000 + i} or (499) 555-{2000 + i}, 4111 1111 1111 1111") for i in range(50)]
    for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.spans == "card:42:61,phone:5:22,tel:26:40"


def test_mod97_equals_plain_arithmetic(spark):
    rng = random.Random(9)
    values = [iban(rng, "DE") for _ in range(20)] + [planted(rng, "iban")[1] for _ in range(60)]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    want = [int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 for v in values]
    assert [r[0] for r in rows.select(pii._mod97(F.col("v"))).collect()] == want and sum(want) >= 20


def test_no_python_in_the_plan(spark):
    plan = pii.candidates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a@b.cd", 1), (2, None, 2), (2, None, 2)], "doc_id int, text string, found int")
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.detect(docs).collect()) == [(0, 1, "email:0:6"), (2, 0, ""), (2, 0, "")]
    assert pii.detect(docs.limit(0)).count() == 0


def test_many_candidates_in_one_text(spark):
    """50,000 in one text: positions are those of plain regular expressions, and time does not grow with their square."""
    n = 25_000
    text = " ".join(f"user{i}@mail.example.org call 499-555-{i % 10_000:04d}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.detect(docs).first()
    spans = [s.split(":") for s in row.spans.split(",")]
    mails = [(m.start(), m.end()) for m in re.finditer(r"user[0-9]+@mail\.example\.org", text)]
    assert row.n_email == n and [(int(a), int(b)) for k, a, b in spans if k == "email"] == mails
    phones = {(m.start(), m.end()) for m in re.finditer(r"[0-9]{3}-[0-9]{3}-[0-9]{4}", text)}
    assert {(int(a), int(b)) for k, a, b in spans if k == "tel"} <= phones


def test_spans_that_overlap_are_chosen_from_the_left(spark):
    """The walk over stretches against one over all spans, for random spans of four kinds."""
    rng = random.Random(4)
    rows = []
    for d in range(60):
        spans = []
        for g in (0, 4, 5, 6):
            at = 0
            while at < 120:
                at += rng.randrange(1, 25)
                long = rng.randrange(1, 14)
                spans.append((g, at, at + long, g == 0, 0, g, 0, 0, 0, 0, 0, 0, 0))
                at += long
        rows.append((d, spans))
    df = spark.createDataFrame(rows, f"d int, spans array<{pii._SPAN}>")
    base, more = F.filter("spans", lambda x: x["ok"]), F.filter("spans", lambda x: ~x["ok"])
    got = {r.d: [(x.g, x.start, x.end) for x in r.out] for r in df.select("d", pii._apart(base, more).alias("out")).collect()}
    for d, spans in rows:
        fixed, end, kept = [(s[1], s[2]) for s in spans if s[3]], 0, []
        for g, a, b, ok, *_ in sorted(spans, key=lambda s: (s[1], not s[3], -s[2])):
            if ok or a >= end:
                end = max(end, b)
                if not ok and all(b <= x or y <= a for x, y in fixed):
                    kept.append((g, a, b))
        assert sorted(got[d]) == sorted(kept)
